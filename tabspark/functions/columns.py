"""Column families and missing-value rules shared by every operator.

A value is *missing* when it is NULL or, for float and double columns, NaN.
Spark's aggregates skip NULL only, so public functions first turn NaN into NULL
with :func:`denan` and then rely on the NULL rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)
DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(data_type: T.DataType) -> str:
    """Physical family of a type: integral, floating, decimal, string, datetime, boolean, other."""
    if isinstance(data_type, INTEGRAL):
        return "integral"
    if isinstance(data_type, FLOATING):
        return "floating"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, DATETIME):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "other"


def is_numeric(data_type: T.DataType) -> bool:
    return family(data_type) in ("integral", "floating", "decimal")


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns in schema order (booleans are not numeric)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) == "string"]


def col(name: str) -> Column:
    """Reference a column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def denan(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float and double column (a plain projection)."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    if not floating:
        return df
    return df.select(
        *[
            F.when(~F.isnan(col(c)), col(c)).alias(c) if c in floating else col(c)
            for c in df.columns
        ]
    )


def as_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Narrow to the given numeric columns, as doubles, NaN as NULL."""
    return denan(df.select(*[col(c).cast("double").alias(c) for c in columns]))


def require_columns(df: DataFrame, columns: list[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"columns not in the table: {absent}; it has {df.columns}")
