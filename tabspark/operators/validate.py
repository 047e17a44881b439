"""Table and target checks, as a report table or as errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.columns import col, denan


class TableCheckError(ValueError):
    """A table does not meet a stated requirement."""


def validate_table(
    df: DataFrame, target: str | None = None, min_rows: int = 1, min_cols: int = 2
) -> DataFrame:
    """``(rule, ok, detail)`` for every table rule and, if a target is named, target rule.

    Row rules read at most ``min_rows`` rows, the target's rules its smallest and largest value.
    """
    names = df.columns
    folded = [c.lower() for c in names]
    duplicates = sorted({c for c in folded if folded.count(c) > 1})
    n = 0 if min_rows < 1 else len(df.select(F.lit(1)).limit(min_rows).take(min_rows))
    some = n > 0 or not df.isEmpty()
    checks = [
        ("not_empty", some, "" if some else "no rows"),
        ("min_rows", n >= min_rows, f"{n} of at least {min_rows}"),
        ("min_columns", len(names) >= min_cols, f"{len(names)} of at least {min_cols}"),
        ("unique_column_names", not duplicates, ", ".join(duplicates)),
    ]
    if target is not None:
        exists = target in names
        values = 0
        if exists:
            # Two values: the smallest is not the largest. One aggregate, no shuffle of the column.
            ends = denan(df.select(col(target))).agg(F.min(col(target)).alias("low"), F.max(col(target)).alias("high"))
            values = ends.select(F.when(F.col("low").isNull(), 0).when(F.col("low") == F.col("high"), 1).otherwise(2)
                                 ).first()[0]
        checks += [
            ("target_exists", exists, target),
            ("target_not_all_missing", values > 0, ""),
            ("target_two_values", values >= 2, "" if values > 1 else f"{values} distinct"),
        ]
    return df.sparkSession.createDataFrame(
        checks, "rule string, ok boolean, detail string"
    ).coalesce(1)


def require_valid(
    df: DataFrame, target: str | None = None, min_rows: int = 1, min_cols: int = 2
) -> DataFrame:
    """Return the table unchanged, or raise :class:`TableCheckError` for the first broken rule."""
    for row in validate_table(df, target, min_rows, min_cols).collect():
        if not row["ok"]:
            raise TableCheckError(f"{row['rule']}: {row['detail']}")
    return df


def split_overlap(train: DataFrame, test: DataFrame, key: str | list[str]) -> DataFrame:
    """Distinct keys that occur in both tables (empty = no leak between the two)."""
    keys = [key] if isinstance(key, str) else list(key)
    # Keys are made distinct before they are shuffled, so a frequent key costs one row per task.
    left, right = (df.select(*[col(k) for k in keys]).distinct() for df in (train, test))
    return left.join(right, keys, "left_semi")


def has_split_overlap(train: DataFrame, test: DataFrame, key: str | list[str]) -> bool:
    return not split_overlap(train, test, key).isEmpty()
