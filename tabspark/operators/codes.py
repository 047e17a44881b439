"""Integer codes for category values, by sorted order, without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import col
from tabspark.functions.scratch import materialise

# Distinct values that one task may sort, and that may be broadcast to every task, and the bytes of both.
CODE_BOUND = 100_000
CODE_BYTES = 16 << 20


def code_table(df: DataFrame, column: str, bound: int = CODE_BOUND) -> DataFrame:
    """``(value, code)``: codes 0, 1, … in sorted order of the non-missing values.

    Up to ``bound`` values one task numbers them. Beyond, the values are sorted in
    range partitions and saved; each partition's codes start at the number of
    values in the partitions before it.
    """
    values = materialise(
        df.select(col(column).cast("string").alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
    )
    if _within(values, bound):
        order = Window.orderBy("value")
        return values.select("value", (F.row_number().over(order) - 1).cast("bigint").alias("code"))
    return _codes_by_partition(values)


def _within(values: DataFrame, bound: int) -> bool:
    """Whether a saved table has at most ``bound`` rows and ``CODE_BYTES`` of text; two numbers come back."""
    row = values.agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("size")).first()
    return row["n"] <= bound and (row["size"] or 0) <= CODE_BYTES


def _codes_by_partition(values: DataFrame) -> DataFrame:
    # The high bits of the id are the partition, the low 33 bits the place inside it.
    ids = materialise(
        values.sort("value").select("value", F.monotonically_increasing_id().alias("id"))
    ).select(
        "value",
        F.shiftright("id", 33).alias("part"),
        F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
    )
    # One row per partition, whatever the number of values.
    sizes = ids.groupBy("part").agg((F.max("place") + 1).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return ids.join(F.broadcast(starts), "part").select(
        "value", (F.col("start") + F.col("place")).cast("bigint").alias("code")
    )


def apply_codes(
    df: DataFrame, column: str, codes: DataFrame, bound: int = CODE_BOUND, unseen: int = -1
) -> DataFrame:
    """Replace a column by its code; missing and unseen values become ``unseen``.

    A code table within the bound is broadcast; a larger one is joined by shuffle,
    where adaptive execution splits partitions of hot values.
    """
    small = _within(codes, bound)
    table = codes.select(F.col("value").alias("__value"), F.col("code").alias("__code"))
    joined = df.join(
        F.broadcast(table) if small else table,
        col(column).cast("string") == F.col("__value"),
        "left",
    )
    return joined.select(
        *[
            F.coalesce("__code", F.lit(unseen)).cast("bigint").alias(c) if c == column else col(c)
            for c in df.columns
        ]
    )
