"""Running totals along an ordered key that never sort a whole group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.scratch import materialise

# Rows that one task may sort for a running total, and ranges a key may be cut into.
SORT_BOUND = 1_000_000
MAX_RANGES = 10_000


def key_ranges(df: DataFrame, key: str, ranges: int) -> list[float]:
    """Inner boundaries that cut the key's values into ``ranges`` parts of like size (one scan)."""
    fractions = [i / ranges for i in range(1, ranges)]
    ends = df.agg(F.percentile_approx(key, fractions, F.lit(10 * ranges))).first()[0]
    return sorted(set(ends))


def ordered_by(
    rows: DataFrame, counted: DataFrame, key: str, bound: int = SORT_BOUND
) -> tuple[DataFrame, list[float]]:
    """A table with one row per key, ready for :func:`running_totals`, and its boundaries.

    ``rows`` is the table before grouping; one scan of its key estimates the number of
    distinct keys. Up to ``bound`` of them need no boundaries. Beyond, the grouped table
    is saved, so that rows are not grouped again for boundaries, totals and result.
    """
    distinct = rows.agg(F.approx_count_distinct(key, 0.02)).first()[0] * 1.1
    if distinct <= bound:
        return counted, []
    saved = materialise(counted)
    return saved, key_ranges(saved, key, min(MAX_RANGES, math.ceil(distinct / bound)))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    values: Sequence[str],
    boundaries: Sequence[float] = (),
    descending: bool = False,
) -> DataFrame:
    """Add ``<value>_upto``: the sum up to and including the row, by ``key`` within ``by``.

    The table must hold one row per (by, key), see :func:`ordered_by`. With boundaries
    the rows are sorted range by range and every range starts at the total of the ranges
    before it; a group may then be arbitrarily large.
    """
    by = list(by)
    order = F.col(key).desc() if descending else F.col(key).asc()
    if not boundaries:
        # At most SORT_BOUND distinct keys: small enough for one task per group.
        window = Window.partitionBy(*by).orderBy(order)
        return df.withColumns({f"{v}_upto": F.sum(v).over(window) for v in values})
    cutter = Bucketizer(
        splits=[-math.inf, *boundaries, math.inf],
        inputCol=key,
        outputCol="__range",
        handleInvalid="keep",
    )
    cells = [*by, "__range"]
    # One shuffle by range serves the totals, the join and the window.
    ranged = (
        cutter.transform(df)
        .withColumn("__range", F.col("__range").cast("int"))
        .repartition(*[F.col(c) for c in cells])
    )
    totals = ranged.groupBy(*cells).agg(*[F.sum(v).alias(v) for v in values])
    range_order = F.col("__range").desc() if descending else F.col("__range").asc()
    before = (
        Window.partitionBy(*by).orderBy(range_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        *cells, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"__{v}") for v in values]
    )
    inside = Window.partitionBy(*cells).orderBy(order)
    joined = (
        ranged.alias("r")
        .join(starts.alias("s"), _null_safe(cells), "inner")
        .select("r.*", *[f"s.__{v}" for v in values])
    )
    return joined.select(
        *df.columns,
        *[(F.sum(v).over(inside) + F.col(f"__{v}")).alias(f"{v}_upto") for v in values],
    )


def _null_safe(columns: Sequence[str]):
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return test
