"""Exploratory statistics: distributions, correlation, outliers, target and category analysis."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import (
    as_double,
    col,
    denan,
    is_numeric,
    numeric_columns,
    require_columns,
    string_columns,
)
from tabspark.functions.numeric import (
    percent,
    ratio,
    rounded,
    sample_kurtosis,
    sample_skewness,
)
from tabspark.operators.stats import (
    attach,
    exact_quantiles,
    per_column,
    value_counts_long,
)

# Fixed values of the reports: whisker length, bins per histogram, listed categories, and
# distinct values above which a numeric target gets a histogram.
IQR_MULTIPLIER = 1.5
BINS = 30
TOP_VALUES = 10
TARGET_HISTOGRAM_ABOVE = 10


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Location, spread and shape of each numeric column; columns without values are left out."""
    columns = list(columns or numeric_columns(df))
    data = as_double(df, columns)
    shape = per_column(
        data,
        columns,
        lambda c: {
            "n": F.count(col(c)),
            "mean": F.avg(col(c)),
            "std": F.stddev_samp(col(c)),
            "skewness": sample_skewness(col(c)),
            "kurtosis": sample_kurtosis(col(c)),
            "min": F.min(col(c)),
            "max": F.max(col(c)),
        },
    )
    quartiles = exact_quantiles(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return (
        attach(shape, quartiles)
        .filter(F.col("n") > 0)
        .select("column", "mean", "median", "std", "skewness", "kurtosis", "min", "max", "q25", "q75")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(col_x, col_y, corr)``, pairwise complete, 4 digits.

    One scan for the means and one for the sums of all pairs, whatever the number of
    columns: each task adds its batches to matrices of sums, shifted by the means against
    cancellation, and hands on one row per pair. Each pair is mirrored.
    """
    columns = list(columns or numeric_columns(df))
    empty = "col_x string, col_y string, corr double"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], empty)
    data = as_double(df, columns).select(*[col(c) for c in columns])
    means = {r["column"]: r["mean"] or 0.0
             for r in per_column(data, columns, lambda c: {"mean": F.avg(col(c))}).collect()}
    shift = np.array([means[c] for c in columns])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(columns)
        n, x, xx, xy = (np.zeros((k, k)) for _ in range(4))
        for batch in batches:
            values = np.column_stack([
                c.fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns]) - shift
            known = ~np.isnan(values)
            filled, there = np.where(known, values, 0.0), known.astype(float)
            n += there.T @ there
            x += filled.T @ there
            xx += (filled ** 2).T @ there
            xy += filled.T @ filled
        i, j = np.triu_indices(k)
        cells = [i, j, n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]]
        names = ["i", "j", "n", "x", "y", "xx", "yy", "xy"]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in cells], names)

    parts = data.mapInArrow(sums, "i long, j long, " + ", ".join(f"{v} double" for v in ("n", "x", "y", "xx", "yy", "xy")))
    total = parts.groupBy("i", "j").agg(*[F.sum(v).alias(v) for v in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    spread_x, spread_y = F.col("xx") - F.col("x") ** 2 / n, F.col("yy") - F.col("y") ** 2 / n
    # What is left of rounding where a column is constant counts as no spread.
    varied = (spread_x > 1e-12 * F.col("xx")) & (spread_y > 1e-12 * F.col("yy"))
    same = F.col("i") == F.col("j")
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(spread_x * spread_y)
    value = F.when((n > 0) & varied, F.when(same, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))
    pairs = total.select("i", "j", rounded(value).alias("corr"))
    both = pairs.unionByName(pairs.filter(~same).select(F.col("j").alias("i"), F.col("i").alias("j"), "corr"))
    names = F.array(*[F.lit(c) for c in columns])
    return both.select(F.get(names, F.col("i")).alias("col_x"), F.get(names, F.col("j")).alias("col_y"), "corr")


def correlation_chart(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """:func:`correlation_matrix` of the charted columns: all numeric ones unless named."""
    return correlation_matrix(df, columns)


def iqr_bounds(
    df: DataFrame, columns: Sequence[str], multiplier: float = IQR_MULTIPLIER
) -> dict[str, tuple[float, float]]:
    """``{column: (lower, upper)}``: two numbers per column, on the driver."""
    rows = exact_quantiles(df, columns, {"q1": 0.25, "q3": 0.75}).collect()
    return {
        r["column"]: (
            r["q1"] - multiplier * (r["q3"] - r["q1"]),
            r["q3"] + multiplier * (r["q3"] - r["q1"]),
        )
        for r in rows
        if r["q1"] is not None
    }


def iqr_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = IQR_MULTIPLIER
) -> DataFrame:
    """``(column, n_outliers, pct, lower, upper)`` of the columns that have outliers."""
    columns = list(columns or numeric_columns(df))
    bounds = iqr_bounds(df, columns, multiplier)
    filled = [c for c in columns if c in bounds]
    if not filled:
        return df.sparkSession.createDataFrame(
            [], "column string, n_outliers bigint, pct double, lower double, upper double"
        )

    def measures(c: str) -> dict[str, Column]:
        lower, upper = bounds[c]
        return {
            "n": F.count(col(c)),
            "n_outliers": F.count_if((col(c) < lower) | (col(c) > upper)),
            "lower": F.lit(lower),
            "upper": F.lit(upper),
        }

    return (
        per_column(as_double(df, filled), filled, measures)
        .filter(F.col("n_outliers") > 0)
        .select(
            "column",
            "n_outliers",
            percent(F.col("n_outliers"), F.col("n")).alias("pct"),
            "lower",
            "upper",
        )
    )


def with_outlier_flag(
    df: DataFrame, column: str, multiplier: float = IQR_MULTIPLIER, name: str = "is_outlier"
) -> DataFrame:
    """Flag each row whose value lies outside the IQR bounds; missing values are not outliers."""
    require_columns(df, [column])
    bounds = iqr_bounds(df, [column], multiplier)
    if column not in bounds:
        return df.withColumn(name, F.lit(False))
    lower, upper = bounds[column]
    value = col(column).cast("double")
    outside = ((value < lower) | (value > upper)) & ~F.isnan(value)
    return df.withColumn(name, F.coalesce(outside, F.lit(False)))


def target_continuous(df: DataFrame, target: str) -> DataFrame:
    """One row: mean, sample deviation, minimum and maximum of a numeric target."""
    return per_column(
        as_double(df, [target]),
        [target],
        lambda c: {
            "mean": F.avg(col(c)),
            "std": F.stddev_samp(col(c)),
            "min": F.min(col(c)),
            "max": F.max(col(c)),
        },
    )


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """``(class, n, n_classes, balance_ratio)``: class counts and smallest over largest count."""
    counts = _counts(df, target)
    spread = counts.agg(
        F.struct(
            F.count("*").alias("classes"), rounded(ratio(F.min("n"), F.max("n"))).alias("balance")
        )
    ).scalar()
    return counts.select(
        F.col("value").alias("class"),
        "n",
        spread["classes"].alias("n_classes"),
        spread["balance"].alias("balance_ratio"),
    )


def analyse_target(df: DataFrame, target: str, as_categorical: bool = False) -> DataFrame:
    """Continuous analysis for a numeric target, class counts otherwise."""
    require_columns(df, [target])
    if is_numeric(df.schema[target].dataType) and not as_categorical:
        return target_continuous(df, target)
    return target_classes(df, target)


def _counts(df: DataFrame, column: str) -> DataFrame:
    value = denan(df.select(col(column))).select(col(column).cast("string").alias("value"))
    return value.filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, top_n: int | None = TOP_VALUES) -> DataFrame:
    """``(value, n)`` of the ``top_n`` most frequent values, ties by value (all for None)."""
    ordered = _counts(df, column).orderBy(F.col("n").desc(), "value")
    return ordered if top_n is None else ordered.limit(top_n)


def categorical_top(
    df: DataFrame, columns: Sequence[str] | None = None, top_n: int = TOP_VALUES
) -> DataFrame:
    """The most frequent values of each category column, with its distinct count and mode.

    ``rank <= top_n`` sits right on the window, so each task keeps its best ``top_n``
    rows before the shuffle.
    """
    counts = value_counts_long(df, list(columns or string_columns(df)))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value"))
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
    # Reading n keeps this branch equal to the one above, so that both share one shuffle.
    sizes = counts.groupBy("column").agg(F.count_if(F.col("n") > 0).alias("n_unique"))
    return top.join(F.broadcast(sizes), "column").select(
        "column",
        F.col("rank").cast("bigint").alias("rank"),
        "value",
        "n",
        "n_unique",
        (F.col("rank") == 1).alias("is_mode"),
    )


def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS
) -> DataFrame:
    """``(column, bin, lower, upper, n)``: equal-width bins, the last one closed, empty ones kept."""
    columns = list(columns or numeric_columns(df))
    data = as_double(df, columns)
    spans = {
        r["column"]: (r["low"], r["high"])
        for r in per_column(
            data, columns, lambda c: {"low": F.min(col(c)), "high": F.max(col(c))}
        ).collect()
        if r["low"] is not None
    }
    spans = {
        c: (low - 0.5, high + 0.5) if low == high else (low, high)
        for c, (low, high) in spans.items()
    }
    schema = "column string, bin bigint, lower double, upper double"
    edges = [
        (c, i, low + i * ((high - low) / bins), low + (i + 1) * ((high - low) / bins))
        for c, (low, high) in spans.items()
        for i in range(bins)
    ]
    frame = df.sparkSession.createDataFrame(edges, schema).coalesce(1)
    if not spans:
        return frame.withColumn("n", F.lit(0).cast("bigint"))
    numbered = data.select(
        *[
            # least() skips NULL, so missing values are kept out of the last bin here.
            F.when(
                col(c).isNotNull(),
                F.least(F.floor((col(c) - low) / ((high - low) / bins)), F.lit(bins - 1)),
            ).alias(c)
            for c, (low, high) in spans.items()
        ]
    )
    counts = (
        numbered.unpivot([], [col(c) for c in spans], "column", "bin")
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin")
        .agg(F.count("*").alias("n"))
    )
    # At most bins x columns rows on either side.
    return frame.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n")
    )


def _few_values(most: int):
    """Keep up to ``most`` different values of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            if seen is not None and len(seen) >= most:
                continue
            new = batch.column(0).unique()
            seen = (new if seen is None else pa.concat_arrays([seen, new]).unique())[:most]
        if seen is not None:
            yield pa.RecordBatch.from_arrays([seen], ["v"])

    return run


def target_distribution(df: DataFrame, target: str, bins: int = BINS) -> DataFrame:
    """Histogram of a numeric target with more than 10 values, value counts otherwise."""
    require_columns(df, [target])
    if is_numeric(df.schema[target].dataType):
        # At most 11 values of each task, and of all, are gathered: enough to know if there are more than 10.
        some = df.select(col(target).alias("v")).filter(F.col("v").isNotNull()).mapInArrow(
            _few_values(TARGET_HISTOGRAM_ABOVE + 1), f"v {df.schema[target].dataType.simpleString()}")
        if len(some.distinct().take(TARGET_HISTOGRAM_ABOVE + 1)) > TARGET_HISTOGRAM_ABOVE:
            return histogram(df, [target], bins).select(
                F.lit("histogram").alias("kind"),
                F.col("bin").cast("string").alias("value"),
                "lower",
                "upper",
                "n",
            )
    missing = F.lit(None).cast("double")
    return _counts(df, target).select(
        F.lit("counts").alias("kind"),
        "value",
        missing.alias("lower"),
        missing.alias("upper"),
        "n",
    )
