"""Column profiles: types, missing values, distinct counts, numeric summaries, semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.columns import col, denan, family, numeric_columns
from tabspark.functions.numeric import percent, ratio
from tabspark.operators.stats import attach, distinct_counts, exact_quantiles, per_column

# Mean length above which a string column counts as text, cardinality limits
# of the semantic kinds, and name fragments that point to a target column.
TEXT_LENGTH = 50
BINARY_VALUES = 2
CATEGORY_VALUES = 20
CATEGORY_SHARE = 0.05
TARGET_FRAGMENTS = (
    "target", "label", "class", "y", "outcome", "response", "is_", "has_", "churned",
    "default", "fraud",
)

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def guess_target(columns: Sequence[str], whole_word: bool = False) -> str:
    """First column whose lower-case name contains a target fragment, else the last column.

    With ``whole_word`` a fragment must be one of the name's ``_``-separated parts.
    """
    for name in columns:
        lowered = name.lower()
        parts = lowered.split("_")
        for fragment in TARGET_FRAGMENTS:
            if fragment.strip("_") in parts if whole_word else fragment in lowered:
                return name
    return columns[-1]


def _basic_counts(df: DataFrame) -> DataFrame:
    """``(column, n_rows, n_missing, avg_length)`` in one scan."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def measures(c: str) -> dict[str, Column]:
        is_text = family(types[c]) == "string"
        return {
            "n_rows": F.count("*"),
            "n_missing": F.count("*") - F.count(col(c)),
            "avg_length": F.avg(F.length(col(c))) if is_text else F.lit(None).cast("double"),
        }

    return per_column(denan(df), df.columns, measures)


def _described_columns(df: DataFrame) -> DataFrame:
    """Names, positions and types of the columns: a table built from the schema only."""
    rows = [
        (i, f.name, f.dataType.simpleString(), family(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal bigint, column string, dtype string, family string"
    ).coalesce(1)


def _countable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if family(f.dataType) != "other"]


def column_kinds(df: DataFrame) -> DataFrame:
    """``(ordinal, column, dtype, kind)``: numeric, categorical, text, datetime, boolean, other."""
    return attach(_described_columns(df), _basic_counts(df)).select(
        "ordinal", "column", "dtype", _kind().alias("kind")
    )


def _kind() -> Column:
    fam = F.col("family")
    return (
        F.when(fam.isin("integral", "floating", "decimal"), "numeric")
        .when((fam == "string") & (F.col("avg_length") > TEXT_LENGTH), "text")
        .when(fam == "string", "categorical")
        .otherwise(fam)
    )


def column_profile(df: DataFrame, whole_word_target: bool = False,
                   approximate_distinct: bool = False) -> DataFrame:
    """One row per column: type, kind, missing count and share, distinct count, target guess."""
    target = guess_target(df.columns, whole_word_target)
    if approximate_distinct:
        distinct = per_column(
            denan(df), _countable(df), lambda c: {"n_unique": F.approx_count_distinct(col(c))}
        )
    else:
        distinct = distinct_counts(df, _countable(df))
    return attach(_described_columns(df), _basic_counts(df), distinct).select(
        "ordinal",
        "column",
        "dtype",
        _kind().alias("kind"),
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        "n_missing",
        percent(F.col("n_missing"), F.col("n_rows")).alias("missing_pct"),
        F.when(F.col("family") != "other", F.coalesce("n_unique", F.lit(0))).alias("n_unique"),
        (F.col("column") == target).alias("target_guess"),
    )


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, count, mean, std, min, q25, q50, q75, max)`` of the numeric columns."""
    columns = list(columns or numeric_columns(df))
    data = denan(df)
    moments = per_column(
        data,
        columns,
        lambda c: {
            "count": F.count(col(c)),
            "mean": F.avg(col(c).cast("double")),
            "std": F.stddev_samp(col(c).cast("double")),
            "min": F.min(col(c).cast("double")),
            "max": F.max(col(c).cast("double")),
        },
    )
    return attach(moments, exact_quantiles(df, columns, QUARTILES)).select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def profile_totals(profile: DataFrame) -> DataFrame:
    """Totals over a :func:`column_profile` table, in one row."""
    return profile.agg(
        F.max("n_rows").alias("n_rows"),
        F.max("n_columns").alias("n_columns"),
        F.count_if(F.col("kind") == "numeric").alias("numeric_columns"),
        F.count_if(F.col("kind") == "categorical").alias("categorical_columns"),
        F.count_if(F.col("kind") == "text").alias("text_columns"),
        F.count_if(F.col("kind") == "datetime").alias("datetime_columns"),
        F.sum("n_missing").alias("missing_total"),
    )


def semantic_types(df: DataFrame) -> DataFrame:
    """``(column, semantic)`` by content: datetime, binary, categorical, numeric, text, id, other."""
    table = attach(
        _described_columns(df), _basic_counts(df), distinct_counts(df, _countable(df))
    )
    fam, n, unique = F.col("family"), F.col("n_rows"), F.coalesce("n_unique", F.lit(0))
    numeric = fam.isin("integral", "floating", "decimal", "boolean")
    semantic = (
        F.when(fam == "datetime", "datetime")
        .when(numeric & (unique <= BINARY_VALUES), "binary")
        .when(
            numeric & (unique <= CATEGORY_VALUES) & (ratio(unique, n) < CATEGORY_SHARE),
            "categorical",
        )
        .when(numeric, "numeric")
        .when((fam == "string") & (F.col("avg_length") > TEXT_LENGTH), "text")
        .when((fam == "string") & (unique == n), "id")
        .when(fam == "string", "categorical")
        .otherwise("other")
    )
    return table.select("ordinal", "column", semantic.alias("semantic"))


def _missing_aggregate(df: DataFrame) -> DataFrame:
    """One row: rows, complete rows and the number of missing cells, in one scan."""
    data = denan(df)
    complete = F.lit(True)
    present = F.lit(0).cast("bigint")
    for c in df.columns:
        complete = complete & col(c).isNotNull()
        present = present + F.count(col(c))
    width = len(df.columns)
    return data.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") * width).alias("total_cells"),
        (F.count("*") * width - present).alias("total_missing"),
        F.count_if(complete).alias("complete_rows"),
    )


def missing_pattern(df: DataFrame) -> DataFrame:
    """One row: missing cells, cells, rate (0–1), complete rows and their share (0–1)."""
    return _missing_aggregate(df).select(
        "total_missing",
        "total_cells",
        ratio(F.col("total_missing"), F.col("total_cells")).alias("missing_rate"),
        "complete_rows",
        ratio(F.col("complete_rows"), F.col("n_rows")).alias("complete_rows_share"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """One row as :func:`missing_pattern`, as percentages with 2 digits (0 for no cells)."""
    zero = F.lit(0.0)
    return _missing_aggregate(df).select(
        "total_missing",
        "total_cells",
        F.coalesce(percent(F.col("total_missing"), F.col("total_cells")), zero).alias("missing_pct"),
        "complete_rows",
        F.coalesce(percent(F.col("complete_rows"), F.col("n_rows")), zero).alias("complete_rows_pct"),
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """``(column, n_missing, fraction)`` of the columns with gaps, ascending by fraction."""
    return (
        _basic_counts(df)
        .filter(F.col("n_missing") > 0)
        .select("column", "n_missing", ratio(F.col("n_missing"), F.col("n_rows")).alias("fraction"))
        .orderBy("fraction", "column")
    )
