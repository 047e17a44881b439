"""Feature preparation: imputation, encoding, scaling, and reproducible splits.

Every step is fitted on a table and applied to the same or another one. A fit keeps
a few numbers per column on the driver; code tables of many values stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import as_double, col, denan, family, require_columns
from tabspark.functions.hashing import SLOTS, fine_slot, key_text, slot
from tabspark.functions.numeric import sample_skewness
from tabspark.functions.scratch import materialise
from tabspark.operators.codes import CODE_BOUND, apply_codes, code_table
from tabspark.operators.profile import column_kinds
from tabspark.operators.stats import distinct_counts, exact_quantiles, per_column, value_counts_long

# Skewness above which the median replaces the mean, fill for columns without
# any value, cardinality limits of the encodings.
SKEW_LIMIT = 1.0
UNKNOWN = "unknown"
BINARY_LEVELS = 2
ONE_HOT_LEVELS = 10
# Classes whose limits or starts are broadcast (10,000 small rows each at most).
FEW_CLASSES = 50


@dataclass(frozen=True)
class Imputation:
    """Fill values by column."""

    numbers: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Fill the fitted columns; a filled numeric column becomes double."""
        data = denan(df)
        filled = []
        for c in data.columns:
            if c in self.numbers:
                value = F.coalesce(col(c).cast("double"), F.lit(self.numbers[c])).alias(c)
            elif c in self.modes:
                value = F.coalesce(col(c), F.lit(self.modes[c])).alias(c)
            else:
                value = col(c)
            filled.append(value)
        return data.select(*filled)


def kinds_of(df: DataFrame) -> dict[str, list[str]]:
    """Column names by kind (numeric, categorical, text, …), in schema order."""
    result: dict[str, list[str]] = {}
    for row in column_kinds(df).orderBy("ordinal").collect():
        result.setdefault(row["kind"], []).append(row["column"])
    return result


def fit_imputation(
    df: DataFrame, numeric: Sequence[str] | None = None, categorical: Sequence[str] | None = None
) -> Imputation:
    """Median for skewed numeric columns, mean for the others, mode for categories.

    Only columns with gaps are fitted. A column without any value gets 0 or "unknown".
    """
    if numeric is None or categorical is None:
        kinds = kinds_of(df)
        numeric = kinds.get("numeric", []) if numeric is None else numeric
        categorical = kinds.get("categorical", []) if categorical is None else categorical
    numbers: dict[str, float] = {}
    if numeric:
        rows = per_column(
            as_double(df, list(numeric)),
            list(numeric),
            lambda c: {
                "gaps": F.count("*") - F.count(col(c)),
                "skew": sample_skewness(col(c)),
                "mean": F.avg(col(c)),
            },
        ).filter(F.col("gaps") > 0).collect()
        numbers = {r["column"]: 0.0 if r["mean"] is None else r["mean"] for r in rows}
        skewed = [r["column"] for r in rows if abs(r["skew"] or 0.0) > SKEW_LIMIT]
        if skewed:
            medians = exact_quantiles(df, skewed, {"median": 0.5}).collect()
            numbers |= {r["column"]: r["median"] for r in medians}
    modes: dict[str, str] = {}
    if categorical:
        gaps = per_column(
            df, list(categorical), lambda c: {"gaps": F.count("*") - F.count(col(c))}
        ).filter(F.col("gaps") > 0)
        wanted = [r["column"] for r in gaps.collect()]
        modes = dict.fromkeys(wanted, UNKNOWN)
        if wanted:
            modes |= {r["column"]: r["mode"] for r in column_modes(df, wanted).collect()}
    return Imputation(numbers, modes)


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, mode)``: the most frequent value, the smallest one among ties."""
    best = F.min(F.struct(-F.col("n"), F.col("value")))
    return (
        value_counts_long(df, columns)
        .groupBy("column")
        .agg(best.alias("best"))
        .select("column", F.col("best.value").alias("mode"))
    )


@dataclass(frozen=True)
class Encoding:
    """Levels of small categories (on the driver) and code tables of large ones (distributed)."""

    codes: dict[str, list[str]] = field(default_factory=dict)
    one_hot: dict[str, list[str]] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        """Codes in place; one-hot columns at the end; unseen or missing values get -1 or all 0."""
        plain = []
        for c in df.columns:
            if c in self.one_hot:
                continue
            if c in self.codes:
                plain.append(_code_of(c, self.codes[c]).alias(c))
            else:
                plain.append(col(c))
        flags = [
            F.coalesce((col(c) == level).cast("int"), F.lit(0)).alias(f"{c}_{level}")
            for c, levels in self.one_hot.items()
            for level in levels[1:]
        ]
        result = df.select(*plain, *flags)
        for c, table in self.tables.items():
            result = apply_codes(result, c, table)
        return result

    def mapping(self, spark) -> DataFrame:
        """``(column, category, code)`` of all integer-coded columns."""
        rows = [(c, v, i) for c, levels in self.codes.items() for i, v in enumerate(levels)]
        result = spark.createDataFrame(rows, "column string, category string, code bigint")
        for c, table in self.tables.items():
            part = table.select(F.lit(c).alias("column"), F.col("value").alias("category"), "code")
            result = result.unionByName(part)
        return result


def _code_of(column: str, levels: list[str]):
    value = col(column).cast("string")
    code = F.lit(-1).cast("bigint")
    for i, level in enumerate(levels):
        code = F.when(value == level, F.lit(i).cast("bigint")).otherwise(code)
    return code


def fit_encoding(
    df: DataFrame, columns: Sequence[str], target: str | None = None, bound: int = CODE_BOUND
) -> Encoding:
    """Choose and fit the encoding of each category column by its number of values.

    Up to 2 values: integer code. 3 to 10: one 0/1 column per value but the first.
    More: integer code from a code table. A string target is always coded.
    """
    wanted = [c for c in columns if c != target]
    if target is not None and family(df.schema[target].dataType) == "string":
        wanted.append(target)
    if not wanted:
        return Encoding()
    sizes = {r["column"]: r["n_unique"] for r in distinct_counts(df, wanted).collect()}
    small = [c for c in wanted if sizes.get(c, 0) <= ONE_HOT_LEVELS]
    levels: dict[str, list[str]] = {c: [] for c in small}
    if small:
        # At most 10 values of each of these columns reach the driver.
        for r in value_counts_long(df, small).select("column", "value").orderBy("value").collect():
            levels[r["column"]].append(r["value"])
    codes, one_hot, tables = {}, {}, {}
    for c in wanted:
        if c not in levels:
            tables[c] = code_table(df, c, bound)
        elif c == target or len(levels[c]) <= BINARY_LEVELS:
            codes[c] = levels[c]
        else:
            one_hot[c] = levels[c]
    return Encoding(codes, one_hot, tables)


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation by column."""

    centres: dict[str, tuple[float, float]]

    def apply(self, df: DataFrame) -> DataFrame:
        return denan(df).select(
            *[
                ((col(c).cast("double") - self.centres[c][0]) / self.centres[c][1]).alias(c)
                if c in self.centres
                else col(c)
                for c in df.columns
            ]
        )


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """Standardisation by the population deviation; a constant column is only centred."""
    columns = list(columns)
    if not columns:
        return Scaling({})
    rows = per_column(
        as_double(df, columns),
        columns,
        lambda c: {"mean": F.avg(col(c)), "std": F.stddev_pop(col(c))},
    ).collect()
    return Scaling({r["column"]: (r["mean"] or 0.0, r["std"] or 1.0) for r in rows})


def with_split(
    df: DataFrame, key: str | list[str], test_size: float = 0.2, seed: int = 42, name: str = "split"
) -> DataFrame:
    """Add ``train``/``test`` by a hash of the key: no shuffle, about ``test_size`` in test."""
    cut = round(test_size * SLOTS)
    return df.withColumn(
        name, F.when(slot(key_text(key), seed) < cut, "test").otherwise("train")
    )


def with_stratified_split(
    df: DataFrame,
    key: str,
    label: str | None,
    test_size: float = 0.2,
    seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Add an exact split: the first ``ceil(test_size * n)`` rows of every class are test.

    Rows are ordered by (slot, fine slot, key); the key must be unique. No class is
    ever sorted: counts per (class, slot) locate the slot where the quota ends,
    counts per fine slot the place inside it, and only the rows of that one cell
    (about one in 10^8 of a class) are ranked by key. There may be any number of
    classes: their limits are broadcast up to ``FEW_CLASSES`` and else joined by shuffle.
    ``label=None`` treats the table as one class.
    """
    class_of = F.lit("all") if label is None else F.coalesce(col(label).cast("string"), F.lit(""))
    data = df.withColumn("__class", class_of)
    data = data.withColumn("__slot", slot(key_text(key), seed)).withColumn("__fine", fine_slot(key_text(key), seed))
    # A row per class and slot that occur together.
    slots = materialise(data.groupBy("__class", "__slot").count())
    quotas = slots.groupBy("__class").agg(
        F.ceil(F.sum("count") * F.lit(test_size)).cast("bigint").alias("__left")
    )
    cuts = materialise(_cut(slots, "__slot", quotas))
    few = _sender(cuts)
    # The rows of one slot per class, one in 10,000.
    inside = materialise(
        data.join(few(cuts), "__class")
        .filter(F.col("__slot") == F.col("__cut___slot"))
        .select("__class", "__fine", col(key).alias("__key"))
    )
    fines = inside.groupBy("__class", "__fine").count()
    fine_cuts = materialise(_cut(fines, "__fine", cuts.select("__class", "__left")))
    edge = inside.join(few(fine_cuts), "__class").filter(
        F.col("__fine") == F.col("__cut___fine")
    )
    place = F.row_number().over(Window.partitionBy("__class").orderBy("__key"))
    last = (
        edge.withColumn("__place", place)
        .filter(F.col("__place") <= F.col("__left"))
        .groupBy("__class")
        .agg(F.max("__key").alias("__last"))
    )
    limits = (
        cuts.drop("__left")
        .join(few(fine_cuts.drop("__left")), "__class", "left")
        .join(few(last), "__class", "left")
    )
    below = F.col("__slot") < F.col("__cut___slot")
    same = F.col("__slot") == F.col("__cut___slot")
    below_fine = F.col("__fine") < F.col("__cut___fine")
    same_fine = F.col("__fine") == F.col("__cut___fine")
    is_test = below | (same & (below_fine | (same_fine & (col(key) <= F.col("__last")))))
    return data.join(few(limits), "__class", "left").select(
        *[col(c) for c in df.columns],
        F.when(F.coalesce(is_test, F.lit(False)), "test").otherwise("train").alias(name),
    )


def with_stratified_fold(
    df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add a fold number such that every class is spread over the folds evenly (±1 row).

    A row's place in its class, modulo the number of folds, is its fold. The place is
    the number of rows in the slots before plus the place inside the slot, so a class
    is sorted in 10,000 pieces. The key must be unique. Starts are broadcast for up to
    ``FEW_CLASSES`` classes and else joined by shuffle.
    """
    cells = ["__class", "__slot"]
    data = df.withColumn("__class", F.coalesce(col(label).cast("string"), F.lit(""))).withColumn(
        "__slot", slot(key_text(key), seed)
    )
    before = (
        Window.partitionBy("__class").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = materialise(data.groupBy(*cells).count().select(
        *cells, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start")
    ))
    place = F.row_number().over(Window.partitionBy(*cells).orderBy(col(key))) - 1
    few = _sender(starts.select("__class").distinct())
    return data.join(few(starts), cells).select(
        *[col(c) for c in df.columns],
        F.pmod(F.col("__start") + place, F.lit(folds)).cast("int").alias(name),
    )


def _sender(classes: DataFrame):
    """``broadcast`` where the table has few classes, else nothing: the join is shuffled."""
    small = classes.limit(FEW_CLASSES + 1).count() <= FEW_CLASSES
    return F.broadcast if small else lambda table: table


def _cut(counts: DataFrame, slot_name: str, quotas: DataFrame) -> DataFrame:
    """Per class: the slot in which the quota ends and how many of its rows still belong to it."""
    order = Window.partitionBy("__class").orderBy(slot_name)
    return (
        counts.withColumn("__upto", F.sum("count").over(order))
        .join(quotas, "__class")
        .filter(F.col("__upto") >= F.col("__left"))
        .groupBy("__class")
        .agg(F.min(F.struct(slot_name, "__upto", "count", "__left")).alias("s"))
        .select(
            "__class",
            F.col(f"s.{slot_name}").alias(f"__cut_{slot_name}"),
            (F.col("s.__left") - (F.col("s.__upto") - F.col("s.count"))).alias("__left"),
        )
    )


@dataclass(frozen=True)
class Prepared:
    """A prepared table with ``split``, the feature columns, and what was done to get there."""

    table: DataFrame
    target: str
    features: list[str]
    left_out: list[str]
    imputation: Imputation
    encoding: Encoding
    scaling: Scaling

    def assembled(self, name: str = "features") -> DataFrame:
        """The table with a feature vector and a double ``label``."""
        ready = VectorAssembler(inputCols=self.features, outputCol=name, handleInvalid="keep")
        return ready.transform(self.table).withColumn("label", col(self.target).cast("double"))

    def summary(self) -> DataFrame:
        """One row: features, split sizes, imputed and encoded columns."""
        return self.table.agg(
            F.lit(len(self.features)).cast("bigint").alias("n_features"),
            F.count_if(F.col("split") == "train").alias("train_size"),
            F.count_if(F.col("split") == "test").alias("test_size"),
            F.lit(len(self.imputation.numbers) + len(self.imputation.modes))
            .cast("bigint").alias("imputed_columns"),
            F.lit(len(self.encoding.codes) + len(self.encoding.tables))
            .cast("bigint").alias("encoded_columns"),
        )


def prepare(
    df: DataFrame,
    target: str,
    key: str,
    fit_on: str = "train",
    test_size: float = 0.2,
    seed: int = 42,
    stratify: bool = False,
) -> Prepared:
    """Split, impute, encode and scale a table.

    ``fit_on="train"`` fits every step on the training rows; ``"all"`` on all rows.
    ``stratify`` keeps class shares exactly. Text, datetime and nested columns and the key are
    left out of the features.
    """
    require_columns(df, [target, key])
    kinds = kinds_of(df.drop(key))
    numeric, categorical = kinds.get("numeric", []), kinds.get("categorical", [])
    if target in kinds.get("text", []):
        raise ValueError(f"target {target} holds long texts")
    if stratify:
        split = with_stratified_split(df, key, target, test_size, seed)
    else:
        split = with_split(df, key, test_size, seed)

    def fitting(table: DataFrame) -> DataFrame:
        return table.filter(F.col("split") == "train") if fit_on == "train" else table

    imputation = fit_imputation(fitting(split), numeric, categorical)
    filled = imputation.apply(split)
    encoding = fit_encoding(fitting(filled), categorical, target)
    coded = encoding.apply(filled)
    scaled_columns = [c for c in numeric if c != target]
    scaling = fit_scaling(fitting(coded), scaled_columns)
    table = scaling.apply(coded)
    left_out = [c for kind, names in kinds.items() if kind not in ("numeric", "categorical", "boolean")
                for c in names if c != target]
    skip = {target, key, "split", *left_out}
    features = [c for c in table.columns if c not in skip]
    return Prepared(table, target, features, left_out, imputation, encoding, scaling)
