"""Metrics of prediction tables.

Input is ``(by…, label, prediction [, score])``. Every function takes ``by`` columns, so
one query measures many models or segments. Classification metrics all derive from
the confusion cells: one grouped count over the rows, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import col, denan
from tabspark.functions.hashing import SLOTS, key_text, slot
from tabspark.functions.numeric import clipped, ratio, rounded
from tabspark.functions.scratch import materialise
from tabspark.operators.cumulative import SORT_BOUND, ordered_by, running_totals
from tabspark.operators.explore import histogram

# Default success criteria by task type, metrics where lower is better,
# and criterion names that mean a metric of another name.
DEFAULT_CRITERIA = {
    "binary_classification": {"accuracy": 0.85, "f1_score": 0.80, "auc_roc": 0.85},
    "multiclass_classification": {"accuracy": 0.80, "macro_f1": 0.75},
    "regression": {"r2_score": 0.80, "mape": 0.15},
    "clustering": {"silhouette_score": 0.50},
    "time_series": {"mape": 0.10, "rmse_relative": 0.15},
    "anomaly_detection": {"precision": 0.80, "recall": 0.75},
    "ranking": {"ndcg": 0.80},
    "recommendation": {"precision_at_k": 0.70, "recall_at_k": 0.60},
}
OTHER_CRITERIA = {"accuracy": 0.80}
LOWER_IS_BETTER = ("mape", "rmse", "mae")
METRIC_ALIASES = {"f1_score": "f1", "macro_f1": "f1_macro", "r2_score": "r2"}
PROBABILITY_FLOOR = 2.220446049250313e-16

# Classes up to which a dense confusion matrix is built.
MATRIX_CLASSES = 1_000


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _long(wide: DataFrame, by: Sequence[str], names: Sequence[str], digits: int = 4) -> DataFrame:
    """``(by…, metric, value)``, rounded; metrics that do not exist for a group are left out."""
    rows = F.array(
        *[F.struct(F.lit(m).alias("metric"), rounded(col(m), digits).alias("value")) for m in names]
    )
    return wide.select(*[col(b) for b in by], F.inline(rows)).filter(F.col("value").isNotNull())


# ── classification ──


def confusion_cells(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``(by…, label, prediction, n)``: the non-empty cells."""
    return df.groupBy(
        *[col(b) for b in by], col(label).alias("label"), col(prediction).alias("prediction")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
    max_classes: int = MATRIX_CLASSES,
) -> DataFrame:
    """``(by…, label, prediction, n)`` for every pair of classes seen, zeros included.

    The result has classes² rows per group by definition. Above ``max_classes`` use
    :func:`confusion_cells`, which holds the same counts without the zeros.
    """
    by = list(by)
    cells = materialise(confusion_cells(df, by, label, prediction))
    # Classes travel in a struct, because lists leave out NULL, which is a class of its own here.
    sides = F.array(F.struct(F.col("label").alias("c")), F.struct(F.col("prediction").alias("c")))
    seen = cells.select(*by, F.explode(sides).alias("class")).distinct()
    largest = seen.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > max_classes:
        raise ValueError(f"{largest} classes make a matrix too large; use confusion_cells")
    classes = seen.groupBy(*by).agg(F.collect_list("class").alias("classes"))
    frame = classes.select(*by, F.explode("classes").alias("row"), "classes").select(
        *by, F.col("row.c").alias("label"), F.explode("classes").alias("column")
    ).select(*by, "label", F.col("column.c").alias("prediction"))
    keys = [*by, "label", "prediction"]
    named = cells.select(*[col(k).alias(f"__{k}") for k in keys], "n")
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"`__{k}`")) for k in keys])
    return frame.join(named, same, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``(by…, class, support, predicted, hits, precision, recall, f1)``; undefined ratios are 0."""
    by = list(by)
    sides = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("n").alias("support"),
            F.lit(0).cast("bigint").alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            F.lit(0).cast("bigint").alias("support"),
            F.col("n").alias("predicted"),
            F.lit(0).cast("bigint").alias("hits"),
        ),
    )
    counts = (
        confusion_cells(df, by, label, prediction)
        .select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    hits = F.col("hits")
    return counts.select(
        "*",
        _zero(ratio(hits, F.col("predicted"))).alias("precision"),
        _zero(ratio(hits, F.col("support"))).alias("recall"),
        _zero(ratio(hits * 2, F.col("predicted") + F.col("support"))).alias("f1"),
    )


CLASSIFICATION = ("accuracy", "f1_weighted", "precision_weighted", "recall_weighted",
                  "f1", "precision", "recall", "f1_macro")


def classification_metrics(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    prediction: str = "prediction",
    score: str | None = None,
    positive: object = 1,
    task: str = "auto",
    digits: int = 4,
) -> DataFrame:
    """``(by…, metric, value)``.

    Always accuracy and the weighted precision, recall and F1. ``task="binary"`` adds
    precision, recall and F1 of the positive class and, given a score, ROC AUC;
    ``"multiclass"`` adds macro F1; ``"auto"`` decides per group by the number of
    classes in the truth.
    """
    by = list(by)
    classes = class_metrics(df, by, label, prediction)
    binary = {
        "auto": F.count_if(F.col("support") > 0) == 2,
        "binary": F.lit(True),
        "multiclass": F.lit(False),
    }[task]
    rows = F.sum("support")
    of_positive = {
        m: _zero(F.max(F.when(F.col("class") == F.lit(positive), F.col(m))))
        for m in ("f1", "precision", "recall")
    }
    wide = classes.groupBy(*by).agg(
        ratio(F.sum("hits"), rows).alias("accuracy"),
        *[
            ratio(F.sum(F.col(m) * F.col("support")), rows).alias(f"{m}_weighted")
            for m in ("precision", "recall", "f1")
        ],
        *[F.when(binary, v).alias(m) for m, v in of_positive.items()],
        F.when(~binary, F.avg("f1")).alias("f1_macro"),
    )
    result = _long(wide, by, CLASSIFICATION, digits)
    if score is None or task == "multiclass":
        return result
    return result.unionByName(roc_auc(df, by, label, score, positive, digits=digits))


def class_report(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``(by…, class, precision, recall, f1, support)`` with accuracy, macro and weighted rows."""
    by = list(by)
    classes = class_metrics(df, by, label, prediction)
    measures = ("precision", "recall", "f1")
    single = classes.select(
        *by, F.col("class").cast("string").alias("class"),
        *[rounded(F.col(m)).alias(m) for m in measures], "support",
    )
    rows = F.sum("support")
    accuracy = rounded(ratio(F.sum("hits"), rows))
    totals = classes.groupBy(*by).agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), *[accuracy.alias(m) for m in measures],
                rows.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                *[rounded(F.avg(m)).alias(m) for m in measures],
                rows.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[rounded(ratio(F.sum(F.col(m) * F.col("support")), rows)).alias(m) for m in measures],
                rows.alias("support"),
            ),
        ).alias("rows")
    )
    return single.unionByName(totals.select(*by, F.inline("rows")))


def worst_class(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """``(by…, class, accuracy, is_worst)``: share of each class predicted right, lowest flagged."""
    by = list(by)
    classes = class_metrics(df, by, label, prediction).filter(F.col("support") > 0)
    worst = classes.groupBy(*by).agg(F.min(F.struct("recall", "class"))["class"].alias("__worst"))
    joined = classes.join(worst, by) if by else classes.withColumn(
        "__worst", worst.scalar()
    )
    return joined.select(
        *by, "class", rounded(F.col("recall")).alias("accuracy"),
        (F.col("class") == F.col("__worst")).alias("is_worst"),
    )


def _by_score(
    df: DataFrame, by: list[str], label: str, score: str, positive: object, bound: int
) -> tuple[DataFrame, list[float]]:
    """``(by…, score, pos, neg)`` and the boundaries for running totals over it."""
    is_positive = col(label) == F.lit(positive)
    rows = denan(
        df.select(*[col(b) for b in by], col(label), col(score).cast("double").alias("score"))
    ).filter(F.col("score").isNotNull() & col(label).isNotNull())
    counted = rows.groupBy(*by, "score").agg(
        F.count_if(is_positive).alias("pos"), F.count_if(~is_positive).alias("neg")
    )
    return ordered_by(rows, counted, "score", bound)


def roc_auc(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    positive: object = 1,
    sort_bound: int = SORT_BOUND,
    digits: int = 4,
) -> DataFrame:
    """``(by…, metric="auc_roc", value)``: exact area with ties at half weight."""
    by = list(by)
    counted, ranges = _by_score(df, by, label, score, positive, sort_bound)
    ranked = running_totals(counted, by, "score", ["neg"], ranges)
    below = F.col("neg_upto") - F.col("neg") / 2
    area = ratio(
        F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg").cast("double")
    )
    return _long(ranked.groupBy(*by).agg(area.alias("auc_roc")), by, ["auc_roc"], digits)


def roc_curve(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    positive: object = 1,
    sort_bound: int = SORT_BOUND,
) -> DataFrame:
    """``(by…, threshold, fpr, tpr)`` at every distinct score, and the origin at infinity."""
    by = list(by)
    counted, ranges = _by_score(df, by, label, score, positive, sort_bound)
    ranked = running_totals(counted, by, "score", ["pos", "neg"], ranges, descending=True)
    totals = counted.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if by:
        points = ranked.join(totals, by)
    else:
        sums = totals.select(F.struct("all_pos", "all_neg")).scalar()
        points = ranked.withColumn("all_pos", sums["all_pos"]).withColumn("all_neg", sums["all_neg"])
    curve = points.select(
        *by, F.col("score").alias("threshold"),
        ratio(F.col("neg_upto"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("pos_upto"), F.col("all_pos")).alias("tpr"),
    )
    origin = totals.select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return curve.unionByName(origin)


def log_loss(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score",
    positive: object = 1,
) -> DataFrame:
    """``(by…, metric="log_loss", value)`` with probabilities clipped away from 0 and 1."""
    floor = PROBABILITY_FLOOR
    p = clipped(F.nanvl(col(score).cast("double"), F.lit(None)), floor, 1.0 - floor)
    loss = -F.when(col(label) == F.lit(positive), F.ln(p)).otherwise(F.ln(1 - p))
    # avg skips rows without a score
    return _long(df.groupBy(*by).agg(F.avg(loss).alias("log_loss")), by, ["log_loss"])


def baseline_classification(
    df: DataFrame, by: Sequence[str] = (), label: str = "label"
) -> DataFrame:
    """``(by…, metric="baseline_accuracy", value)``: accuracy of always naming the largest class."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(ratio(F.max("n"), F.sum("n")).alias("baseline_accuracy"))
    return _long(best, by, ["baseline_accuracy"])


# ── regression ──


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prediction: str = "prediction",
    digits: int = 4,
) -> DataFrame:
    """``(by…, metric, value)``: r2, rmse, mae, mape (non-zero truth only) and rmse_relative."""
    data = denan(
        df.select(
            *[col(b) for b in by],
            col(label).cast("double").alias("y"),
            col(prediction).cast("double").alias("p"),
        )
    ).filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    y, error = F.col("y"), F.col("y") - F.col("p")
    residual = F.sum(error * error)
    total = F.var_pop(y) * F.count(y)
    wide = data.groupBy(*by).agg(
        F.when(total > 0, 1 - F.try_divide(residual, total))
        .otherwise(F.when(residual == 0, 1.0).otherwise(0.0)).alias("r2"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(F.when(y != 0, F.abs(F.try_divide(error, y)))).alias("mape"),
        F.try_divide(F.sqrt(F.avg(error * error)), F.avg(F.abs(y))).alias("rmse_relative"),
    )
    return _long(wide, by, ["r2", "rmse", "mae", "mape", "rmse_relative"], digits)


def baseline_regression(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """``(by…, metric, value)``: error of always predicting the mean, and its R² of 0."""
    wide = df.groupBy(*by).agg(
        F.stddev_pop(col(label).cast("double")).alias("baseline_rmse"),
        F.lit(0.0).alias("baseline_r2"),
    )
    return _long(wide, by, ["baseline_rmse", "baseline_r2"])


def with_residual(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("residual", col(label).cast("double") - col(prediction).cast("double"))


def residual_histogram(
    df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30
) -> DataFrame:
    return histogram(with_residual(df, label, prediction), ["residual"], bins)


def actual_vs_predicted(
    df: DataFrame, key: str, label: str = "label", prediction: str = "prediction",
    share: float = 1.0,
) -> DataFrame:
    """``(key, actual, predicted, low, high)``: chart points and the common range of both axes.

    ``share`` below 1 draws that share of the points by a hash of the key; the range
    always covers all rows.
    """
    points = df.select(
        col(key), col(label).cast("double").alias("actual"),
        col(prediction).cast("double").alias("predicted"),
    )
    span = points.agg(
        F.struct(
            F.least(F.min("actual"), F.min("predicted")).alias("low"),
            F.greatest(F.max("actual"), F.max("predicted")).alias("high"),
        )
    ).scalar()
    if share < 1.0:
        points = points.filter(slot(key_text(key)) < round(share * SLOTS))
    return points.select("*", span["low"].alias("low"), span["high"].alias("high"))


# ── comparison, criteria, segments ──


def model_comparison(scores: DataFrame) -> DataFrame:
    """``(model, folds, cv_mean, cv_std, rank, is_best)`` from ``(model, fold, score)``.

    Models rank by their plain mean; the shown mean is rounded.
    """
    table = scores.filter(F.col("score").isNotNull()).groupBy("model").agg(
        F.count("*").alias("folds"),
        F.avg("score").alias("mean"),
        rounded(F.stddev_pop("score")).alias("cv_std"),
    )
    # One row per model.
    rank = F.row_number().over(Window.orderBy(F.col("mean").desc(), "model")).cast("bigint")
    return table.select("model", "folds", rounded(F.col("mean")).alias("cv_mean"), "cv_std", rank.alias("rank")
                        ).withColumn("is_best", F.col("rank") == 1)


def criteria_table(spark: SparkSession, task_type: str, criteria: dict | None = None,
                   aliases: bool = True) -> DataFrame:
    """``(criterion, metric, threshold, lower_is_better)``; defaults by task type."""
    chosen = DEFAULT_CRITERIA.get(task_type, OTHER_CRITERIA) if criteria is None else criteria
    rows = []
    for name, threshold in chosen.items():
        metric = METRIC_ALIASES.get(name, name) if aliases else name
        rows.append((name, metric, float(threshold), metric in LOWER_IS_BETTER))
    schema = "criterion string, metric string, threshold double, lower_is_better boolean"
    return spark.createDataFrame(rows, schema).coalesce(1)


def check_criteria(metrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """``(run…, criterion, metric, value, threshold, lower_is_better, met)``.

    Criteria without a metric of that name are skipped.
    """
    joined = metrics.join(F.broadcast(criteria), "metric")
    met = F.when(
        F.col("lower_is_better"), F.col("value") <= F.col("threshold")
    ).otherwise(F.col("value") >= F.col("threshold"))
    return joined.withColumn("met", met)


def success_check(metrics: DataFrame, criteria: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """``(by…, n_checked, n_met, passed)``; a run that no criterion applies to has passed."""
    by = list(by)
    checked = check_criteria(metrics, criteria).groupBy(*by).agg(
        F.count("*").alias("n_checked"), F.count_if("met").alias("n_met")
    )
    runs = metrics.select(*by).distinct()
    return runs.join(checked, by, "left").select(
        *by,
        F.coalesce("n_checked", F.lit(0)).alias("n_checked"),
        F.coalesce("n_met", F.lit(0)).alias("n_met"),
        F.coalesce(F.col("n_met") == F.col("n_checked"), F.lit(True)).alias("passed"),
    )


def segment_gaps(segments: DataFrame, overall: DataFrame) -> DataFrame:
    """``(segment…, metric, value, overall, gap)`` from metric tables by segment and without."""
    whole = overall.select("metric", F.col("value").alias("overall"))
    return segments.join(F.broadcast(whole), "metric").withColumn(
        "gap", rounded(F.col("value") - F.col("overall"))
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``(class, n, weight)`` with weight = rows / (classes * rows of the class)."""
    counts = (
        df.filter(col(label).isNotNull())
        .groupBy(col(label).alias("class")).agg(F.count("*").alias("n"))
    )
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("weight", ratio(totals["rows"], totals["k"] * F.col("n")))


def with_class_weight(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    """Add the balanced class weight to every row.

    The weights of up to ``MATRIX_CLASSES`` classes are broadcast, so the table is not
    shuffled by its label; beyond, the join is left to adaptive execution.
    """
    weights = materialise(class_weights(df, label).select(F.col("class").alias(label), F.col("weight").alias(name)))
    few = weights.limit(MATRIX_CLASSES + 1).count() <= MATRIX_CLASSES
    return df.join(F.broadcast(weights) if few else weights, label, "left").select(*df.columns, name)


# ── clustering and ranking ──


def adjusted_rand(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", cluster: str = "prediction", digits: int = 4
) -> DataFrame:
    """``(by…, metric="adjusted_rand_score", value)`` from the contingency counts."""
    by = list(by)
    cells = confusion_cells(df, by, label, cluster)

    def pairs(n: Column) -> Column:
        n = n.cast("double")
        return n * (n - 1) / 2

    def summed(keys: list[str], name: str) -> DataFrame:
        grouped = cells.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
        return grouped.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias(name))

    both = cells.groupBy(*by).agg(
        F.sum(pairs(F.col("n"))).alias("both"), pairs(F.sum("n")).alias("all_pairs")
    )
    # Groups are brought together by grouping once more, so a NULL group stays a group.
    parts = [both, summed(["label"], "rows"), summed(["prediction"], "columns")]
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    joined = table.groupBy(*by).agg(*[F.max(c).alias(c) for c in ("both", "all_pairs", "rows", "columns")])
    expected = F.try_divide(F.col("rows") * F.col("columns"), F.col("all_pairs"))
    top = F.col("both") - expected
    bottom = (F.col("rows") + F.col("columns")) / 2 - expected
    value = F.when(bottom == 0, 1.0).otherwise(F.try_divide(top, bottom))
    return _long(joined.withColumn("adjusted_rand_score", value), by, ["adjusted_rand_score"], digits)


def ranking_metrics(
    df: DataFrame, query: str, item: str, score: str, relevance: str, k: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by…, metric, value)``: mean ndcg, precision_at_k and recall_at_k over the queries.

    Only the ``k`` best rows of a query by score, and by relevance, are ranked: each
    task keeps its best ``k`` before the shuffle, so a query may hold any number of rows.
    Queries without a relevant item count as 0.
    """
    keys = [*by, query]
    gain = col(relevance).cast("double")

    def top(order: list[Column], name: str) -> DataFrame:
        window = Window.partitionBy(*[col(c) for c in keys]).orderBy(*order)
        best = df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= k)
        discounted = gain / (F.ln(F.col("__rank") + 1) / F.ln(F.lit(2.0)))
        return best.groupBy(*keys).agg(
            F.sum(discounted).alias(f"{name}_gain"), F.count_if(gain > 0).alias(f"{name}_hits")
        )

    found = top([col(score).desc(), col(item).asc()], "found")
    ideal = top([gain.desc(), col(item).asc()], "ideal")
    relevant = df.groupBy(*keys).agg(F.count_if(gain > 0).alias("relevant"))
    joined = found.join(ideal, keys).join(relevant, keys)
    wide = joined.groupBy(*by).agg(
        F.avg(_zero(F.try_divide(F.col("found_gain"), F.col("ideal_gain")))).alias("ndcg"),
        F.avg(F.col("found_hits") / F.lit(float(k))).alias("precision_at_k"),
        F.avg(_zero(ratio(F.col("found_hits"), F.col("relevant")))).alias("recall_at_k"),
    )
    return _long(wide, by, ["ndcg", "precision_at_k", "recall_at_k"])


def combine(*tables: DataFrame) -> DataFrame:
    """Union of metric tables with the same columns."""
    return reduce(DataFrame.unionByName, tables)
