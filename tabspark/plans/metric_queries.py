"""Registered queries: metrics of prediction tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabspark.functions.hashing import key_text, slot, with_fold
from tabspark.operators import clusters_quality as C
from tabspark.operators import metrics as M
from tabspark.plans.common import rounded_doubles, slot_sql, split_sql, table, union_sql

# ── inputs ──


def binary_predictions(spark, sf):
    """``(run, l_orderkey, label, prediction, score)`` from a fixed rule on lineitem."""
    score = F.col("l_discount") * 5 + F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        "l_orderkey",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (score > 0.4).cast("int").alias("prediction"),
        score.alias("score"),
    )


def class_predictions(spark, sf):
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        code.alias("label"),
        (F.col("l_orderkey") % 3).cast("int").alias("prediction"),
    )


def value_predictions(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_extendedprice").alias("label"),
        (F.col("l_quantity") * 1000).alias("prediction"),
    )


def clustered_vectors(spark, sf):
    """Vectors with a cluster by the signs of their first two components."""
    sign = F.col("embedding")
    cluster = (sign[0] > 0).cast("int") * 2 + (sign[1] > 0).cast("int")
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label", cluster.alias("prediction"))


def rule_runs(spark, sf):
    """Predictions of six fixed rules for lineitem, one run each, with split and fold."""
    label = (F.col("l_returnflag") == "R").cast("int")
    flip = 1 - label
    rules = {
        "perfect": label,
        "constant": F.lit(0),
        "inverted": flip,
        "threshold": (F.col("l_discount") * 5 + F.col("l_tax") > 0.4).cast("int"),
        "memory": F.when(F.col("split") == "train", label).otherwise(0),
        "one_fold": F.when(F.col("fold") == 0, label).otherwise(flip),
        "almost": F.when(F.col("l_linenumber") <= 5, label).otherwise(0),
    }
    split = F.when(F.col("slot_is_test"), "test").otherwise("train")
    items = with_fold(table(spark, sf, "lineitem"), "l_orderkey")
    items = items.withColumn(
        "slot_is_test", slot(key_text("l_orderkey")) < 2000
    ).withColumn("split", split)
    runs = F.array(
        *[F.struct(F.lit(n).alias("run"), p.alias("prediction")) for n, p in rules.items()]
    )
    return items.select("split", "fold", label.alias("label"), F.inline(runs))


BINARY = """(SELECT l_linestatus AS run, l_orderkey, CAST(l_returnflag = 'R' AS INTEGER) AS label,
    CAST(l_discount * 5 + l_tax > 0.4 AS INTEGER) AS prediction, l_discount * 5 + l_tax AS score
    FROM lineitem)"""
MULTI = """(SELECT l_linestatus AS run, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
    CAST(l_orderkey % 3 AS INTEGER) AS prediction FROM lineitem)"""
VALUES = """(SELECT l_linestatus AS run, l_orderkey, l_linenumber, l_extendedprice AS label,
    l_quantity * 1000 AS prediction FROM lineitem)"""
CLUSTERED = """(SELECT vec_id, embedding, label, CAST(embedding[1] > 0 AS INTEGER) * 2
    + CAST(embedding[2] > 0 AS INTEGER) AS prediction FROM embeddings)"""
RULE_RUNS = f"""(WITH b AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label,
        {split_sql('l_orderkey')} AS split, {slot_sql('l_orderkey')} % 5 AS fold,
        l_discount * 5 + l_tax > 0.4 AS above, l_linenumber FROM lineitem)
    SELECT split, fold, label, 'perfect' AS run, label AS prediction FROM b
    UNION ALL SELECT split, fold, label, 'constant', 0 FROM b
    UNION ALL SELECT split, fold, label, 'inverted', 1 - label FROM b
    UNION ALL SELECT split, fold, label, 'threshold', CAST(above AS INTEGER) FROM b
    UNION ALL SELECT split, fold, label, 'memory', CASE WHEN split = 'train' THEN label ELSE 0 END FROM b
    UNION ALL SELECT split, fold, label, 'one_fold', CASE WHEN fold = 0 THEN label ELSE 1 - label END FROM b
    UNION ALL SELECT split, fold, label, 'almost', CASE WHEN l_linenumber <= 5 THEN label ELSE 0 END FROM b)"""

# ── queries ──


def clf_metrics(spark, sf):
    return M.classification_metrics(binary_predictions(spark, sf), ["run"], score="score")


def clf_metrics_multi(spark, sf):
    return M.classification_metrics(class_predictions(spark, sf), ["run"])


def roc_auc(spark, sf):
    return M.roc_auc(binary_predictions(spark, sf))


def roc_auc_many_scores(spark, sf):
    """Almost every row has its own score here."""
    orders = table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.col("o_totalprice").alias("score")
    )
    return M.roc_auc(orders, sort_bound=2_000)


def roc_curve(spark, sf):
    return rounded_doubles(M.roc_curve(binary_predictions(spark, sf), ["run"]), 6)


def reg_metrics(spark, sf):
    return M.regression_metrics(value_predictions(spark, sf), ["run"])


def baseline_clf(spark, sf):
    return M.baseline_classification(class_predictions(spark, sf), ["run"])


def baseline_reg(spark, sf):
    return M.baseline_regression(value_predictions(spark, sf), ["run"])


def confusion_matrix(spark, sf):
    return M.confusion_matrix(class_predictions(spark, sf), ["run"])


def class_report(spark, sf):
    return M.class_report(class_predictions(spark, sf))


def worst_class(spark, sf):
    return M.worst_class(class_predictions(spark, sf), ["run"])


def residual_histogram(spark, sf):
    return rounded_doubles(M.residual_histogram(value_predictions(spark, sf)))


def actual_vs_predicted(spark, sf):
    return M.actual_vs_predicted(value_predictions(spark, sf), "l_orderkey")


def success_check(spark, sf):
    metrics = M.combine(
        M.classification_metrics(binary_predictions(spark, sf), ["run"], score="score"),
        M.regression_metrics(value_predictions(spark, sf), ["run"]),
    )
    criteria = M.criteria_table(
        spark, "mixed", {"accuracy": 0.5, "f1_score": 0.8, "mape": 10.0, "rmse": 1.0, "unknown": 1.0}
    )
    checked = M.check_criteria(metrics, criteria).select("run", "metric", "value", "threshold", "met")
    passed = M.success_check(metrics, criteria).select("run", "passed")
    return checked.join(passed, "run")


def fold_scores(spark, sf):
    """Accuracy of every rule by fold, on the training rows."""
    rows = rule_runs(spark, sf).filter("split = 'train'")
    return rows.groupBy("run", "fold").agg(
        F.avg((F.col("label") == F.col("prediction")).cast("int")).alias("score")
    )


def model_comparison(spark, sf):
    return M.model_comparison(fold_scores(spark, sf).withColumnRenamed("run", "model"))


def class_weights(spark, sf):
    return rounded_doubles(M.class_weights(table(spark, sf, "lineitem"), "l_returnflag"), 6)


def adjusted_rand(spark, sf):
    return M.adjusted_rand(clustered_vectors(spark, sf))


def log_loss(spark, sf):
    scored = binary_predictions(spark, sf).withColumn("score", F.col("score") / 0.58)
    return M.log_loss(scored, ["run"])


def silhouette(spark, sf):
    return C.silhouette(clustered_vectors(spark, sf), "embedding")


def calinski_harabasz(spark, sf):
    return C.calinski_harabasz(clustered_vectors(spark, sf), "embedding")


def ranking_metrics(spark, sf):
    kinds = {"purchase": 3, "signup": 2, "click": 1}
    gain = F.lit(0)
    for kind, value in kinds.items():
        gain = F.when(F.col("event_type") == kind, value).otherwise(gain)
    events = table(spark, sf, "events").withColumn("gain", gain)
    return M.ranking_metrics(events, "user_id", "event_id", "value", "gain", k=10)


def segment_bias(spark, sf):
    predictions = binary_predictions(spark, sf)
    return M.segment_gaps(
        M.classification_metrics(predictions, ["run"], score="score"),
        M.classification_metrics(predictions, score="score"),
    )


QUERIES = {
    "clf_metrics": clf_metrics,
    "clf_metrics_multi": clf_metrics_multi,
    "roc_auc": roc_auc,
    "roc_auc_many_scores": roc_auc_many_scores,
    "roc_curve": roc_curve,
    "reg_metrics": reg_metrics,
    "baseline_clf": baseline_clf,
    "baseline_reg": baseline_reg,
    "confusion_matrix": confusion_matrix,
    "class_report": class_report,
    "worst_class": worst_class,
    "residual_histogram": residual_histogram,
    "actual_vs_predicted": actual_vs_predicted,
    "success_check": success_check,
    "model_comparison": model_comparison,
    "class_weights": class_weights,
    "adjusted_rand": adjusted_rand,
    "log_loss": log_loss,
    "silhouette": silhouette,
    "calinski_harabasz": calinski_harabasz,
    "ranking_metrics": ranking_metrics,
    "segment_bias": segment_bias,
}

# ── SQL twins ──


def classes_sql(source: str, by: str = "run") -> str:
    """Per-class support, predictions, hits, precision, recall and F1."""
    lead = f"{by}, " if by else ""
    return f"""(WITH cells AS (SELECT {lead}label, prediction, count(*) AS n FROM {source} GROUP BY ALL),
    c AS (SELECT {lead}class, sum(s) AS support, sum(p) AS predicted, sum(h) AS hits FROM (
        SELECT {lead}label AS class, n AS s, 0 AS p, CASE WHEN label = prediction THEN n ELSE 0 END AS h FROM cells
        UNION ALL SELECT {lead}prediction, 0, n, 0 FROM cells) GROUP BY ALL)
    SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision,
        coalesce(hits / nullif(support, 0), 0) AS recall,
        coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1 FROM c)"""


def metrics_sql(source: str, binary: bool, score: bool = False, by: str = "run") -> str:
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    items = {"accuracy": "sum(hits) / sum(support)"}
    items |= {f"{m}_weighted": f"sum({m} * support) / sum(support)" for m in ("precision", "recall", "f1")}
    if binary:
        items |= {m: f"coalesce(max(CASE WHEN class = 1 THEN {m} END), 0)" for m in ("f1", "precision", "recall")}
    else:
        items["f1_macro"] = "avg(f1)"
    parts = [
        f"SELECT {lead}'{name}' AS metric, round({expr}, 4) AS value FROM {classes_sql(source, by)}{group}"
        for name, expr in items.items()
    ]
    if score:
        parts.append(auc_sql(source, by))
    return union_sql(parts)


def auc_sql(source: str, by: str = "run") -> str:
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {lead}'auc_roc' AS metric, round(sum(pos * (upto - neg / 2)) / (sum(pos) * sum(neg)), 4) AS value
FROM (SELECT *, sum(neg) OVER ({part}ORDER BY score) AS upto FROM (
    SELECT {lead}score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
    FROM {source} GROUP BY ALL)){group}"""


def _regression_sql() -> str:
    mean = f"(SELECT *, avg(label) OVER (PARTITION BY run) AS centre FROM {VALUES})"
    items = {
        "r2": "1 - sum((label - prediction) ** 2) / sum((label - centre) ** 2)",
        "rmse": "sqrt(avg((label - prediction) ** 2))",
        "mae": "avg(abs(label - prediction))",
        "mape": "avg(abs((label - prediction) / label)) FILTER (WHERE label <> 0)",
        "rmse_relative": "sqrt(avg((label - prediction) ** 2)) / avg(abs(label))",
    }
    return union_sql(
        [f"SELECT run, '{m}' AS metric, round({e}, 4) AS value FROM {mean} GROUP BY run"
         for m, e in items.items()]
    )


_CRITERIA = """(VALUES ('accuracy', 0.5, false), ('f1', 0.8, false), ('mape', 10.0, true),
    ('rmse', 1.0, true), ('unknown', 1.0, false)) c(metric, threshold, lower)"""
_DISTANCE = """(WITH v AS (SELECT vec_id, prediction, unnest(range(64)) AS d,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM {source}),
    s AS (SELECT prediction AS k, d, sum(x) AS sx FROM v GROUP BY ALL),
    q AS (SELECT prediction AS k, count(DISTINCT vec_id) AS n, sum(x * x) AS sq FROM v GROUP BY ALL),
    own AS (SELECT vec_id, prediction, sum(x * x) AS xx FROM v GROUP BY ALL),
    dots AS (SELECT v.vec_id, s.k, sum(v.x * s.sx) AS xs FROM v JOIN s USING (d) GROUP BY ALL)
    SELECT vec_id, prediction, k, n, own.xx + q.sq / n - 2 * xs / n AS mean_distance
    FROM dots JOIN own USING (vec_id) JOIN q USING (k))""".replace("{source}", CLUSTERED)
_GAIN = "CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 WHEN 'click' THEN 1 ELSE 0 END"

FOLD_SCORES = f"""(SELECT run, fold, avg(CAST(label = prediction AS INTEGER)) AS score
    FROM {RULE_RUNS} WHERE split = 'train' GROUP BY ALL)"""

ORACLE = {
    "clf_metrics": metrics_sql(BINARY, binary=True, score=True),
    "clf_metrics_multi": union_sql(
        [
            metrics_sql(f"(SELECT * FROM {MULTI} WHERE run IN (SELECT run FROM {MULTI} GROUP BY run "
                        f"HAVING count(DISTINCT label) {test}))", binary)
            for test, binary in (("= 2", True), ("<> 2", False))
        ]
    ),
    "roc_auc": auc_sql(BINARY, by=""),
    "roc_auc_many_scores": auc_sql(
        "(SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS label, o_totalprice AS score FROM orders)", by=""
    ),
    "roc_curve": f"""WITH s AS (SELECT run, score, count(*) FILTER (WHERE label = 1) AS pos,
        count(*) FILTER (WHERE label = 0) AS neg FROM {BINARY} GROUP BY ALL)
SELECT run, round(score, 6) AS threshold,
    round(sum(neg) OVER (PARTITION BY run ORDER BY score DESC) / sum(neg) OVER (PARTITION BY run), 6) AS fpr,
    round(sum(pos) OVER (PARTITION BY run ORDER BY score DESC) / sum(pos) OVER (PARTITION BY run), 6) AS tpr
FROM s UNION ALL SELECT DISTINCT run, CAST('infinity' AS DOUBLE), 0.0, 0.0 FROM s""",
    "reg_metrics": _regression_sql(),
    "baseline_clf": f"""SELECT run, 'baseline_accuracy' AS metric, round(max(n) / sum(n), 4) AS value
FROM (SELECT run, label, count(*) AS n FROM {MULTI} GROUP BY ALL) GROUP BY run""",
    "baseline_reg": f"""SELECT run, 'baseline_rmse' AS metric, round(stddev_pop(label), 4) AS value FROM {VALUES} GROUP BY run
UNION ALL SELECT DISTINCT run, 'baseline_r2', 0.0 FROM {VALUES}""",
    "confusion_matrix": f"""WITH p AS (SELECT * FROM {MULTI}),
    k AS (SELECT DISTINCT run, class FROM (SELECT run, label AS class FROM p UNION ALL SELECT run, prediction FROM p))
SELECT a.run, a.class AS label, b.class AS prediction, count(p.run) AS n FROM k a JOIN k b USING (run)
LEFT JOIN p ON p.run = a.run AND p.label = a.class AND p.prediction = b.class GROUP BY ALL""",
    "class_report": f"""WITH c AS (SELECT * FROM {classes_sql(MULTI, "")})
SELECT CAST(class AS VARCHAR) AS class, round(precision, 4) AS precision, round(recall, 4) AS recall,
    round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM c
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 4), round(sum(hits) / sum(support), 4),
    round(sum(hits) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
    CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
    round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
    CAST(sum(support) AS BIGINT) FROM c""",
    "worst_class": f"""SELECT run, class, round(recall, 4) AS accuracy,
    row_number() OVER (PARTITION BY run ORDER BY recall, class) = 1 AS is_worst
FROM {classes_sql(MULTI)} WHERE support > 0""",
    "residual_histogram": f"""WITH r AS (SELECT label - prediction AS x FROM {VALUES}),
    s AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 30 AS w FROM r),
    v AS (SELECT least(CAST(floor((x - lo) / w) AS BIGINT), 29) AS bin, count(*) AS n FROM r, s GROUP BY 1)
SELECT 'residual' AS "column", CAST(b.bin AS BIGINT) AS bin, round(lo + b.bin * w, 4) + 0.0 AS lower,
    round(lo + (b.bin + 1) * w, 4) + 0.0 AS upper, coalesce(n, 0) AS n
FROM range(30) b(bin) CROSS JOIN s LEFT JOIN v ON v.bin = b.bin""",
    "actual_vs_predicted": f"""SELECT l_orderkey, label AS actual, prediction AS predicted,
    least(min(label) OVER (), min(prediction) OVER ()) AS low,
    greatest(max(label) OVER (), max(prediction) OVER ()) AS high FROM {VALUES}""",
    "success_check": f"""WITH m AS ({metrics_sql(BINARY, True, True)} UNION ALL {_regression_sql()}),
    k AS (SELECT run, m.metric, value, CAST(threshold AS DOUBLE) AS threshold,
        CASE WHEN lower THEN value <= threshold ELSE value >= threshold END AS met
        FROM m JOIN {_CRITERIA} ON m.metric = c.metric)
SELECT run, metric, value, threshold, met, bool_and(met) OVER (PARTITION BY run) AS passed FROM k""",
    "model_comparison": f"""SELECT model, folds, cv_mean, cv_std, row_number() OVER (ORDER BY cv_mean DESC, model) AS rank,
    row_number() OVER (ORDER BY cv_mean DESC, model) = 1 AS is_best
FROM (SELECT run AS model, count(*) AS folds, round(avg(score), 4) AS cv_mean,
    round(stddev_pop(score), 4) AS cv_std FROM {FOLD_SCORES} GROUP BY run)""",
    "class_weights": """SELECT class, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
FROM (SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1)""",
    "adjusted_rand": f"""WITH c AS (SELECT label, prediction, count(*) AS n FROM {CLUSTERED} GROUP BY ALL),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS joint,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY label)) AS r,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY prediction)) AS k,
    (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT 'adjusted_rand_score' AS metric, round((joint - r * k / t) / ((r + k) / 2 - r * k / t), 4) AS value FROM s""",
    "log_loss": f"""SELECT run, 'log_loss' AS metric, round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 4) AS value
FROM (SELECT *, greatest(2.220446049250313e-16, least(1.0 - 2.220446049250313e-16, score / 0.58)) AS p FROM {BINARY})
GROUP BY run""",
    "silhouette": f"""WITH d AS (SELECT * FROM {_DISTANCE}),
    p AS (SELECT vec_id, max(CASE WHEN k = prediction THEN n END) AS own_n,
        max(CASE WHEN k = prediction THEN mean_distance * n / nullif(n - 1, 0) END) AS a,
        min(CASE WHEN k <> prediction THEN mean_distance END) AS b FROM d GROUP BY vec_id)
SELECT 'silhouette_score' AS metric,
    round(avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS value FROM p""",
    "calinski_harabasz": f"""WITH v AS (SELECT vec_id, prediction AS k, unnest(range(64)) AS d,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM {CLUSTERED}),
    g AS (SELECT k, d, count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS ss FROM v GROUP BY ALL),
    o AS (SELECT d, avg(x) AS c FROM v GROUP BY d),
    t AS (SELECT count(DISTINCT k) AS kk, count(DISTINCT vec_id) AS nn FROM v)
SELECT 'calinski_harabasz' AS metric,
    round((sum(n * (m - c) ** 2) / (max(kk) - 1)) / (sum(ss) / (max(nn) - max(kk))), 4) AS value
FROM g JOIN o USING (d), t""",
    "ranking_metrics": f"""WITH e AS (SELECT user_id, {_GAIN} AS gain,
        row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r,
        row_number() OVER (PARTITION BY user_id ORDER BY {_GAIN} DESC, event_id) AS i FROM events),
    q AS (SELECT user_id, coalesce(sum(gain / log2(r + 1)) FILTER (WHERE r <= 10), 0) AS dcg,
        sum(gain / log2(i + 1)) FILTER (WHERE i <= 10) AS best,
        count(*) FILTER (WHERE r <= 10 AND gain > 0) AS hits,
        count(*) FILTER (WHERE gain > 0) AS relevant FROM e GROUP BY user_id)
SELECT 'ndcg' AS metric, round(avg(coalesce(dcg / nullif(best, 0), 0)), 4) AS value FROM q
UNION ALL SELECT 'precision_at_k', round(avg(hits / 10), 4) FROM q
UNION ALL SELECT 'recall_at_k', round(avg(coalesce(hits / nullif(relevant, 0), 0)), 4) FROM q""",
    "segment_bias": f"""WITH s AS ({metrics_sql(BINARY, True, True)}), o AS ({metrics_sql(BINARY, True, True, "")})
SELECT s.run, metric, s.value, o.value AS overall, round(s.value - o.value, 4) + 0.0 AS gap
FROM s JOIN o USING (metric)""",
}
