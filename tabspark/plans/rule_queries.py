"""Registered queries: diagnosis, review, text tags and report facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.scratch import materialise
from tabspark.operators import explore as E
from tabspark.operators import metrics as M
from tabspark.operators import profile as P
from tabspark.operators import report as R
from tabspark.operators import review as V
from tabspark.operators import rules as D
from tabspark.operators import tags as T
from tabspark.operators.prepare import with_split
from tabspark.plans.common import split_sql, table, union_sql
from tabspark.plans.metric_queries import (
    FOLD_SCORES,
    RULE_RUNS,
    VALUES,
    fold_scores,
    metrics_sql,
    rule_runs,
    value_predictions,
)

CRITERIA = {"accuracy": 0.9, "f1_score": 0.8}


def run_metrics(spark, sf):
    """Test metrics and baseline of every rule run."""
    test = rule_runs(spark, sf).filter("split = 'test'")
    return M.combine(
        M.classification_metrics(test, ["run"], task="binary"),
        M.baseline_classification(test, ["run"]),
    )


def saved_metrics(spark, sf):
    """The metric table (runs x metrics rows), saved because rules read it several times."""
    return materialise(run_metrics(spark, sf))


def saved_scores(spark, sf):
    return materialise(fold_scores(spark, sf))


def _diagnosis(metrics, scores):
    criteria = M.criteria_table(metrics.sparkSession, "binary_classification", CRITERIA)
    return D.diagnose(metrics, scores, criteria)


def diagnose_runs(spark, sf):
    return _diagnosis(saved_metrics(spark, sf), fold_scores(spark, sf))


def diagnose_regression(spark, sf):
    criteria = M.criteria_table(spark, "regression")
    metrics = M.regression_metrics(value_predictions(spark, sf), ["run"])
    return D.diagnose(metrics, None, criteria, task="regression")


def run_verdict(spark, sf):
    metrics = saved_metrics(spark, sf)
    return D.run_verdict(_diagnosis(metrics, fold_scores(spark, sf)), metrics)


def leakage_by_correlation(spark, sf):
    part = table(spark, sf, "part").withColumn(
        "p_price_twin", F.col("p_retailprice") * 2 + F.col("p_size")
    )
    return V.leakage_by_correlation(E.correlation_matrix(part), "p_retailprice").drop("value")


def review_data(spark, sf):
    """Findings about the data of three tables."""
    tables = {
        "region": table(spark, sf, "region"),
        "customer": table(spark, sf, "customer"),
        "part": table(spark, sf, "part").select(
            "p_partkey", *[F.when(F.col("p_partkey") % 3 == 0, F.col(c)).alias(c)
                           for c in ("p_size", "p_retailprice")]
        ),
    }
    profiles = reduce(
        DataFrame.unionByName,
        [P.column_profile(df).withColumn("table", F.lit(name)) for name, df in tables.items()],
    )
    return V.review_data(profiles)


def review_split(spark, sf):
    """Findings about a split of all orders, by status."""
    orders = with_split(table(spark, sf, "orders"), "o_orderkey", test_size=0.05)
    sizes = orders.groupBy(F.col("o_orderstatus").alias("subject")).agg(
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "test").alias("test_size"),
        F.lit(5).alias("n_features"),
    )
    return V.review_split(sizes)


def review_runs(spark, sf):
    """Findings about the scores and metrics of all rule runs."""
    metrics = saved_metrics(spark, sf)
    runs = metrics.select("run").distinct().unionByName(
        table(spark, sf, "region").select(F.col("r_name").alias("run"))
    )
    scores = saved_scores(spark, sf).withColumn("model", F.concat("run", F.col("fold") % 2))
    scores = scores.withColumn("model", F.when(F.col("run") == "perfect", "one").otherwise(F.col("model")))
    scored = scores.filter("run <> 'inverted'")
    return V.review_training(runs, scored).unionByName(V.review_metrics(runs, metrics))


def review_findings(spark, sf):
    """Findings about three tables, a split and all rule runs."""
    return reduce(DataFrame.unionByName, [part(spark, sf) for part in (review_data, review_split, review_runs)])


def review_verdict(spark, sf):
    findings = materialise(review_findings(spark, sf))
    return V.review_verdict(findings, findings)


def statements(spark, sf):
    """One problem statement per part and per order, by templates."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.expr("""CASE p_partkey % 8
            WHEN 0 THEN concat('Predict the price of ', p_type, '. Goal is ', p_brand, '.')
            WHEN 1 THEN concat('We want to detect fraud in ', p_name, ' loans')
            WHEN 2 THEN concat('Objective: rank ', p_name, ' by relevance.\nNeed to search images of ', p_type)
            WHEN 3 THEN concat('Cluster the customer cohort of ', p_brand, ' into segment groups.')
            WHEN 4 THEN concat('Anomaly and novelty in sensor telemetry of ', p_name)
            WHEN 5 THEN concat('AIM IS  to suggest ', p_type, ' . Recommend products. trying to  sell. need to buy. purpose: a. goal: b. predict c')
            WHEN 6 THEN concat('Seasonal trend, temporal time series of ', p_name, ' patients')
            ELSE concat(p_name, ' ', p_brand, ' ', repeat('x', 220)) END""").alias("text"),
    )
    return part


def tag_task_type(spark, sf):
    return T.tag_statements(statements(spark, sf), "text").select("id", "task_type")


def tag_domain(spark, sf):
    return T.tag_statements(statements(spark, sf), "text").select("id", "domain")


def tag_objectives(spark, sf):
    tagged = T.tag_statements(statements(spark, sf), "text")
    return tagged.select("id", F.posexplode("objectives").alias("place", "objective"))


def tag_task_type_texts(spark, sf):
    """The tags over the long texts of documents, whole."""
    documents = table(spark, sf, "documents")
    return documents.select("doc_id", T.task_type(F.col("text")).alias("task_type"),
                            T.domain(F.col("text")).alias("domain"))


def report_facts(spark, sf):
    profile = P.column_profile(table(spark, sf, "orders"))
    metrics, scores = saved_metrics(spark, sf), saved_scores(spark, sf)
    diagnosis = materialise(_diagnosis(metrics, scores))
    verdict = D.run_verdict(diagnosis, metrics)
    comparison = M.model_comparison(scores.withColumnRenamed("run", "model"))
    criteria = M.criteria_table(spark, "binary_classification", CRITERIA)
    outliers = E.iqr_outliers(table(spark, sf, "events"), ["value"])
    four = "%.4f"
    return R.report(
        R.status_facts(verdict),
        R.step_facts(diagnosis),
        R.criteria_facts(criteria, "orders"),
        R.wide_facts(
            P.profile_totals(profile).select("n_rows", "n_columns", "numeric_columns", "missing_total"),
            "data", "orders",
        ),
        R.facts(outliers, "exploration", F.col("column"), "n_outliers", F.col("n_outliers")),
        R.facts(comparison, "modelling", F.col("model"), "cv_mean", F.format_string(four, F.col("cv_mean"))),
        R.facts(metrics, "evaluation", F.col("run"), F.col("metric"), F.format_string(four, F.col("value"))),
        R.facts(diagnosis, "diagnosis", F.col("run"), F.col("type"), F.col("severity")),
    )


QUERIES = {
    "diagnose_runs": diagnose_runs,
    "diagnose_regression": diagnose_regression,
    "run_verdict": run_verdict,
    "leakage_by_correlation": leakage_by_correlation,
    "review_data": review_data,
    "review_split": review_split,
    "review_runs": review_runs,
    "review_findings": review_findings,
    "review_verdict": review_verdict,
    "tag_task_type": tag_task_type,
    "tag_domain": tag_domain,
    "tag_objectives": tag_objectives,
    "tag_texts": tag_task_type_texts,
    "report_facts": report_facts,
}

# ── SQL twins ──

_TEST = f"(SELECT * FROM {RULE_RUNS} WHERE split = 'test')"
_METRICS = f"""({metrics_sql(_TEST, binary=True)}
UNION ALL SELECT run, 'baseline_accuracy', round(max(n) / sum(n), 4)
    FROM (SELECT run, label, count(*) AS n FROM {_TEST} GROUP BY ALL) GROUP BY run)"""
_CRITERIA = "(VALUES ('accuracy', 0.9), ('f1', 0.8)) k(metric, threshold)"

_DIAGNOSIS = f"""(WITH m AS (SELECT * FROM {_METRICS}),
    w AS (SELECT run, max(value) FILTER (WHERE metric = 'accuracy') AS acc,
        max(value) FILTER (WHERE metric = 'f1_weighted') AS f1w,
        max(value) FILTER (WHERE metric = 'baseline_accuracy') AS base FROM m GROUP BY run),
    s AS (SELECT run, avg(score) AS cv, stddev_pop(score) AS sd FROM {FOLD_SCORES} GROUP BY run),
    f AS (SELECT * FROM w LEFT JOIN s USING (run))
SELECT run, CASE WHEN cv - f1w > 0.1 THEN 'overfitting' ELSE 'mild_overfitting' END AS type,
    CASE WHEN cv - f1w > 0.1 THEN 'error' ELSE 'warning' END AS severity, 'cv_gap' AS metric,
    round(cv - f1w, 4) AS value, CASE WHEN cv - f1w > 0.1 THEN 0.1 ELSE 0.05 END::DOUBLE AS threshold
    FROM f WHERE cv - f1w > 0.05
UNION ALL SELECT run, 'underfitting', 'error', 'test_score', round(f1w, 4), 0.5 FROM f WHERE cv < 0.5 AND f1w < 0.5
UNION ALL SELECT run, 'high_cv_variance', 'warning', 'cv_spread', round(sd / cv, 4), 0.15
    FROM f WHERE cv > 0 AND sd / cv > 0.15
UNION ALL SELECT run, 'below_baseline', 'critical', 'accuracy', acc, base FROM f WHERE acc <= base
UNION ALL SELECT run, 'marginal_improvement', 'warning', 'accuracy', acc, base
    FROM f WHERE acc > base AND acc - base < 0.02
UNION ALL SELECT run, 'class_imbalance_effect', 'warning', 'accuracy_f1_gap', round(abs(acc - f1w), 4), 0.1
    FROM f WHERE acc > 0 AND f1w > 0 AND abs(acc - f1w) > 0.1
UNION ALL SELECT run, 'success_criteria_not_met', 'error', m.metric, value, CAST(threshold AS DOUBLE)
    FROM m JOIN {_CRITERIA} ON m.metric = k.metric WHERE value < threshold)"""

_VERDICT = f"""(SELECT r.run, count(d.run) AS n_issues, count(d.run) FILTER (WHERE severity = 'critical') AS n_critical,
    count(d.run) FILTER (WHERE severity = 'error') AS n_error,
    count(d.run) FILTER (WHERE severity IN ('critical', 'error')) = 0 AS acceptable
FROM (SELECT DISTINCT run FROM {RULE_RUNS}) r LEFT JOIN {_DIAGNOSIS} d ON d.run = r.run GROUP BY r.run)"""

_PART3 = """(SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS p_size,
    CASE WHEN p_partkey % 3 = 0 THEN p_retailprice END AS p_retailprice FROM part)"""

_REVIEW = f"""(WITH runs AS (SELECT DISTINCT run FROM {RULE_RUNS} UNION SELECT r_name FROM region),
    m AS (SELECT * FROM {_METRICS}),
    sc AS (SELECT run, CASE WHEN run = 'perfect' THEN 'one' ELSE concat(run, fold % 2) END AS model
        FROM {FOLD_SCORES} WHERE run <> 'inverted'),
    t AS (SELECT runs.run, count(DISTINCT model) AS models FROM runs LEFT JOIN sc ON sc.run = runs.run GROUP BY ALL),
    z AS (SELECT o_orderstatus AS subject, count(*) FILTER (WHERE {split_sql('o_orderkey', 0.05)} = 'train') AS tr,
        count(*) FILTER (WHERE {split_sql('o_orderkey', 0.05)} = 'test') AS te FROM orders GROUP BY ALL),
    e AS (SELECT runs.run, count(m.metric) AS n FROM runs LEFT JOIN m ON m.run = runs.run GROUP BY ALL)
SELECT 'region' AS subject, 'few_rows' AS rule, 'warning' AS severity, 'data' AS category, '' AS detail,
    CAST(count(*) AS DOUBLE) AS value, CAST(100 AS DOUBLE) AS threshold FROM region HAVING count(*) < 100
UNION ALL SELECT 'part', 'high_missing', 'warning', 'data', '',
    round((2 * count(*) - count(p_size) - count(p_retailprice)) / (3 * count(*)), 4), 0.3 FROM {_PART3}
    HAVING (2 * count(*) - count(p_size) - count(p_retailprice)) / (3 * count(*)) > 0.3
UNION ALL SELECT 'customer', 'many_categories', 'info', 'data', 'c_name', CAST(count(DISTINCT c_name) AS DOUBLE), 100
    FROM customer HAVING count(DISTINCT c_name) > 100
UNION ALL SELECT 'customer', 'many_categories', 'info', 'data', 'c_mktsegment', CAST(count(DISTINCT c_mktsegment) AS DOUBLE), 100
    FROM customer HAVING count(DISTINCT c_mktsegment) > 100
UNION ALL SELECT subject, 'small_test_set', 'warning', 'methodology', '', round(te / (te + tr), 4), 0.1 FROM z WHERE te / (te + tr) < 0.1
UNION ALL SELECT subject, 'few_rows_per_feature', 'warning', 'methodology', '', round(tr / 5, 4), 10 FROM z WHERE tr / 5 < 10
UNION ALL SELECT run, 'no_cross_validation', 'warning', 'methodology', '', 0, 1 FROM t WHERE models = 0
UNION ALL SELECT run, 'one_model', 'info', 'methodology', '', models, 2 FROM t WHERE models < 2
UNION ALL SELECT run, 'no_metrics', 'error', 'evaluation', '', 0, 1 FROM e WHERE n = 0
UNION ALL SELECT run, 'no_baseline', 'info', 'methodology', '', 0, 1 FROM e WHERE n = 0
UNION ALL SELECT run, 'perfect_score', 'critical', 'data_leakage', metric, value, 0.999 FROM m
    WHERE metric IN ('accuracy', 'f1', 'auc_roc', 'r2', 'f1_weighted') AND value >= 0.999)"""

_STATEMENTS = """(SELECT p_partkey AS id, CASE p_partkey % 8
    WHEN 0 THEN concat('Predict the price of ', p_type, '. Goal is ', p_brand, '.')
    WHEN 1 THEN concat('We want to detect fraud in ', p_name, ' loans')
    WHEN 2 THEN concat('Objective: rank ', p_name, ' by relevance.', chr(10), 'Need to search images of ', p_type)
    WHEN 3 THEN concat('Cluster the customer cohort of ', p_brand, ' into segment groups.')
    WHEN 4 THEN concat('Anomaly and novelty in sensor telemetry of ', p_name)
    WHEN 5 THEN concat('AIM IS  to suggest ', p_type, ' . Recommend products. trying to  sell. need to buy. purpose: a. goal: b. predict c')
    WHEN 6 THEN concat('Seasonal trend, temporal time series of ', p_name, ' patients')
    ELSE concat(p_name, ' ', p_brand, ' ', repeat('x', 220)) END AS text FROM part)"""


def _task_sql(source: str, key: str) -> str:
    def hits(fragments) -> str:
        return " + ".join(f"CAST(contains(lower(text), '{f}') AS INTEGER)" for f in fragments)

    scores = ", ".join(f"{hits(f)} AS {t}" for t, f in T.TASK_FRAGMENTS.items())
    best = f"greatest({', '.join(T.TASK_FRAGMENTS)})"
    cases = " ".join(f"WHEN {t} = {best} THEN '{t}'" for t in T.TASK_FRAGMENTS)
    return (f"SELECT {key}, CASE WHEN {best} = 0 THEN '{T.DEFAULT_TASK}' {cases} END AS task_type "
            f"FROM (SELECT {key}, {scores} FROM {source})")


def _domain_sql(source: str, key: str) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join(f'contains(lower(text), {chr(39)}{f}{chr(39)})' for f in fragments)} THEN '{d}'"
        for d, fragments in T.DOMAIN_FRAGMENTS.items()
    )
    return f"SELECT {key}, CASE {cases} ELSE '{T.DEFAULT_DOMAIN}' END AS domain FROM {source}"


def _objectives_sql() -> str:
    found = " || ".join(
        f"regexp_extract_all(text, '(?i){p.replace(chr(39), chr(39) * 2)}', 1)" for p in T.OBJECTIVE_PATTERNS
    )
    return f"""WITH o AS (SELECT id, text, list_filter(list_transform({found},
        lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS found FROM {_STATEMENTS}),
    l AS (SELECT id, list_slice(CASE WHEN len(found) > 0 THEN found
        ELSE [concat('Solve: ', substring(text, 1, 200))] END, 1, 5) AS kept FROM o)
SELECT id, unnest(range(len(kept))) AS place, unnest(kept) AS objective FROM l"""


def _worded(findings: str) -> str:
    steps = " ".join(f"WHEN '{kind}' THEN '{text}'" for kind, text in D.STEPS.items())
    return f"""SELECT *, printf('%s is %.4f, the limit is %.4f', metric, value, threshold) AS description,
    printf('%s to move %s by %.4f', CASE type {steps} ELSE 'look at the rows behind it' END, metric,
        round(threshold - value, 4)) AS recommendation FROM {findings}"""


def _reviewed(where: str = "true") -> str:
    cases = " ".join(f"WHEN '{rule}' THEN '{text}'" for rule, text in V.RECOMMENDATIONS.items())
    return f"SELECT *, CASE rule {cases} END AS recommendation FROM {_REVIEW} WHERE {where}"


_DATA_RULES = "rule IN ('few_rows', 'high_missing', 'many_categories')"
_SPLIT_RULES = "rule IN ('small_test_set', 'few_rows_per_feature')"


def _steps_sql() -> str:
    return f"""SELECT 'conclusion' AS section, run AS subject, concat(type, ':', metric) AS name, recommendation AS value
FROM ({_worded(_DIAGNOSIS)})"""


ORACLE = {
    "diagnose_runs": _worded(_DIAGNOSIS),
    "diagnose_regression": _worded(f"""(WITH m AS (SELECT run,
        round(1 - sum((label - prediction) ** 2) / sum((label - c) ** 2), 4) AS r2,
        round(avg(abs((label - prediction) / label)), 4) AS mape
        FROM (SELECT *, avg(label) OVER (PARTITION BY run) AS c FROM {VALUES}) GROUP BY run)
SELECT run, 'below_baseline' AS type, 'critical' AS severity, 'r2' AS metric, r2 AS value, CAST(0 AS DOUBLE) AS threshold
    FROM m WHERE r2 < 0
UNION ALL SELECT run, 'success_criteria_not_met', 'error', 'r2', r2, 0.8 FROM m WHERE r2 < 0.8
UNION ALL SELECT run, 'success_criteria_not_met', 'error', 'mape', mape, 0.15 FROM m WHERE mape > 0.15)"""),
    "run_verdict": f"SELECT * FROM {_VERDICT}",
    "leakage_by_correlation": """WITH p AS (SELECT *, p_retailprice * 2 + p_size AS p_price_twin FROM part),
    c AS (SELECT 'p_partkey' AS detail, corr(p_retailprice, p_partkey) AS r FROM p
    UNION ALL SELECT 'p_size', corr(p_retailprice, p_size) FROM p
    UNION ALL SELECT 'p_price_twin', corr(p_retailprice, p_price_twin) FROM p)
SELECT 'p_retailprice' AS subject, 'leaking_feature' AS rule, 'critical' AS severity, 'data_leakage' AS category,
    detail, 0.95::DOUBLE AS threshold, '""" + V.RECOMMENDATIONS["leaking_feature"] + """' AS recommendation
    FROM c WHERE abs(round(r, 4)) > 0.95""",
    "review_data": _reviewed(_DATA_RULES),
    "review_split": _reviewed(_SPLIT_RULES),
    "review_runs": _reviewed(f"NOT {_DATA_RULES} AND NOT {_SPLIT_RULES}"),
    "review_findings": _reviewed(),
    "review_verdict": f"""SELECT subject, count(*) AS n_findings, count(*) FILTER (WHERE severity = 'critical') AS n_critical,
    count(*) FILTER (WHERE severity = 'error') AS n_error,
    count(*) FILTER (WHERE severity = 'critical') = 0 AS approved FROM {_REVIEW} GROUP BY subject""",
    "tag_task_type": _task_sql(_STATEMENTS, "id"),
    "tag_domain": _domain_sql(_STATEMENTS, "id"),
    "tag_objectives": _objectives_sql(),
    "tag_texts": f"SELECT * FROM ({_task_sql('documents', 'doc_id')}) JOIN ({_domain_sql('documents', 'doc_id')}) USING (doc_id)",
    "report_facts": union_sql(
        [
            f"""SELECT 'summary' AS section, run AS subject, 'status' AS name,
    CASE WHEN acceptable THEN 'PASSED' ELSE 'NEEDS IMPROVEMENT' END AS value FROM {_VERDICT}""",
            _steps_sql(),
            "SELECT 'problem', 'orders', metric, concat('>= ', printf('%.2f', CAST(threshold AS DOUBLE))) "
            f"FROM {_CRITERIA}",
            f"""SELECT 'data', 'orders', unnest(['n_rows', 'n_columns', 'numeric_columns', 'missing_total']),
    unnest([CAST(count(*) AS VARCHAR), '6', '3', '0']) FROM orders""",
            """SELECT 'exploration', 'value', 'n_outliers', CAST(count(*) AS VARCHAR) FROM events,
    (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
            f"SELECT 'modelling', run, 'cv_mean', printf('%.4f', round(avg(score), 4)) FROM {FOLD_SCORES} GROUP BY run",
            f"SELECT 'evaluation', run, metric, printf('%.4f', value) FROM {_METRICS}",
            f"SELECT 'diagnosis', run, type, severity FROM {_DIAGNOSIS}",
        ]
    ),
}
