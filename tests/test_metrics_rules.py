import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import metrics as M
from tabspark.operators import review as V
from tabspark.operators import rules as D
from tabspark.operators import tags as T
from tabspark.operators.clusters_quality import calinski_harabasz, silhouette


def values(df):
    return {r["metric"]: r["value"] for r in df.collect()}


def predictions(spark, n=300, seed=0, levels=12):
    source = np.random.RandomState(seed)
    label = source.randint(0, 2, n)
    score = np.round((label * 0.3 + source.rand(n)) * levels) / levels
    frame = pd.DataFrame({"label": label, "prediction": (score > 0.6).astype(int), "score": score})
    return frame, spark.createDataFrame(frame)


@pytest.mark.parametrize("bound", [10**6, 5])
def test_auc_equals_all_pairs(spark, bound):
    frame, df = predictions(spark, levels=10_000 if bound == 5 else 12)
    pos = frame.score[frame.label == 1].to_numpy()[:, None]
    neg = frame.score[frame.label == 0].to_numpy()[None, :]
    wanted = ((pos > neg) + 0.5 * (pos == neg)).mean()
    assert values(M.roc_auc(df, sort_bound=bound))["auc_roc"] == pytest.approx(wanted, abs=6e-5)


def test_auc_of_one_class_is_left_out(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "label int, score double")
    assert M.roc_auc(df).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_classification_metrics(spark, partitions):
    frame, df = predictions(spark)
    tp = ((frame.label == 1) & (frame.prediction == 1)).sum()
    precision, recall = tp / (frame.prediction == 1).sum(), tp / (frame.label == 1).sum()
    got = values(M.classification_metrics(df.repartition(partitions), score="score"))
    assert got["accuracy"] == round((frame.label == frame.prediction).mean(), 4)
    assert got["precision"] == pytest.approx(precision, abs=6e-5)
    assert got["recall"] == pytest.approx(recall, abs=6e-5)
    assert got["f1"] == pytest.approx(2 * precision * recall / (precision + recall), abs=6e-5)
    assert got["recall_weighted"] == got["accuracy"]
    assert "f1_macro" not in got and "auc_roc" in got


def test_class_without_prediction_counts_as_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (2, 3)], "label int, prediction int")
    got = values(M.classification_metrics(df))
    # classes 0..3: F1 is 0.5 for class 0 and 0 for the others, also for the never true class 3
    assert got["f1_macro"] == 0.125
    assert got["precision_weighted"] == round((1 / 3) / 4, 4)
    cells = {(r["label"], r["prediction"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert len(cells) == 16 and cells[2, 3] == 1 and cells[3, 3] == 0


def test_regression_edge_cases(spark):
    constant = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "label double, prediction double")
    assert values(M.regression_metrics(constant))["r2"] == 1.0
    wrong = constant.withColumn("prediction", F.lit(3.0))
    assert values(M.regression_metrics(wrong))["r2"] == 0.0
    zero = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "label double, prediction double")
    got = values(M.regression_metrics(zero))
    assert "mape" not in got and got["rmse"] == 1.0


def test_roc_curve_ends(spark):
    _, df = predictions(spark)
    rows = sorted(map(tuple, M.roc_curve(df).collect()), reverse=True)
    assert rows[0] == (math.inf, 0.0, 0.0)
    assert rows[-1][1:] == (1.0, 1.0)
    assert [r[1] for r in rows] == sorted(r[1] for r in rows)


def test_adjusted_rand_of_equal_and_shuffled_clusterings(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("label"), ((F.col("id") + 1) % 3).alias("prediction"))
    assert values(M.adjusted_rand(df))["adjusted_rand_score"] == 1.0
    other = df.withColumn("prediction", F.xxhash64(F.monotonically_increasing_id()) % 3)
    assert abs(values(M.adjusted_rand(other))["adjusted_rand_score"]) < 0.05


def test_cluster_quality(spark):
    source = np.random.RandomState(0)
    x = np.r_[source.randn(40, 3), source.randn(40, 3) + 9]
    k = [0] * 40 + [1] * 40
    df = spark.createDataFrame(pd.DataFrame({"v": x.tolist(), "prediction": k}))
    assert values(silhouette(df, "v"))["silhouette_score"] > 0.9
    means = [x[:40].mean(0), x[40:].mean(0)]
    within = sum(((x[i * 40 : i * 40 + 40] - means[i]) ** 2).sum() for i in range(2))
    between = sum(40 * ((m - x.mean(0)) ** 2).sum() for m in means)
    assert values(calinski_harabasz(df, "v"))["calinski_harabasz"] == pytest.approx(between / (within / 78), rel=1e-6)


def test_ranking_of_a_hand_made_query(spark):
    df = spark.createDataFrame(
        [("q", 1, 0.9, 0), ("q", 2, 0.8, 2), ("q", 3, 0.1, 1), ("none", 4, 0.5, 0)],
        "query string, item int, score double, gain int",
    )
    got = values(M.ranking_metrics(df, "query", "item", "score", "gain", k=2))
    dcg, ideal = 2 / math.log2(3), 2 + 1 / math.log2(3)
    assert got["ndcg"] == pytest.approx(dcg / ideal / 2, abs=6e-5)
    assert got["precision_at_k"] == 0.25 and got["recall_at_k"] == 0.25


def test_success_check_and_aliases(spark):
    metrics = spark.createDataFrame(
        [("a", "f1", 0.9), ("a", "mape", 0.3), ("b", "other", 1.0)], "run string, metric string, value double"
    )
    goals = M.criteria_table(spark, "", {"f1_score": 0.8, "mape": 0.2})
    rows = {r["run"]: (r["n_checked"], r["passed"]) for r in M.success_check(metrics, goals).collect()}
    assert rows == {"a": (2, False), "b": (0, True)}
    plain = M.criteria_table(spark, "", {"f1_score": 0.95}, aliases=False)
    assert M.check_criteria(metrics, plain).count() == 0


def make(spark, runs):
    metrics = [(run, m, float(v)) for run, (ms, _) in runs.items() for m, v in ms.items()]
    scores = [(run, i, float(s)) for run, (_, ss) in runs.items() for i, s in enumerate(ss)]
    return (
        spark.createDataFrame(metrics, "run string, metric string, value double"),
        spark.createDataFrame(scores, "run string, fold int, score double"),
    )


def test_every_diagnosis_rule(spark):
    metrics, scores = make(
        spark,
        {
            "good": ({"accuracy": 0.9, "f1_weighted": 0.9, "baseline_accuracy": 0.5}, [0.9, 0.91]),
            "over": ({"accuracy": 0.7, "f1_weighted": 0.7, "baseline_accuracy": 0.5}, [0.9, 0.9]),
            "mild": ({"accuracy": 0.82, "f1_weighted": 0.82, "baseline_accuracy": 0.5}, [0.9, 0.9]),
            "under": ({"accuracy": 0.45, "f1_weighted": 0.45, "baseline_accuracy": 0.44}, [0.4, 0.4]),
            "below": ({"accuracy": 0.5, "f1_weighted": 0.5, "baseline_accuracy": 0.5}, [0.5]),
            "gap": ({"accuracy": 0.9, "f1_weighted": 0.7, "baseline_accuracy": 0.8}, [0.7]),
            "shaky": ({"accuracy": 0.9, "f1": 0.9, "baseline_accuracy": 0.5}, [0.5, 1.0]),
            "none": ({"accuracy": 0.9, "f1_weighted": 0.88, "baseline_accuracy": 0.5}, []),
        },
    )
    goals = M.criteria_table(spark, "", {"accuracy": 0.6})
    rows = D.diagnose(metrics, scores, goals).collect()
    found = {}
    for r in rows:
        found.setdefault(r["run"], set()).add(r["type"])
    assert found == {
        "over": {"overfitting"},
        "mild": {"mild_overfitting"},
        "under": {"underfitting", "marginal_improvement", "success_criteria_not_met"},
        "below": {"below_baseline", "success_criteria_not_met"},
        "gap": {"class_imbalance_effect"},
        "shaky": {"high_cv_variance"},
    }
    verdicts = {
        r["run"]: r["acceptable"]
        for r in D.run_verdict(D.diagnose(metrics, scores, goals), metrics).collect()
    }
    assert {k for k, v in verdicts.items() if not v} == {"over", "under", "below"}


def test_negative_r2_is_critical(spark):
    metrics, scores = make(spark, {"r": ({"r2": -0.2}, [0.1])})
    kinds = {r["type"]: r["severity"] for r in D.diagnose(metrics, scores, None, "regression").collect()}
    assert kinds["below_baseline"] == "critical" and kinds["overfitting"] == "error"


def test_review_rules(spark):
    profiles = spark.createDataFrame(
        [("t", "c", "categorical", 50, 20, 101), ("t", "d", "numeric", 50, 20, 500)],
        "table string, column string, kind string, n_rows bigint, n_missing bigint, n_unique bigint",
    )
    assert {r["rule"] for r in V.review_data(profiles).collect()} == {"few_rows", "high_missing", "many_categories"}
    sizes = spark.createDataFrame([("s", 95, 5, 20)], "subject string, train_size int, test_size int, n_features int")
    assert {r["rule"] for r in V.review_split(sizes).collect()} == {"small_test_set", "few_rows_per_feature"}
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    scores = spark.createDataFrame([("a", "m", 0, 0.5)], "run string, model string, fold int, score double")
    got = {(r["subject"], r["rule"]) for r in V.review_training(runs, scores).collect()}
    assert got == {("a", "one_model"), ("b", "one_model"), ("b", "no_cross_validation")}
    metrics = spark.createDataFrame([("a", "accuracy", 1.0)], "run string, metric string, value double")
    findings = V.review_metrics(runs, metrics)
    got = {(r["subject"], r["rule"]) for r in findings.collect()}
    assert got == {("a", "perfect_score"), ("a", "no_baseline"), ("b", "no_metrics"), ("b", "no_baseline")}
    verdict = {r["subject"]: r["approved"] for r in V.review_verdict(findings, findings).collect()}
    assert verdict == {"a": False, "b": True}
    corr = spark.createDataFrame(
        [("y", "y", 1.0), ("y", "a", -0.97), ("y", "b", 0.5), ("a", "y", -0.97)],
        "col_x string, col_y string, corr double",
    )
    assert [r["detail"] for r in V.leakage_by_correlation(corr, "y").collect()] == ["a"]


@pytest.mark.parametrize(
    "text,task,domain,objectives",
    [
        ("Predict the price. Goal is profit.", "regression", "general", ["profit", "the price"]),
        ("nothing here", "binary_classification", "general", ["Solve: nothing here"]),
        ("Detect fraud in bank loans", "binary_classification", "finance", ["fraud in bank loans"]),
        ("We want to group patients\nby cohort", "clustering", "healthcare", ["Solve: We want to group patients\nby cohort"]),
        ("x" * 300, "binary_classification", "general", ["Solve: " + "x" * 200]),
    ],
)
def test_tags(spark, text, task, domain, objectives):
    row = T.tag_statements(spark.createDataFrame([(text,)], "text string"), "text").first()
    assert (row["task_type"], row["domain"], row["objectives"]) == (task, domain, objectives)


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    rows = {r["label"]: r["weight"] for r in M.with_class_weight(df).distinct().collect()}
    assert rows == {"a": pytest.approx(4 / 6), "b": 2.0}


def test_missing_sides_are_classes_of_the_confusion_matrix(spark):
    df = spark.createDataFrame([(1, None), (None, 1), (1, 1), (None, None)], "label int, prediction int")
    cells = {(r["label"], r["prediction"]): r["n"] for r in M.confusion_matrix(df).collect()}
    assert cells == {(1, None): 1, (None, 1): 1, (1, 1): 1, (None, None): 1}


def test_models_rank_by_their_plain_mean(spark):
    scores = spark.createDataFrame([("a", 0, 0.900001), ("b", 0, 0.900049)], "model string, fold int, score double")
    best = M.model_comparison(scores).filter("is_best").first()
    assert best["model"] == "b"


def test_adjusted_rand_keeps_null_groups(spark):
    rows = [(g, float(i % 2), float(i % 2 if g else i % 3)) for g in ("a", None) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, label double, prediction double")
    found = {r["g"]: r["value"] for r in M.adjusted_rand(df, ["g"]).collect()}
    assert found["a"] == 1.0 and None in found and found[None] < 1.0
    assert M.adjusted_rand(df.filter("g = 'a'")).first()["value"] == 1.0
