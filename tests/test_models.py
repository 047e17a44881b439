import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabspark.operators import metrics as M
from tabspark.operators import rules
from tabspark.operators.components import connected_components
from tabspark.operators.models import catalog, isolation, train, tune
from tabspark.operators.models.cluster import best_kmeans
from tabspark.operators.models.density import density_clusters, density_clusters_of_vectors
from tabspark.operators.models.isolation import average_path, fit_isolation_forest
from tabspark.operators.models.neighbors import local_outlier_factor, novelty_factor


@pytest.fixture(scope="module")
def linear(spark):
    source = np.random.RandomState(0)
    x = source.randn(400, 3) * [1, 2, 5]
    y = 7 * (3 * x[:, 0] + 2 * x[:, 1] + 10 + source.randn(400) * 0.5)
    frame = pd.DataFrame(x, columns=list("abc")).assign(label=y, id=range(400), cls=(y > 70).astype(float))
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(
        spark.createDataFrame(frame).coalesce(2)
    )
    return x, frame, df.cache()


def test_ridge_equals_normal_equations(linear):
    x, frame, df = linear
    model = catalog.build("LinearRegression", "regression", df, {"alpha": 50.0}).fit(df)
    xc, yc = x - x.mean(0), frame.label - frame.label.mean()
    wanted = np.linalg.solve(xc.T @ xc + 50 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), wanted, rtol=1e-6, atol=1e-8)


def test_elastic_net_equals_coordinate_descent(linear):
    x, frame, df = linear
    model = catalog.build("ElasticNet", "regression", df, {"alpha": 5.0, "l1_ratio": 0.5}).fit(df)
    xc, yc, b = x - x.mean(0), frame.label - frame.label.mean(), np.zeros(3)
    for _ in range(500):
        for j in range(3):
            rho = xc[:, j] @ (yc - xc @ b + xc[:, j] * b[j]) / 400
            b[j] = np.sign(rho) * max(abs(rho) - 2.5, 0) / ((xc[:, j] ** 2).mean() + 2.5)
    assert np.allclose(model.coefficients.toArray(), b, rtol=1e-4, atol=1e-4)


def test_logistic_equals_newton(linear):
    x, frame, df = linear
    data = df.withColumn("label", F.col("cls"))
    model = catalog.build("LogisticRegression", "binary_classification", data, {"C": 0.1}).fit(data)
    z, b, ridge = np.c_[np.ones(400), x], np.zeros(4), np.diag([0.0, 1, 1, 1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        gradient = 0.1 * z.T @ (p - frame.cls) + ridge @ b
        b -= np.linalg.solve(0.1 * (z.T * (p * (1 - p))) @ z + ridge, gradient)
    assert np.allclose([model.intercept, *model.coefficients], b, atol=2e-3)


def test_candidates_by_size():
    assert catalog.candidates("binary_classification")[0] == "LogisticRegression"
    assert catalog.candidates("binary_classification", simple_last=True)[-1] == "LogisticRegression"
    assert "SVM" in catalog.candidates("binary_classification")
    assert all(n in catalog.DEFAULTS for names in catalog.CANDIDATES.values() for n in names)
    assert catalog.candidates("ranking") == catalog.candidates("binary_classification")
    with pytest.raises(ValueError, match="deepest"):
        catalog.tree_depth(31)


def test_comparison_skips_failures(linear, monkeypatch):
    _, _, df = linear
    data = df.withColumn("label", F.col("cls"))
    real = catalog.build

    def build(name, *args, **kwargs):
        if name == "SVM":
            raise RuntimeError("no")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(train, "build", build)
    best = train.train_best(data, "binary_classification", ["SVM", "LogisticRegression"], folds=3, key="id")
    assert best.name == "LogisticRegression" and list(best.failures) == ["SVM"]
    assert best.scores.count() == 3
    with pytest.raises(train.TrainingError):
        train.train_best(data, "binary_classification", ["SVM"], folds=3, key="id")


def test_forest_and_importance(spark, linear):
    _, _, df = linear
    model = catalog.build("RandomForest", "regression", df, {"n_estimators": 5}).fit(df)
    rows = {r["feature"]: r["importance"] for r in train.feature_importance(model, list("abc"), spark).collect()}
    assert rows["b"] > rows["c"]


def test_multiclass_boosting_votes_one_against_rest(linear):
    _, _, df = linear
    data = df.withColumn("label", (F.col("id") % 3).cast("double"))
    model = catalog.build(
        "GradientBoosting", "multiclass_classification", data, {"n_estimators": 2}
    ).fit(data)
    assert set(train.predict(model, data).columns) == {"label", "prediction", "score"}


def test_calibrated_svm_has_probabilities(linear):
    _, _, df = linear
    data = df.withColumn("label", F.col("cls"))
    model = catalog.build("SVM", "binary_classification", data, {"max_iter": 20}).fit(data)
    row = train.predict(model, data).agg(F.min("score"), F.max("score")).first()
    assert 0 <= row[0] < 0.5 < row[1] <= 1


def test_draws_stay_in_their_space():
    for name, space in tune.SPACES.items():
        drawn = tune.draw_params(space, 200)
        assert len(drawn) == 200 and drawn[:50] == tune.draw_params(space, 50)
        for params in drawn:
            for k, (kind, *limits) in space.items():
                if kind == "choice":
                    assert params[k] in limits
                else:
                    assert limits[0] <= params[k] <= limits[1]


@pytest.mark.parametrize(
    "name,params,issue,wanted",
    [
        ("GradientBoosting", {}, "overfitting", {"max_depth": 2}),
        ("GradientBoosting", {"max_depth": 8}, "mild_overfitting", {"max_depth": 6}),
        ("LogisticRegression", {}, "overfitting", {"C": 0.1}),
        ("RandomForest", {}, "overfitting", {"n_estimators": 50}),
        ("RandomForest", {}, "underfitting", {"max_depth": 10}),
        ("GradientBoosting", {}, "underfitting", {"max_depth": 8}),
        ("LogisticRegression", {}, "underfitting", {}),
        ("RandomForest", {}, "class_imbalance_effect", {"class_weight": "balanced"}),
        ("GradientBoosting", {}, "class_imbalance_effect", {}),
        ("RandomForest", {}, "success_criteria_not_met", {"n_estimators": 200}),
        ("RandomForest", {}, "high_cv_variance", {"min_samples_leaf": 3}),
        ("LinearRegression", {}, "high_cv_variance", {}),
    ],
)
def test_adjustments(name, params, issue, wanted):
    assert tune.adjust(name, params, issue)[0] == {**params, **wanted}


def test_steps_of_the_report_are_those_of_the_loop():
    for issue, changes in tune.ADJUSTMENTS.items():
        assert all(parameter in rules.STEPS[issue] for parameter, _ in changes)


def test_retrain_stops_when_acceptable(spark, linear):
    _, _, df = linear
    data = df.withColumn("label", F.col("cls"))
    first = train.train_best(data, "binary_classification", ["LogisticRegression"], folds=3, key="id")
    goals = M.criteria_table(spark, "", {"accuracy": 0.5})
    _, rounds = tune.retrain(data, data, "binary_classification", first, goals, folds=3, key="id")
    assert {r["round"] for r in rounds.collect()} == {0}
    hard = M.criteria_table(spark, "", {"accuracy": 1.1})
    last, rounds = tune.retrain(
        data, data, "binary_classification", first, hard, ["LogisticRegression"], 1, 3, "id"
    )
    assert {r["round"] for r in rounds.collect()} == {0, 1}


def test_kmeans_keeps_the_cheapest_start(linear):
    _, _, df = linear
    model = best_kmeans(df, k=3, starts=3, max_iter=5)
    assert len(model.clusterCenters()) == 3


def brute_density(x, eps, minimum):
    distance = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = distance <= eps
    core, label = near.sum(1) >= minimum, np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] == -1:
            label[i], stack = i, [i]
            while stack:
                for v in np.flatnonzero(near[stack.pop()] & core):
                    if label[v] == -1:
                        label[v] = i
                        stack.append(v)
    for i in np.flatnonzero(~core):
        around = np.flatnonzero(near[i] & core)
        if len(around):
            label[i] = min(label[around[distance[i, around] == distance[i, around].min()]])
    return label, core


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_density_clusters_equal_brute_force(spark, dims):
    source = np.random.RandomState(dims)
    x = np.r_[
        source.randn(150, dims) * 0.4, source.randn(150, dims) * 0.4 + 2,
        source.uniform(-4, 6, (100, dims)), np.repeat(source.uniform(-4, 6, (3, dims)), 60, 0),
    ]
    names = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x))))
    got = density_clusters(df, "id", names, 0.3, 5).toPandas().sort_values("id")
    label, core = brute_density(x, 0.3, 5)
    assert (got.cluster.to_numpy() == label).all() and (got.is_core.to_numpy() == core).all()


@pytest.mark.parametrize("pivots,block", [(64, 2048), (6, 40)])
def test_density_of_long_vectors_equals_brute_force(spark, pivots, block):
    source = np.random.RandomState(9)
    x = np.r_[
        source.randn(120, 5) * 0.3, source.randn(120, 5) * 0.3 + 1.5,
        source.uniform(-3, 4, (60, 5)), np.repeat(source.uniform(-3, 4, (2, 5)), 50, 0),
    ]
    names = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(id=range(len(x))))
    vectors = df.select("id", F.array(*names).alias("v"))
    got = density_clusters_of_vectors(vectors, "id", "v", 0.6, 5, pivots, block).toPandas().sort_values("id")
    label, core = brute_density(x, 0.6, 5)
    assert (label >= 0).any() and ((label >= 0) & ~core).any()
    assert (got.cluster.to_numpy() == label).all() and (got.is_core.to_numpy() == core).all()
    if pivots == 64:
        same = density_clusters(df, "id", names, 0.6, 5).toPandas().sort_values("id")
        assert (same.cluster.to_numpy() == label).all()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 240)]
    nodes = spark.createDataFrame([(i,) for i in {n for e in edges for n in e} | {999}], "id bigint")
    found = connected_components(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    for r in found:
        assert r["component"] == (999 if r["id"] == 999 else 100 if r["id"] < 200 else 200)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, 1, kind="stable")[:, :k]
    near = np.take_along_axis(d, order, 1)
    density = 1 / (np.maximum(near, near[:, -1][order]).mean(1) + 1e-10)
    return density[order].mean(1) / density


@pytest.mark.parametrize("pivots,block", [(256, 2048), (7, 30)])
def test_outlier_factor_equals_brute_force(spark, pivots, block):
    source = np.random.RandomState(1)
    x = source.randn(300, 5)
    x[0] += 6
    x[200:] = x[150]  # a third of all rows are copies of one vector
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "v": x.tolist()}))
    got = local_outlier_factor(df, "id", "v", 20, pivots, block).toPandas().sort_values("id")
    assert np.allclose(got.lof, brute_lof(x, 20), rtol=1e-6)


def test_novelty_of_a_far_row(spark):
    source = np.random.RandomState(2)
    old = pd.DataFrame({"id": range(200), "v": source.randn(200, 3).tolist()})
    new = pd.DataFrame({"id": [1, 2], "v": [[0.1, 0.0, 0.0], [9.0, 9.0, 9.0]]})
    rows = novelty_factor(spark.createDataFrame(old), spark.createDataFrame(new), "id", "v", 10)
    factor = {r["id"]: r["lof"] for r in rows.collect()}
    assert factor[2] > 3 > factor[1]


def test_isolation_forest_ranks_planted_outliers_first(spark):
    source = np.random.RandomState(0)
    x = source.randn(2000, 3)
    x[:5] += 9
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(id=range(2000)))
    forest = fit_isolation_forest(df, list("abc"), "id", trees=30)
    assert len(forest.trees) == 30 and all(t[4][0] == 256 for t in forest.trees)
    top = forest.transform(df).orderBy(F.col("anomaly_score").desc()).limit(5).collect()
    assert {r["id"] for r in top} == {0, 1, 2, 3, 4} and all(r["is_anomaly"] for r in top)
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_contamination_sets_the_share_of_anomalies(spark):
    df = spark.range(1000).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"))
    forest = fit_isolation_forest(df, ["a", "b"], "id", trees=10, max_features=0.5, contamination=0.1)
    assert all(len(set(t[0][t[0] >= 0])) == 1 for t in forest.trees)
    assert abs(forest.transform(df).filter("is_anomaly").count() - 100) <= 10


def test_search_over_clusters_and_forests(spark):
    source = np.random.RandomState(5)
    x = np.r_[source.randn(60, 2), source.randn(60, 2) + 8]
    frame = pd.DataFrame(x, columns=["a", "b"]).assign(id=range(120), label=[0.0] * 60 + [1.0] * 60)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(frame).coalesce(2)
    )
    best, _ = tune.random_search(
        df, "KMeans", "clustering", 2, 2, key="id", space={"n_clusters": ("int", 2, 2), "n_init": ("int", 1, 1)}
    )
    assert {r["score"] for r in best.scores.collect()} == {1.0}
    rare = df.withColumn("label", (F.col("id") == 7).cast("double"))
    _, draws = tune.random_search(
        rare, "IsolationForest", "anomaly_detection", 1, 2, key="id",
        space={"n_estimators": ("int", 5, 5), "contamination": ("float", 0.05, 0.1)},
    )
    assert draws.count() == 1


class Doubler(Transformer):
    """A user stage: any Transformer fits into a Pipeline next to the built-in ones."""

    def _transform(self, dataset):
        return dataset.withColumn("a", F.col("a") * 2)


def test_user_stages(linear):
    _, _, df = linear
    by_pipeline = Pipeline(stages=[Doubler()]).fit(df).transform(df)
    by_function = df.transform(lambda d: d.withColumn("a", F.col("a") * 2))
    assert by_pipeline.agg(F.sum("a")).first() == by_function.agg(F.sum("a")).first()


def test_drawn_rows_follow_the_share_and_not_the_partitions(spark):
    rows = spark.range(20_000)
    drawn = isolation.drawn_rows(rows, "id", 40, 0.01)
    counts = {r["tree"]: r["count"] for r in drawn.groupBy("tree").count().collect()}
    assert sorted(counts) == list(range(40)) and all(130 < n < 270 for n in counts.values())
    assert drawn.groupBy("id", "tree").count().filter("count > 1").isEmpty()
    again = isolation.drawn_rows(rows.repartition(7), "id", 40, 0.01)
    assert again.exceptAll(drawn).isEmpty() and drawn.exceptAll(again).isEmpty()
    # Two trees share rows as often as independent draws would.
    both = drawn.groupBy("id").agg(F.count_if(F.col("tree") == 3).alias("a"), F.count_if(F.col("tree") == 4).alias("b"))
    assert both.filter("a = 1 and b = 1").count() < 15
    assert isolation.drawn_rows(spark.range(3), "id", 5, 1.0).count() == 15


def test_level_order_scores_equal_a_walk_from_the_root(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((600, 3)) < 0.05, np.nan, rng.normal(size=(600, 3)))
    x[:, 2] = np.round(x[:, 2])
    frame = pd.DataFrame(x, columns=list("abc")).assign(id=range(600))
    forest = isolation.fit_isolation_forest(spark.createDataFrame(frame), list("abc"), "id", trees=7, rows_per_tree=64)

    def walk(row):
        total = 0.0
        for t in range(7):
            node = 0
            for _ in range(6):
                f = forest.feature[t, node]
                if f < 0 or row[f] < forest.threshold[t, node]:
                    node = 2 * node + 1
                else:
                    node = 2 * node + 2
            total += forest.path[t, node - 63]
        return total

    assert np.allclose(forest.paths(x), [walk(r) for r in x])
    complete = forest.size[:, 1:][:, ::2] + forest.size[:, 1:][:, 1::2]
    cut = forest.feature[:, :31] >= 0
    assert (complete[cut] == forest.size[:, :31][cut]).all()
