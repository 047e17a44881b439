"""Registered queries: training, comparison, clustering and anomaly scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.numeric import rounded
from tabspark.functions.scratch import materialise
from tabspark.operators import metrics as M
from tabspark.operators.models import catalog, isolation, train, tune
from tabspark.operators.models.cluster import best_kmeans
from tabspark.operators.models.density import density_clusters, density_clusters_of_vectors
from tabspark.operators.models.isolation import fit_isolation_forest
from tabspark.operators.models.neighbors import local_outlier_factor
from tabspark.operators.prepare import prepare
from tabspark.plans.common import slot_sql, table
from tabspark.plans.workflow import assess


def labelled_documents(spark, sf) -> DataFrame:
    """Documents with a quality label and simple measures of their whole text.

    Written once to the shared folder, without the texts: preparing and assessing read the table
    many times, and each time would split all texts again.
    """
    words = F.size(F.split(F.col("text"), r"\s+"))
    lines = F.size(F.split(F.col("text"), "\n"))
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    documents = table(spark, sf, "documents").select(
        "doc_id", "lang", "n_chars", words.alias("n_words"), lines.alias("n_lines"),
        digits.alias("n_digits"), (F.col("n_chars") / words).alias("chars_per_word"),
    )
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return materialise(documents.join(labels, "doc_id"))


def with_training_tables(spark, sf, work: Callable[[DataFrame, DataFrame, list], DataFrame],
                         rows: DataFrame | None = None, target: str = "quality") -> DataFrame:
    """Prepare, cache, run ``work(train, test, features)``, keep its few result rows, release."""
    prepared = prepare(labelled_documents(spark, sf) if rows is None else rows, target, "doc_id")
    ready = prepared.assembled().select("doc_id", "split", "label", "features")
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        result = work(ready.filter("split = 'train'"), ready.filter("split = 'test'"), prepared.features)
        return spark.createDataFrame(result.collect(), result.schema)
    finally:
        ready.unpersist()


def _train(name: str, task: str = "binary_classification", target: str = "quality"):
    def query(spark, sf):
        def work(training, test, features):
            model = catalog.build(name, task, training).fit(training)
            return train.evaluate(train.predict(model, test).withColumn("run", F.lit(name)), task)

        return with_training_tables(spark, sf, work, target=target)

    return query


def train_ridge(spark, sf):
    """Ridge coefficients of price on quantity, discount and tax."""
    return _linear(spark, sf, "LinearRegression", {"alpha": 1000.0}, ["l_quantity", "l_discount"])


def train_elastic(spark, sf):
    return _linear(spark, sf, "ElasticNet", {"alpha": 100.0, "l1_ratio": 0.5}, ["l_quantity"])


def _linear(spark, sf, name, params, features):
    items = table(spark, sf, "lineitem").select(*features, F.col("l_extendedprice").alias("label"))
    ready = VectorAssembler(inputCols=features, outputCol="features").transform(items)
    model = catalog.build(name, "regression", ready, params).fit(ready)
    rows = [(f, round(float(v), 3)) for f, v in zip(features, model.coefficients)]
    rows.append(("intercept", round(float(model.intercept), 3)))
    return spark.createDataFrame(rows, "term string, coefficient double")


def cv_scores(spark, sf):
    def work(training, test, features):
        task = "binary_classification"
        models = {
            "plain": catalog.build("LogisticRegression", task, training),
            "strict": catalog.build("LogisticRegression", task, training, {"C": 0.01}),
        }
        return train.cross_validate(training, models, task, key="doc_id")

    return with_training_tables(spark, sf, work)


def train_compare(spark, sf):
    """All candidates of the task with their default settings; an error if one of them cannot be compared."""
    def work(training, test, features):
        best = train.train_best(training, "binary_classification", key="doc_id", skip_failures=False)
        return best.comparison.drop("seconds")

    return with_training_tables(spark, sf, work)


PRICE_FEATURES = ["l_quantity", "l_discount"]
DRAWS, FOLDS = 20, 5


def _priced_items(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        "l_orderkey", *PRICE_FEATURES, F.col("l_extendedprice").alias("label"))
    ready = VectorAssembler(inputCols=PRICE_FEATURES, outputCol="features").transform(items)
    return ready.select("l_orderkey", "features", "label")


def tune_random(spark, sf):
    """Drawn ridge penalties for the price of every line item, over five folds."""
    found = tune.search_params(_priced_items(spark, sf), "LinearRegression", "regression", DRAWS, FOLDS, key="l_orderkey")
    return found.draws.withColumn("mean_score", rounded(F.col("mean_score"), 9))


def train_compare_tuned(spark, sf):
    """The penalised linear candidates for the price of every line item, each searched before they are compared."""
    best, _ = tune.tuned_best(_priced_items(spark, sf), "regression", ["LinearRegression", "ElasticNet"], DRAWS, FOLDS,
                              key="l_orderkey", fit=False)
    return best.comparison.drop("seconds")


def tuning_rounds(spark, sf):
    def work(training, test, features):
        task = "binary_classification"
        first = train.train_best(training, task, ["LogisticRegression"], key="doc_id")
        criteria = M.criteria_table(spark, task, {"accuracy": 0.995})
        _, rounds = tune.retrain(
            training, test, task, first, criteria, ["LogisticRegression", "RandomForest"],
            key="doc_id",
        )
        return rounds

    return with_training_tables(spark, sf, work)


def feature_importance(spark, sf):
    def work(training, test, features):
        model = catalog.build("RandomForest", "binary_classification", training).fit(training)
        return train.feature_importance(model, features, spark)

    return with_training_tables(spark, sf, work)


def assessment(spark, sf):
    """The report of a whole assessment run."""
    result = assess(
        labelled_documents(spark, sf), "doc_id", "Classify documents. Goal is to detect quality.",
        target="quality",
    )
    return result.tables["report"]


def cluster_kmeans(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    model = best_kmeans(vectors, k=10)
    return model.transform(vectors).select("vec_id", "label", "prediction")


def cluster_density(spark, sf):
    part = table(spark, sf, "part")
    return density_clusters(part, "p_partkey", ["p_size", "p_retailprice"], eps=2.0, min_points=5)


def cluster_density_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return density_clusters_of_vectors(vectors, "vec_id", "embedding", eps=1.18, min_points=5)


def anomaly_iforest(spark, sf):
    items = table(spark, sf, "lineitem").withColumn(
        "row_key", F.col("l_orderkey") * 8 + F.col("l_linenumber")
    )
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    forest = fit_isolation_forest(items, columns, "row_key")
    return forest.transform(items).select(
        "l_orderkey", "l_linenumber", rounded(F.col("anomaly_score")).alias("anomaly_score"), "is_anomaly"
    )


def iforest_draws(spark, sf):
    """The rows drawn and kept for each tree of the forest over all line items."""
    items = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_key"))
    n = items.count()
    wanted = min(isolation.ROWS_PER_TREE, n)
    drawn = isolation.drawn_rows(items, "row_key", isolation.TREES, isolation.draw_share(n, wanted)).groupBy("tree").agg(
        F.count("*").alias("n_drawn"))
    kept = isolation.tree_samples(items, "row_key", isolation.TREES, wanted, n).groupBy("tree").agg(
        F.count("*").alias("n_kept"), F.sum("row_key").alias("key_sum"))
    return drawn.join(kept, "tree")


def anomaly_lof(spark, sf):
    factors = local_outlier_factor(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return factors.select("vec_id", rounded(F.col("lof")).alias("lof"))


QUERIES = {
    "train_logistic": _train("LogisticRegression"),
    "train_forest": _train("RandomForest"),
    "train_gbt": _train("GradientBoosting"),
    "train_svm": _train("SVM"),
    "train_multinomial": _train("LogisticRegression", "multiclass_classification", "lang"),
    "train_ridge": train_ridge,
    "train_elastic": train_elastic,
    "cv_scores": cv_scores,
    "train_compare": train_compare,
    "train_compare_tuned": train_compare_tuned,
    "tune_random": tune_random,
    "tuning_rounds": tuning_rounds,
    "feature_importance": feature_importance,
    "assessment": assessment,
    "cluster_kmeans": cluster_kmeans,
    "cluster_density": cluster_density,
    "cluster_density_vectors": cluster_density_vectors,
    "anomaly_iforest": anomaly_iforest,
    "iforest_draws": iforest_draws,
    "anomaly_lof": anomaly_lof,
}



def _density_sql(pairs: str, key: str, source: str) -> str:
    """Density clusters from ``(i, j, d)`` pairs within the radius, every row paired with itself."""
    return f"""WITH RECURSIVE p AS ({pairs}),
    core AS (SELECT i FROM p GROUP BY i HAVING count(*) >= 5),
    e AS (SELECT i, j FROM p WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
    r(id, root) AS (SELECT i, i FROM core UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.id),
    c AS (SELECT id, min(root) AS cluster FROM r GROUP BY id),
    b AS (SELECT p.i AS id, first(c.cluster ORDER BY p.d, c.cluster) AS cluster FROM p JOIN c ON c.id = p.j GROUP BY p.i)
SELECT s.{key}, coalesce(c.cluster, b.cluster, -1) AS cluster, c.id IS NOT NULL AS is_core
FROM {source} s LEFT JOIN c ON c.id = s.{key} LEFT JOIN b ON b.id = s.{key}"""


def _searched_sql(name: str, tail: str) -> str:
    """Means of drawn penalties over the folds: sums per fold, coordinate descent by recursion, r2 on the fold."""
    values = []
    for i, p in enumerate(tune.draw_params(tune.space_of(name, "regression"), DRAWS)):
        text = ", ".join(f"{k}={v}" for k, v in sorted(p.items()))
        ratio = p.get("l1_ratio", 0.0)
        l2 = f"{p['alpha']!r} / n" if name == "LinearRegression" else repr(p["alpha"] * (1 - ratio))
        values.append(f"SELECT {i} AS draw, '{text}' AS params, k, {p['alpha'] * ratio!r} AS l1, {l2} AS l2 FROM o")
    a, b, y = "l_quantity", "l_discount", "l_extendedprice"
    stats = (f"count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, avg({y}) AS my, var_pop({a}) AS aa, var_pop({b}) AS bb, "
             f"covar_pop({a}, {b}) AS ab, covar_pop({a}, {y}) AS ay, covar_pop({b}, {y}) AS by_, var_pop({y}) AS yy")
    shrunk = "sign({0}) * greatest(abs({0}) - l1, 0) / ({1} + l2)"
    first = shrunk.format("(ay - ab * wb)", "aa")
    return f"""WITH RECURSIVE i AS (SELECT *, {slot_sql("l_orderkey")} % {FOLDS} AS fold FROM lineitem),
    h AS (SELECT fold AS k, {stats} FROM i GROUP BY fold),
    o AS (SELECT k, {stats} FROM i JOIN (SELECT k FROM h) f ON i.fold <> f.k GROUP BY k),
    p AS ({" UNION ALL ".join(values)}),
    q AS (SELECT draw, params, l1, l2, o.* FROM p JOIN o USING (k)),
    w AS (SELECT q.*, 0 AS step, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb FROM q UNION ALL
        SELECT * REPLACE ({shrunk.format("(by_ - ab * wa)", "bb")} AS wb) FROM (
            SELECT * REPLACE (step + 1 AS step, {first} AS wa) FROM w WHERE step < 60)),
    r AS (SELECT draw, params, k, 1 - (h.yy - 2 * (wa * h.ay + wb * h.by_) + wa * wa * h.aa + 2 * wa * wb * h.ab
            + wb * wb * h.bb + (h.my - w.my + wa * (w.ma - h.ma) + wb * (w.mb - h.mb)) ** 2) / h.yy AS score
        FROM w JOIN h USING (k) WHERE step = 60),
    m AS (SELECT draw, params, avg(score) AS mean FROM r GROUP BY draw, params),
    best AS (SELECT draw FROM m ORDER BY mean DESC, draw LIMIT 1)
{tail}"""


def _compared_sql() -> str:
    parts = [f"""(SELECT * FROM ({_searched_sql(name, f"SELECT '{name}' AS model, score FROM r JOIN best USING (draw)")}))"""
             for name in ("LinearRegression", "ElasticNet")]
    return f"""WITH s AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT model, count(*) AS folds, avg(score) AS mean, stddev_pop(score) AS std FROM s GROUP BY model),
    k AS (SELECT *, row_number() OVER (ORDER BY mean DESC, model) AS rank FROM g)
SELECT model, folds, round(mean, 4) AS cv_mean, round(std, 4) AS cv_std, rank, rank = 1 AS is_best FROM k"""


def _draws_sql() -> str:
    """The walks over the trees by recursion: one hash per row and tree reached."""
    trees, wanted, seed = isolation.TREES, isolation.ROWS_PER_TREE, isolation.SEED
    digest = f"md5('{seed}|' || k || '|' || {{}})"
    even = f"(CAST('0x' || substr({digest}, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
    skip = f"CAST(least(floor(ln({even}) / rest), {trees}) AS INT)"
    return f"""WITH RECURSIVE r AS (SELECT l_orderkey * 8 + l_linenumber AS k FROM lineitem),
    c AS (SELECT least({wanted}, count(*)) AS wanted, CASE WHEN 2 * least({wanted}, count(*)) + 32 < count(*)
        THEN ln(1 - (2 * least({wanted}, count(*)) + 32) / count(*)) ELSE -1e300 END AS rest FROM r),
    d AS (SELECT k, rest, 0 AS i, {skip.format("0")} AS tree FROM r, c UNION ALL
        SELECT k, rest, i + 1, tree + 1 + {skip.format("(i + 1)")} FROM d WHERE tree < {trees}),
    p AS (SELECT k, tree, row_number() OVER (PARTITION BY tree ORDER BY {digest.format("'t' || tree")}, k) AS place
        FROM d WHERE tree < {trees})
SELECT tree, count(*) AS n_drawn, count(*) FILTER (place <= wanted) AS n_kept,
    CAST(sum(k) FILTER (place <= wanted) AS BIGINT) AS key_sum FROM p, c GROUP BY tree"""


# Closed forms: two centred features with a ridge, one feature with a soft threshold.
ORACLE = {
    "iforest_draws": _draws_sql(),
    "tune_random": _searched_sql(
        "LinearRegression", "SELECT draw, params, round(mean, 9) AS mean_score, draw = (SELECT draw FROM best) AS is_best FROM m"),
    "train_compare_tuned": _compared_sql(),
    "train_ridge": """WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb,
        avg(l_extendedprice) AS my, var_pop(l_quantity) * count(*) + 1000 AS aa,
        var_pop(l_discount) * count(*) + 1000 AS bb, covar_pop(l_quantity, l_discount) * count(*) AS ab,
        covar_pop(l_quantity, l_extendedprice) * count(*) AS ay,
        covar_pop(l_discount, l_extendedprice) * count(*) AS by_ FROM lineitem),
    w AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS wa,
        (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)
SELECT 'l_quantity' AS term, round(wa, 3) AS coefficient FROM w
UNION ALL SELECT 'l_discount', round(wb, 3) FROM w
UNION ALL SELECT 'intercept', round(my - wa * ma - wb * mb, 3) FROM w""",
    "train_elastic": """WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
        var_pop(l_quantity) + 50 AS d, covar_pop(l_quantity, l_extendedprice) AS c FROM lineitem),
    w AS (SELECT *, sign(c) * greatest(abs(c) - 50, 0) / d AS b FROM m)
SELECT 'l_quantity' AS term, round(b, 3) AS coefficient FROM w
UNION ALL SELECT 'intercept', round(my - b * mx, 3) FROM w""",
    "cluster_density": _density_sql(
        """SELECT a.p_partkey AS i, b.p_partkey AS j,
        sqrt((a.p_size - b.p_size) ** 2 + (a.p_retailprice - b.p_retailprice) ** 2) AS d
        FROM part a JOIN part b ON sqrt((a.p_size - b.p_size) ** 2
            + (a.p_retailprice - b.p_retailprice) ** 2) <= 2.0""",
        "p_partkey", "part",
    ),
    "cluster_density_vectors": _density_sql(
        """SELECT a.vec_id AS i, b.vec_id AS j, sqrt(sum((a.x - b.x) ** 2)) AS d
        FROM (SELECT vec_id, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) a
        JOIN (SELECT vec_id, unnest(range(64)) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) b
        ON a.k = b.k GROUP BY ALL HAVING sqrt(sum((a.x - b.x) ** 2)) <= 1.18""",
        "vec_id", "embeddings",
    ),
    "anomaly_lof": """WITH v AS (SELECT vec_id, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    p AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt(sum((a.x - b.x) ** 2)) AS dist
        FROM v a JOIN v b ON a.d = b.d AND a.vec_id <> b.vec_id GROUP BY ALL),
    k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY dist, j) <= 20),
    r AS (SELECT i, max(dist) AS reach FROM k GROUP BY i),
    l AS (SELECT k.i, 1 / (avg(greatest(dist, reach)) + 1e-10) AS lrd FROM k JOIN r ON r.i = k.j GROUP BY k.i)
SELECT k.i AS vec_id, round(avg(o.lrd) / max(s.lrd), 4) AS lof
FROM k JOIN l o ON o.i = k.j JOIN l s ON s.i = k.i GROUP BY k.i""",
}
