"""Isolation forest: small random trees built in parallel, scored by an Arrow UDF."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import col
from tabspark.functions.hashing import key_text
from tabspark.operators.stats import exact_quantiles

# Trees, rows per tree, seed, and the score above which a row is an anomaly.
TREES = 100
ROWS_PER_TREE = 256
SEED = 42
ANOMALY_ABOVE = 0.5
EULER_GAMMA = 0.5772156649015329

TREE = "tree int, feature array<int>, threshold array<double>, path array<double>, size array<int>"
# Rows whose nodes in all trees are followed together.
STEP_ROWS = 512


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass(frozen=True)
class IsolationForest:
    """Trees in level order, all of one depth, so the forest is small whatever the data.

    ``feature`` (-1: not cut), ``threshold`` and ``size`` have a row per tree and a cell per inner node:
    the children of node i are 2i + 1 and 2i + 2. ``path`` has the path length of each place below.
    """

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    size: np.ndarray
    columns: list[str]
    rows_per_tree: int
    threshold_score: float = ANOMALY_ABOVE

    @property
    def trees(self) -> list[tuple]:
        """Node arrays of each tree: feature, threshold, left and right child, rows that arrived in the fit."""
        left = 2 * np.arange(self.feature.shape[1]) + 1
        return [(f, t, left, left + 1, n) for f, t, n in zip(self.feature, self.threshold, self.size, strict=True)]

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Sum of path lengths over all trees for each row; a missing value goes right."""
        trees, inner = self.feature.shape
        feature, threshold = np.maximum(self.feature, 0).astype(np.intp).ravel(), self.threshold.ravel()
        base, below = np.arange(trees) * inner, np.arange(trees) * (inner + 1) - inner
        total = np.empty(len(x))
        for start in range(0, len(x), STEP_ROWS):
            rows = np.ascontiguousarray(x[start:start + STEP_ROWS])
            cells, own = rows.ravel(), (np.arange(len(rows)) * rows.shape[1])[:, None]
            node = np.zeros((len(rows), trees), np.intp)
            for _ in range((inner + 1).bit_length() - 1):
                at = node + base
                left = cells.take(feature.take(at, mode="wrap") + own, mode="wrap") < threshold.take(at, mode="wrap")
                node *= 2
                node += 2
                node -= left
            total[start:start + STEP_ROWS] = self.path.ravel().take(node + below, mode="wrap").sum(axis=1)
        return total

    def score(self) -> Column:
        """Anomaly score in (0, 1) of the columns the forest was fitted on."""
        unit = float(average_path(self.rows_per_tree)) or 1.0
        trees = len(self.feature)

        @F.pandas_udf("double")
        def path_score(cells: pd.Series) -> pd.Series:
            if not len(cells):
                return pd.Series([], dtype=float)
            return pd.Series(2.0 ** (-self.paths(np.stack(cells.to_numpy()).astype(float)) / trees / unit))

        return path_score(F.array(*[col(c).cast("double") for c in self.columns]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` and ``is_anomaly``."""
        return df.withColumn("anomaly_score", self.score()).withColumn(
            "is_anomaly", F.col("anomaly_score") > self.threshold_score
        )


def _build_tree(
    x: np.ndarray, source: np.random.Generator, limit: int, max_features: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and thresholds of the inner nodes, the path lengths below and the rows that arrive, in level order.

    A node that is not cut sends everything on to places of one path length.
    """
    width = x.shape[1]
    allowed = source.permutation(width)[: max(1, int(max_features * width))]
    feature = np.full(2**limit - 1, -1, np.int32)
    size = np.zeros(2**limit - 1, np.int32)
    threshold = np.full(2**limit - 1, np.inf)
    path = np.zeros(2**limit)
    pending = [(np.arange(len(x)), 0, 0)]
    while pending:
        rows, depth, node = pending.pop()
        if depth < limit:
            size[node] = len(rows)
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_columns = allowed[high[allowed] > low[allowed]]
        if depth >= limit or len(rows) <= 1 or not len(open_columns):
            below = 2 ** (limit - depth)
            first = (node + 1) * below - 2**limit
            path[first:first + below] = depth + average_path(len(rows))
            continue
        c = int(source.choice(open_columns))
        # In (low, high], so that both sides get a row.
        cut = high[c] - (high[c] - low[c]) * source.random()
        goes_left = x[rows, c] < cut
        feature[node], threshold[node] = c, cut
        pending.append((rows[~goes_left], depth + 1, 2 * node + 2))
        pending.append((rows[goes_left], depth + 1, 2 * node + 1))
    return feature, threshold, path, size


def draw_share(n: int, wanted: int) -> float:
    """The share of rows that a tree draws first: about twice what it keeps."""
    return min(1.0, (2 * wanted + 32) / n)


def drawn_rows(df: DataFrame, key: str | list[str], trees: int, share: float, seed: int = SEED) -> DataFrame:
    """The rows with a row for each ``tree`` they are drawn for, each with probability ``share``.

    One walk over the trees serves all of them: a hash of the key gives the number of trees
    that are skipped, which is geometric, so most rows take one hash and are done. The hash
    of key and step (md5) makes the draw the same in every run and engine.
    """
    text = key_text(key)
    log_rest = math.log1p(-share) if share < 1 else -1e300

    def skip(step: Column) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}|"), text, F.lit("|"), step.cast("string")).cast("binary"))
        even = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
        return F.least(F.floor(F.log(even) / log_rest), F.lit(trees)).cast("int")

    first = df.withColumn("__first", skip(F.lit(0))).filter(F.col("__first") < trees)

    def step(state: Column, i: Column) -> Column:
        last = F.element_at(state, -1)
        return F.when(last < trees, F.concat(state, F.array(last + 1 + skip(i)))).otherwise(state)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(trees)), F.array("__first"), step)
    return first.select(*[col(c) for c in df.columns], F.explode(F.filter(walk, lambda t: t < trees)).alias("tree"))


def tree_samples(df: DataFrame, key: str | list[str], trees: int, wanted: int, n: int, seed: int = SEED) -> DataFrame:
    """At most ``wanted`` rows per ``tree`` with their ``place``, the first by a hash of key and tree."""
    # A few rows, but much work for each tree: a fixed number of partitions is not merged.
    parts = min(trees, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = drawn_rows(df, key, trees, draw_share(n, wanted), seed).repartition(parts, "tree")
    order = F.md5(F.concat(F.lit(f"{seed}|"), key_text(key), F.lit("|t"), F.col("tree").cast("string")).cast("binary"))
    keys = [key] if isinstance(key, str) else key
    place = F.row_number().over(Window.partitionBy("tree").orderBy(order, *[col(k) for k in keys]))
    return drawn.withColumn("place", place).filter(F.col("place") <= wanted)


def fit_isolation_forest(
    df: DataFrame, columns: Sequence[str], key: str, trees: int = TREES,
    rows_per_tree: int = ROWS_PER_TREE, seed: int = SEED, max_features: float = 1.0,
    contamination: float | str = "auto",
) -> IsolationForest:
    """Draw up to 256 rows per tree by a hash of the key and build every tree in its own task.

    :func:`drawn_rows` draws about twice as many as wanted, :func:`tree_samples` keeps the exact
    number by order of a hash. No task sees more than one tree's rows.
    With a ``contamination`` share that share of the rows is anomalous, else scores above 0.5.
    """
    columns = list(columns)
    data = df.select(col(key).alias("__key"), *[col(c).cast("double").alias(c) for c in columns])
    data = data.dropna()
    n = data.count()
    if n == 0:
        raise ValueError("no complete row to fit a forest on")
    wanted = min(rows_per_tree, n)
    sample = tree_samples(data, "__key", trees, wanted, n, seed)
    limit = max(1, math.ceil(math.log2(max(wanted, 2))))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        ordered = group.sort_values("place")
        parts = _build_tree(ordered[columns].to_numpy(), np.random.default_rng([seed, tree]), limit, max_features)
        return pd.DataFrame({"tree": [tree], **{
            name: [part] for name, part in zip(("feature", "threshold", "path", "size"), parts)
        }})

    rows = sample.groupBy("tree").applyInPandas(build, TREE).orderBy("tree").collect()
    forest = [np.array([r[c] for r in rows]) for c in ("feature", "threshold", "path", "size")]
    fitted = IsolationForest(*forest, columns, wanted)
    if contamination == "auto":
        return fitted
    scores = data.select(fitted.score().alias("score"))
    cut = exact_quantiles(scores, ["score"], {"cut": 1.0 - contamination}).first()["cut"]
    return replace(fitted, threshold_score=cut)


class IsolationForestEstimator(Estimator):
    """The forest as a pipeline stage over a feature vector; ``prediction`` 1 marks anomalies."""

    def __init__(self, key: str, features: str = "features", **settings):
        super().__init__()
        self.key, self.features, self.settings = key, features, settings

    def _fit(self, dataset: DataFrame) -> "IsolationForestModel":
        width = len(dataset.select(self.features).first()[0])
        cells = vector_to_array(col(self.features))
        names = [f"__f{i}" for i in range(width)]
        flat = dataset.select(self.key, *[cells[i].alias(n) for i, n in enumerate(names)])
        return IsolationForestModel(
            fit_isolation_forest(flat, names, self.key, **self.settings), self.features
        )


class IsolationForestModel(Model):
    def __init__(self, forest: IsolationForest, features: str):
        super().__init__()
        self.forest, self.features = forest, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cells = vector_to_array(col(self.features))
        flat = dataset.withColumns({n: cells[i] for i, n in enumerate(self.forest.columns)})
        scored = self.forest.transform(flat).drop(*self.forest.columns)
        return scored.withColumn("prediction", F.col("is_anomaly").cast("double"))
