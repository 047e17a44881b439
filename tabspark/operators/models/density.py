"""Exact density clustering.

Up to three numeric columns are clustered on a grid. The grid's cells are so small that all points of a cell are within ``eps`` of each
other. A cell with enough points therefore needs no comparison inside it: all its
points are core, and they belong together. Equal points are merged into one weighted
point first. Whether two cells touch is decided on bounding boxes that are refined
only where they do not decide yet, so two full cells are never compared point by point.

Longer vectors are clustered in cells around pivots, compared block by block; a pair of
blocks reports counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.columns import col
from tabspark.functions.scratch import materialise
from tabspark.operators.components import connected_components
from tabspark.operators.models.blocks import (
    PIVOTS,
    assign_cells,
    cell_sizes,
    choose_pivots,
    compare_blocks,
    distinct_vectors,
    finite_rows,
    group_cells,
    in_groups,
    matrix,
    merge_labels,
    pair_distances,
    rows_per_block,
    send_to_groups,
    within,
)

# Neighbourhood radius, points of a dense neighbourhood, mark of noise.
EPS = 0.5
MIN_POINTS = 5
NOISE = -1

GRID_COLUMNS = 3
REFINE = 2  # bits per refinement: boxes are cut into 2**REFINE parts per column
LAST_LEVEL = 26  # beyond, boxes are single points


def density_clusters(
    df: DataFrame, key: str, columns: Sequence[str], eps: float = EPS, min_points: int = MIN_POINTS
) -> DataFrame:
    """``(key, cluster, is_core)``; a cluster is named by its smallest core key, noise is -1.

    Points near several clusters join the one of their nearest core point. The key
    must be an integer; rows with a missing value are noise.
    """
    columns = list(columns)
    if not columns:
        raise ValueError("no column to cluster by")
    if len(columns) > GRID_COLUMNS:
        vectors = df.withColumn("__v", F.array(*[col(c).cast("double") + F.lit(0.0) for c in columns]))
        return density_clusters_of_vectors(vectors, key, "__v", eps, min_points)
    axes = range(len(columns))
    x, g = [f"x{i}" for i in axes], [f"g{i}" for i in axes]
    side = eps / math.sqrt(len(columns)) * (1 - 1e-9)
    rows = df.select(
        col(key).alias("key"), *[(col(c).cast("double") + F.lit(0.0)).alias(x[i]) for i, c in enumerate(columns)]
    )
    points = materialise(
        rows.dropna()
        .groupBy(*x)
        .agg(F.min("key").cast("bigint").alias("id"), F.count("*").alias("weight"))
        .select("id", "weight", *x, *[F.floor(F.col(x[i]) / side).alias(g[i]) for i in axes])
    )
    totals = materialise(points.groupBy(*g).agg(F.sum("weight").alias("total")))
    full = totals.filter(F.col("total") >= min_points).select(*g)
    # Fewer than min_points points per cell from here on.
    sparse = points.join(totals.filter(F.col("total") < min_points).select(*g), g)
    near = _near(sparse, points, x, g, side, eps)
    counts = near.groupBy("id").agg(F.sum("other_weight").alias("near"))
    sparse = materialise(
        sparse.join(counts, "id").withColumn("is_core", F.col("near") >= min_points)
    )
    core = points.join(full, g).select("id", *x, *g).unionByName(
        sparse.filter("is_core").select("id", *x, *g)
    )
    nodes = materialise(
        core.groupBy(*g).agg(
            F.min("id").alias("node"),
            *[F.min(c).alias(f"lo_{c}") for c in x],
            *[F.max(c).alias(f"hi_{c}") for c in x],
        )
    )
    core = materialise(core.join(nodes.select(*g, "node"), g))
    edges = _touching(nodes, core, x, g, side, eps)
    parts = materialise(connected_components(nodes.select(F.col("node").alias("id")), edges))
    of_node = parts.select(F.col("id").alias("node"), "component")
    inner = core.join(of_node, "node").select("id", "component")
    outer = sparse.filter(~F.col("is_core"))
    border = (
        _near(outer, core.withColumn("weight", F.lit(1)), x, g, side, eps)
        .join(inner.select(F.col("id").alias("other"), "component"), "other")
        .groupBy("id")
        .agg(F.min(F.struct("distance", "component"))["component"].alias("component"))
    )
    found = inner.withColumn("is_core", F.lit(True)).unionByName(
        border.withColumn("is_core", F.lit(False))
    )
    labelled = points.select("id", *x).join(found, "id", "left")
    return rows.join(labelled.drop("id"), x, "left").select(
        F.col("key").alias(key),
        F.coalesce("component", F.lit(NOISE)).cast("bigint").alias("cluster"),
        F.coalesce("is_core", F.lit(False)).alias("is_core"),
    )


def density_clusters_of_vectors(
    df: DataFrame, key: str, vector: str, eps: float = EPS, min_points: int = MIN_POINTS,
    pivots: int = PIVOTS, block_rows: int | None = None,
) -> DataFrame:
    """``(key, cluster, is_core)`` as :func:`density_clusters`, for an array column of any length."""
    rows = df.select(col(key).alias("key"), col(vector).cast("array<double>").alias("vector"))
    whole = rows.filter(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v)))
    base = materialise(distinct_vectors(whole, "key", "vector"))
    centres = choose_pivots(base, pivots)
    placed = materialise(assign_cells(base, centres))
    radius, sizes = cell_sizes(placed, len(centres))
    reach = np.full(len(centres), eps)
    block_rows = block_rows or rows_per_block(int(sizes.sum()), centres.shape[-1])
    groups = group_cells(centres, sizes, block_rows)
    placed = in_groups(placed, groups)

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "near": []})
        x, y, weights = matrix(a["vector"]), matrix(b["other_vector"]), b["other_weight"].to_numpy()
        # What is not finite is near nothing.
        of_a, of_b = finite_rows(x), finite_rows(y)
        weights, found = weights[of_b], np.zeros(len(of_a), np.int64)
        for i, j, near in within(x[of_a], y[of_b], eps):
            own = weights[j : j + near.shape[1]]
            if (own == 1).all():
                found[i : i + len(near)] += np.count_nonzero(near, axis=1)
            else:
                found[i : i + len(near)] += near @ own
        total = np.zeros(len(a), np.int64)
        total[of_a] = found
        return pd.DataFrame({"id": a["id"], "near": total})

    counts = compare_blocks(
        placed, send_to_groups(base, centres, radius, reach, groups), count, "id bigint, near bigint", block_rows
    ).groupBy("id").agg((F.sum("near") >= min_points).alias("core"))
    marked = materialise(placed.join(counts, "id"))

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Core rows: links to the smallest connected id. Others: their nearest core vector."""
        empty = pd.DataFrame({"id": [], "other": [], "distance": [], "core": []})
        b = b[b["other_core"]]
        if a.empty or b.empty:
            return empty
        x, y = matrix(a["vector"]), matrix(b["other_vector"])
        of_a, of_b = finite_rows(x), finite_rows(y)
        x, y = x[of_a], y[of_b]
        own, names = a["id"].to_numpy()[of_a], b["other"].to_numpy()[of_b]
        core = a["core"].to_numpy(bool)[of_a]
        label, outside = np.arange(len(x) + len(y)), [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i, j, near in within(x, y, eps):
            r, c = np.nonzero(near)
            r, c = r + i, c + j
            inner = core[r]
            label = merge_labels(label, r[inner], c[inner] + len(x))
            if not inner.all():
                # Fewer than min_points each, as these rows are not core.
                r, c = r[~inner], c[~inner]
                outside.append((r, c, pair_distances(x, y, r, c)))
        ends = np.r_[own, names]
        at = np.flatnonzero(label != np.arange(len(label)))
        linked = pd.DataFrame({"id": ends[at], "other": ends[label[at]], "distance": 0.0, "core": True})
        # Every core vector at the smallest distance may decide; blocks keep one per distance tie.
        r, c, d = (np.concatenate(part) for part in zip(*outside, strict=True))
        gap = np.full(len(x), np.inf)
        np.minimum.at(gap, r, d)
        r, c, d = r[d == gap[r]], c[d == gap[r]], d[d == gap[r]]
        return pd.concat([linked, pd.DataFrame({"id": own[r], "other": names[c], "distance": d, "core": False})])

    # Core vectors alone are sent: nothing else links or attracts.
    others = send_to_groups(marked.filter("core").drop("cell", "gap"), centres, radius, reach, groups)
    found = materialise(
        compare_blocks(
            marked, others, link, "id bigint, other bigint, distance double, core boolean", block_rows,
            extra=("core",),
        )
    )
    nodes = marked.filter("core").select("id")
    edges = found.filter("core").select(F.col("id").alias("a"), F.col("other").alias("b"))
    inner = materialise(connected_components(nodes, edges))
    border = (
        found.filter(~F.col("core"))
        .join(inner.select(F.col("id").alias("other"), "component"), "other")
        .groupBy("id")
        .agg(F.min(F.struct("distance", "component"))["component"].alias("component"))
    )
    labels = inner.withColumn("is_core", F.lit(True)).unionByName(
        border.withColumn("is_core", F.lit(False))
    )
    labelled = base.select("id", "vector").join(labels, "id", "left").drop("id")
    return rows.join(labelled, "vector", "left").select(
        F.col("key").alias(key),
        F.coalesce("component", F.lit(NOISE)).cast("bigint").alias("cluster"),
        F.coalesce("is_core", F.lit(False)).alias("is_core"),
    )


def _offsets(dims: int, side: float, eps: float) -> list[tuple[int, ...]]:
    reach = math.floor(eps / side) + 1
    return list(product(range(-reach, reach + 1), repeat=dims))


def _root(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def _near(few: DataFrame, many: DataFrame, x: list[str], g: list[str], side: float, eps: float) -> DataFrame:
    """``(id, other, other_weight, distance)`` within ``eps``; ``few`` has few points per cell."""
    shifts = F.array(
        *[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(shift)])
          for shift in _offsets(len(x), side, eps)]
    )
    # Send a point only to cells whose box it can reach.
    spread = few.select("id", *x, *g, F.inline(shifts))
    gaps = []
    for i in range(len(x)):
        start = (F.col(g[i]) + F.col(f"o{i}")) * side
        gaps.append(F.greatest(F.lit(0.0), start - F.col(x[i]), F.col(x[i]) - start - side))
    sent = spread.filter(_root(gaps) <= eps * (1 + 1e-9)).select(
        "id", *[F.col(c).alias(f"my_{c}") for c in x],
        *[(F.col(g[i]) + F.col(f"o{i}")).alias(g[i]) for i in range(len(g))],
    )
    others = many.select(F.col("id").alias("other"), F.col("weight").alias("other_weight"), *x, *g)
    distance = _root([F.col(f"my_{c}") - F.col(c) for c in x])
    return (
        sent.join(others, g)
        .withColumn("distance", distance)
        .filter(F.col("distance") <= eps)
        .select("id", "other", "other_weight", "distance")
    )



def _decide(pairs: DataFrame, x: list[str], eps: float) -> DataFrame:
    """Add ``sure`` (every point pair is within eps) and drop pairs of boxes too far apart."""
    least, most = [], []
    for c in x:
        a_lo, a_hi, b_lo, b_hi = (F.col(f"{t}_{e}_{c}") for t in "ab" for e in ("lo", "hi"))
        least.append(F.greatest(F.lit(0.0), b_lo - a_hi, a_lo - b_hi))
        most.append(F.greatest(F.abs(b_hi - a_lo), F.abs(a_hi - b_lo)))
    return pairs.filter(_root(least) <= eps).withColumn("sure", _root(most) <= eps)


def _touching(nodes: DataFrame, core: DataFrame, x: list[str], g: list[str], side: float, eps: float) -> DataFrame:
    """``(a, b)``: pairs of cells that hold core points within ``eps`` of each other."""
    half = [o for o in _offsets(len(x), side, eps) if o > (0,) * len(x)]
    shifts = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in half])
    boxes = [f"{e}_{c}" for c in x for e in ("lo", "hi")]
    first = nodes.select("node", *boxes, *g, F.inline(shifts)).select(
        *[F.col(n).alias(f"a_{n}") for n in ("node", *boxes)],
        *[(F.col(g[i]) + F.col(f"o{i}")).alias(g[i]) for i in range(len(g))],
    )
    second = nodes.select(*[F.col(n).alias(f"b_{n}") for n in ("node", *boxes)], *g)
    level = 0
    open_pairs = materialise(_decide(first.join(second, g), x, eps))
    found = open_pairs.filter("sure").select("a_node", "b_node")
    open_pairs = open_pairs.filter("NOT sure").select(
        "a_node", "b_node", *[F.lit(None).cast("bigint").alias(f"{t}_s{i}") for t in "ab" for i in range(len(x))]
    )
    subs = [f"s{i}" for i in range(len(x))]
    while not open_pairs.isEmpty():
        level += REFINE
        last = level >= LAST_LEVEL
        involved = open_pairs.select(F.explode(F.array("a_node", "b_node")).alias("node")).distinct()
        here = core.join(involved, "node")
        for i, c in enumerate(x):
            cut = F.col(c) / side * float(2**level)
            here = here.withColumn(f"s{i}", F.floor(cut))
        keys = ["node", *subs, *(x if last else [])]
        small = here.groupBy(*keys).agg(
            *[F.min(c).alias(f"lo_{c}") for c in x], *[F.max(c).alias(f"hi_{c}") for c in x]
        )
        # The box one level up is found by integer division of the box numbers.
        for s in subs:
            small = small.withColumn(f"up_{s}", F.floor(F.col(s) / 2**REFINE))
        extra = [*subs, *[f"up_{s}" for s in subs]]
        small = materialise(small)
        joined = open_pairs
        for tag in "ab":
            test = F.col(f"{tag}_node") == F.col("node")
            for s in subs:
                parent = F.col(f"{tag}_{s}")
                test = test & (parent.isNull() | (parent == F.col(f"up_{s}")))
            child = small.select("node", *boxes, *extra)
            joined = joined.join(child, test).select(
                *[c for c in joined.columns if c not in {f"{tag}_{s}" for s in subs} | {f"{tag}_node"}],
                *[F.col(n).alias(f"{tag}_{n}") for n in ("node", *boxes, *subs)],
            )
        decided = materialise(_decide(joined, x, eps))
        sure = decided.filter("sure").select("a_node", "b_node").distinct()
        found = materialise(found.unionByName(sure))
        open_pairs = decided.filter("NOT sure").select(
            "a_node", "b_node", *[f"{t}_{s}" for t in "ab" for s in subs]
        ).join(sure, ["a_node", "b_node"], "left_anti")
    return found.distinct().select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
