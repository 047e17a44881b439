"""Vectors in cells around pivots, and pairs of bounded blocks of cells.

Shared by the exact neighbour and density operators. A table of vectors is
``(id, vector, weight)``; equal vectors are one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.columns import col
from tabspark.functions.scratch import materialise

PIVOTS = 256
# Rows of a block on the asked side: a table is cut in BLOCKS, each of at least BLOCK_ROWS rows and at most
# BLOCK_VALUES numbers. A vector is shipped once a block of the other side, so blocks grow with the table.
BLOCKS, BLOCK_ROWS, BLOCK_VALUES = 24, 2048, 1 << 20
# Blocks of the sent side are longer: they cost memory but no further copies.
SENT_BLOCK = 4
# Pairs whose distances a task holds at once.
TILE_ROWS, TILE_COLUMNS = 256, 2048


def matrix(cells: pd.Series) -> np.ndarray:
    return np.stack(cells.to_numpy()).astype(float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a slice of rows at a time (no cancellation)."""
    result = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        delta = a[start : start + step, None, :] - b[None, :, :]
        result[start : start + step] = np.sqrt((delta * delta).sum(axis=2))
    return result


def pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The numbers of :func:`distances` for some pairs only."""
    result = np.empty(len(rows))
    step = max(1, 1_000_000 // max(1, a.shape[1]))
    for start in range(0, len(rows), step):
        delta = a[rows[start : start + step]] - b[columns[start : start + step]]
        result[start : start + step] = np.sqrt((delta * delta).sum(axis=1))
    return result


def tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, float]]:
    """``(row, column, squares, slack)``: squared distances of all pairs, a tile at a time, row by row.

    They come from a matrix product around the middle of ``b`` and may be wrong by ``slack``, so whoever
    decides by them asks :func:`pair_distances` about the pairs in doubt. All numbers must be finite.
    """
    if not len(a) or not len(b):
        return
    with np.errstate(over="ignore", invalid="ignore"):
        middle = b.mean(axis=0)
        a, b = a - middle, b - middle
        a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
        slack = 8 * (a.shape[1] + 8) * np.finfo(float).eps * (a2.max() + b2.max())
    known = bool(np.isfinite(slack))
    left = np.column_stack([a, a2, np.ones(len(a))])
    right = np.ascontiguousarray(np.column_stack([-2.0 * b, np.ones(len(b)), b2]).T)
    for i in range(0, len(a), TILE_ROWS):
        for j in range(0, len(b), TILE_COLUMNS):
            if known:
                yield i, j, left[i : i + TILE_ROWS] @ right[:, j : j + TILE_COLUMNS], slack
            else:  # too large to be squared: every pair is in doubt
                yield i, j, np.zeros((len(a[i : i + TILE_ROWS]), len(b[j : j + TILE_COLUMNS]))), np.inf


def finite_rows(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.isfinite(x).all(axis=1))


def within(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """``(row, column, near)``: by tiles, which pairs have a distance of at most ``eps``."""
    for i, j, squares, slack in tiles(a, b):
        slack = slack + 1e-14 * eps * eps
        near = squares <= eps * eps + slack
        doubt = near & ~(squares < eps * eps - slack)
        if doubt.any():
            r, c = np.nonzero(doubt)
            near[r, c] = pair_distances(a, b, r + i, c + j) <= eps
        yield i, j, near


def nearest_pairs(
    a: np.ndarray, b: np.ndarray, k: int, a_names: np.ndarray | None = None, b_names: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and distances of the ``k`` nearest of ``b`` for each of ``a``, ties to the earlier column.

    With names, pairs of equal names are left out; a name occurs once in ``b``.
    """
    found = []
    limit = r = c = d = None
    for i, j, squares, slack in tiles(a, b):
        if j == 0:
            if limit is not None:
                found.append((r, c, d))
            limit = np.full(len(squares), np.inf)
            r, c, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            if squares.shape[1] > k + 1:
                # One more than wanted, as a row may meet itself.
                limit = np.partition(squares, k, axis=1)[:, k] + 2 * slack
        new_r, new_c = np.nonzero(squares <= limit[:, None])
        if not len(new_r):
            continue
        new_r, new_c = new_r + i, new_c + j
        if a_names is not None:
            other = a_names[new_r] != b_names[new_c]
            new_r, new_c = new_r[other], new_c[other]
        with np.errstate(over="ignore"):
            new_d = pair_distances(a, b, new_r, new_c)
        r, c, d = np.r_[r, new_r], np.r_[c, new_c], np.r_[d, new_d]
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = (place < k) & np.isfinite(d)
        r, c, d, place = r[kept], c[kept], d[kept], place[kept]
        full = place == k - 1
        at = r[full] - i
        limit[at] = np.minimum(limit[at], d[full] ** 2 * (1 + 1e-14) + slack)
    if limit is not None:
        found.append((r, c, d))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merge_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``label`` (the smallest node of each node's group) after linking nodes ``u`` and ``v`` pairwise."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def distinct_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, vector, weight)``: one row per different vector, named by its smallest key."""
    return (
        df.select(col(key).cast("bigint").alias("id"), col(vector).cast("array<double>").alias("vector"))
        .groupBy("vector")
        .agg(F.min("id").alias("id"), F.count("*").alias("weight"))
        .select("id", "vector", "weight")
    )


def choose_pivots(base: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """A fixed number of vectors, chosen by hash; they reach the driver."""
    chosen = base.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").collect()
    return np.array([r["vector"] for r in chosen], dtype=float)


def assign_cells(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot ``cell`` and the distance ``gap`` to it."""

    @F.pandas_udf("cell int, gap double")
    def nearest(cells: pd.Series) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame({"cell": np.array([], dtype="int32"), "gap": np.array([], dtype=float)})
        d = distances(matrix(cells), pivots)
        best = d.argmin(axis=1)
        return pd.DataFrame({"cell": best.astype("int32"), "gap": d[np.arange(len(d)), best]})

    return df.withColumn("__at", nearest("vector")).select("*", "__at.cell", "__at.gap").drop("__at")


def cell_sizes(asked: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest gap per cell, -inf for empty cells, and rows per cell."""
    radius, rows = np.full(n, -np.inf), np.zeros(n, np.int64)
    for r in asked.groupBy("cell").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():
        radius[r["cell"]], rows[r["cell"]] = r["radius"], r["n"]
    return radius, rows


def rows_per_block(rows: int, width: int) -> int:
    return max(1, min(max(BLOCK_ROWS, rows // BLOCKS), BLOCK_VALUES // max(1, width)))


def group_cells(pivots: np.ndarray, rows: np.ndarray, block_rows: int) -> np.ndarray:
    """A group for each cell: cells near each other together, while they have at most ``block_rows`` rows.

    A vector is sent once to a group. Where bounds exclude few cells, as in many dimensions, that
    is a copy a block and not a copy a cell.
    """
    groups = np.zeros(len(pivots), np.int64)
    if not len(pivots):
        return groups
    between = distances(pivots, pivots)
    left = np.ones(len(pivots), bool)
    at, group, held = 0, 0, 0
    while True:
        if held and held + rows[at] > block_rows:
            group, held = group + 1, 0
        groups[at] = group
        held += rows[at]
        left[at] = False
        if not left.any():
            return groups
        at = int(np.where(left, np.where(np.isnan(between[at]), np.inf, between[at]), np.inf).argmin())
        if not left[at]:
            at = int(np.flatnonzero(left)[0])


def in_groups(placed: DataFrame, groups: np.ndarray) -> DataFrame:
    """Replace each row's cell by the cell's group."""
    return placed.withColumn("cell", F.array(*[F.lit(int(g)) for g in [*groups, 0]])[F.col("cell")])


def send_to_groups(
    base: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: np.ndarray, groups: np.ndarray
) -> DataFrame:
    """Copy each base vector to the groups of the cells with a vector that may lie within the cell's ``reach``."""

    @F.pandas_udf("array<int>")
    def targets(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        # No vector of a cell is nearer than distance - radius; a little slack covers rounding.
        lower = distances(matrix(vectors), pivots) - np.where(np.isfinite(radius), radius, 0.0)
        near = (lower <= reach * (1 + 1e-9) + 1e-12) & np.isfinite(radius)
        return pd.Series([np.unique(groups[row]).astype("int32") for row in near])

    return base.withColumn("cell", F.explode(targets("vector")))


def compare_blocks(
    asked: DataFrame, sent: DataFrame, work: Callable, schema: str, block_rows: int,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Run ``work(asked block, sent block)`` for every pair of blocks of the same cell.

    A cell (or group of cells) is cut into blocks of about ``block_rows``, and ``SENT_BLOCK`` times
    as many on the sent side, so no task holds a whole cell. The second block's columns are named ``other…``; ``extra`` columns are
    passed on both sides.
    """
    q_sizes = asked.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("q_blocks"))
    c_sizes = sent.groupBy("cell").agg(F.ceil(F.count("*") / (SENT_BLOCK * block_rows)).alias("c_blocks"))
    # One row per pivot at most.
    sizes = F.broadcast(materialise(q_sizes.join(c_sizes, "cell")))

    def block(count: str):
        return F.pmod(F.xxhash64("id"), F.col(count)).cast("int")

    def others(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))

    names = ("id", "vector", "weight", *extra)
    left = asked.join(sizes, "cell").select(
        F.col("cell"), *[F.col(c).alias(c) for c in names],
        block("q_blocks").alias("qb"), others("c_blocks").alias("cb"),
    )
    right = sent.join(sizes, "cell").select(
        F.col("cell").alias("cell"), *[F.col(c).alias("other" if c == "id" else f"other_{c}") for c in names],
        block("c_blocks").alias("cb"), others("q_blocks").alias("qb"),
    )
    keys = ["cell", "qb", "cb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)
