"""Exact nearest neighbours and local outlier factors.

Vectors are assigned to the nearest of a fixed number of pivots. Triangle-inequality
bounds tell which cells can hold a neighbour of a cell, so a vector is only sent
there, once for each group of near cells. Groups are cut into blocks of bounded size on both
sides; a task compares two blocks and emits the ``k`` best per vector, never all pairs. A matrix
product finds the few pairs that can be among the best, and these are measured exactly. Equal vectors are merged
first, so a vector copied very often is one row with a weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import col
from tabspark.functions.scratch import materialise
from tabspark.operators.models.blocks import (
    PIVOTS,
    assign_cells,
    cell_sizes,
    choose_pivots,
    compare_blocks,
    distances,
    distinct_vectors,
    finite_rows,
    group_cells,
    in_groups,
    matrix,
    nearest_pairs,
    rows_per_block,
    send_to_groups,
)

# Neighbours of the outlier factor and its guard against division by zero.
NEIGHBOURS = 20
REACH_GUARD = 1e-10


def nearest_neighbours(
    base: DataFrame, k: int, queries: DataFrame | None = None, pivots: int = PIVOTS,
    block_rows: int | None = None,
) -> DataFrame:
    """``(id, neighbour, distance, weight)``: the ``k`` nearest base vectors of every query.

    Both tables are ``(id, vector, weight)`` as from :func:`distinct_vectors`. Without
    queries every base vector is asked for its neighbours other than itself. Ties
    go to the smaller id. ``weight`` is the neighbour's.
    """
    itself = queries is None
    centres = choose_pivots(base, pivots)
    placed = materialise(assign_cells(base, centres))
    asked = placed if itself else materialise(assign_cells(queries, centres))
    radius, rows, reach = _bounds(placed, asked, centres, k + 1 if itself else k)
    block_rows = block_rows or rows_per_block(int(rows.sum()), centres.shape[-1])
    groups = group_cells(centres, rows, block_rows)
    sent = send_to_groups(base, centres, radius, reach, groups)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "distance": [], "weight": []})
        b = b.sort_values("other", kind="stable")
        names, weights, own = b["other"].to_numpy(), b["other_weight"].to_numpy(), a["id"].to_numpy()
        x, y = matrix(a["vector"]), matrix(b["other_vector"])
        # What is not finite is near nothing.
        of_a, of_b = finite_rows(x), finite_rows(y)
        rows, at, found = nearest_pairs(
            x[of_a], y[of_b], k, own[of_a] if itself else None, names[of_b] if itself else None
        )
        rows, at = of_a[rows], of_b[at]
        return pd.DataFrame(
            {"id": own[rows], "neighbour": names[at], "distance": found,
             "weight": weights[at]}
        )

    pairs = compare_blocks(
        in_groups(asked, groups), sent, best, "id bigint, neighbour bigint, distance double, weight bigint", block_rows
    )
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _bounds(
    placed: DataFrame, asked: DataFrame, pivots: np.ndarray, wanted: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell: radius and number of its queries, and a distance within which ``wanted`` base vectors lie."""
    radius, rows = cell_sizes(asked, len(pivots))
    reach = np.full(len(pivots), -np.inf)
    nearest = Window.partitionBy("cell").orderBy("gap", "id")
    first = (
        placed.withColumn("place", F.row_number().over(nearest))
        .filter(F.col("place") <= wanted)
        .groupBy("cell")
        .agg(F.collect_list("gap").alias("gaps"))  # at most `wanted` numbers per pivot
        .collect()
    )
    between = distances(pivots, pivots)
    for i in np.flatnonzero(np.isfinite(radius)):
        ways = np.concatenate([between[i, r["cell"]] + np.array(r["gaps"]) for r in first])
        reach[i] = np.inf if len(ways) < wanted else radius[i] + np.partition(ways, wanted - 1)[wanted - 1]
    return radius, rows, reach


def _shares(neighbours: DataFrame, k: int, own: DataFrame | None) -> DataFrame:
    """``(id, neighbour, distance, take)``: copies counted until ``k`` neighbours are reached."""
    table = neighbours.select("id", "neighbour", "distance", "weight")
    if own is not None:
        copies = own.filter(F.col("weight") > 1).select(
            "id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"),
            (F.col("weight") - 1).alias("weight"),
        )
        table = table.unionByName(copies)
    # At most k + 1 rows per id.
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    upto = F.sum("weight").over(order)
    counted = table.withColumn("take", F.least(F.col("weight"), F.lit(k) - (upto - F.col("weight"))))
    return counted.filter(F.col("take") > 0)


def local_outlier_factor(
    df: DataFrame, key: str, vector: str, k: int = NEIGHBOURS, pivots: int = PIVOTS,
    block_rows: int | None = None,
) -> DataFrame:
    """``(key, lof)``: density of a row's neighbours over its own; about 1 for inliers, NULL without a vector."""
    base = materialise(distinct_vectors(df.filter(col(vector).isNotNull()), key, vector))
    near = _shares(nearest_neighbours(base, k, pivots=pivots, block_rows=block_rows), k, base)
    near = materialise(near)
    density = materialise(_density(near, near.groupBy("id").agg(F.max("distance").alias("reach"))))
    factors = _factor(near, density, density).join(base, "id").select("vector", "lof")
    rows = df.select(col(key), col(vector).cast("array<double>").alias("vector"))
    return rows.join(factors, "vector", "left").select(key, "lof")


def novelty_factor(
    train: DataFrame, new: DataFrame, key: str, vector: str, k: int = NEIGHBOURS,
    pivots: int = PIVOTS, block_rows: int | None = None,
) -> DataFrame:
    """``(key, lof)`` of new rows against a training table."""
    base = materialise(distinct_vectors(train.filter(col(vector).isNotNull()), key, vector))
    near = materialise(_shares(nearest_neighbours(base, k, None, pivots, block_rows), k, base))
    reach = near.groupBy("id").agg(F.max("distance").alias("reach"))
    density = materialise(_density(near, reach))
    asked = materialise(distinct_vectors(new.filter(col(vector).isNotNull()), key, vector))
    found = materialise(_shares(nearest_neighbours(base, k, asked, pivots, block_rows), k, None))
    factors = _factor(found, density, _density(found, reach)).join(asked, "id").select("vector", "lof")
    rows = new.select(col(key), col(vector).cast("array<double>").alias("vector"))
    return rows.join(factors, "vector", "left").select(key, "lof")


def _density(near: DataFrame, reach: DataFrame) -> DataFrame:
    """``(id, density)``: inverse mean reachability distance to the neighbours."""
    limits = reach.select(F.col("id").alias("neighbour"), "reach")
    reached = F.greatest(F.col("distance"), F.col("reach"))
    mean = F.sum(reached * F.col("take")) / F.sum("take")
    return near.join(limits, "neighbour").groupBy("id").agg((1 / (mean + REACH_GUARD)).alias("density"))


def _factor(near: DataFrame, base_density: DataFrame, own_density: DataFrame) -> DataFrame:
    around = base_density.select(F.col("id").alias("neighbour"), F.col("density").alias("around"))
    mean = F.sum(F.col("around") * F.col("take")) / F.sum("take")
    return (
        near.join(around, "neighbour").groupBy("id").agg(mean.alias("around"))
        .join(own_density, "id")
        .select("id", (F.col("around") / F.col("density")).alias("lof"))
    )
