"""Connected components of a graph by alternating star contractions (logarithmic rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.scratch import materialise, release


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)`` for ``nodes(id)`` and undirected ``edges(a, b)``; named by the smallest id.

    Each round links neighbours to the smallest one nearby, first upwards, then
    downwards; the graph becomes one star per component. Every round is saved, and the
    round before it deleted.
    """
    links = materialise(_clean(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    state = _checksum(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = _clean(
            both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, links = links, materialise(_clean(down.unionByName(low.select("u", F.col("m").alias("v")))))
        release(old)
        before, state = state, _checksum(links)
        if state == before:
            break
    found = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _clean(links: DataFrame) -> DataFrame:
    """Distinct links from the larger to the smaller id, loops left out."""
    return (
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _checksum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
