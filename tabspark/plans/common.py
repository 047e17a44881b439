"""Inputs shared by the registered queries, each with its SQL twin.

The driver tables hold no missing values, so queries that need gaps inject them by a
rule on the key that SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.columns import col
from tabspark.functions.numeric import rounded
from tabspark.sources.tables import read_any

MEASURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_any(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round double columns, so that results compare across engines."""
    return df.select(
        *[rounded(col(c), digits).alias(c) if t == "double" else col(c) for c, t in df.dtypes]
    )


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# lineitem with gaps in two measures and one category.
def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("l_discount", F.when(key % 13 != 0, F.col("l_discount")))
        .withColumn("l_returnflag", F.when(key % 7 != 0, F.col("l_returnflag")))
    )


GAPPY_LINEITEM = """(SELECT * REPLACE (
    CASE WHEN l_orderkey % 13 <> 0 THEN l_discount END AS l_discount,
    CASE WHEN l_orderkey % 7 <> 0 THEN l_returnflag END AS l_returnflag) FROM lineitem)"""


# events with gaps in its skewed value column.
def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "value", F.when(F.col("event_id") % 11 != 0, F.col("value"))
    )


GAPPY_EVENTS = """(SELECT * REPLACE (
    CASE WHEN event_id % 11 <> 0 THEN value END AS value) FROM events)"""


def slot_sql(key: str, seed: int = 42, start: int = 1) -> str:
    """The row hash of tabspark.functions.hashing.slot in SQL."""
    digest = f"md5('{seed}|' || coalesce(CAST({key} AS VARCHAR), '~'))"
    return f"(CAST('0x' || substr({digest}, {start}, 8) AS BIGINT) % 10000)"


def fine_slot_sql(key: str, seed: int = 42) -> str:
    return slot_sql(key, seed, 9)


def split_sql(key: str, test_size: float = 0.2) -> str:
    return f"CASE WHEN {slot_sql(key)} < {round(test_size * 10000)} THEN 'test' ELSE 'train' END"
