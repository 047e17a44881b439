"""Registered queries: imputation, encoding, scaling and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.operators import prepare as P
from tabspark.operators.codes import apply_codes, code_table
from tabspark.plans.common import (
    GAPPY_EVENTS,
    GAPPY_LINEITEM,
    fine_slot_sql,
    gappy_events,
    gappy_lineitem,
    rounded_doubles,
    slot_sql,
    split_sql,
    table,
    union_sql,
)


def impute_numeric(spark, sf):
    """Skewed column: median; symmetric column: mean."""
    events, items = gappy_events(spark, sf), gappy_lineitem(spark, sf)
    skewed = P.fit_imputation(events, ["value"], []).apply(events)
    even = P.fit_imputation(items, ["l_discount"], []).apply(items)
    parts = [
        skewed.select(F.lit("value").alias("column"), F.col("event_id").alias("key"),
                      F.col("value").alias("filled")),
        even.select(F.lit("l_discount").alias("column"), F.col("l_orderkey").alias("key"),
                    F.col("l_discount").alias("filled")),
    ]
    return rounded_doubles(reduce(DataFrame.unionByName, parts))


def impute_mode(spark, sf):
    items = gappy_lineitem(spark, sf)
    filled = P.fit_imputation(items, [], ["l_returnflag"]).apply(items)
    return filled.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_orderkey") % 7 == 0).alias("n_filled")
    )


def label_encode(spark, sf):
    items = table(spark, sf, "lineitem")
    coded = P.fit_encoding(items, ["l_linestatus"]).apply(items)
    return coded.select("l_orderkey", "l_linenumber", "l_linestatus")


def one_hot(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return P.fit_encoding(orders, ["o_orderstatus"]).apply(orders)


def label_encode_high(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return P.fit_encoding(part, ["p_brand"]).apply(part)


def label_encode_by_partition(spark, sf):
    """The same codes by range partitions, as for columns with very many values."""
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return apply_codes(customer, "c_name", code_table(customer, "c_name", bound=100), bound=100)


def target_encode(spark, sf):
    items = table(spark, sf, "lineitem")
    encoding = P.fit_encoding(items, [], target="l_returnflag")
    counts = encoding.apply(items).groupBy(F.col("l_returnflag").alias("code")).agg(
        F.count("*").alias("n")
    )
    return counts.join(encoding.mapping(spark), "code").select("column", "category", "code", "n")


def standardize(spark, sf):
    items = gappy_lineitem(spark, sf)
    scaled = P.fit_scaling(items, ["l_quantity", "l_discount"]).apply(items)
    return rounded_doubles(scaled.select("l_orderkey", "l_partkey", "l_quantity", "l_discount"))


def split_hash(spark, sf):
    return P.with_split(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "split")


def split_stratified(spark, sf):
    orders = P.with_stratified_split(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus")
    return orders.select("o_orderkey", "o_orderstatus", "split")


def split_exact(spark, sf):
    customer = P.with_stratified_split(table(spark, sf, "customer"), "c_custkey", None)
    return customer.select("c_custkey", "split")


def fold_stratified(spark, sf):
    orders = P.with_stratified_fold(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus")
    return orders.select("o_orderkey", "o_orderstatus", "fold")


def _two_hundred_classes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("class"))


def split_stratified_many(spark, sf):
    return P.with_stratified_split(_two_hundred_classes(spark, sf), "o_orderkey", "class")


def fold_stratified_many(spark, sf):
    return P.with_stratified_fold(_two_hundred_classes(spark, sf), "o_orderkey", "class")


def prepared_orders(spark, sf):
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
    orders = table(spark, sf, "orders").select(*columns)
    gappy = orders.withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice"))
    )
    return P.prepare(gappy, "o_orderstatus", "o_orderkey", fit_on="all")


def prepared_table(spark, sf):
    prepared = prepared_orders(spark, sf)
    return rounded_doubles(prepared.table.select("o_orderkey", "o_orderstatus", *prepared.features, "split"))


def prep_summary(spark, sf):
    return prepared_orders(spark, sf).summary()


QUERIES = {
    "impute_numeric": impute_numeric,
    "impute_mode": impute_mode,
    "label_encode": label_encode,
    "one_hot": one_hot,
    "label_encode_high": label_encode_high,
    "label_encode_by_partition": label_encode_by_partition,
    "target_encode": target_encode,
    "standardize": standardize,
    "split_hash": split_hash,
    "split_stratified": split_stratified,
    "split_exact": split_exact,
    "fold_stratified": fold_stratified,
    "split_stratified_many": split_stratified_many,
    "fold_stratified_many": fold_stratified_many,
    "prepared_table": prepared_table,
    "prep_summary": prep_summary,
}

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _fill_sql(source: str, column: str, key: str) -> str:
    return f"""SELECT '{column}' AS "column", {key} AS key, round(coalesce({column}, fill), 4) AS filled
FROM {source}, (SELECT CASE WHEN abs(skewness({column})) > 1 THEN median({column})
    ELSE avg({column}) END AS fill FROM {source})"""


def _z_sql(column: str) -> str:
    return f"round(({column} - avg({column}) OVER ()) / stddev_pop({column}) OVER (), 4) + 0.0"


_PRICE = "CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END"

ORACLE = {
    "impute_numeric": union_sql(
        [
            _fill_sql(GAPPY_EVENTS, "value", "event_id"),
            _fill_sql(GAPPY_LINEITEM, "l_discount", "l_orderkey"),
        ]
    ),
    "impute_mode": f"""WITH m AS (SELECT l_returnflag AS mode FROM {GAPPY_LINEITEM}
    WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT coalesce(l_returnflag, mode) AS l_returnflag, count(*) AS n,
    count(*) FILTER (WHERE l_orderkey % 7 = 0) AS n_filled FROM {GAPPY_LINEITEM}, m GROUP BY 1""",
    "label_encode": """SELECT l_orderkey, l_linenumber,
    (SELECT count(DISTINCT s.l_linestatus) FROM lineitem s WHERE s.l_linestatus < i.l_linestatus)
    AS l_linestatus FROM lineitem i""",
    "one_hot": """SELECT o_orderkey, o_orderpriority, CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
    CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders""",
    "label_encode_high": """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code
    FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey, code AS p_brand FROM part JOIN c USING (p_brand)""",
    "label_encode_by_partition": """WITH c AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS code
    FROM (SELECT DISTINCT c_name FROM customer))
SELECT c_custkey, code AS c_name FROM customer JOIN c USING (c_name)""",
    "target_encode": """SELECT 'l_returnflag' AS "column", l_returnflag AS category,
    row_number() OVER (ORDER BY l_returnflag) - 1 AS code, count(*) AS n FROM lineitem GROUP BY l_returnflag""",
    "standardize": f"""SELECT l_orderkey, l_partkey, {_z_sql("l_quantity")} AS l_quantity,
    {_z_sql("l_discount")} AS l_discount FROM {GAPPY_LINEITEM}""",
    "split_hash": f"SELECT o_orderkey, {split_sql('o_orderkey')} AS split FROM orders",
    "split_stratified": f"""SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (
        PARTITION BY o_orderstatus ORDER BY {slot_sql('o_orderkey')}, {fine_slot_sql('o_orderkey')}, o_orderkey)
    <= ceil(0.2 * count(*) OVER (PARTITION BY o_orderstatus)) THEN 'test' ELSE 'train' END AS split FROM orders""",
    "split_exact": f"""SELECT c_custkey, CASE WHEN row_number() OVER (
        ORDER BY {slot_sql('c_custkey')}, {fine_slot_sql('c_custkey')}, c_custkey)
    <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM customer""",
    "fold_stratified": f"""SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (
        PARTITION BY o_orderstatus ORDER BY {slot_sql('o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders""",
    "split_stratified_many": f"""SELECT o_orderkey, o_custkey % 200 AS class, CASE WHEN row_number() OVER (
        PARTITION BY o_custkey % 200 ORDER BY {slot_sql('o_orderkey')}, {fine_slot_sql('o_orderkey')}, o_orderkey)
    <= ceil(0.2 * count(*) OVER (PARTITION BY o_custkey % 200)) THEN 'test' ELSE 'train' END AS split FROM orders""",
    "fold_stratified_many": f"""SELECT o_orderkey, o_custkey % 200 AS class, CAST((row_number() OVER (
        PARTITION BY o_custkey % 200 ORDER BY {slot_sql('o_orderkey')}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders""",
    "prepared_table": f"""WITH f AS (SELECT *, {_PRICE} AS price FROM orders),
    g AS (SELECT *, coalesce(price, CASE WHEN abs(skewness(price) OVER ()) > 1 THEN median(price) OVER ()
        ELSE avg(price) OVER () END) AS filled FROM f)
SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS o_orderstatus,
    {_z_sql("filled")} AS o_totalprice, {", ".join(
        f"CAST(o_orderpriority = '{p}' AS INTEGER) AS " + chr(34) + f"o_orderpriority_{p}" + chr(34)
        for p in PRIORITIES[1:])},
    {split_sql('o_orderkey')} AS split FROM g""",
    "prep_summary": f"""SELECT 1 + (SELECT count(DISTINCT o_orderpriority) - 1 FROM orders) AS n_features,
    count(*) FILTER (WHERE {split_sql('o_orderkey')} = 'train') AS train_size,
    count(*) FILTER (WHERE {split_sql('o_orderkey')} = 'test') AS test_size,
    CAST(count(*) > count({_PRICE}) AS BIGINT) AS imputed_columns, CAST(1 AS BIGINT) AS encoded_columns FROM orders""",
}
