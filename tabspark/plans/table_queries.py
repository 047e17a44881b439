"""Registered queries: scans, sinks, validation and column profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.hashing import with_fold
from tabspark.functions.scratch import scratch_path
from tabspark.operators import profile as P
from tabspark.operators.prepare import with_split
from tabspark.operators.validate import split_overlap, validate_table
from tabspark.plans.common import (
    GAPPY_LINEITEM,
    MEASURES,
    gappy_lineitem,
    rounded_doubles,
    slot_sql,
    split_sql,
    table,
    union_sql,
)
from tabspark.sources.tables import read_any, write_table


def _round_trip(spark: SparkSession, df: DataFrame, suffix: str) -> DataFrame:
    path = scratch_path(spark, "table") + suffix
    write_table(df, path)
    return read_any(spark, path)


def scan_parquet(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


def scan_csv(spark, sf):
    return _round_trip(spark, table(spark, sf, "customer"), ".csv")


def scan_tsv(spark, sf):
    return _round_trip(spark, table(spark, sf, "supplier"), ".tsv")


def scan_csv_texts(spark, sf):
    return _round_trip(spark, table(spark, sf, "documents"), ".csv")


def scan_tsv_texts(spark, sf):
    return _round_trip(spark, table(spark, sf, "documents"), ".tsv")


def scan_jsonl(spark, sf):
    orders = _round_trip(spark, table(spark, sf, "orders"), ".jsonl")
    return orders.withColumn("o_orderdate", F.to_date("o_orderdate"))


def scan_json(spark, sf):
    return _round_trip(spark, table(spark, sf, "documents"), ".json")


def sink_roundtrip(spark, sf):
    part = table(spark, sf, "part")
    parts = [
        _round_trip(spark, part, "." + suffix).agg(
            F.lit(suffix).alias("format"),
            F.count("*").alias("n"),
            F.sum("p_partkey").alias("key_sum"),
            F.round(F.sum("p_retailprice"), 2).alias("price_sum"),
            F.count_distinct("p_brand").alias("brands"),
        )
        for suffix in ("csv", "tsv", "parquet", "json", "jsonl")
    ]
    return reduce(DataFrame.unionByName, parts)


def validate(spark, sf):
    return validate_table(table(spark, sf, "lineitem"), "l_returnflag").select("rule", "ok")


def overlap(spark, sf):
    orders = with_split(table(spark, sf, "orders"), "o_orderkey")
    return split_overlap(
        orders.filter("split = 'train'"), orders.filter("split = 'test'"), "o_custkey"
    )


def column_profile(spark, sf):
    return P.column_profile(gappy_lineitem(spark, sf))


def column_profile_texts(spark, sf):
    return P.column_profile(table(spark, sf, "documents"))


def numeric_summary(spark, sf):
    return rounded_doubles(P.numeric_summary(gappy_lineitem(spark, sf), MEASURES))


def profile_totals(spark, sf):
    return P.profile_totals(P.column_profile(gappy_lineitem(spark, sf)))


def semantic_types(spark, sf):
    parts = [
        P.semantic_types(table(spark, sf, name)).withColumn("table", F.lit(name))
        for name in ("lineitem", "customer", "documents", "labels", "embeddings")
    ]
    return reduce(DataFrame.unionByName, parts)


def missing_pattern(spark, sf):
    return rounded_doubles(P.missing_pattern(gappy_lineitem(spark, sf)), 6)


def missing_summary(spark, sf):
    return P.missing_summary(gappy_lineitem(spark, sf))


def missing_fraction(spark, sf):
    return rounded_doubles(P.missing_by_column(gappy_lineitem(spark, sf)), 6)


def folds(spark, sf):
    orders = with_fold(table(spark, sf, "orders"), "o_orderkey")
    return orders.groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


QUERIES = {
    "scan_parquet": scan_parquet,
    "scan_csv": scan_csv,
    "scan_tsv": scan_tsv,
    "scan_csv_texts": scan_csv_texts,
    "scan_tsv_texts": scan_tsv_texts,
    "scan_jsonl": scan_jsonl,
    "scan_json": scan_json,
    "sink_roundtrip": sink_roundtrip,
    "validate_table": validate,
    "split_overlap": overlap,
    "column_profile": column_profile,
    "column_profile_texts": column_profile_texts,
    "numeric_summary": numeric_summary,
    "profile_totals": profile_totals,
    "semantic_types": semantic_types,
    "missing_pattern": missing_pattern,
    "missing_summary": missing_summary,
    "missing_fraction": missing_fraction,
    "fold_hash": folds,
}

# ── SQL twins ──

LINEITEM = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
    ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
    ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
    ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
DOCUMENTS = [
    ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
    ("n_chars", "bigint"),
]
CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
    ("c_acctbal", "double"), ("c_mktsegment", "string"),
]
LABELS = [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")]
EMBEDDINGS = [("vec_id", "bigint"), ("embedding", "array"), ("label", "int")]


def _kind_sql(name: str, dtype: str) -> str:
    if dtype == "string":
        return f"CASE WHEN avg(length({name})) > 50 THEN 'text' ELSE 'categorical' END"
    return "'datetime'" if dtype == "timestamp_ntz" else "'numeric'"


def _profile_sql(source: str, columns: list[tuple[str, str]], target: str) -> str:
    return union_sql(
        [
            f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column", '{t}' AS dtype,
    {_kind_sql(c, t)} AS kind, count(*) AS n_rows, CAST({len(columns)} AS BIGINT) AS n_columns,
    count(*) - count({c}) AS n_missing,
    round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_pct,
    count(DISTINCT {c}) AS n_unique, {str(c == target).lower()} AS target_guess FROM {source}"""
            for i, (c, t) in enumerate(columns)
        ]
    )


def _semantic_sql(name: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, t) in enumerate(columns):
        if t == "timestamp_ntz":
            rule = "max('datetime')"
        elif t == "array":
            rule = "max('other')"
        elif t == "string":
            rule = (f"CASE WHEN avg(length({c})) > 50 THEN 'text' "
                    f"WHEN count(DISTINCT {c}) = count(*) THEN 'id' ELSE 'categorical' END")
        else:
            rule = (f"CASE WHEN count(DISTINCT {c}) <= 2 THEN 'binary' "
                    f"WHEN count(DISTINCT {c}) <= 20 AND count(DISTINCT {c}) / count(*) < 0.05 "
                    f"THEN 'categorical' ELSE 'numeric' END")
        parts.append(f"""SELECT CAST({i} AS BIGINT) AS ordinal, '{c}' AS "column",
    {rule} AS semantic, '{name}' AS "table" FROM {name}""")
    return union_sql(parts)


_MISSING = " + ".join(f"(count(*) - count({c}))" for c, _ in LINEITEM)
_COMPLETE = "count(*) FILTER (WHERE " + " AND ".join(f"{c} IS NOT NULL" for c, _ in LINEITEM) + ")"
_WIDTH = len(LINEITEM)
# The guess fragment "y" is contained in l_orderkey, the first column.
_PROFILE = _profile_sql(GAPPY_LINEITEM, LINEITEM, "l_orderkey")

ORACLE = {
    "scan_parquet": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
    "scan_csv": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
                "c_mktsegment FROM customer",
    "scan_tsv": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal "
                "FROM supplier",
    "scan_csv_texts": "SELECT * FROM documents",
    "scan_tsv_texts": "SELECT * FROM documents",
    "scan_jsonl": "SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders",
    "scan_json": "SELECT * FROM documents",
    "sink_roundtrip": union_sql(
        [
            f"""SELECT '{f}' AS format, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS key_sum,
    round(sum(p_retailprice), 2) AS price_sum, count(DISTINCT p_brand) AS brands FROM part"""
            for f in ("csv", "tsv", "parquet", "json", "jsonl")
        ]
    ),
    "validate_table": union_sql(
        [
            "SELECT 'not_empty' AS rule, count(*) > 0 AS ok FROM lineitem",
            "SELECT 'min_rows' AS rule, count(*) >= 1 AS ok FROM lineitem",
            "SELECT 'min_columns' AS rule, count(*) >= 2 AS ok FROM (DESCRIBE lineitem)",
            "SELECT 'unique_column_names' AS rule, count(*) = count(DISTINCT lower(column_name)) AS ok "
            "FROM (DESCRIBE lineitem)",
            "SELECT 'target_exists' AS rule, count(*) = 1 AS ok FROM (DESCRIBE lineitem) "
            "WHERE column_name = 'l_returnflag'",
            "SELECT 'target_not_all_missing' AS rule, count(l_returnflag) > 0 AS ok FROM lineitem",
            "SELECT 'target_two_values' AS rule, count(DISTINCT l_returnflag) >= 2 AS ok FROM lineitem",
        ]
    ),
    "split_overlap": f"""WITH s AS (SELECT o_custkey, {split_sql('o_orderkey')} AS split FROM orders)
SELECT o_custkey FROM s WHERE split = 'train'
INTERSECT SELECT o_custkey FROM s WHERE split = 'test'""",
    "column_profile": _PROFILE,
    "column_profile_texts": _profile_sql("documents", DOCUMENTS, "n_chars"),
    "numeric_summary": union_sql(
        [
            f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
    round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
    round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50,
    round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max FROM {GAPPY_LINEITEM}"""
            for c in MEASURES
        ]
    ),
    "profile_totals": f"""SELECT max(n_rows) AS n_rows, max(n_columns) AS n_columns,
    count(*) FILTER (WHERE kind = 'numeric') AS numeric_columns,
    count(*) FILTER (WHERE kind = 'categorical') AS categorical_columns,
    count(*) FILTER (WHERE kind = 'text') AS text_columns,
    count(*) FILTER (WHERE kind = 'datetime') AS datetime_columns,
    CAST(sum(n_missing) AS BIGINT) AS missing_total FROM ({_PROFILE})""",
    "semantic_types": union_sql(
        [
            _semantic_sql("lineitem", LINEITEM),
            _semantic_sql("customer", CUSTOMER),
            _semantic_sql("documents", DOCUMENTS),
            _semantic_sql("labels", LABELS),
            _semantic_sql("embeddings", EMBEDDINGS),
        ]
    ),
    "missing_pattern": f"""SELECT {_MISSING} AS total_missing, count(*) * {_WIDTH} AS total_cells,
    round(({_MISSING}) / (count(*) * {_WIDTH}), 6) AS missing_rate, {_COMPLETE} AS complete_rows,
    round({_COMPLETE} / count(*), 6) AS complete_rows_share FROM {GAPPY_LINEITEM}""",
    "missing_summary": f"""SELECT {_MISSING} AS total_missing, count(*) * {_WIDTH} AS total_cells,
    round(100.0 * ({_MISSING}) / (count(*) * {_WIDTH}), 2) AS missing_pct,
    {_COMPLETE} AS complete_rows,
    round(100.0 * {_COMPLETE} / count(*), 2) AS complete_rows_pct FROM {GAPPY_LINEITEM}""",
    "missing_fraction": union_sql(
        [
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_missing,
    round((count(*) - count({c})) / count(*), 6) AS fraction FROM {GAPPY_LINEITEM}"""
            for c in ("l_discount", "l_returnflag")
        ]
    ),
    "fold_hash": f"""SELECT CAST({slot_sql('o_orderkey')} % 5 AS INTEGER) AS fold,
    count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
}
