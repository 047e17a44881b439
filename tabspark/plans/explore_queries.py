"""Registered queries: exploratory statistics."""

from __future__ import annotations


from tabspark.operators import explore as E
from tabspark.plans.common import (
    GAPPY_EVENTS,
    GAPPY_LINEITEM,
    MEASURES,
    gappy_events,
    gappy_lineitem,
    rounded_doubles,
    table,
    union_sql,
)


def distributions(spark, sf):
    return rounded_doubles(E.distributions(gappy_lineitem(spark, sf), MEASURES))


def distributions_skewed(spark, sf):
    return rounded_doubles(E.distributions(gappy_events(spark, sf), ["value"]))


def correlation_matrix(spark, sf):
    return E.correlation_matrix(gappy_lineitem(spark, sf), MEASURES)


def correlation_chart(spark, sf):
    return E.correlation_chart(table(spark, sf, "part"))


def iqr_outliers(spark, sf):
    return rounded_doubles(E.iqr_outliers(gappy_events(spark, sf), ["user_id", "value"]))


def outlier_rows(spark, sf):
    flagged = E.with_outlier_flag(gappy_events(spark, sf), "value")
    return flagged.select("event_id", "is_outlier")


def target_continuous(spark, sf):
    return rounded_doubles(E.analyse_target(table(spark, sf, "lineitem"), "l_extendedprice"))


def target_classes(spark, sf):
    return E.analyse_target(gappy_lineitem(spark, sf), "l_returnflag")


def categorical_top(spark, sf):
    return E.categorical_top(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


def value_counts(spark, sf):
    return E.value_counts(table(spark, sf, "events"), "user_id")


def histogram(spark, sf):
    return rounded_doubles(E.histogram(gappy_lineitem(spark, sf), MEASURES))


def target_distribution(spark, sf):
    return rounded_doubles(E.target_distribution(table(spark, sf, "orders"), "o_totalprice"))


def target_distribution_classes(spark, sf):
    return E.target_distribution(table(spark, sf, "lineitem"), "l_linenumber")


QUERIES = {
    "distributions": distributions,
    "distributions_skewed": distributions_skewed,
    "correlation_matrix": correlation_matrix,
    "correlation_chart": correlation_chart,
    "iqr_outliers": iqr_outliers,
    "outlier_rows": outlier_rows,
    "target_continuous": target_continuous,
    "target_classes": target_classes,
    "categorical_top": categorical_top,
    "value_counts": value_counts,
    "histogram": histogram,
    "target_distribution": target_distribution,
    "target_distribution_classes": target_distribution_classes,
}


def _distribution_sql(source: str, columns: list[str]) -> str:
    return union_sql(
        [
            f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
    round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness,
    round(kurtosis({c}), 4) AS kurtosis, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
    round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75
    FROM {source}"""
            for c in columns
        ]
    )


def _correlation_sql(source: str, columns: list[str]) -> str:
    return union_sql(
        [
            f"SELECT '{x}' AS col_x, '{y}' AS col_y, round(corr({x}, {y}), 4) + 0.0 AS corr FROM {source}"
            for x in columns
            for y in columns
        ]
    )


def _bounds_sql(source: str, column: str) -> str:
    q1, q3 = f"quantile_cont({column}, 0.25)", f"quantile_cont({column}, 0.75)"
    return (f"(SELECT {q1} - 1.5 * ({q3} - {q1}) AS lower, {q3} + 1.5 * ({q3} - {q1}) AS upper "
            f"FROM {source})")


def _histogram_sql(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST(b.bin AS BIGINT) AS bin,
    round(s.lo + b.bin * s.w, 4) AS lower, round(s.lo + (b.bin + 1) * s.w, 4) AS upper,
    count(v.bin) AS n
FROM range(30) b(bin)
CROSS JOIN (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS w
    FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {source})) s
LEFT JOIN (SELECT least(CAST(floor((x - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin
    FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {source}) d,
         (SELECT CAST(min({column}) AS DOUBLE) AS lo, CAST(max({column}) AS DOUBLE) AS hi FROM {source}) m
    WHERE x IS NOT NULL) v ON v.bin = b.bin
GROUP BY b.bin, s.lo, s.w"""


ORACLE = {
    "distributions": _distribution_sql(GAPPY_LINEITEM, MEASURES),
    "distributions_skewed": _distribution_sql(GAPPY_EVENTS, ["value"]),
    "correlation_matrix": _correlation_sql(GAPPY_LINEITEM, MEASURES),
    "correlation_chart": _correlation_sql("part", ["p_partkey", "p_size", "p_retailprice"]),
    "iqr_outliers": union_sql(
        [
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < lower OR {c} > upper) AS n_outliers,
    round(100.0 * count(*) FILTER (WHERE {c} < lower OR {c} > upper) / count({c}), 2) AS pct,
    round(max(lower), 4) AS lower, round(max(upper), 4) AS upper
    FROM {GAPPY_EVENTS}, {_bounds_sql(GAPPY_EVENTS, c)}
    HAVING count(*) FILTER (WHERE {c} < lower OR {c} > upper) > 0"""
            for c in ("user_id", "value")
        ]
    ),
    "outlier_rows": f"""SELECT event_id, coalesce(value < lower OR value > upper, false) AS is_outlier
FROM {GAPPY_EVENTS}, {_bounds_sql(GAPPY_EVENTS, "value")}""",
    "target_continuous": """SELECT 'l_extendedprice' AS "column", round(avg(l_extendedprice), 4) AS mean,
    round(stddev_samp(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min,
    round(max(l_extendedprice), 4) AS max FROM lineitem""",
    "target_classes": f"""WITH c AS (SELECT l_returnflag AS class, count(*) AS n FROM {GAPPY_LINEITEM}
    WHERE l_returnflag IS NOT NULL GROUP BY 1)
SELECT class, n, (SELECT count(*) FROM c) AS n_classes,
    (SELECT round(min(n) / max(n), 4) FROM c) AS balance_ratio FROM c""",
    "categorical_top": union_sql(
        [
            f"""SELECT '{c}' AS "column", rank, value, n, n_unique, rank = 1 AS is_mode FROM (
    SELECT {c} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
        count(*) OVER () AS n_unique FROM part GROUP BY {c}) WHERE rank <= 10"""
            for c in ("p_name", "p_brand", "p_type")
        ]
    ),
    "value_counts": """SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events
GROUP BY 1 ORDER BY n DESC, value LIMIT 10""",
    "histogram": union_sql([_histogram_sql(GAPPY_LINEITEM, c) for c in MEASURES]),
    "target_distribution": f"""SELECT 'histogram' AS kind, CAST(bin AS VARCHAR) AS value, lower, upper, n
FROM ({_histogram_sql("orders", "o_totalprice")})""",
    "target_distribution_classes": """SELECT 'counts' AS kind, CAST(l_linenumber AS VARCHAR) AS value,
    CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, count(*) AS n
FROM lineitem GROUP BY l_linenumber""",
}
