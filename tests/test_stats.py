import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import explore as E
from tabspark.operators import profile as P
from tabspark.operators.cumulative import key_ranges, running_totals
from tabspark.operators.stats import distinct_counts, exact_quantiles


def awkward_frame(n=400):
    source = np.random.RandomState(3)
    frame = pd.DataFrame(
        {
            "id": range(n),
            "normal": source.randn(n),
            "heavy": np.exp(source.randn(n) * 2),
            "ties": source.randint(0, 4, n).astype(float),
            "hot": np.where(source.rand(n) < 0.6, 7.0, source.randn(n)),
            "constant": 5.0,
            "empty": np.nan,
        }
    )
    for c in ("normal", "ties", "hot"):
        frame.loc[source.rand(n) < 0.1, c] = np.nan
    return frame


@pytest.fixture(scope="module")
def awkward(spark):
    frame = awkward_frame()
    # NaN in one half, NULL in the other: both are missing.
    df = spark.createDataFrame(frame)
    df = df.withColumn("normal", F.when(~(F.isnan("normal") & (F.col("id") % 2 == 0)), F.col("normal")))
    return frame, df


COLUMNS = ["normal", "heavy", "ties", "hot", "constant", "empty"]


@pytest.mark.parametrize("bound", [10**9, 50, 1])
def test_quantiles_equal_pandas_for_any_bound(awkward, bound):
    frame, df = awkward
    probs = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.77, "f": 1.0}
    rows = {r["column"]: r for r in exact_quantiles(df, COLUMNS, probs, bound).collect()}
    for c in COLUMNS:
        for name, p in probs.items():
            wanted = frame[c].quantile(p)
            got = rows[c][name]
            if math.isnan(wanted):
                assert got is None
            else:
                assert got == pytest.approx(wanted, abs=1e-12)


def test_quantiles_of_one_row(spark):
    df = spark.createDataFrame([(3.5,)], "v double")
    assert exact_quantiles(df, ["v"], {"q": 0.3}).first()["q"] == 3.5


def test_distinct_counts_ignore_missing_and_merge_zeros(spark):
    df = spark.createDataFrame(
        [(0.0, "a" * 100, None), (-0.0, "a" * 100, 1), (float("nan"), None, 1), (None, "a" * 99 + "b", 2)],
        "v double, s string, i int",
    )
    rows = {r["column"]: r["n_unique"] for r in distinct_counts(df).collect()}
    assert rows == {"v": 1, "s": 2, "i": 2}


def test_distributions_equal_pandas(awkward):
    frame, df = awkward
    rows = {r["column"]: r for r in E.distributions(df, COLUMNS).collect()}
    assert "empty" not in rows
    for c in COLUMNS[:-1]:
        s = frame[c].dropna()
        wanted = {
            "mean": s.mean(), "median": s.median(), "std": s.std(), "skewness": s.skew(),
            "kurtosis": s.kurtosis(), "min": s.min(), "max": s.max(), "q25": s.quantile(0.25),
        }
        for k, v in wanted.items():
            assert rows[c][k] == pytest.approx(v, abs=1e-9), (c, k)


def test_correlation_equals_pandas_pairwise(awkward):
    frame, df = awkward
    wanted = frame[COLUMNS].corr()
    rows = E.correlation_matrix(df, COLUMNS).collect()
    assert len(rows) == len(COLUMNS) ** 2
    for r in rows:
        value = wanted.loc[r["col_x"], r["col_y"]]
        if math.isnan(value):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(value, abs=6e-5)


def test_correlation_needs_two_columns(awkward):
    assert E.correlation_matrix(awkward[1], ["normal"]).count() == 0


def test_profile_counts_nan_and_null(awkward):
    frame, df = awkward
    rows = {r["column"]: r for r in P.column_profile(df).collect()}
    for c in frame.columns:
        assert rows[c]["n_missing"] == frame[c].isna().sum()
        assert rows[c]["n_unique"] == frame[c].nunique()


def test_profile_of_nested_and_boolean_columns(spark):
    df = spark.createDataFrame([([1], True, "x"), ([2], None, "y")], "a array<int>, b boolean, c string")
    rows = {r["column"]: r for r in P.column_profile(df).collect()}
    assert (rows["a"]["kind"], rows["a"]["n_unique"]) == ("other", None)
    assert (rows["b"]["kind"], rows["b"]["n_missing"]) == ("boolean", 1)
    kinds = {r["column"]: r["semantic"] for r in P.semantic_types(df).collect()}
    assert kinds == {"a": "other", "b": "binary", "c": "id"}


def test_missing_pattern_equals_pandas(awkward):
    frame, df = awkward
    row = P.missing_pattern(df).first()
    assert row["total_missing"] == frame.isna().sum().sum()
    assert row["complete_rows"] == 0
    fractions = [r["fraction"] for r in P.missing_by_column(df).collect()]
    assert fractions == sorted(fractions)


@pytest.mark.parametrize(
    "names,whole,wanted",
    [
        (["orderkey", "label"], False, "orderkey"),
        (["orderkey", "label"], True, "label"),
        (["a", "is_late", "b"], False, "is_late"),
        (["a", "b"], False, "b"),
    ],
)
def test_target_guess(names, whole, wanted):
    assert P.guess_target(names, whole) == wanted


def test_histogram_bins_sum_to_values_and_match_numpy(awkward):
    frame, df = awkward
    rows = E.histogram(df, ["normal", "heavy", "constant"]).collect()
    for c in ("normal", "heavy", "constant"):
        counts = [r["n"] for r in sorted((r for r in rows if r["column"] == c), key=lambda r: r["bin"])]
        assert counts == np.histogram(frame[c].dropna(), bins=30)[0].tolist()


def test_outlier_flags_and_counts_agree(awkward):
    frame, df = awkward
    flagged = E.with_outlier_flag(df, "heavy").filter("is_outlier").count()
    q1, q3 = frame["heavy"].quantile([0.25, 0.75])
    wanted = ((frame["heavy"] > q3 + 1.5 * (q3 - q1)) | (frame["heavy"] < q1 - 1.5 * (q3 - q1))).sum()
    assert flagged == wanted
    rows = {r["column"]: r for r in E.iqr_outliers(df, COLUMNS).collect()}
    assert rows["heavy"]["n_outliers"] == wanted
    assert "constant" not in rows and "empty" not in rows


def test_target_analysis_of_classes(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    rows = {r["class"]: r for r in E.target_classes(df, "t").collect()}
    assert rows["a"]["n"] == 2 and rows["b"]["n_classes"] == 2 and rows["a"]["balance_ratio"] == 0.5


def test_numeric_target_can_be_seen_as_classes(spark):
    df = spark.createDataFrame([(0,), (1,), (1,)], "t int")
    assert "mean" in E.analyse_target(df, "t").columns
    assert "class" in E.analyse_target(df, "t", as_categorical=True).columns


def test_categorical_top_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(c,) for c in "bbaac"], "v string")
    rows = E.categorical_top(df, ["v"], 2).orderBy("rank").collect()
    assert [(r["value"], r["n"], r["is_mode"]) for r in rows] == [("a", 2, True), ("b", 2, False)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_totals_by_range_equal_the_simple_form(spark, by, descending):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("g"),
        (F.pow(F.col("id"), F.lit(3.0)) / 7).alias("k"),
        (F.col("id") % 11).alias("v"),
    )
    if not by:
        df = df.drop("g")
    edges = key_ranges(df, "k", ranges=30)
    assert len(edges) == 29
    simple = running_totals(df, by, "k", ["v"], [], descending)
    ranged = running_totals(df, by, "k", ["v"], edges, descending)
    assert sorted(map(tuple, simple.collect())) == sorted(map(tuple, ranged.collect()))
