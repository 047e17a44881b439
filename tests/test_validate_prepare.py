import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.functions.hashing import with_fold
from tabspark.operators import prepare as P
from tabspark.operators.codes import apply_codes, code_table
from tabspark.operators.validate import (
    TableCheckError,
    has_split_overlap,
    require_valid,
    split_overlap,
    validate_table,
)


def failed(df, *args, **kwargs):
    return {r["rule"] for r in validate_table(df, *args, **kwargs).collect() if not r["ok"]}


def test_table_rules(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "x int, t string")
    assert failed(good, "t") == set()
    assert failed(good.limit(0)) == {"not_empty", "min_rows"}
    assert failed(good, min_rows=3) == {"min_rows"}
    assert failed(good.select("x")) == {"min_columns"}
    assert failed(good.toDF("x", "X")) == {"unique_column_names"}
    assert "target_exists" in failed(good, "none")
    missing = good.withColumn("t", F.lit(None).cast("double"))
    assert failed(missing, "t") == {"target_not_all_missing", "target_two_values"}
    nan = good.withColumn("t", F.lit(float("nan")))
    assert failed(nan, "t") == {"target_not_all_missing", "target_two_values"}
    assert failed(good.withColumn("t", F.lit(1)), "t") == {"target_two_values"}


def test_require_valid(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert require_valid(df) is df
    with pytest.raises(TableCheckError, match="target_exists"):
        require_valid(df, "t")


def test_overlap(spark):
    a, b = spark.range(5), spark.range(3, 8)
    assert sorted(r["id"] for r in split_overlap(a, b, "id").collect()) == [3, 4]
    assert has_split_overlap(a, b, "id")
    assert not has_split_overlap(a, spark.range(10, 12), "id")


def test_imputation_rules(spark):
    frame = pd.DataFrame(
        {
            "skewed": [1.0, 1, 1, 1, 2, 2, 90, None],
            "even": [1.0, 2, 3, 4, 5, 6, 7, None],
            "full": range(8),
            "none": [None] * 8,
            "tie": ["b", "b", "a", "a", "c", None, None, None],
        }
    )
    df = spark.createDataFrame(
        [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)],
        "skewed double, even double, full int, none string, tie string",
    )
    fit = P.fit_imputation(df, ["skewed", "even", "full"], ["none", "tie"])
    assert fit.numbers == {"skewed": 1.0, "even": 4.0}
    assert fit.modes == {"none": "unknown", "tie": "a"}
    filled = fit.apply(df)
    assert filled.dropna().count() == 8
    assert dict(filled.dtypes)["full"] == "int"


@pytest.mark.parametrize("n_values,form", [(1, "codes"), (2, "codes"), (3, "one_hot"), (10, "one_hot"), (11, "tables")])
def test_encoding_by_number_of_values(spark, n_values, form):
    df = spark.range(40).withColumn("c", F.format_string("v%02d", F.col("id") % n_values))
    fit = P.fit_encoding(df, ["c"])
    assert list(getattr(fit, form)) == ["c"]
    result = fit.apply(df)
    if form == "one_hot":
        names = [f"c_v{i:02d}" for i in range(1, n_values)]
        assert result.columns == ["id", *names]
        sums = result.select(sum((F.col(n) for n in names), F.lit(0)).alias("s")).distinct().collect()
        assert {r["s"] for r in sums} == {0, 1}
    else:
        assert {r["c"] for r in result.select("c").distinct().collect()} == set(range(n_values))


def test_unseen_and_missing_values(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    other = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    assert [r["c"] for r in P.fit_encoding(train, ["c"]).apply(other).collect()] == [1, -1, -1]


def test_codes_by_partition_equal_codes_in_one_task(spark):
    df = spark.range(2000).withColumn("v", F.sha2(F.col("id").cast("string"), 256))
    small = {tuple(r) for r in code_table(df, "v").collect()}
    large = {tuple(r) for r in code_table(df, "v", bound=10).collect()}
    assert small == large
    coded = apply_codes(df, "v", code_table(df, "v", bound=10), bound=10)
    assert coded.agg(F.count_distinct("v")).first()[0] == 2000


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (None, 2.0)], "a double, k double")
    rows = P.fit_scaling(df, ["a", "k"]).apply(df).collect()
    assert [r["a"] for r in rows] == [-1.0, 1.0, None]
    assert [r["k"] for r in rows] == [0.0, 0.0, 0.0]


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(5000)
    one = P.with_split(df.repartition(1), "id").orderBy("id").collect()
    many = P.with_split(df.repartition(64), "id").orderBy("id").collect()
    assert one == many
    share = sum(r["split"] == "test" for r in one) / 5000
    assert abs(share - 0.2) < 0.02
    text = P.with_split(df.withColumn("k", F.col("id").cast("string")), "k")
    assert abs(text.filter("split = 'test'").count() / 5000 - 0.2) < 0.03


def test_stratified_split_is_exact(spark):
    df = spark.range(30011).withColumn(
        "y", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string"))
    )
    result = P.with_stratified_split(df, "id", "y", 0.2)
    assert result.count() == 30011
    for r in result.groupBy("y").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("t")).collect():
        assert r["t"] == -(-r["n"] * 2 // 10)


def test_stratified_split_of_many_classes(spark):
    df = spark.range(6000).withColumn("y", F.col("id") % 300)
    result = P.with_stratified_split(df, "id", "y", 0.2)
    sizes = result.groupBy("y").agg(F.count_if(F.col("split") == "test").alias("t")).collect()
    assert len(sizes) == 300 and all(r["t"] == 4 for r in sizes)
    folds = P.with_stratified_fold(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    assert len(folds) == 1500 and all(r["count"] == 4 for r in folds)


@pytest.mark.parametrize("step", [1, 2, 5, 10_000])
def test_regular_keys_spread_evenly(spark, step):
    keys = spark.range(10_000).select((F.col("id") * step).alias("k"))
    folds = [r["count"] for r in with_fold(keys, "k", 5).groupBy("fold").count().collect()]
    assert len(folds) == 5 and max(folds) < 2200 and min(folds) > 1800
    assert abs(P.with_split(keys, "k").filter("split = 'test'").count() - 2000) < 200


def test_rows_without_a_key_have_a_place(spark):
    keys = spark.createDataFrame([(None,), (1,)], "k bigint")
    assert with_fold(keys, "k", 5).filter("fold is null").isEmpty()
    assert P.with_split(keys, "k").filter("split is null").isEmpty()


def test_folds_keep_groups_together(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") / 10).cast("bigint"))
    folds = with_fold(df, "g", 5)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    assert folds.select("fold").distinct().count() == 5


def test_stratified_folds_are_even(spark):
    df = spark.range(3001).withColumn("y", F.when(F.col("id") % 100 == 0, 1).otherwise(0))
    folds = P.with_stratified_fold(df, "id", "y", 5)
    rows = folds.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in rows if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_prepare_leaves_out_text_and_dates(spark):
    source = np.random.RandomState(0)
    frame = pd.DataFrame(
        {
            "id": range(300),
            "x": source.randn(300),
            "c": source.choice(list("abcd"), 300),
            "when": pd.Timestamp("2024-01-01"),
            "story": "word " * 20,
            "y": source.choice(["no", "yes"], 300),
        }
    )
    prepared = P.prepare(spark.createDataFrame(frame), "y", "id", stratify=True)
    assert prepared.features == ["x", "c_b", "c_c", "c_d"]
    assert set(prepared.left_out) == {"when", "story"}
    row = prepared.summary().first()
    assert row["train_size"] + row["test_size"] == 300
    mapping = {(r["category"], r["code"]) for r in prepared.encoding.mapping(spark).collect()}
    assert mapping == {("no", 0), ("yes", 1)}
    train = prepared.table.filter("split = 'train'").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert train[0] == pytest.approx(0, abs=1e-9) and train[1] == pytest.approx(1)
