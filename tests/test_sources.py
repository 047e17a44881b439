import json

import pyarrow as pa
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer

from tabspark.operators.validate import TableCheckError
from tabspark.sources.saved import load_model, load_table, save_artifacts
from tabspark.sources.tables import format_of, read_any, read_delimited, write_table


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,d,b,s,e,t\n1,1.5,true,x,,NA\n2,NaN,False,5f,,a\nNA,3,null,y,,b\n")
    df = read_any(spark, str(path))
    assert dict(df.dtypes) == {
        "i": "bigint", "d": "double", "b": "boolean", "s": "string", "e": "double", "t": "string",
    }
    rows = df.collect()
    assert [r["i"] for r in rows] == [1, 2, None]
    assert [r["d"] for r in rows] == [1.5, None, 3.0]
    assert [r["b"] for r in rows] == [True, False, None]
    assert [r["t"] for r in rows] == [None, "a", "b"]


def test_csv_with_schema_needs_no_typing_scan(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,x\n,y\n")
    df = read_delimited(spark, str(path), schema="a int, b string")
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (None, "y")]


def test_tsv_json_and_jsonl(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx\n")
    (tmp_path / "t.json").write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": None}]))
    (tmp_path / "t.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    assert read_any(spark, str(tmp_path / "t.tsv")).first()["a"] == 1
    for name in ("t.json", "t.jsonl"):
        rows = read_any(spark, str(tmp_path / name)).orderBy("a").collect()
        assert [tuple(r) for r in rows] == [(1, "x"), (2, None)]


def test_feather_reads_one_partition_per_batch(spark, tmp_path):
    table = pa.table({"a": list(range(10)), "b": [str(i) for i in range(10)]})
    path = str(tmp_path / "t.feather")
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, table.schema) as writer:
        for batch in table.to_batches(max_chunksize=4):
            writer.write_batch(batch)
    df = read_any(spark, path)
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == [(i, str(i)) for i in range(10)]


def test_reader_errors(spark, tmp_path):
    for suffix in ("csv", "tsv", "parquet", "json", "jsonl", "feather"):
        with pytest.raises(TableCheckError, match="not found"):
            read_any(spark, str(tmp_path / f"none.{suffix}"))
    with pytest.raises(TableCheckError, match="unsupported"):
        read_any(spark, str(tmp_path / "none.xyz"))
    (tmp_path / "bad.parquet").mkdir()
    with pytest.raises(TableCheckError, match="failed to load"):
        read_any(spark, str(tmp_path / "bad.parquet"))


def test_format_override_directory_and_glob(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "one").write_text("a,b\n1,2\n")
    assert read_any(spark, str(tmp_path / "data"), format="csv").count() == 1
    assert read_any(spark, str(tmp_path / "data" / "o*"), format="csv").count() == 1
    assert format_of("/x/part-*.jsonl") == "jsonl"


@pytest.mark.parametrize("suffix", [".parquet", ".csv", ".tsv", ".jsonl", ".json", ".other"])
def test_write_and_read_back(spark, tmp_path, suffix):
    df = spark.createDataFrame([(1, "x", 0.5), (2, None, None)], "a bigint, b string, c double")
    path = str(tmp_path / "deep" / ("t" + suffix))
    write_table(df, path)
    back = read_any(spark, path, format="csv" if suffix == ".other" else "auto")
    assert sorted(map(tuple, back.select("a", "b", "c").collect())) == [(1, "x", 0.5), (2, None, None)]


@pytest.mark.parametrize("suffix", [".csv", ".tsv", ".json", ".jsonl", ".parquet"])
def test_texts_come_back_whole(spark, tmp_path, suffix):
    texts = ['he said "hi", ok', "two\nlines", "  pad ", 'a\t"b"\\', "x,y;z", '"', "end\\"]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, t string").repartition(3)
    path = str(tmp_path / ("t" + suffix))
    write_table(df, path)
    back = read_any(spark, path).select("i", "t").orderBy("i").collect()
    assert [tuple(r) for r in back] == list(enumerate(texts))


def test_csv_with_quotes_and_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,"he said ""hi"", ok",2\n3,"two\nlines",4\n')
    df = read_any(spark, str(path))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, 'he said "hi", ok', 2), (3, "two\nlines", 4)]


def test_json_documents_and_lines(spark, tmp_path):
    rows = [{"a": i, "b": str(i)} for i in range(10)]
    (tmp_path / "pretty.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "one.json").write_text(json.dumps(rows))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("pretty", "one", "lines"):
        assert read_any(spark, str(tmp_path / f"{name}.json")).count() == 10


def test_saved_tables_and_models(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "v string")
    model = Pipeline(stages=[StringIndexer(inputCol="v", outputCol="i")]).fit(df)
    save_artifacts(str(tmp_path), {"table": df, "model": model})
    assert load_table(spark, str(tmp_path), "table").count() == 2
    assert isinstance(load_model(str(tmp_path), "model"), PipelineModel)
    with pytest.raises(TypeError):
        save_artifacts(str(tmp_path), {"x": 1})
