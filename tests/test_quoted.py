"""Split reading of quoted files against Spark's own reading of whole files."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabspark.sources.quoted import first_states, line_automaton
from tabspark.sources.tables import read_any, read_delimited

SPLIT = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _ends_inside(line, inside, sep=","):
    """Letter by letter: whether a line ends inside a quoted cell."""
    state, i = "quoted" if inside else "start", 0
    while i < len(line):
        c = line[i]
        if state == "quoted":
            if c == '"' and line[i + 1:i + 2] == '"':
                i += 1
            elif c == '"':
                state = "plain"
        elif c == sep:
            state = "start"
        elif state == "start" and c == '"':
            state = "quoted"
        else:
            state = "plain"
        i += 1
    return state == "quoted"


@settings(max_examples=400, deadline=None)
@given(st.text('ab",', max_size=14), st.booleans())
def test_automaton_equals_letter_by_letter(line, inside):
    outside, within = line_automaton(",")
    assert bool((within if inside else outside).match(line)) == _ends_inside(line, inside)


def test_states_are_composed_along_each_file():
    splits = [(1, 0, True, False, True, True), (1, 64, True, True, True, False), (1, 128, False, False, True, True),
              (2, 0, False, True, True, True), (2, 64, True, False, False, True)]
    assert first_states(splits[::-1]) == {
        (1, 0): (False, None), (1, 64): (True, 0), (1, 128): (True, 0), (2, 0): (False, None), (2, 64): (False, 0)}


TEXTS = ["plain", "", 'he said "hi", ok', "two\nlines", "five\n\n\n\nlines " * 12, '"', '""', "x,y;z", " pad ", "\n", "é漢\n😀",
         "a\tb", 'x"y', "end\\", '",\n",', "long " * 60]


@pytest.mark.parametrize("suffix, sep", [("csv", ","), ("tsv", "\t")])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_breaks_and_quotes_across_split_borders(spark, tmp_path, small_splits, suffix, sep, eol):
    def written(text):
        return '"' + text.replace('"', '""') + '"' if re.search(f'["\n\r{sep}]', text) else text

    (tmp_path / f"t.{suffix}").mkdir()
    wanted = []
    for k in range(3):
        rows = [(100 * k + i, TEXTS[(i * (k + 1)) % len(TEXTS)]) for i in range(40)]
        wanted += [(i, t or None) for i, t in rows]
        body = eol.join([f"id{sep}text", *(f"{i}{sep}{written(t)}" for i, t in rows)])
        (tmp_path / f"t.{suffix}" / f"part-{k}.{suffix}").write_bytes((body + (eol if k else "")).encode())
    found = read_any(spark, str(tmp_path / f"t.{suffix}"))
    assert dict(found.dtypes) == {"id": "bigint", "text": "string"}
    assert found.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


@pytest.mark.parametrize("body", [
    'a,b\n1,5" pipe\n2,"x"\n3,6" wide, 7"\n', "a,b\n", '"a\nb",c\n1,2\n', "a,b\n1\n1,2,3\n\n4,\n",
    'a,b\n"x" y,2\n"p\nq" z,3\n',
])
def test_uneven_files_read_as_spark_reads_them(spark, tmp_path, small_splits, body):
    path = tmp_path / "t.csv"
    path.write_text(body)
    split = read_delimited(spark, str(path))
    whole = read_delimited(spark, str(path), multiLine=True)
    assert split.dtypes == whole.dtypes
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def test_a_cell_that_is_never_closed_takes_the_rest(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text('a,b\n0,y\n1,"never closed\n' + "2,x\n" * 40)
    rows = sorted(map(tuple, read_delimited(spark, str(path)).collect()))
    assert rows == [(0, "y"), (1, "never closed\n" + "2,x\n" * 39 + "2,x")]


def test_folder_of_both_json_forms(spark, tmp_path):
    folder = tmp_path / "t.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"a": 1, "b": "}\\"{"}\n{"a": 2, "b": null}\n')
    (folder / "b.json").write_text('\n[\n {"a": 3,\n  "c": [1, 2]},\n {"a": 4}\n]\n')
    (folder / "c.json").write_text('[{"a": 5}, {"a": 6}]')
    (folder / "d.json").write_text('{"a": 7, "b": "x\n"}'.replace("\n", "\\n"))
    (folder / "empty.json").write_text(" \n")
    rows = {r["a"]: (r["b"], r["c"]) for r in read_any(spark, str(folder)).collect() if r["a"] is not None}
    assert rows == {1: ('}"{', None), 2: (None, None), 3: (None, [1, 2]), 4: (None, None), 5: (None, None), 6: (None, None),
                    7: ("x\n", None)}


def test_changed_splits_are_an_error(spark, tmp_path, small_splits):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "1,2\n" * 200)
    found = read_delimited(spark, str(path), schema="a int, b int")
    assert found.count() == 200
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    with pytest.raises(Exception, match="splits of the file changed"):
        found.count()
