"""Delimited files with quoted cells, read in splits: a line break inside a cell may fall anywhere."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions.scratch import materialise

_SUMMARY = ("file long, block long, opens boolean, stays boolean, ends_outside boolean, ends_inside boolean, "
            "head string, tail_outside string, tail_inside string")


def line_automaton(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Whether a line ends inside a quoted cell, if it begins outside of one and if inside.

    A quote opens a cell only at the cell's start, a doubled quote stays inside, and a single one
    closes; quotes in the middle of a plain cell are text.
    """
    s = re.escape(sep)
    cell = f'(?:"(?:[^"]|"")*+"[^{s}]*+|[^"{s}][^{s}]*+)?+'
    outside = f'(?:{cell}{s})*+"(?:[^"]|"")*+'
    inside = f'(?:[^"]|"")*+(?:"[^{s}]*+{s}{outside})?+'
    return re.compile(outside + r"\Z"), re.compile(inside + r"\Z")


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and split, in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Array]]:
    """Parts of batches that lie in one split, with the columns before the text as their name."""
    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
        start = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or any(c[i] != c[start] for c in names[:2]):
                yield tuple(c[start] for c in names), batch.column(batch.num_columns - 1).slice(start, i - start)
                start = i


class _Tracker:
    """One hypothesis about a split's first state: where rows end, and what is left at both ends."""

    def __init__(self, inside: bool):
        self.inside = inside
        self.held: list[str] = []
        self.head: str | None = None

    def line(self, text: str, outside: re.Pattern, within: re.Pattern) -> str | None:
        """The row that ends with this line, if one does."""
        self.held.append(text)
        if '"' in text:
            self.inside = bool((within if self.inside else outside).match(text.removesuffix("\r")))
        if self.inside:
            return None
        row, self.held = "\n".join(self.held), []
        return row.removesuffix("\r")


def _summarise(sep: str):
    outside, within = line_automaton(sep)

    def summary(name: tuple, tracked: tuple[_Tracker, _Tracker]) -> tuple:
        plain, quoted = tracked
        tails = ["\n".join(t.held) if t.inside else None for t in tracked]
        # ends_*: whether a row ends in the split; opens, stays: the last state for each first one.
        return (*name, plain.inside, quoted.inside, plain.head is not None, quoted.head is not None,
                quoted.head if quoted.head is not None else "\n".join(quoted.held), *tails)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tracked, rows = None, (_Tracker(False), _Tracker(True)), []
        for name, lines in _runs(batches):
            if name != current:
                if current is not None:
                    rows.append(summary(current, tracked))
                current, tracked = name, (_Tracker(False), _Tracker(True))
            for text in lines.to_pylist():
                for t in tracked:
                    row = t.line(text, outside, within)
                    if row is not None and t.head is None:
                        t.head = row
        if current is not None:
            rows.append(summary(current, tracked))
        kinds = [pa.int64(), pa.int64(), *[pa.bool_()] * 4, *[pa.string()] * 3]
        names = [x.split(" ")[0] for x in _SUMMARY.split(", ")]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _whole_rows(sep: str, first_states: dict[tuple[int, int], bool]):
    """Rows that begin and end in one split; the header row of each file is left out."""
    outside, within = line_automaton(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tracker, skip = None, _Tracker(False), 0
        for name, lines in _runs(batches):
            if name != current:
                if name not in first_states:
                    raise RuntimeError("the splits of the file changed since it was opened; read it again")
                current, tracker = name, _Tracker(first_states[name])
                # The first row to end here began before, or is the header.
                skip = int(tracker.inside or name[1] == 0)
            if not tracker.inside and not tracker.held and not skip and not pc.any(pc.match_substring(lines, '"')).as_py():
                rows = pc.replace_substring_regex(lines, "\r$", "")
            else:
                found = []
                for text in lines.to_pylist():
                    row = tracker.line(text, outside, within)
                    if row is not None:
                        if skip:
                            skip -= 1
                        else:
                            found.append(row)
                rows = pa.array(found, pa.string())
            yield pa.RecordBatch.from_arrays([rows], ["value"])

    return run


def first_states(splits: list[tuple]) -> dict[tuple[int, int], tuple[bool, int | None]]:
    """For each split whether it begins inside a cell, and the split where that row began.

    ``splits``: (file, block, opens, stays, ends_outside, ends_inside). A split is a function
    from its first state to its last; the functions are composed along each file.
    """
    found, file, inside, owner = {}, None, False, None
    for name, block, opens, stays, _, ends_inside in sorted(splits):
        if name != file:
            file, inside, owner = name, False, None
        found[name, block] = (inside, owner)
        if not inside:
            inside, owner = opens, block
        elif ends_inside:
            inside, owner = stays, block
    return found


def quoted_rows(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """The rows of delimited files, without headers, as texts in ``value``; files are read in splits.

    Two passes. The first finds, for each split and both states that it may begin in, the
    state it ends in and the pieces of rows at its ends, and writes that, a row for each split,
    to the shared folder. States are then composed along each file; only they reach
    the driver, as many as there are splits. In the second pass every split knows its first
    state and yields the rows that lie in it. Rows over a border are put together from the pieces.
    Empty lines are no rows. Splits must not change between the passes; if they do, tasks fail and say so.
    """
    lines = _text_lines(spark, path)
    summary = materialise(lines.mapInArrow(_summarise(sep), _SUMMARY))
    splits = [tuple(r) for r in summary.drop("head", "tail_outside", "tail_inside").collect()]
    states = first_states(splits)
    rows = lines.mapInArrow(_whole_rows(sep, {k: s for k, (s, _) in states.items()}), "value string")
    # A row over a border: the tail of the split where it began, then the heads of those it runs on into.
    table = spark.createDataFrame(
        [(f, b, s, o) for (f, b), (s, o) in states.items()], "file long, block long, inside boolean, owner long")
    known = summary.join(table, ["file", "block"])
    begun = known.filter((~F.col("inside") & F.col("opens")) | (F.col("inside") & F.col("ends_inside") & F.col("stays")))
    tails = begun.select("file", F.col("block").alias("owner"), "block",
                         F.when(F.col("inside"), F.col("tail_inside")).otherwise(F.col("tail_outside")).alias("part"),
                         # The header itself may run over the border.
                         (F.col("inside") | F.col("ends_outside") | (F.col("block") > 0)).alias("is_row"))
    heads = known.filter("inside").select("file", "owner", "block", F.col("head").alias("part"), F.lit(True).alias("is_row"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda p: p["part"])
    stitched = tails.unionByName(heads).groupBy("file", "owner").agg(
        F.regexp_replace(F.array_join(parts, "\n"), "\r$", "").alias("value"), F.min("is_row").alias("is_row")
    ).filter("is_row").select("value")
    return rows.unionByName(stitched).filter("value <> ''")
