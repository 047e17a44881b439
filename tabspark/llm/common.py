"""What several operators of this package share: batches, samples of labelled rows, row filters."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a task turns into Python objects at a time.
SLICE_BYTES = 8 << 20
# Bytes that a Python worker gets at a time.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Labelled texts above this length are not used for fitting unless the caller says otherwise (they are scored whole).
FIT_CHARS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the queries' batches are bounded from here on."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Send at most ``BATCH_BYTES`` to a Python worker at once, unless the session says otherwise.

    Spark's own bound is 64 MB, which every task would hold several times.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def free_name(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is not taken, in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``SLICE_BYTES`` of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
        ends = np.cumsum(sizes.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def strings(column: pa.Array) -> list[str]:
    """Python texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


def held_out(key: Column, folds: int = 5) -> Column:
    """Whether crc32 of the key's text leaves remainder 0; null keys hash as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, per_class: int, key: str = "doc_id", text: str = "text",
    longest: int | None = FIT_CHARS,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and weights of at most ``per_class`` documents of each class to fit a classifier on.

    The sample is bounded by its parameters whatever the size of the tables: by rows and by
    ``longest`` characters a text (longer ones are left out of the sample; None: any length). Its
    members and their order are chosen by hashes of the key, so they do not depend on partitioning. Rows whose
    key is held out, null labels and labels other than 0 and 1 are left out; of repeated keys
    the largest label and the smallest text count, of equal texts the first key. Weights
    restore the shares of the classes. Only the chosen keys, a bounded number, are broadcast.
    """
    known = (
        labels.select(F.col(key).cast("long").alias("k"), F.col(target).cast("int").alias("y"))
        .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
        .groupBy("k").agg(F.max("y").alias("y"))
    )
    order = F.xxhash64(F.col("k"), F.lit(17))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = known.filter("y = 0").orderBy(order, "k").limit(per_class).unionByName(
        known.filter("y = 1").orderBy(order, "k").limit(per_class))
    texts = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    if longest is not None:
        texts = texts.filter(F.length("t") <= longest)
    single = texts.join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    first = single.groupBy("t", "y").agg(F.min(F.struct(order.alias("at"), "k")).alias("first"))
    rows = first.orderBy("first.at", "first.k").limit(2 * per_class).collect()
    y = np.array([r["y"] for r in rows], np.int64)
    weights = np.ones(len(y))
    for c in (0, 1):
        if (y == c).any():
            weights[y == c] = sizes[c] / (y == c).sum()
    return [r["t"] for r in rows], y, weights / weights.mean() if len(y) else weights


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct integers in order, and how often each occurs, by sorting."""
    ordered = np.sort(values)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


def kept_rows(docs: DataFrame, keep: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows, all columns, whose text ``keep`` accepts: one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.filter(pa.array(keep(strings(batch.column(text))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def scored_rows(docs: DataFrame, score: Callable[[list[str]], np.ndarray], threshold: float,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null texts are empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.asarray(score(strings(batch.column("text"))), np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(found),
                 pa.array((found >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


class WordCodes(dict):
    """A bounded dictionary from a word to a number made by ``code(word)``.

    Words repeat, so the work for a word is done once per worker and not per occurrence. When
    the dictionary is full the words met first, the frequent ones, stay; results do not
    depend on it.
    """

    def __init__(self, code: Callable, dtype, keep: int = 500_000):
        super().__init__()
        self.code, self.dtype, self.keep = code, dtype, keep

    def __missing__(self, word: str):
        self[word] = value = self.code(word)
        return value

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self) > self.keep:
            first = dict(itertools.islice(self.items(), self.keep // 2))
            self.clear()
            self.update(first)
        return np.fromiter(map(self.__getitem__, words), self.dtype, len(words))
