"""Token ids as Parquet lists that allow selective reads of tokens and of metadata."""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.llm.common import slices
from tabspark.llm.encoding import encoder

# How the files are laid out: token lists in delta encoding, the rest by dictionary; row groups
# small enough to skip, pages small enough for the page index to pick a few documents.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#tokens.list.element": "false",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
}
_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def little(ids: bytes) -> bytes:
    """Ids in little-endian order."""
    return ids if sys.byteorder == "little" else np.frombuffer(ids, "u4").astype("<u4").tobytes()


def _encode(tokenizer: str, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_all
        part, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, counts = encode(batch.column("text"))
            if end_id is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
            ends = np.cumsum(counts)
            tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.view(np.int32)))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + ends - counts),
                 pa.array(counts), tokens],
                ["doc_id", "part", "part_start", "n_tokens", "tokens"])
            before += int(ends[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0,
                 key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every whole text below ``path``, in ascending order of the key.

    ``path/tokens`` holds a row per document: doc_id, part, part_start, n_tokens, tokens;
    ``path/parts`` a row per part with the ids before it. Null texts count as empty (only
    ``end_id`` is written), null keys come first, rows with one key are ordered by a hash of
    the text and then the text. Ranges are cut by key and hash, so that rows of one
    repeated key may lie in several parts. An empty table gives empty files.
    """
    order = ["doc_id", "spread", "text"]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("spread", F.xxhash64("text"))
    sorted_rows = rows.repartitionByRange("doc_id", "spread").sortWithinPartitions(*order)
    (sorted_rows.select("doc_id", "text").mapInArrow(_encode(tokenizer, end_id), _SCHEMA)
     .write.options(**LAYOUT).parquet(f"{path}/tokens"))
    totals = docs.sparkSession.read.schema(_SCHEMA).parquet(f"{path}/tokens").groupBy("part").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    # One row per part: small enough to be numbered in one task.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals.withColumn("before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """Read documents back: doc_id, start (ids of all documents before it), n_tokens, tokens.

    ``columns`` narrows what is read, so metadata does not touch the token pages; ``where``
    on doc_id or n_tokens reaches the files as a filter on row groups and pages. The parts
    are broadcast: one row for each write task.
    """
    rows = spark.read.schema(_SCHEMA).parquet(f"{path}/tokens")
    if where is not None:
        rows = rows.filter(where)
    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    found = rows.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("part_start"))
    return found.select(*(columns or ["doc_id", "start", "n_tokens", "tokens"]))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        flat = np.asarray(lists.flatten()).astype("<u4")
        ends = np.cumsum(lists.value_lengths().to_numpy())
        sums = [zlib.crc32(flat[b - n:b].tobytes()) for b, n in zip(ends, lists.value_lengths().to_numpy(), strict=True)]
        keep = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(sums, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, computed from the files."""
    return read_tokens(spark, path).mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
