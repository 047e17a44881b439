"""Importance resampling towards a target text collection, ranked by a distributed radix sort."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import col
from tabspark.functions.scratch import materialise
from tabspark.llm.common import slices

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
# Bits of a digit: a pass counts at most 2 ** DIGIT_BITS values for each block of rows.
DIGIT_BITS = 12
_BLANK = 0x20


def _letters() -> np.ndarray:
    """What each byte becomes: A-Z in lower case, digits, a-z and bytes of other letters as they are, the rest blank."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    for low, high in ((0x00, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
        table[low:high] = _BLANK
    return table


_LETTERS = _letters()


@lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """How ``length`` further bytes change a crc32, as four tables for its four bytes.

    The change is linear in the bits, so the images of single bits say all.
    """
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    bits = np.array([zlib.crc32(zeros, 1 << i) ^ base for i in range(32)], np.uint32)
    tables = np.zeros((4, 256), np.uint32)
    for k in range(4):
        for i in range(8):
            tables[k, np.arange(256) >> i & 1 == 1] ^= bits[8 * k + i]
    return tables.ravel()


def _joined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of two strings in a row, from theirs and the lengths of the second ones."""
    kinds, which = np.unique(lengths, return_inverse=True)
    tables = np.concatenate([_shift(int(n)) for n in kinds]) if len(kinds) else np.zeros(0, np.uint32)
    base = which.astype(np.int64) * 1024
    found = second.copy()
    for k in range(4):
        found ^= tables[base + (256 * k) + (first >> np.uint32(8 * k) & np.uint32(255))]
    return found


def gram_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text, and for runs of 1, 2 and 3 words the bucket at each word and whether a run begins there.

    A bucket is the crc32 of the run, joined by single spaces, modulo ``buckets``. Words are
    hashed once for each distinct word of the batch; runs from the hashes of their words.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    letters = _LETTERS[raw]
    inside = letters != _BLANK
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    # Where a text begins, so does a word, and where it ends, its last word does.
    edges = ends[:-1][ends[:-1] < ends[1:]]
    begins[edges] = inside[edges]
    stops[edges[1:] - 1] = inside[edges[1:] - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    counts = np.diff(np.searchsorted(starts, ends))
    packed = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)]), pa.py_buffer(letters[inside])])
    coded = packed.dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    open_hashes = np.fromiter((zlib.crc32(b" ", h) for h in hashes.tolist()), np.uint32, len(distinct))
    codes = coded.indices.to_numpy()
    one, before = hashes[codes], open_hashes[codes]
    two = _joined(before[:-1], one[1:], lengths[1:])
    three = _joined(before[:-2], two[1:], lengths[1:-1] + 1 + lengths[2:])
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = [(g % np.uint32(buckets)).astype(np.int64) for g in (one, two, three)]
    whole = [np.ones(len(owner), bool), owner[:-1] == owner[1:], owner[:-2] == owner[2:]]
    return counts, runs, whole


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all whole texts. A row per bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            _, runs, whole = gram_buckets(batch.column("text"), buckets)
            for found, valid in zip(runs, whole, strict=True):
                sums += np.bincount(found[valid], minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], ["bucket", "n"])

    totals = np.zeros(buckets, np.int64)
    rows = df.select(col(text).alias("text")).mapInArrow(run, "bucket long, n long")
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[r["bucket"]] = r["n"]
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + float(n)) / ((source + 1.0) * (target.sum() + float(n)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of gains over a text's features (none: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, runs, whole = gram_buckets(batch.column("text"), len(gain))
            sums = np.zeros(int(counts.sum()), np.int64)
            for found, valid in zip(runs, whole, strict=True):
                sums[:len(found)] += np.where(valid, gain[found], 0)
            ends = np.r_[0, np.cumsum(sums)][np.r_[0, np.cumsum(counts)]]
            features = counts + np.maximum(counts - 1, 0) + np.maximum(counts - 2, 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(features.astype(np.int64)),
                 pa.array(np.diff(ends))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(col(key).cast("long").alias("doc_id"), col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = 42) -> Column:
    """Thousandths of a Gumbel variate that depends on the key alone, rounded down; null counts as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _digit(high: Column, low: Column, low_bits: int, start: int, width: int) -> Column:
    """Bits ``start`` to ``start + width`` of ``high`` followed by the ``low_bits`` bits of ``low``."""
    if start >= low_bits:
        part = F.shiftrightunsigned(high, start - low_bits)
    elif start + width <= low_bits:
        part = F.shiftrightunsigned(low, start)
    else:
        part = F.shiftrightunsigned(low, start).bitwiseOR(F.shiftleft(high, low_bits - start))
    return part.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def radix_ranks(df: DataFrame, high: str, low: str, width: int = DIGIT_BITS, block_rows: int | None = None) -> DataFrame:
    """Add rank, 1, 2, 3 ... by ``high`` descending, then ``low`` ascending, nulls of ``low`` first.

    Least significant digit first: the two numbers, counted from their extremes, are one key
    of as many bits as they need. Each pass takes one digit. Rows stand in blocks of
    ``block_rows`` places; the rows of each digit are counted by block, prefix sums over digits
    and then blocks give every block its first destination for the digit, and a row goes to
    that plus the number of rows before it in its block with the digit. Rows that stood in
    order stay so, hence the last pass leaves them sorted. A pass shuffles the narrow rows
    once and writes them to the shared folder; no task sorts more than one block and digit.
    A digit has ``2 ** width`` values at most, which bounds the one small table that is summed in one task.

    Rows equal in both take consecutive ranks in no given order. ``high`` must not be null.
    """
    key, top = col(low).cast("long"), col(high).cast("long")
    ends = df.agg(F.min(top).alias("least"), F.max(top).alias("most"), F.min(key).alias("first"),
                  F.max(key).alias("last"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return df.withColumn("rank", F.lit(None).cast("long"))
    block_rows = block_rows or max(4096, min(1 << 20, ends["n"] >> 8))
    low_bits = (ends["last"] - ends["first"] + 1).bit_length() if ends["first"] is not None else 1
    bits = low_bits + (ends["most"] - ends["least"]).bit_length()
    rows = df.withColumns({
        "key_low": F.coalesce(key - F.lit(ends["first"] or 0) + 1, F.lit(0)).cast("long"),
        "key_high": F.lit(ends["most"]).cast("long") - top, "at": F.monotonically_increasing_id()})
    rows = materialise(rows)
    for start in range(0, max(bits, 1), width):
        rows = materialise(_counting_pass(rows, _digit(F.col("key_high"), F.col("key_low"), low_bits, start, width), block_rows))
    return rows.withColumn("rank", F.col("at") + 1).drop("key_low", "key_high", "at")


def _counting_pass(rows: DataFrame, digit: Column, block_rows: int) -> DataFrame:
    """One stable counting sort: new places ``at`` by digit, then by old place."""
    placed = rows.withColumns({"digit": digit, "block": F.expr(f"at div {block_rows}")})
    counts = placed.groupBy("digit", "block").agg(F.count("*").alias("rows"))
    # A row per digit.
    digits = counts.groupBy("digit").agg(F.sum("rows").alias("all"))
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    digits = digits.select("digit", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("smaller"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(digits, "digit").select(
        "digit", "block", (F.col("smaller") + F.coalesce(F.sum("rows").over(earlier), F.lit(0))).alias("first"))
    own = F.row_number().over(Window.partitionBy("block", "digit").orderBy("at")) - 1
    found = placed.withColumn("own", own).join(offsets, ["block", "digit"])
    return found.withColumn("at", F.col("first") + F.col("own")).select(*[col(c) for c in rows.columns])


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             buckets: int = BUCKETS, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Draw ``percent`` of the documents, likelier the more they resemble the target's texts, without replacement.

    Features of a text are its runs of one to three words, hashed to buckets. A bucket gains
    by its share in the target against its share in the documents; a document's weight is the
    sum over its features, and its score adds noise that makes the highest scores a draw by
    weight. Of the documents with ``least_words`` words at least, floor(percent * N / 100)
    are drawn. A row per document: doc_id, n_features, weight, score and rank (null: not drawn).

    Counts of all buckets, a number set by ``buckets``, pass the driver and return to the tasks.
    Null texts have no feature, a null key has noise of its own and comes first among equal scores, repeated rows
    are drawn as often as they occur. An empty table gives no rows, an empty target gains by rarity alone.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    found = weigh(docs, gain, key, text)
    scored = materialise(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = scored.filter(F.col("n_words") >= least_words)
    ranked = radix_ranks(enough, "score", "doc_id")
    drawn = percent * ranked.count() // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(rest.select(*columns, "rank"))


def oracle() -> str:
    """The draw in SQL. crc32 is linear: a byte's share depends on its value and its distance from the end."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    step = "xor(a >> 1, 3988292384 * (a & 1))"

    def features(name: str, table: str, key: str) -> str:
        words = (f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), "
                 r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
        return f"""{name}_words AS (SELECT row_number() OVER () AS r, {key} AS doc_id, {words} AS w FROM {table}),
{name} AS (
  SELECT r, unnest(w) AS f FROM {name}_words UNION ALL
  SELECT r, w[i] || ' ' || w[i + 1] FROM {name}_words, unnest(range(1, len(w))) AS t(i) UNION ALL
  SELECT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM {name}_words, unnest(range(1, len(w) - 1)) AS t(i))"""

    return f"""
WITH RECURSIVE {features("d", "documents", "doc_id")},
{features("b", "benchmark", "item_id")},
names AS (SELECT f, hex(f) AS hx, strlen(f) AS n FROM (SELECT f FROM d UNION SELECT f FROM b)),
bytes AS (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: {step}) AS t FROM range(256) AS r(b)),
far AS (
  SELECT 0 AS k, b, t AS v FROM bytes UNION ALL
  SELECT k + 1, far.b, xor(v >> 8, bytes.t) FROM far JOIN bytes ON bytes.b = (v & 255) WHERE k < (SELECT max(n) FROM names)),
zeros AS (
  SELECT 0 AS k, 4294967295 AS v UNION ALL
  SELECT k + 1, xor(v >> 8, bytes.t) FROM zeros JOIN bytes ON bytes.b = (v & 255) WHERE k < (SELECT max(n) FROM names)),
parts AS (SELECT f, n, i, substr(hx, 2 * i + 1, 2) AS h FROM names, unnest(range(n)) AS t(i)),
codes AS (SELECT b, printf('%02X', b) AS h FROM bytes),
hashed AS (
  SELECT f, xor(bit_xor(far.v), xor(any_value(zeros.v), 4294967295)) % 10000 AS bucket
  FROM parts JOIN codes USING (h) JOIN far ON far.k = n - 1 - i AND far.b = codes.b JOIN zeros ON zeros.k = n GROUP BY f),
s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN hashed USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
weights AS (
  SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT d_words.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM d_words LEFT JOIN weights USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= 5 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
