"""Near copies of documents: SimHash classes and MinHash bands name the candidates, an exact comparison of shingles decides."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.scratch import materialise, release
from tabspark.llm.common import WordCodes, slices, strings
from tabspark.llm.simhash import RADIUS, SHARD, _digest, _free, fingerprint, link_forest
from tabspark.operators.components import connected_components

WORDS = 5
# Shared shingles of all shingles of two near copies, in hundredths.
SIMILARITY = 80
# Two documents at the limit agree in a band with probability 0.8 ** 5, in one of nine with 0.97.
BANDS, ROWS = 9, 5
# Documents that one task compares with each other; fuller bands are cut into blocks that meet pairwise.
BLOCK = 1024
# Distinct runs of words of those documents; together they take 8 bytes each in a task, twice for two blocks.
BLOCK_RUNS = 1 << 20

_RANDOM = np.random.default_rng(5)
_FACTORS, _SHIFTS = (_RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in "ab")
_PRIMES = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _PRIMES[1]
    return (x ^ (x >> np.uint64(32))) * _PRIMES[2]


def word_codes() -> WordCodes:
    return WordCodes(lambda word: xxhash.xxh64_intdigest(word, 5), np.uint64)


def shingles(text: str, codes: WordCodes, words: int = WORDS) -> tuple[int, np.ndarray]:
    """A hash of the words of a text, and the distinct hashes of its runs of words in order.

    Words stand between ASCII blanks, A-Z in lower case. A text of fewer words is one run.
    """
    found = text.encode().lower().split()
    same = xxhash.xxh64_intdigest(b" ".join(found), 7)
    if len(found) <= words:
        return same, np.array([same], np.uint64)
    each = codes(found)
    runs = np.zeros(len(found) - words + 1, np.uint64)
    for i in range(words):
        runs = _mixed(runs * _PRIMES[0] + each[i:i + len(runs)])
    return same, np.unique(runs)


def bands(runs: np.ndarray) -> np.ndarray:
    """One value a band: a hash of the smallest values of its rows."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(runs), 4096):
        least = np.minimum(least, (runs[at:at + 4096, None] * _FACTORS + _SHIFTS).min(axis=0))
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        value = _mixed(value * _PRIMES[0] + row)
    return value.view(np.int64)


def _signed(values: list) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = word_codes()
    for batch in slices(batches, "text"):
        found = [shingles(x, codes) for x in strings(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), _signed([same for same, _ in found]),
             pa.array([bands(runs) for _, runs in found], pa.list_(pa.int64())),
             pa.array([len(runs) for _, runs in found], pa.int64())],
            ["doc_id", "digest", "same", "bands", "n_runs"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_banded` with the SimHash fingerprint of each text."""
    batches, again = itertools.tee(slices(batches, "text"))
    for batch, banded in zip(batches, _banded(again), strict=True):
        bits = np.array([fingerprint(x) for x in strings(batch.column("text"))], np.uint64)
        yield banded.append_column("fp", pa.array(bits.view(np.int64)))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = word_codes()
    for batch in slices(batches, "text"):
        runs = [np.sort(shingles(x, codes)[1].view(np.int64)) for x in strings(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(runs, pa.list_(pa.int64()))],
                                         ["same", "runs"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def forest(sets: list) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted arrays of distinct values), each tied to its group's first.

    A set is compared with the members of each group until one is near; pairs that are joined
    already are not compared, and sets too different in size cannot be near.
    """
    sets = [np.sort(np.fromiter(s, np.int64, len(s))) if isinstance(s, set) else s for s in sets]
    groups: list[list[int]] = []
    for i, own in enumerate(sets):
        near, far = [], []
        for group in groups:
            for j in group:
                low, high = sorted((len(own), len(sets[j])))
                if 100 * low < SIMILARITY * high:
                    continue
                both = _common(own, sets[j])
                if 100 * both >= SIMILARITY * (low + high - both):
                    near.append(group)
                    break
            else:
                far.append(group)
        groups = [*far, sorted([i, *(j for group in near for j in group)])]
    return [(j, group[0]) for group in groups for j in group[1:]]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for group in batch.column("members"):
            same = group.values.field("same").to_numpy()
            order = np.argsort(same, kind="stable")
            lists = group.values.field("runs")
            # Views of the batch: no copy is made of a document's runs.
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [values[ends[i]:ends[i + 1]] for i in order.tolist()]
            for i, j in forest(sets):
                a.append(same[order[i]])
                b.append(same[order[j]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _meetings(distinct: DataFrame, block: int, block_runs: int) -> DataFrame:
    """``place, same``, written to the shared folder: which documents are compared with each other.

    Bands with the same members, as near copies agree in most bands, are one place. Bands with
    more than ``block`` documents or ``block_runs`` runs of words are cut into blocks, and every two blocks are a
    place; so a place is bounded in bytes, but for single documents that are longer.
    """
    keyed = distinct.select("same", "n_runs", F.explode("bands").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count("*").alias("n"), F.sum("n_runs").alias("all_runs")).filter("n > 1")
    sized = materialise(keyed.join(sizes, "band"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all_runs") / block_runs)).cast("int")
    small = (sized.filter(blocks <= 1).groupBy("band").agg(F.sort_array(F.collect_list("same")).alias("all"))
             .select("all").distinct()
             .select(F.struct(F.xxhash64("all").alias("band"), F.lit(0).alias("i"), F.lit(0).alias("j")).alias("place"),
                     F.explode("all").alias("same")))
    full = sized.filter(blocks > 1).withColumns(
        {"blocks": blocks, "own": F.pmod(F.xxhash64("same", F.lit(3)), blocks).cast("int")})
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        "band", F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    found = materialise(small.unionByName(full.select(F.explode(pairs).alias("place"), "same")))
    release(sized)
    return found


def _classed(firsts: DataFrame, radius: int, shard: int) -> DataFrame:
    """``same, bands, n_runs`` with one band more: the class of the document's fingerprint.

    Fingerprints are looked up in the BK-trees of their shards; a class is what links within ``radius`` bits
    lead to, so documents whose fingerprints link always meet.
    """
    prints = firsts.select(F.col("fp").alias("id")).distinct()
    classes = connected_components(prints, link_forest(prints.select(F.col("id").alias("fp")), radius, shard))
    own = F.xxhash64("component", F.lit(11))
    return firsts.join(classes, firsts["fp"] == classes["id"]).select(
        "same", F.concat("bands", F.array(own)).alias("bands"), "n_runs")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), _digest(text).alias("digest"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK,
             block_runs: int = BLOCK_RUNS, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group of near copies: the smallest key, once.

    Texts link when at least ``SIMILARITY`` hundredths of the distinct runs of five words of
    both are in both; groups are what links lead to. Texts of the same words meet as one before
    anything is compared. Candidates have SimHash fingerprints in one class (links within ``radius``
    bits, found by BK-trees over shards) or agree in a MinHash band, as few texts at the limit are so few bits
    apart. Each is verified on its shingles, so documents below the limit never link. Rows without a key stay only where their
    group has no row with a key; exact repetitions of a row become one.
    """
    banded = materialise(_rows(docs, key, text).mapInArrow(
        _named, "doc_id long, digest long, same long, bands array<long>, n_runs long, fp long"))
    row: Column = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    firsts = materialise(banded.groupBy("same").agg(F.min(row).alias("first"), F.any_value("bands").alias("bands"),
                                                      F.any_value("n_runs").alias("n_runs"), F.any_value("fp").alias("fp")))
    release(banded)
    meetings = _meetings(_classed(firsts, radius, shard), block, block_runs)
    wanted = meetings.select("same").distinct().join(firsts, "same").select(
        "same", F.col("first.doc_id").alias("at"), F.col("first.digest").alias("digest"))
    texts = _rows(docs, key, text).join(wanted, "digest").filter(F.col("doc_id").eqNullSafe(F.col("at")))
    runs = materialise(texts.select("same", "text").mapInArrow(_shingled, "same long, runs array<long>")
                       .dropDuplicates(["same"]))
    links = (meetings.join(runs, "same").groupBy("place").agg(F.collect_list(F.struct("same", "runs")).alias("members"))
             .select("members").mapInArrow(_linked, "a long, b long"))
    # The links are written there, so what they were made of can go.
    groups = connected_components(firsts.select(F.col("same").alias("id")), links)
    release(meetings)
    release(runs)
    stay = (firsts.join(groups, firsts["same"] == groups["id"]).groupBy("component").agg(F.min("first").alias("stays"))
            .select("stays.doc_id", "stays.digest"))
    known, digest = _free(docs, "id"), _free(docs, "digest")
    rows = docs.withColumns({known: F.col(f"`{key}`").cast("long"), digest: _digest(text)})
    kept = rows.join(stay, rows[known].eqNullSafe(stay["doc_id"]) & (rows[digest] == stay["digest"]), "left_semi")
    return kept.dropDuplicates([known, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])
