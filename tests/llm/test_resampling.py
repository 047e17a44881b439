"""Weights against plain hashing, the radix sort against a plain sort, and the whole draw."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabspark.llm import resampling
from tabspark.llm.queries import op13_resample
from tests.llm.helpers import TRICKY, tricky_docs


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _features(text):
    w = _words(text)
    return [" ".join(w[i:i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def _buckets(text, buckets=10_000):
    return [zlib.crc32(f.encode()) % buckets for f in _features(text)]


TEXTS = st.lists(st.sampled_from(["a", "Bc", " ", "  ", "\n", "-", "é", "漢字", "É", "12", "_", "\0", "x" * 70, "😀"]),
                 max_size=25).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS | st.none(), max_size=8), st.integers(0, 2))
def test_buckets_equal_plain_hashes(texts, skip):
    counts, runs, whole = resampling.gram_buckets(pa.array(["skipped row", "", *texts], pa.string()).slice(skip))
    rows = ["skipped row", "", *texts][skip:]
    assert counts.tolist() == [len(_words(t)) for t in rows]
    found = sorted(b for r, v in zip(runs, whole, strict=True) for b in r[v].tolist())
    assert found == sorted(b for t in rows for b in _buckets(t))


def plain_draw(rows, target, percent=5, least=20):
    """doc_id -> (n_features, weight, score, rank), by dictionaries and one sort."""
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for _, x in rows:
        np.add.at(s, _buckets(x), 1)
    for x in target:
        np.add.at(t, _buckets(x), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000))))
            for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    found = []
    for key, x in rows:
        own = _buckets(x)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        found.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = [r for r, (_, x) in zip(found, rows, strict=True) if len(_words(x)) >= least]
    long.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(long[:percent * len(long) // 100]):
        r[4] = i + 1
    return found


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_op13_of_all_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert _sorted(op13_resample(spark, small).collect()) == _sorted(plain_draw(rows, target))


@pytest.mark.parametrize("extra", [False, True])
def test_tricky_rows(spark, extra):
    docs = tricky_docs(spark, extra)
    target = spark.createDataFrame([("word word word",), (None,)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = resampling.resample(docs, target, percent=100, least_words=0).drop("rank")
    assert _sorted(found.collect()) == _sorted(r[:4] for r in plain_draw(rows, ["word word word", None], 100, 0))
    ranks = resampling.resample(docs, target, percent=100, least_words=0).collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, len(TRICKY) + 4))
    assert resampling.resample(docs.limit(0), target).count() == 0
    alone = resampling.resample(docs, target.limit(0)).collect()
    assert len(alone) == len(rows) and all(r["rank"] is None for r in alone)


@pytest.mark.parametrize("width, block", [(12, None), (3, 7), (16, 64)])
@pytest.mark.parametrize("spread", [3, 1 << 40])
def test_radix_ranks_equal_a_plain_sort(spark, width, block, spread):
    rng = np.random.default_rng(4)
    high, low = rng.integers(-spread, spread, 500), rng.permutation(500) * 10**9 - 5 * 10**10
    rows = [(int(h), int(x)) for h, x in zip(high, low, strict=True)] + [(0, None), (int(high.max()), None)]
    docs = spark.createDataFrame(rows, "score long, doc_id long").repartition(4)
    wide = width if spread == 3 or width > 3 else 24
    found = {(r["score"], r["doc_id"]): r["rank"] for r in resampling.radix_ranks(docs, "score", "doc_id", wide, block).collect()}
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
    assert found == {r: i + 1 for i, r in enumerate(ordered)}


def test_equal_rows_take_consecutive_ranks(spark):
    docs = spark.range(50).select((F.col("id") % 2).alias("score"), F.lit(7).cast("long").alias("doc_id")).repartition(3)
    rows = sorted(map(tuple, resampling.radix_ranks(docs, "score", "doc_id", block_rows=8).select("rank", "score").collect()))
    assert rows == [(i, 1 if i <= 25 else 0) for i in range(1, 51)]
