"""Certified best-fit packing against plain packings and against exact bounds."""

import functools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabspark.llm import best_fit
from tabspark.llm.queries import WORD_BPE, op11_best_fit
from tests.llm.helpers import tricky_docs


def _plain_best_fit(lengths, capacity):
    room = []
    for need in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= need]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= need
        else:
            room.append(capacity - need)
    return room


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_equals_the_plain_form(lengths):
    places, room = best_fit.best_fit_decreasing(np.array(lengths, np.int64), 30)
    assert sorted(room) == sorted(_plain_best_fit(lengths, 30))
    filled = np.bincount(places, lengths, len(room)) if lengths else np.zeros(0)
    assert (30 - filled == room).all()


def _fewest(lengths, capacity):
    """The least number of bins, by trying every way."""
    lengths = tuple(sorted(lengths, reverse=True))

    @functools.lru_cache(None)
    def least(i, room):
        if i == len(lengths):
            return 0
        tried, best = set(), 99
        for k, r in enumerate(room):
            if r >= lengths[i] and r not in tried:
                tried.add(r)
                best = min(best, least(i + 1, tuple(sorted((*room[:k], r - lengths[i], *room[k + 1:])))))
        return min(best, 1 + least(i + 1, tuple(sorted((*room, capacity - lengths[i])))))

    return least(0, ())


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_bound_never_exceeds_the_optimum(lengths):
    counts = np.bincount(lengths, minlength=13) if lengths else np.zeros(13, np.int64)
    bound = best_fit.lower_bound(counts, 12)
    assert -(-sum(lengths) // 12) <= bound <= _fewest(lengths, 12)


def test_bound_sees_more_than_volume():
    # Seven pieces above a half, and five above a third that fit two to a bin only.
    counts = np.zeros(101, np.int64)
    counts[51] = 7
    assert best_fit.lower_bound(counts, 100) == 7
    counts[:] = 0
    counts[34] = 5
    assert best_fit.lower_bound(counts, 100) == 3
    counts[:] = 0
    counts[26] = 8
    assert best_fit.lower_bound(counts, 100) == 3


def _dealt(spark, values, groups):
    kind = "grp long, bin long, tokens binary, pieces array<struct<doc_id: long, piece: int, start: long, length: long, offset: long>>"
    rows = [(i % groups, -1, bytes(2 * int(x)), [(i, 0, 0, int(x), 0)]) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, kind).repartition(3)


def test_exchange_closes_the_gaps_of_small_groups(spark):
    lengths = np.random.default_rng(1).integers(1, 60, 700)
    found, certificates = best_fit.exchange(_dealt(spark, lengths, 18), "<u2", 18, capacity=100, group_pieces=40)
    rows = found.collect()
    assert sorted(p["doc_id"] for r in rows for p in r["pieces"]) == list(range(700))
    for r in rows:
        assert sum(p["length"] for p in r["pieces"]) + r["padding"] == 100
        assert all(p["length"] == lengths[p["doc_id"]] for p in r["pieces"])
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    bound = best_fit.lower_bound(np.bincount(lengths, minlength=101), 100)
    first = [r for r in certificates.collect() if r["round"] == 0]
    assert sum(r["n_bins"] for r in first) > bound + 3
    assert all(r["bound"] <= r["n_bins"] for r in certificates.collect())
    # Packing all 700 at once needs the bound itself; 18 groups alone need 11 more.
    assert len(rows) <= bound + 3


def test_one_length_only_a_grown_group_and_no_rows(spark):
    found, _ = best_fit.exchange(_dealt(spark, [51] * 90, 9), "<u2", 9, capacity=100, group_pieces=10)
    assert found.count() == 90
    found, certificates = best_fit.exchange(_dealt(spark, [50] * 90, 1), "<u2", 1, capacity=100, group_pieces=10)
    assert found.count() == 45 and {r["part"] for r in certificates.collect()} == {0, 1, 2, 3, 4}
    found, certificates = best_fit.exchange(_dealt(spark, [1], 1).limit(0), "<u2", 1)
    assert found.count() == certificates.count() == 0


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(WORD_BPE)
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


def _check(rows, texts, ids_of, capacity):
    """Every id once, at its place, no document cut that fits, sequences gapless."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(docs) == set(texts)
    for key, own in docs.items():
        ids = [*ids_of(texts[key]), 1]
        assert [r["piece"] for r in sorted(own, key=lambda r: r["start"])] == list(range(-(-len(ids) // capacity)))
        for r in own:
            assert r["start"] == r["piece"] * capacity
            part = np.array(ids[r["start"]:r["start"] + capacity], "<u4")
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    return sequences


def test_op11_packs_every_id_once(spark, small, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op11_best_fit(spark, small).collect()
    sequences = _check(rows, texts, plain, 4096)
    counts = np.bincount([r["length"] for r in rows], minlength=4097)
    assert len(sequences) == best_fit.lower_bound(counts, 4096)


@pytest.mark.parametrize("group", [4096, 4])
def test_tricky_rows(spark, plain, group):
    docs = tricky_docs(spark, extra=True)
    sequences = best_fit.pack_best_fit(docs, WORD_BPE, capacity=64, group_pieces=group)
    rows = best_fit.piece_digests(sequences).collect()
    known = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    # The row that occurs twice is checked once; nameless rows by their total.
    seen, single = set(), []
    for r in rows:
        if r["doc_id"] is not None and (r["doc_id"], r["start"]) not in seen:
            seen.add((r["doc_id"], r["start"]))
            single.append(r)
    found = {r["doc_id"] for r in single}
    assert found == set(texts)
    for r in single:
        ids = [*plain(texts[r["doc_id"]]), 1]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in rows) == sum(len(plain(r["text"])) + 1 for r in docs.collect())
    for s in sequences.collect():
        assert len(s["tokens"]) // 4 + s["padding"] == 64
        assert [p["offset"] for p in s["pieces"]] == list(np.cumsum([0, *[p["length"] for p in s["pieces"]]])[:-1])
    assert best_fit.pack_best_fit(docs.limit(0), WORD_BPE).count() == 0
    assert sequences.agg(F.count_distinct("sequence_id")).first()[0] == sequences.count()
