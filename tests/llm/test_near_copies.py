import random

import numpy as np
import pytest

import corpus_pipeline
from tabspark.llm import near_copies, simhash
from tests.llm.helpers import components, tricky_docs, words


def plain_shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def near(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def plain_kept(texts):
    """The smallest id of each brute-force component of documents at similarity 0.8 or more."""
    sets = {k: plain_shingles(t) for k, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if near(sets[a], sets[b])]
    group = components(ids, links)
    return {k for k in ids if group[k] == k}, links


def edited(rnd, w, similarity):
    """A copy whose words are changed one by one until its similarity is just above the wanted one."""
    text, base = " ".join(w), plain_shingles(" ".join(w))
    w = list(w)
    for i in rnd.sample(range(len(w)), len(w)):
        w[i] = f"new{rnd.random()}"
        other = plain_shingles(" ".join(w))
        if len(base & other) < similarity * len(base | other):
            return text
        text = " ".join(w)


def planted(seed=1, n=150):
    rnd = random.Random(seed)
    texts = {}
    for i in range(n):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(120, 400))]
        texts[2 * i], texts[2 * i + 1] = " ".join(w), edited(rnd, w, 0.8 if i % 2 else 0.9)
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)


def test_stage_removes_planted_near_copies(spark, small):
    """Planted copies at 0.8 and above: at least 0.9 of them go, and nothing else does."""
    texts = planted()
    wanted, links = plain_kept(texts)
    assert len(links) == 150
    kept = {r["doc_id"] for r in corpus_pipeline.single_documents(spark, frame(spark, texts), small).collect()}
    assert wanted <= kept
    assert len(texts) - len(kept) >= 0.9 * len(links)


def test_simhash_finds_near_copies_that_no_band_names(spark, small):
    """Near copies a few bits apart that agree in no MinHash band: a phrase outweighs the words that differ."""
    codes, texts, found = near_copies.word_codes(), {}, 0
    for seed in range(2000):
        rnd = random.Random(seed)
        w = [f"s{seed}w{i}" for i in range(100)]
        phrase = [f"s{seed}p{i}" for i in range(7)] * 200
        copy = list(w)
        for i in (15, 85):
            copy[i] = f"s{seed}x{rnd.random()}"
        a, b = (" ".join(phrase + x) for x in (w, copy))
        bands = [near_copies.bands(near_copies.shingles(x, codes)[1]) for x in (a, b)]
        if (bands[0] != bands[1]).all():
            bits = simhash.fingerprint(a) ^ simhash.fingerprint(b)
            assert near(plain_shingles(a), plain_shingles(b))
            if bits.bit_count() <= simhash.RADIUS:
                texts[2 * found], texts[2 * found + 1], found = a, b, found + 1
        if found == 4:
            break
    assert found == 4
    kept = {r["doc_id"] for r in corpus_pipeline.single_documents(spark, frame(spark, texts), small).collect()}
    assert kept == {0, 2, 4, 6}


def test_fingerprints_that_link_are_no_near_copies_below_the_limit(spark):
    """The same phrase outweighs all else: the fingerprints link, the runs of words hardly agree, so both stay."""
    phrase = ["one two three four five six seven"] * 300
    texts = {i: " ".join(phrase + [f"d{i}w{k}" for k in range(40)]) for i in range(5)}
    bits = [simhash.fingerprint(t) for t in texts.values()]
    assert max((bits[0] ^ x).bit_count() for x in bits) <= simhash.RADIUS
    assert {r["doc_id"] for r in near_copies.keep_one(frame(spark, texts)).collect()} == set(texts)


def test_documents_below_the_limit_stay(spark):
    rnd = random.Random(2)
    texts = {}
    for i in range(60):
        w = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        texts[2 * i], copy = " ".join(w), edited(rnd, w, 0.8).split()
        copy[rnd.randrange(80, 120)] = "gone"
        copy[20] = copy[180] = "more"
        texts[2 * i + 1] = " ".join(copy)
    wanted, links = plain_kept(texts)
    assert len(links) < 20
    assert {r["doc_id"] for r in near_copies.keep_one(frame(spark, texts)).collect()} >= wanted


@pytest.mark.parametrize("block", [1024, 16])
def test_large_groups_meet_in_blocks(spark, block):
    rnd = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    texts = {}
    for i in range(120):
        copy = list(w)
        copy[rnd.randrange(300)] = f"x{i}"
        texts[i] = " ".join(copy)
    texts |= {200 + i: texts[7].upper() for i in range(20)} | {300 + i: f"alone {i} and so on it goes" for i in range(20)}
    wanted, _ = plain_kept(texts)
    assert wanted == {0, *range(300, 320)}
    assert {r["doc_id"] for r in near_copies.keep_one(frame(spark, texts), block=block).collect()} == wanted


def test_long_near_copies_meet_in_blocks_of_bounded_bytes(spark):
    """300 near copies of 20,000 words: no place holds more than two blocks of runs, and all are found."""
    rnd = random.Random(8)
    w = [f"w{rnd.randrange(50_000)}" for _ in range(20_000)]
    texts = {}
    for i in range(300):
        copy = list(w)
        for _ in range(20):
            copy[rnd.randrange(20_000)] = f"x{i}"
        texts[i] = " ".join(copy)
    docs = frame(spark, texts)
    banded = near_copies._rows(docs, "doc_id", "text").mapInArrow(
        near_copies._banded, "doc_id long, digest long, same long, bands array<long>, n_runs long").cache()
    places = near_copies._meetings(banded.select("same", "bands", "n_runs"), 1024, 1 << 19)
    most = places.join(banded, "same").groupBy("place").agg({"n_runs": "sum"}).agg({"sum(n_runs)": "max"}).first()[0]
    assert most < 3 << 19
    assert [r["doc_id"] for r in near_copies.keep_one(docs, block_runs=1 << 19).collect()] == [0]
    assert [r["doc_id"] for r in near_copies.keep_one(docs).collect()] == [0]
    banded.unpersist()


def test_common_values_of_sorted_arrays():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = (np.unique(rng.integers(-20, 20, rng.integers(0, 15))) for _ in "ab")
        assert near_copies._common(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_forest_joins_groups():
    rnd = np.random.default_rng(4)
    base = [set(range(c, c + 100)) for c in (0, 1000, 2000)]
    sets = [b - set(rnd.choice(sorted(b), 5).tolist()) for b in base for _ in range(8)]
    rnd.shuffle(sets)
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if near(a, b)]
    assert components(range(24), near_copies.forest(sets)) == components(range(24), links)


@pytest.mark.parametrize("extra", [False, True])
def test_one_row_of_each_group_stays(spark, extra):
    docs = tricky_docs(spark, extra)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert [r["doc_id"] for r in rows if not words(r["text"])] == [0]
    assert sum(r["text"] == "no id" for r in rows) == 1
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_documents_of_the_tables(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    wanted, links = plain_kept(texts)
    kept = {r["doc_id"] for r in near_copies.keep_one(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert wanted <= kept and len(texts) - len(kept) >= 0.9 * (len(texts) - len(wanted))
