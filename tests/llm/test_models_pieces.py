import itertools
import random
import zlib

import numpy as np
import pytest
import sentencepiece

from tabspark.llm import pieces, quality, toxicity
from tabspark.llm.queries import PIECES, op3_toxicity, op6_sentencepiece, op9_quality_classifier
from tests.llm.helpers import TRICKY, tricky_docs


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 7):
        u, a, start = rng.normal(0, 2, n), rng.uniform(0.1, 3, (2, 2)), 0.4
        first = np.zeros(n, bool)
        first[0] = True
        if n > 4:
            first[3] = True
        weights = {}
        for y in itertools.product((0, 1), repeat=n):
            w = 1.0
            for t in range(n):
                w *= (start if y[t] else 1.0) if first[t] else a[y[t - 1], y[t]]
                w *= np.exp(u[t]) if y[t] else 1.0
            weights[y] = w
        total = sum(weights.values())
        wanted = [sum(w for y, w in weights.items() if y[t]) / total for t in range(n)]
        assert np.allclose(toxicity.marginals(u, first, start, a), wanted)


def test_toxic_words_are_learned_and_found():
    rnd = random.Random(1)
    plain = ["red", "green", "blue", "and", "the", "of", "stone", "river"]
    texts, y = [], []
    for i in range(160):
        w = [rnd.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            w[rnd.randrange(40)] = rnd.choice(["grobly", "snarkfool" + "abc"[i % 3]])
        texts.append(" ".join(w))
        y.append(int(i % 4 == 0))
    model = toxicity.fit(texts, np.array(y), np.ones(160))
    scores, spans = model.spans(["the stone is grobly, and blue", "the river", "", "snarkfoolx of stone"])
    assert scores[0] > 0.5 > scores[1] and scores[2] < 0.5 < scores[3]
    assert [(s["start"], s["end"]) for s in spans[0]] == [(13, 20)] and spans[1] == []


def _auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query, target, cut, least", [(op3_toxicity, "toxic", 0.5, 0.8), (op9_quality_classifier, "quality", 0.3, 0.95)])
def test_held_out_documents(spark, query, target, cut, least):
    sf = "/root/testdata/sf0.01"
    rows = query(spark, sf).collect()
    labels = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert _auc(np.array([s for s, _ in held]), np.array([t for _, t in held])) >= least


@pytest.mark.parametrize("extra", [False, True])
def test_scores_of_tricky_rows(spark, small, extra):
    docs, labels = tricky_docs(spark, extra), spark.read.parquet(f"{small}/labels.parquet")
    for found in (toxicity.toxicity(docs, labels, 50), quality.quality_scores(docs, labels, 50),
                  quality.quality_scores(docs, labels.limit(0))):
        rows = found.collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        same = {r["score"] for r in rows if r["doc_id"] == 6}
        assert len(same) == 1
    assert quality.keep_good(docs, labels, threshold=0.0).count() == docs.count()
    assert toxicity.keep_clean(docs, labels, threshold=2.0).columns == docs.columns
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_factorisation_equals_the_sum_over_pairs():
    texts = ["red green green blue!", "loud LOUD words", "", "a b c d e"] * 3
    model = quality.fit(texts, np.array([1, 0, 0, 1] * 3), np.ones(12), epochs=2)
    doc, index, value = model.rows(quality.features(texts))
    margin, _ = model.margins(doc, index, value, 12)
    for i in range(4):
        own = np.flatnonzero(doc == i)
        pairs = sum(model.v[index[a]] @ model.v[index[b]] * value[a] * value[b] for a, b in itertools.combinations(own, 2))
        assert np.isclose(margin[i], model.bias + (model.w[index[own]] * value[own]).sum() + pairs, atol=1e-5)


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_the_library(processor):
    rnd = random.Random(9)
    alphabet = " \n\té漢aabbthe▁.,\0😀!s"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(800)]
    texts += [t or "" for t in TRICKY] + ["<s> </s> <unk>", "    x  ", "aaaaaaaaaaaaaaaaaaaaaaa"]
    own = pieces.Encoder(PIECES)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        found = np.frombuffer(ids, "u4")
        assert found.tolist() == processor.encode(text), text
        assert own.vocabulary.decode(found) == processor.decode(found.tolist()), text


def test_decoding_any_ids(processor):
    rnd = random.Random(4)
    vocabulary = pieces.Vocabulary(PIECES)
    for _ in range(300):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(32_000)]) for _ in range(rnd.randint(0, 12))]
        assert vocabulary.decode(np.array(ids, "u4")) == processor.decode(ids), ids


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 200).astype(np.uint32)
    order = pieces.suffix_array(codes, 16)
    suffixes = [codes[i:i + 16].tolist() for i in order]
    assert suffixes == sorted(suffixes) and sorted(order.tolist()) == list(range(200))


def test_op6_of_all_documents(spark, small, processor):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op6_sentencepiece(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = processor.encode(texts[r["doc_id"]])
        assert (r["n_ids"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r["text_md5"] == hashlib.md5(processor.decode(ids).encode()).hexdigest()
    tricky = tricky_docs(spark, True)
    assert pieces.digests(pieces.decode(pieces.encode(tricky, PIECES), PIECES)).count() == tricky.count()
