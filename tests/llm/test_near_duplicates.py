import random

import numpy as np
import pytest
import xxhash

from tabspark.llm import embeddings, simhash
from tabspark.llm.queries import op7_simhash, op8_near_vectors
from tests.llm.helpers import components, tricky_docs, words


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_of_tricky_rows(spark):
    docs = tricky_docs(spark, True)
    found = sorted((r["doc_id"] or -1, r["fp"] & (2 ** 64 - 1)) for r in simhash.fingerprints(docs).collect())
    assert found == sorted((r["doc_id"] or -1, plain_fingerprint(r["text"])) for r in docs.collect())


def test_tree_finds_what_a_scan_finds():
    rnd = random.Random(3)
    items = [rnd.getrandbits(64) for _ in range(200)]
    items += [x ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for x in items]
    tree = simhash.Tree()
    for x in items:
        tree.add(x)
    for x in items:
        near = sorted(items.index(items[i]) for i in tree.within(x, 2))
        assert near == sorted(items.index(y) for y in items if (x ^ y).bit_count() <= 2)


def _plain_components(prints):
    ids = {}
    for doc, fp in prints:
        ids.setdefault(fp, []).append(doc)
    fps = list(ids)
    links = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    group = components(fps, links)
    least = {}
    for fp, docs in ids.items():
        least[group[fp]] = min(docs + [least.get(group[fp], docs[0])])
    return {(doc, fp): least[group[fp]] for doc, fp in prints}


@pytest.mark.parametrize("shard", [2048, 8])
def test_components_with_full_shards(spark, shard):
    """Fingerprints that agree in most bits fill shards, which are then cut again and again."""
    rnd = random.Random(7)
    prints = [(i, rnd.getrandbits(9) << 3) for i in range(60)]
    prints += [(100 + i, rnd.getrandbits(64)) for i in range(60)]
    prints += [(200 + i, fp ^ 3 << rnd.randrange(62)) for i, (_, fp) in enumerate(prints)]
    rows = [(d, d, fp - (1 << 64) if fp >> 63 else fp) for d, fp in prints]
    frame = spark.createDataFrame(rows, "doc_id bigint, digest bigint, fp bigint")
    found = {r["fp"] & (2 ** 64 - 1): r["component_id"] for r in simhash.classes(frame, shard=shard).collect()}
    wanted = _plain_components(prints)
    assert {fp: found[fp] for _, fp in prints} == {fp: wanted[d, fp] for d, fp in prints}


def test_op7_of_all_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    wanted = _plain_components([(d["doc_id"], plain_fingerprint(d["text"])) for d in docs])
    rows = op7_simhash(spark, small).collect()
    assert {(r["doc_id"], int(r["fingerprint"], 16)): r["component_id"] for r in rows} == wanted
    assert all(len(r["fingerprint"]) == 16 for r in rows) and len(rows) == len(docs)


@pytest.mark.parametrize("extra", [False, True])
def test_one_row_of_each_group_stays(spark, extra):
    docs = tricky_docs(spark, extra)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    # Empty, blank and missing texts are one group; the repeated row is one.
    assert [r["doc_id"] for r in rows if not words(r["text"])] == [0]
    assert len({plain_fingerprint(r["text"]) for r in rows}) == len(rows)
    assert sum(r["text"] == "no id" for r in rows) == 1
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def _plain_links(rows, cosine=0.93):
    good = [(i, lab, np.array(v, float) / max(map(abs, v))) for i, lab, v in rows
            if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(good)):
        for b in range(a):
            if good[a][1] == good[b][1] and len(good[a][2]) == len(good[b][2]):
                x, y = good[a][2], good[b][2]
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links.append((good[a][0], good[b][0]))
    return links


def _compare(found, rows, least):
    links = _plain_links(rows)
    group = components([r[0] for r in rows], links)
    wanted = {i: 0 for i, _, _ in rows}
    for a, b in links:
        wanted[a] += 1
        wanted[b] += 1
    assert len(found) == len(rows)
    for r in found:
        assert r["n_links"] <= wanted[r["vec_id"]]
        assert r["kept"] == (r["vec_id"] == r["component_id"])
        assert group[r["component_id"]] == group[r["vec_id"]]
    assert sum(r["n_links"] for r in found) >= least * sum(wanted.values())


def test_op8_recall(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet")
            .select("vec_id", "label", "embedding").collect()]
    _compare(op8_near_vectors(spark, small).collect(), rows, 0.9)


@pytest.mark.parametrize("block", [1024, 16])
def test_vectors_close_together_in_blocks(spark, block):
    """A thick cluster, copies, other labels and rows that cannot link; small blocks meet pairwise."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, i % 2, (centre + 0.25 * rng.standard_normal(16)).tolist()) for i in range(120)]
    rows += [(200 + i, 0, centre.tolist()) for i in range(30)]
    rows += [(300, None, centre.tolist()), (301, 0, None), (302, 0, []), (303, 0, [0.0] * 16),
             (304, 0, [float("nan")] + [1.0] * 15), (305, 0, [None] + [1.0] * 15), (306, 0, [float("inf")] * 16),
             (307, 0, centre.tolist()[:8]), (308, 0, (centre * 1e150).tolist())]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    found = embeddings.near_vectors(frame, block=block, bucket=1000).collect()
    _compare(found, rows, 0.97)
    by = {r["vec_id"]: r for r in found}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i for i in range(300, 307))
    assert by[308]["component_id"] == by[200]["component_id"] and by[200]["n_links"] >= 29
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_cap_decoding_lists_every_exceeding_filter():
    code = embeddings.Code(12, 0.05, 10.0, blocks=3)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, names = code.decode(x)
    turned, n = x @ code.rotation, len(code.words[0])
    wanted = set()
    for i in range(40):
        for c in range(n ** 3):
            parts = (c // n // n, c // n % n, c % n)
            score = sum(turned[i, a:b] @ w[k] for (a, b), w, k in zip(code.cuts, code.words, parts, strict=True))
            if score >= code.threshold:
                wanted.add((i, c))
    assert set(zip(rows.tolist(), names.tolist(), strict=True)) == wanted
