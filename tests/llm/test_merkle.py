"""The manifest against a plain tree, for every shape of tree, and its SQL twin."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tabspark.llm import merkle
from tabspark.llm.queries import op12_manifest
from tests.llm.helpers import DOCS, tricky_docs


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(values):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(digests, fan):
    """Root, and for each leaf the runs on its way: (place, run)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i:i + fan] for i in range(0, len(level), fan)]
        for k in range(len(digests)):
            paths[k].append((at[k] % fan, runs[at[k] // fan]))
            at[k] //= fan
        level = [_h(*r) for r in runs]
    return "".join(level), paths


def plain_manifest(rows, altered, fan=3):
    """Rows (doc_id, text, lang, source, n_chars) to (doc_id, leaf, subroot, root, proof hash, folded root, verified)."""
    rows = [(d, s, _leaf((d, s, la, n, t)), _leaf((d, s, la, n, altered(d, t)))) for d, t, la, s, n in rows]
    rows.sort(key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, r[2]))
    sources = list(dict.fromkeys(r[1] for r in rows))
    trees = {s: _tree([r[2] for r in rows if r[1] == s], fan) for s in sources}
    root, tops = _tree([trees[s][0] for s in sources], fan)
    at, found = dict.fromkeys(sources, 0), []
    for d, s, leaf, now in rows:
        subroot, paths = trees[s]
        path = paths[at[s]] + tops[sources.index(s)]
        at[s] += 1
        siblings = [x for place, run in path for k, x in enumerate(run) if k != place]
        for place, run in path:
            now = _h(*run[:place], now, *run[place + 1:])
        found.append((d, leaf, subroot, root, _h(*siblings), now, now == root))
    return found


def _without_breaks(key, text):
    return text.replace("\n", "") if text and zlib.crc32(str("" if key is None else key).encode()) % 2 == 0 else text


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("fan, levels", [(3, 6), (3, 1), (2, 2)])
def test_trees_of_every_size(spark, fan, levels):
    sizes = [1, 2, 3, 4, 5, 8, 9, 10, 27, 28]
    rows = [(1000 * s + i, f"text {i}\nof {s}", "en", None if s == 0 else f"s{s:02d}é", i)
            for s, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    new = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    found = merkle.manifest(docs, altered={"text": new}, fan=fan, levels=levels)
    wanted = plain_manifest(rows, lambda d, t: t.replace("\n", "") if d % 2 == 0 else t, fan)
    assert _sorted(found.drop("source", "proof").collect()) == _sorted(wanted)
    kept = found.filter("verified").agg(F.count("*"), F.count_if(F.col("doc_id") % 2 == 0)).first()
    assert tuple(kept) == (sum(r[0] % 2 for r in rows), 0)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(i, "a", None, None, None) for i in range(n)]
    found = merkle.manifest(spark.createDataFrame(rows, DOCS)).drop("source", "proof").collect()
    assert _sorted(found) == _sorted(plain_manifest(rows, lambda d, t: t))


@pytest.mark.parametrize("extra", [False, True])
def test_tricky_rows(spark, extra):
    docs = tricky_docs(spark, extra)
    rows = [tuple(r)[:5] for r in docs.collect()]
    found = merkle.manifest(docs, levels=2).drop("source", "proof").collect()
    assert _sorted(found) == _sorted(plain_manifest(rows, lambda d, t: t))
    assert all(r["verified"] for r in found)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_a_proof_is_bound_to_its_leaf(spark):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(20)]
    found = merkle.manifest(spark.createDataFrame(rows, DOCS)).collect()
    first, other = found[0], found[1]
    assert _h(first["proof"]) == first["proof_sha256"]
    assert first["proof"] != other["proof"] and first["root"] == other["root"]


def test_op12_of_all_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    found = op12_manifest(spark, small).collect()
    assert _sorted(found) == _sorted(plain_manifest(rows, _without_breaks))
    assert 0 < sum(r["verified"] for r in found) < len(rows)
