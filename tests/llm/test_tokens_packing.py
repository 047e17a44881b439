import glob
import json
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabspark.functions.scratch import scratch_path
from tabspark.llm import packing, token_store
from tabspark.llm.encoding import Encoder
from tabspark.llm.queries import BYTE_BPE, op1_token_store, op2_packing
from tests.llm.helpers import TRICKY, tricky_docs


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(BYTE_BPE)
    return lambda text: found.encode(text or "", add_special_tokens=False).ids


CODER = Encoder(BYTE_BPE)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\x1c　ab.,1é漢<|>'s!#", max_size=30))
def test_encoder_equals_the_tokenizer(text):
    whole = CODER.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(CODER.encode(text), "u4").tolist() == whole


def test_encoder_with_a_full_dictionary(plain):
    small = Encoder(BYTE_BPE, keep=3)
    for text in [*TRICKY, *TRICKY]:
        assert np.frombuffer(small.encode(text or ""), "u4").tolist() == plain(text)


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("extra", [False, True])
def test_token_files_of_tricky_rows(spark, plain, extra):
    path = scratch_path(spark, "tokens")
    docs = tricky_docs(spark, extra)
    token_store.write_tokens(docs, path, BYTE_BPE)
    rows = sorted(map(tuple, token_store.token_checksums(spark, path).collect()), key=lambda r: r[1])
    known = [r for r in rows if r[0] is not None]
    assert [r[0] for r in rows[:2]] == [None, None] and [r[0] for r in known] == sorted(r[0] for r in known)
    at = 0
    for doc, start, n, _ in rows:
        assert start == at
        at += n
    wanted = sorted((r["doc_id"] or -1, _crc([*plain(r["text"]), 0])) for r in docs.collect())
    assert sorted((r[0] or -1, r[3]) for r in rows) == wanted


def test_token_files_can_be_read_selectively(spark, small):
    path = scratch_path(spark, "tokens")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    token_store.write_tokens(docs, path, BYTE_BPE)
    some = token_store.read_tokens(spark, path, where="doc_id between 50 and 59", columns=["doc_id", "n_tokens"])
    assert [r["doc_id"] for r in some.orderBy("doc_id").collect()] == list(range(50, 60))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan.replace("n_tokens", "") and "PushedFilters" in plan
    file = glob.glob(f"{path}/tokens/*.parquet")[0]
    meta = pq.ParquetFile(file).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    tokens = columns["tokens.list.element"]
    assert "DELTA_BINARY_PACKED" in tokens.encodings and not tokens.has_dictionary_page
    assert tokens.has_offset_index and tokens.has_column_index


def test_empty_tables(spark):
    empty = tricky_docs(spark).limit(0)
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(empty, path, BYTE_BPE)
    assert token_store.token_checksums(spark, path).count() == 0
    assert packing.pack(empty, BYTE_BPE).count() == 0


def test_op1_of_all_documents(spark, small, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op1_token_store(spark, small).orderBy("doc_id").collect()
    at = 0
    for r in rows:
        ids = [*plain(texts[r["doc_id"]]), 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), _crc(ids))
        at += len(ids)
    assert len(rows) == len(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing_equals_the_plain_form(lengths):
    bins, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, left in enumerate(room):
            if left >= lengths[i]:
                break
        else:
            b = len(room)
            room.append(50)
            bins.append([])
        bins[b].append(i)
        room[b] -= lengths[i]
    assert packing.first_fit_decreasing(np.array(lengths, int), 50) == bins


def _check_pieces(rows, ids_of, capacity=2048):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return docs, sequences


def test_op2_packs_every_id_once(spark, small, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op2_packing(spark, small).collect()
    docs, sequences = _check_pieces(rows, plain)
    assert {k for k, _ in docs} == set(texts)
    for (doc, total), own in docs.items():
        ids, at = [*plain(texts[doc]), 1], 0
        assert total == len(ids)
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == _crc(ids[at:at + r["length"]])
            at += r["length"]
        assert at == total
    used = sum(r["length"] for r in rows)
    assert used > 0.95 * 2048 * (len(sequences) - 1)


@pytest.mark.parametrize("most", [4096, 3])
def test_packing_of_tricky_rows(spark, plain, most):
    docs = tricky_docs(spark, extra=True)
    sequences = packing.pack(docs, BYTE_BPE, capacity=64, group_pieces=most)
    rows = packing.piece_digests(sequences).collect()
    _check_pieces(rows, plain, 64)
    assert len({r["sequence_id"] for r in rows}) == sequences.count()
    wanted = sum(len(plain(r["text"])) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == wanted
    for s in sequences.collect():
        assert len(s["tokens"]) // 4 + s["padding"] == 64
    assert json.dumps([r["doc_id"] for r in rows])
