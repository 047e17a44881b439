import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabspark.functions.scratch import scratch_path
from tabspark.llm import packing, token_store
from tabspark.llm.encoding import Encoder
from tabspark.llm.queries import BYTE_BPE
from tests.llm.helpers import DOCS

# The library's default: a quoted marker is its added token.
PLAIN = Tokenizer.from_file(BYTE_BPE)
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z  <|endoftext|> ", "no marker <|endoftext| > here",
         "many words stand before <|endoftext|><|endoftext|>\n\nand after it.", ""]


def ids(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("keep", [700_000, 2])
def test_added_tokens_as_the_library_encodes_them(keep):
    coder = Encoder(BYTE_BPE, keep=keep)
    assert ids(TEXTS[0]) == [64, 220, 50256, 275]
    for text in [*TEXTS, *TEXTS]:
        assert np.frombuffer(coder.encode(text), "u4").tolist() == ids(text)


def test_stored_and_packed_ids_of_quoted_markers(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)], DOCS).repartition(2)
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(docs, path, BYTE_BPE)
    at = 0
    for doc, start, n, crc in sorted(map(tuple, token_store.token_checksums(spark, path).collect())):
        wanted = np.array([*ids(TEXTS[doc]), 0], "<u4")
        assert (start, n, crc) == (at, len(wanted), zlib.crc32(wanted.tobytes()))
        at += n
    rows = packing.piece_digests(packing.pack(docs, BYTE_BPE)).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(ids(t)) + 1 for i, t in enumerate(TEXTS)}
