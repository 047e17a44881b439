"""Columnar encoding against the library, for both kinds of splitter."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabspark.llm.encoding import Encoder
from tests.llm.helpers import TRICKY

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
CODERS = {name: Encoder(public_tokenizers.path(name)) for name in FILES}
PARTS = st.sampled_from([" ", "\n", "\t", "\x1c", "　", "\xa0", "a", "Bc", "it's", ".", ",", "1", "23", "é",
                         "é", "漢", "<|endoftext|>", "<|startoftext|>", "<|end", "!?", "İ", "Σ"])


def _plain(coder, text):
    return coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def _split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[b - n:b].tolist() for b, n in zip(ends, counts, strict=True)]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(PARTS, max_size=10).map("".join) | st.none(), max_size=12))
def test_columns_equal_the_library(name, texts):
    coder = CODERS[name]
    found = _split(*coder.encode_all(pa.array(texts, pa.string())))
    assert found == [_plain(coder, x) for x in texts]
    assert [np.frombuffer(coder.encode(x or ""), "u4").tolist() for x in texts] == found


@pytest.mark.parametrize("name", FILES)
def test_small_dictionary_and_tricky_rows(name):
    coder = Encoder(public_tokenizers.path(name), keep=2)
    for _ in range(2):
        assert _split(*coder.encode_all(pa.array(TRICKY))) == [_plain(coder, x) for x in TRICKY]
    assert coder.chunks is not None


@pytest.mark.parametrize("name", FILES)
def test_letters_one_by_one(name):
    coder = CODERS[name]
    texts = [f"a {chr(c)}b x{chr(c)}. y" for c in range(0x20, 0x250)]
    assert _split(*coder.encode_all(pa.array(texts))) == [_plain(coder, x) for x in texts]
