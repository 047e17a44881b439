"""Ids of whole texts with the tokenizers library, each distinct chunk encoded once."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A boundary of pre-tokens of the byte-level splitter: one space or line break between two non-blanks.
_SAFE = re.compile(r"(?<=\S)([ \n])(?=\S)")
_BLANKS = re.compile(r"\s\s")
# Every blank of Python or of the library, for the columnar matcher.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = f"{_BLANK}{_BLANK}|^{_BLANK}|{_BLANK}$"
# Marks after a word that form one pre-token of their own.
_MARKS = ".,;:!?)]}\"#$%&*"
_LONGEST_KEPT = 48
# Letters that lower-case one by one and do not compose with others, up to this one.
_LAST_PLAIN = "\u024f"
# The word splitter that the shortcut below knows.
_WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
                    {"type": "Lowercase"}]
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_letters() -> dict[int, str]:
    """The letter that the byte-level splitter writes for each byte: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Chunks(dict):
    """Ids of chunks, made when first asked for. Subclasses say what a chunk stands for."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.letters, self.marks = _byte_letters(), {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def spelled(self, word: str, space: bool = False) -> bytes:
        """Ids of one pre-token, with a space before it or not."""
        if not word.isascii():
            word = word.encode().decode("latin1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize("\u0120" + word if space else word)]).tobytes()

    def tail(self, marks: str) -> bytes:
        """Ids of marks that follow a word."""
        if len(marks) > _LONGEST_KEPT:
            return self.whole(marks)
        if marks not in self.marks:
            self.marks[marks] = self.whole(marks)
        return self.marks[marks]

    def keep(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= _LONGEST_KEPT:
            self[chunk] = ids
        return ids


class _ByteChunks(_Chunks):
    """Chunks of the byte-level splitter: what follows a space, a line break, or a tab for the start of a text.

    A single line break between non-blanks is a pre-token of its own, and the word after it
    has no space. The tab only marks that nothing stands before the chunk; it has no id.
    """

    def __missing__(self, chunk: str) -> bytes:
        if chunk[:1] in ("\n", "\t"):
            before = self.tail("\n") if chunk[0] == "\n" else b""
            word = chunk[1:]
            core = word.rstrip(_MARKS)
            if core.isalpha():
                return self.keep(chunk, before + self.spelled(core) + self.tail(word[len(core):]))
            return self.keep(chunk, before + self.whole(word))
        if chunk.isalpha() or chunk.isascii() and chunk.isdigit():
            return self.keep(chunk, self.spelled(chunk, space=True))
        core = chunk.rstrip(_MARKS)
        if core.isalpha():
            return self.keep(chunk, self[core] + self.tail(chunk[len(core):]))
        return self.keep(chunk, self.whole(" " + chunk))


class _WordChunks(_Chunks):
    """Chunks of the splitter into words with ends: runs between blanks, which are dropped."""

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or max(core) <= _LAST_PLAIN and "\u0130" not in core):
            ids = self.get(core) if len(core) < len(chunk) else None
            if ids is None:
                ids = self.keep(core, self.spelled(core.lower()))
            return self.keep(chunk, ids + self.tail(chunk[len(core):])) if len(core) < len(chunk) else ids
        return self.keep(chunk, self.whole(chunk) if chunk else b"")


class Encoder:
    """Ids of texts; each distinct chunk between safe blanks is encoded once by the tokenizer.

    The byte-level splitter attaches one space to the word after it and makes a line break
    between two words a pre-token, so both always end a pre-token when they stand alone
    between non-blanks, and the ids of a text are the ids of its chunks in a row. The
    splitter into words with ends drops blanks, so every space or line break is a
    boundary. A chunk of letters is one pre-token and goes to the tokenizer's model at
    once. Texts that hold an added token, which the library encodes as that token, and
    texts of tokenizers with another splitter are encoded in one call.
    """

    def __init__(self, path: str, keep: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 65_536
        self.chunks = self._splitter(json.loads(self.tokenizer.to_str()))
        # The library takes added tokens out of a text before it splits the rest, inside words too.
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.known = keep, (self.chunks or _Chunks)(self.tokenizer)

    @staticmethod
    def _splitter(kind: dict) -> type | None:
        """How chunks are cut and encoded, None for a tokenizer whose boundaries are not known here."""
        model, split = kind["model"], kind.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            return None
        if (split.get("type") == "ByteLevel" and split.get("use_regex", True)
                and not split.get("add_prefix_space", True) and not kind.get("normalizer")):
            return _ByteChunks
        parts = split.get("pretokenizers") or [{}, {}]
        if ((kind.get("normalizer") or {}).get("normalizers") == _WORD_NORMALIZER and len(parts) == 2
                and parts[0].get("pattern") == {"Regex": _WORD_PATTERN} and parts[0].get("behavior") == "Removed"
                and parts[0].get("invert") and parts[1].get("type") == "ByteLevel"
                and not parts[1].get("use_regex", True) and not parts[1].get("add_prefix_space", True)):
            return _WordChunks
        return None

    def _renew(self) -> _Chunks:
        """The dictionary, halved when it is full: what came first is met most often."""
        if len(self.known) > self.keep or len(self.known.marks) > 10_000:
            kept = dict(itertools.islice(self.known.items(), self.keep // 2))
            self.known = self.chunks(self.tokenizer)
            self.known.update(kept)
        return self.known

    def encode(self, text: str) -> bytes:
        """The ids of a text as unsigned 32-bit integers in the machine's order."""
        if not self.chunks or any(x in text for x in self.added):
            return self.known.whole(text)
        known = self._renew()
        if self.chunks is _WordChunks:
            return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))
        # Cut at the safe blanks only; chunks that hold other blanks go to the tokenizer whole.
        head, *rest = _SAFE.split(text)
        cut = [x if blank == " " else blank + x for blank, x in zip(rest[::2], rest[1::2], strict=True)]
        return known.whole(head) + b"".join(map(known.__getitem__, cut))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has; null is empty.

        Texts with safe blanks only are cut by column operations, and the dictionary is asked
        once for each distinct chunk of the batch; the others go through :meth:`encode`.
        """
        texts = texts.fill_null("")
        if not self.chunks:
            single = np.ones(len(texts), bool)
        else:
            marked = [pc.match_substring(texts, x) for x in self.added]
            if self.chunks is _ByteChunks:
                marked.append(pc.match_substring_regex(texts, _UNEVEN))
            single = np.logical_or.reduce([np.asarray(x.to_numpy(zero_copy_only=False), bool) for x in marked]
                                          or [np.zeros(len(texts), bool)])
        if not single.any():
            return self._columns(texts)
        ids, counts = self._columns(texts.filter(pa.array(~single)))
        alone = [self.encode(x) for x in texts.filter(pa.array(single)).to_pylist()]
        lengths = np.r_[counts, [len(x) // 4 for x in alone]]
        flat = pa.array(np.r_[ids, np.frombuffer(b"".join(alone), "u4")])
        lists = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(lengths)], flat)
        places = np.empty(len(texts), np.int64)
        places[np.r_[np.flatnonzero(~single), np.flatnonzero(single)]] = np.arange(len(texts))
        taken = lists.take(pa.array(places))
        return taken.flatten().to_numpy(), lengths[places]

    def _columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) == 0:
            return np.zeros(0, "u4"), np.zeros(0, np.int64)
        if self.chunks is _WordChunks:
            cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\t", texts, ""), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        found = list(map(self._renew().__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        pool = np.frombuffer(b"".join(found), "u4")
        # A batch is far below 2 ** 31 ids.
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // np.int32(4)
        starts = np.cumsum(sizes, dtype=np.int32) - sizes
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.cumsum(each, dtype=np.int32)
        places = np.repeat(starts[codes] - ends + each, each)
        places += np.arange(len(places), dtype=np.int32)
        ids = pool[places]
        before = np.r_[0, ends.astype(np.int64)][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return ids, np.diff(before)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file, loaded once."""
    return Encoder(path)
