"""SentencePiece encoding and decoding of whole texts by suffix-array matching."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import slices, strings
from tabspark.llm.token_store import little

SPACE = "▁"
# Characters of new words that are indexed together, words that a worker remembers, and the longest of them.
INDEX_CHARS = 1 << 18
KEEP = 450_000
LONGEST_KEPT = 64
# Numbers from here on stand for characters without a piece.
_NO_PIECE = 1 << 24


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``codes`` sorted by their first ``depth`` symbols, by doubling ranks."""
    n = len(codes)
    rank = codes.astype(np.int64) + 1
    width, order = 1, np.argsort(rank, kind="stable")
    while width < depth:
        second = np.zeros(n, np.int64)
        second[:-width or None] = rank[width:] if width < n else 0
        key = rank * (max(n, 1 << 21) + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
        width *= 2
    return order


class Vocabulary:
    """Pieces of a SentencePiece model of the BPE kind with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.pieces = {model.id_to_piece(i): i for i in range(size) if i not in special and i not in self.byte_of}
        self.text_of = {i: p for p, i in self.pieces.items()}
        self.score = {i: model.get_score(i) for i in self.text_of}
        self.special, self.unknown = special, model.unk_id()
        if len(self.bytes) != 256:
            raise ValueError("a model with byte fallback is needed")
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a model whose pieces have blanks only in front is needed")
        # What each id stands for in a text, and which ids are bytes.
        self.spelled = [" \u2047 " if i == self.unknown else self.text_of.get(i, "").replace(SPACE, " ")
                        for i in range(size)]
        self.is_byte = np.array([i in self.byte_of for i in range(size)])
        self.longest = max(map(len, self.pieces))
        # Pieces as rows of code points, sorted, for the binary search.
        self.names = sorted(self.pieces)
        self.sorted = np.array(self.names)
        self.lengths = np.array([len(p) for p in self.names])
        self.ids = np.array([self.pieces[p] for p in self.names])
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE by its definition: join the neighbours whose piece scores best, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.pieces.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their characters are encoded together."""
        a, b = self._text(left), self._text(right)
        return self.merged(a + b) == [a, b]

    def _text(self, piece: int) -> str:
        return self.text_of[piece] if piece < _NO_PIECE else chr(piece - _NO_PIECE)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of a piece in the words laid end to end, by start.

        The joined text, with a mark after each word, gets a suffix array; every piece is
        looked up by two binary searches; the ranges of all pieces are sorted by position.
        """
        joined = "\0".join(words) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        order = suffix_array(codes, self.longest)
        padded = np.r_[codes, np.zeros(self.longest, np.uint32)]
        # Suffixes are compared by their first ``longest`` code points, as fixed-width text.
        table = np.lib.stride_tricks.sliding_window_view(padded, self.longest)[order]
        # The mark after a word is no part of any piece, so what follows it does not matter.
        text = np.ascontiguousarray(table).view(f"<U{self.longest}").ravel()
        low = np.searchsorted(text, self.sorted, "left")
        above = np.array([p + "\U0010ffff" if len(p) < self.longest else p for p in self.names])
        high = np.searchsorted(text, above, "right")
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        places = np.repeat(low[found] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        starts, lengths = order[places], np.repeat(self.lengths[found], counts)
        by = np.lexsort((lengths, starts))
        return starts[by], lengths[by], np.repeat(self.ids[found], counts)[by]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with their blanks, as unsigned 32-bit integers.

        Edges are relaxed from left to right. The encoding of every prefix ends in exactly one
        piece: the one that fits behind the last piece of the encoding before it. Characters
        without a piece are edges of their own and become bytes.
        """
        starts, lengths, ids = (x.tolist() for x in self.edges(words))
        pairs, fits, out, at, base = self.pairs, self.fits, [], 0, 0
        total = len(starts)
        for word in words:
            n = len(word)
            # last[i]: the piece that ends the encoding of the first i characters, and where it starts.
            last, back = [-1] * (n + 1), [0] * (n + 1)
            last[0] = 0
            stop = base + n
            reached = base
            while True:
                here = starts[at] if at < total and starts[at] < stop else stop
                # Characters without an edge of their own length, up to the next edge.
                while reached < here:
                    i = reached - base
                    reached += 1
                    if last[i + 1] < 0 and last[i] >= 0:
                        last[i + 1], back[i + 1] = _NO_PIECE + ord(word[i]), i
                if here == stop:
                    break
                i = here - base
                before = last[i]
                if before < 0:
                    while at < total and starts[at] == here:
                        at += 1
                    reached = here + 1
                    continue
                single = False
                while at < total and starts[at] == here:
                    size = lengths[at]
                    single |= size == 1
                    if last[i + size] < 0:
                        piece = ids[at]
                        if before:
                            key = before << 32 | piece
                            good = pairs.get(key)
                            if good is None:
                                good = pairs[key] = fits(before, piece)
                        else:
                            good = True
                        if good:
                            last[i + size], back[i + size] = piece, i
                    at += 1
                if single:
                    reached = here + 1
            found: list[int] = []
            i = n
            while i:
                piece = last[i]
                if piece < _NO_PIECE:
                    found.append(piece)
                else:
                    found.extend(self.bytes[b] for b in reversed(chr(piece - _NO_PIECE).encode()))
                i = back[i]
            out.append(array("I", found[::-1]).tobytes())
            base += n + 1
        if len(pairs) > 500_000:
            pairs.clear()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with blanks restored, runs of byte pieces as UTF-8, the first blank dropped."""
        if not len(ids):
            return ""
        bytes_ = self.is_byte[ids]
        # Runs of byte pieces and of others, in turn.
        edges = np.r_[0, np.flatnonzero(bytes_[1:] != bytes_[:-1]) + 1, len(ids)].tolist()
        numbers, spelled, kind, parts = ids.tolist(), self.spelled, bool(bytes_[0]), []
        for start, stop in zip(edges, edges[1:]):
            run = numbers[start:stop]
            parts.append(_utf8(bytes([self.byte_of[i] for i in run])) if kind
                         else "".join(map(spelled.__getitem__, run)))
            kind = not kind
        text = "".join(parts)
        return text[1:] if text[:1] == " " else text


def _utf8(run: bytes) -> str:
    """Bytes as UTF-8, each byte that is not part of a character as the replacement character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at:at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _words(pieces: Iterable[str]) -> re.Pattern:
    """Parts of a text that no piece crosses: blanks with what follows, cut before some marks.

    Every step of the merging is a piece, so where no piece holds a letter before a mark, the
    encoding never crosses from a letter to that mark. NUL stands alone: it marks ends in the index.
    """
    crossed = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
    marks = re.escape("".join(m for m in ".,;:!?#$%&*)" if m not in crossed)) or "\0"
    return re.compile(f"{SPACE}*[^\\W\\d_]+(?=[{marks}])|{SPACE}*[^{SPACE}\0]+|{SPACE}+|\0")


class Encoder:
    """Encodes texts; each distinct word is matched once while the worker remembers it."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cut = _words(self.vocabulary.pieces)
        self.known: dict[str, bytes] = {"\0": np.array([self.vocabulary.bytes[0]], "u4").tobytes()}

    def words(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.known) > KEEP:
            nul = self.known["\0"]
            self.known = dict(list(self.known.items())[:KEEP // 2]) | {"\0": nul}
        cut = [self.words(t) for t in texts]
        known = self.known
        new = sorted(set().union(*cut).difference(known))
        batch, size = [], 0
        for w in new:
            batch.append(w)
            size += len(w) + 1
            if size >= INDEX_CHARS:
                known.update(zip(batch, self.vocabulary.encode_words(batch), strict=True))
                batch, size = [], 0
        if batch:
            known.update(zip(batch, self.vocabulary.encode_words(batch), strict=True))
        found = [b"".join(map(known.__getitem__, ws)) for ws in cut]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return found


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text; null texts count as empty and have no id.

    ``ids`` is binary: little-endian unsigned 32-bit integers. ``model`` is a SentencePiece
    BPE model with byte fallback, identity normalisation and a blank put in front. Null
    keys and repeated rows give a row each. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in slices(batches, "text"):
            found = [little(x) for x in own.encode(strings(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, text``: the texts of binary ids; null ids have empty texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(model).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and checksums of ids, and the hash of the decoded text."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"))
