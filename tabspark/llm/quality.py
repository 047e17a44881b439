"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import functools
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tabspark.llm.common import FIT_CHARS, WordCodes, distinct, kept_rows, labelled_sample, scored_rows

# Hashed words, rank of the interactions, bins of each statistic.
WORDS = 1 << 16
RANK = 8
BINS = 12
# Labelled documents of each class to fit on, and the score from which a document is good.
PER_CLASS = 2000
THRESHOLD = 0.3
# Documents whose words are looked at together while fitting.
FIT_DOCS = 128
_SYMBOLS = frozenset("#*$%&|<>")
_FLAGS = 8


def _code(word: str) -> int:
    """Hash of the bare word, length and shape of a word in one integer."""
    flags = word.isupper() | word.istitle() << 5 | (not word.isascii()) << 7
    bare = word
    if not word.isalpha():
        bare = word.strip(".,;:!?()[]{}\"'#*$%&|<>")
        flags |= ((not _SYMBOLS.isdisjoint(word)) << 1 | (not bare.isalpha() and any(map(str.isdigit, word))) << 2
                  | ("!" in word) << 3 | (word[-1] in ".,;:") << 4 | (not bare) << 6)
    return zlib.crc32(bare.lower().encode()) & (WORDS - 1) | min(len(word), 255) << 16 | flags << 24


@functools.lru_cache(maxsize=1)
def _codes() -> WordCodes:
    return WordCodes(_code, np.int64)


@dataclass
class Features:
    """Documents as compressed rows of hashed words with their counts, and dense statistics."""

    ends: np.ndarray
    index: np.ndarray
    count: np.ndarray
    stats: np.ndarray


def features(texts: list[str], codes: WordCodes | None = None) -> Features:
    """Words and statistics of whole texts: length, shapes, repetition, lines. ``codes``: not the worker's dictionary."""
    codes = _codes() if codes is None else codes
    parts, lines = [], np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        parts.append(codes(text.split()))
        rows = [x for x in text.split("\n") if x.strip()]
        lines[i] = len(rows), len(set(rows)), len(text)
    n = np.array([len(p) for p in parts], np.int64)
    flat = np.concatenate([*parts, np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(texts)), n)
    word = flat & (WORDS - 1)
    pairs, count = distinct(doc * WORDS + word)
    owner, index = pairs // WORDS, pairs % WORDS
    different = np.bincount(owner, minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, owner, count)
    same = doc[1:] == doc[:-1]
    twins = distinct((doc[1:][same] * WORDS + word[1:][same]) * WORDS + word[:-1][same])[0] // (WORDS * WORDS)
    per = np.maximum(n, 1)
    shapes = [np.bincount(doc, (flat >> (24 + b)) & 1, len(texts)) / per for b in range(_FLAGS)]
    stats = np.column_stack([
        np.log2(n + 1), np.log2(lines[:, 2] + 1), np.bincount(doc, (flat >> 16) & 255, len(texts)) / per, *shapes,
        different / per, top / per, np.bincount(twins, minlength=len(texts)) / np.maximum(n - 1, 1),
        lines[:, 1] / np.maximum(lines[:, 0], 1), np.log2(lines[:, 0] + 1), n / np.maximum(lines[:, 0], 1)])
    return Features(np.cumsum(different), index, count.astype(np.float64), stats)


def sample_features(texts: list[str]) -> Features:
    """:func:`features` of a sample, some texts at a time, so that the driver never holds the words of all of them.

    The dictionary ends with the call: the driver scores nothing.
    """
    codes = WordCodes(_code, np.int64)
    parts = [features(texts[at:at + FIT_DOCS], codes) for at in range(0, max(1, len(texts)), FIT_DOCS)]
    before = np.cumsum([0, *(len(p.index) for p in parts)])
    return Features(np.concatenate([p.ends + at for p, at in zip(parts, before[:-1], strict=True)]),
                    np.concatenate([p.index for p in parts]), np.concatenate([p.count for p in parts]),
                    np.concatenate([p.stats for p in parts]))


@dataclass
class Model:
    """``bias + w x + 1/2 (|V x|^2 - sum |v_i|^2 x_i^2)``: linear time in the features of a document."""

    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def rows(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value): words by damped counts of length 1, statistics by bin."""
        n = len(f.ends)
        doc = np.repeat(np.arange(n), np.diff(f.ends, prepend=0))
        value = np.log1p(f.count)
        norm = np.sqrt(np.bincount(doc, value ** 2, n))
        s = f.stats.shape[1]
        bins = np.stack([np.searchsorted(self.edges[k], f.stats[:, k], "right") for k in range(s)], axis=1)
        cells = WORDS + np.arange(s) * BINS + bins
        return (np.r_[doc, np.repeat(np.arange(n), s)], np.r_[f.index, cells.ravel()],
                np.r_[value / np.maximum(norm[doc], 1e-9), np.full(n * s, 1 / np.sqrt(s))])

    def margins(self, doc: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(doc, self.w[index] * value, n)
        sums = np.stack([np.bincount(doc, self.v[index, k] * value, n) for k in range(self.v.shape[1])], axis=1)
        own = np.bincount(doc, (self.v ** 2).sum(axis=1)[index] * value ** 2, n)
        return self.bias + linear + 0.5 * ((sums ** 2).sum(axis=1) - own), sums

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin, _ = self.margins(*self.rows(features(texts)), len(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(texts: list[str], y: np.ndarray, weights: np.ndarray, epochs: int = 6, batch: int = 200,
        rate: float = 0.15, decay: float = 1e-4, seed: int = 3) -> Model:
    """Fit by stochastic gradient steps, scaled by the squares of earlier gradients.

    Without two classes the model is the constant share of label 1.
    """
    random = np.random.default_rng(seed)
    f = sample_features(texts)
    width = f.stats.shape[1]
    edges = np.stack([np.quantile(f.stats[:, k], np.arange(1, BINS) / BINS) if len(texts) else np.zeros(BINS - 1)
                      for k in range(width)])
    size = WORDS + width * BINS
    share = float(np.average(y, weights=weights)) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Model(edges, float(np.log(share / (1 - share))), np.zeros(size), random.normal(0, 0.02, (size, RANK)))
    if len(set(y.tolist())) < 2:
        model.v[:] = 0
        return model
    doc, index, value = model.rows(f)
    order = np.argsort(doc, kind="stable")
    doc, index, value = doc[order], index[order], value[order]
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        shuffled = random.permutation(len(texts))
        for at in range(0, len(texts), batch):
            chosen = shuffled[at:at + batch]
            lengths = starts[chosen + 1] - starts[chosen]
            here = np.repeat(starts[chosen] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            d = np.repeat(np.arange(len(chosen)), lengths)
            i, x = index[here], value[here]
            margin, sums = model.margins(d, i, x, len(chosen))
            slope = weights[chosen] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[chosen]) / len(chosen)
            touched, back = np.unique(i, return_inverse=True)
            gx = slope[d] * x
            gw = np.bincount(back, gx, len(touched)) + decay * model.w[touched]
            vi = model.v[i]
            raw = gx[:, None] * (sums[d] - vi * x[:, None])
            gv = np.stack([np.bincount(back, raw[:, k], len(touched)) for k in range(RANK)], axis=1)
            gv += decay * model.v[touched]
            gb = slope.sum()
            seen_w[touched] += gw ** 2
            seen_v[touched] += gv ** 2
            seen_b += gb ** 2
            model.w[touched] -= rate * gw / np.sqrt(seen_w[touched])
            model.v[touched] -= 0.3 * rate * gv / np.sqrt(seen_v[touched])
            model.bias -= rate * gb / np.sqrt(seen_b)
    model.w, model.v = model.w.astype(np.float32), model.v.astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int | None = FIT_CHARS) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out, of at most ``longest`` characters."""
    return fit(*labelled_sample(docs, labels, "quality", per_class, longest=longest))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
                   threshold: float = THRESHOLD, longest: int | None = FIT_CHARS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Scores use the text only: words, structure, and length as metadata. Null texts count as
    empty, which have a score too; null keys and repeated rows give a row each; without labels
    the score is 0.5. The model has a fixed size and is broadcast.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, longest))
    return scored_rows(docs, lambda texts: model.value.scores(texts), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None, per_class: int = PER_CLASS,
              threshold: float = THRESHOLD, longest: int | None = FIT_CHARS) -> DataFrame:
    """The rows, all columns, whose text scores at least ``threshold``; ``fit_on`` has the labelled texts."""
    fitted = train(docs if fit_on is None else fit_on, labels, per_class, longest)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    return kept_rows(docs, lambda texts: model.value.scores(texts) >= threshold)
