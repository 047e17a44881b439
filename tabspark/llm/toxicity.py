"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabspark.llm.common import FIT_CHARS, WordCodes, distinct, held_out, kept_rows, labelled_sample, slices, strings

# Hashed features of a word, labelled documents of each class to fit on.
FEATURES = 1 << 18
PER_CLASS = 1000
THRESHOLD = 0.5
# Documents whose features are spread out at a time while fitting.
FIT_DOCS = 64
# A span is reported where the marginal of a word reaches this.
SPAN_AT = 0.5
# A feature marks toxic words if this share of the documents that have it is toxic, if chance alone
# would hardly make any feature do so well, and if it explains at least so many toxic documents that no
# better feature explains or stands in this share of all toxic documents.
PRECISION = 0.97
CHANCE = 0.05
LEAST_DOCS = 3
COMMON = 0.05
_MARKS = ".,;:!?()[]{}<>\"'`*#$%&|_-"


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: its bare form, its first 4, 5 and 6 bytes, and its last 4."""
    bare = (word if word.isalpha() else word.strip(_MARKS)).lower().encode()
    crc, last = zlib.crc32, FEATURES - 1
    if len(bare) <= 4:
        return (crc(bare) & last ^ 1,)
    h4 = crc(bare[:4])
    h5 = crc(bare[4:5], h4)
    h6 = crc(bare[5:6], h5)
    return (crc(bare[6:], h6) & last ^ 1, h4 & last, h5 & last, h6 & last, crc(bare[-4:], 99) & last)


def marginals(u: np.ndarray, first: np.ndarray, start: float, a: np.ndarray) -> np.ndarray:
    """Marginals of label 1 by forward-backward.

    ``u`` is the log odds of label 1 from the word alone, ``first`` marks the first words
    of documents, ``start`` is the odds of label 1 there and ``a[i, j]`` the weight of a step.
    All documents stand in one row of words that is cut into blocks of equal length; the
    blocks advance together, first to find what each block does to the message that
    enters it, then with that message. A document's first word forgets what came before.
    """
    n = len(u)
    if not n:
        return np.zeros(0)
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    e = np.ones(blocks * length)
    e[:n] = np.exp(np.clip(u, -25, 25))
    new = np.zeros(blocks * length, bool)
    new[:n] = first
    pad = np.arange(blocks * length) >= n
    after = np.r_[new[1:], True] | np.r_[pad[1:], True]

    def step(i: int, j: int, back: bool) -> np.ndarray:
        """The factor from state i to j at every word; back: that of the word after it, seen from here."""
        f = np.where(new, start if j else 1.0, a[i, j])
        if j:
            f *= e
        f[pad] = float(i == j)
        if back:
            # A new document leaves nothing of what comes after.
            f = np.r_[f[1:], 1.0]
            f[after] = 1.0
        return f.reshape(blocks, length)

    def run(back: bool) -> np.ndarray:
        # Message (m0, m1) -> (f00 m0 + f10 m1, f01 m0 + f11 m1); padding leaves it as it is. Walking back, the
        # message of state i gathers over the states j of the word after it. Returns the odds at every word.
        s = np.empty((length, 2, 2, blocks))
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            s[:, j if back else i, i if back else j] = step(i, j, back).T
        order = range(length - 1, -1, -1) if back else range(length)
        p = np.repeat(np.eye(2)[:, :, None], blocks, axis=2)
        q = np.empty_like(p)
        for t in order:
            x = s[t]
            q[:, 0] = p[:, 0] * x[0, 0] + p[:, 1] * x[1, 0]
            q[:, 1] = p[:, 0] * x[0, 1] + p[:, 1] * x[1, 1]
            p, q = q, p
            if t % 8 == 0:
                p /= p.sum(axis=(0, 1))
        enter = np.empty((2, blocks))
        m = np.array([1.0, 1.0])
        for b in range(blocks - 1, -1, -1) if back else range(blocks):
            enter[:, b] = m
            m = m @ p[:, :, b]
            m = m / m.sum()
        out = np.empty((blocks, length))
        m0, m1 = enter
        for t in order:
            x = s[t]
            m0, m1 = m0 * x[0, 0] + m1 * x[1, 0], m0 * x[0, 1] + m1 * x[1, 1]
            total = m0 + m1
            m0, m1 = m0 / total, m1 / total
            out[:, t] = m1 / np.maximum(m0, 1e-300)
        return out.ravel()[:n]

    odds = run(False)
    odds *= run(True)
    return odds / (1 + odds)


@dataclass
class Model:
    """Weights of word features, of steps, and of the aggregation to documents."""

    weights: np.ndarray
    bias: float
    start: float
    steps: np.ndarray
    document: np.ndarray

    def emission(self):
        """From a word to the log odds of label 1 from the word alone."""
        bias, weight = self.bias, self.weights.tolist()
        return lambda word: bias + sum([weight[i] for i in word_features(word)])

    def tag(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, the end of each text among all words, and all marginals."""
        u = _emissions(self)
        words = [t.split() for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        first = np.zeros(n.sum(), bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        flat = np.concatenate([*[u(w) for w in words], np.zeros(0)])
        return words, np.cumsum(n), marginals(flat, first, self.start, self.steps)

    def scores(self, texts: list[str]) -> np.ndarray:
        _, ends, p = self.tag(texts)
        return self.documents(ends, p)

    def documents(self, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = aggregate(ends, p)
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))

    def spans(self, texts: list[str], at: float = SPAN_AT) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and the offending spans of each text in code points: neighbours are one span."""
        _, ends, p = self.tag(texts)
        found = []
        for text, end, begin in zip(texts, ends, np.r_[0, ends[:-1]] if len(ends) else [], strict=True):
            own = p[begin:end]
            spans: list[dict] = []
            if len(own) and own.max() >= at:
                last = -2
                for k, m in enumerate(re.finditer(r"\S+", text)):
                    if own[k] >= at:
                        if last == k - 1:
                            spans[-1]["end"] = m.end()
                            spans[-1]["p"] = max(spans[-1]["p"], float(own[k]))
                        else:
                            spans.append({"start": m.start(), "end": m.end(), "p": float(own[k])})
                        last = k
            found.append(spans)
        return self.documents(ends, p), found


_LAST: list = []


def _emissions(model: Model) -> WordCodes:
    """The worker's dictionary from a word to its log odds under a model; the model is held with it."""
    if not _LAST or _LAST[0] is not model:
        _LAST[:] = [model, WordCodes(model.emission(), np.float64)]
    return _LAST[1]


def aggregate(ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Per document: 1, log odds of its most toxic word, and the expected number of toxic words, damped."""
    n = len(ends)
    doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    most = np.full(n, 1e-9)
    np.maximum.at(most, doc, np.clip(p, 1e-9, 1 - 1e-9))
    return np.column_stack([np.ones(n), np.log(most / (1 - most)), np.log1p(np.bincount(doc, p, n))])


def toxic_features(doc: np.ndarray, feature: np.ndarray, y: np.ndarray) -> list[int]:
    """Features that mark toxic words, chosen one after another by the toxic documents they newly explain.

    Labels are known by document only; this makes labelled words of them. A feature that
    stands in clean documents too, or only in documents that are explained already (as
    every word of a group of copies does), is never chosen.
    """
    pairs = doc * np.int64(FEATURES) + feature
    pairs.sort()
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    # Narrow numbers: these arrays are the largest of a fit.
    doc, feature = (pairs // FEATURES).astype(np.int32), (pairs % FEATURES).astype(np.int32)
    del pairs
    toxic = np.bincount(feature, y[doc], FEATURES)
    seen = np.bincount(feature, minlength=FEATURES)
    # So many toxic documents in a row by chance, over all features that occur often enough to try.
    tried = max(1, int((seen >= LEAST_DOCS).sum()))
    enough = np.log(CHANCE / tried) / np.log(min(max(y.mean(), 1e-6), 0.999))
    fit = (toxic >= max(LEAST_DOCS, enough)) & (toxic >= PRECISION * seen)
    chosen = np.flatnonzero(fit & (toxic >= COMMON * y.sum())).tolist()
    keep = fit[feature] & (y[doc] == 1) & ~np.isin(doc, doc[np.isin(feature, chosen)])
    doc, feature = doc[keep], feature[keep]
    while len(doc):
        gain = np.bincount(feature, minlength=FEATURES)
        best = int(gain.argmax())
        if gain[best] < LEAST_DOCS:
            break
        chosen.append(best)
        left = ~np.isin(doc, doc[feature == best])
        doc, feature = doc[left], feature[left]
    return chosen


def fit(texts: list[str], y: np.ndarray, weights: np.ndarray, rounds: int = 40, rate: float = 1.0,
        decay: float = 1e-7) -> Model:
    """Fit the field by gradient steps on all words at once, then the aggregation to documents.

    Without two classes every document gets the constant share of label 1.
    """
    share = float(np.average(y, weights=weights)) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = Model(np.zeros(FEATURES), -8.0, 1e-3, np.array([[1.0, 1e-2], [1.0, 1e-1]]),
                  np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if len(set(y.tolist())) < 2:
        return model
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in t.split()], np.int32) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat, doc, ends = np.concatenate(words), np.repeat(np.arange(len(texts), dtype=np.int32), n), np.cumsum(n)
    first = np.zeros(len(flat), bool)
    first[(ends - n)[n > 0]] = True
    lists = [word_features(w) for w in vocabulary]
    sizes = np.array([len(x) for x in lists])
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
    feature = np.fromiter(itertools.chain.from_iterable(lists), np.int32, sizes.sum())
    known = len(lists)
    del lists, vocabulary
    begin = np.cumsum(sizes) - sizes
    pairs = []
    for at in range(0, len(words), FIT_DOCS):
        # The features of some documents at a time: of all words at once they would take some hundred MB.
        own = [distinct(w)[0] for w in words[at:at + FIT_DOCS]]
        d, v = np.repeat(np.arange(at, at + len(own)), [len(w) for w in own]), np.concatenate(own)
        spread = np.repeat(begin[v] - np.r_[0, np.cumsum(sizes[v])[:-1]], sizes[v]) + np.arange(sizes[v].sum())
        pairs.append(distinct(np.repeat(d, sizes[v]) * np.int64(FEATURES) + feature[spread])[0])
    del words
    d, v = (np.concatenate([part(p).astype(np.int32) for p in pairs]) for part in (
        lambda p: p // FEATURES, lambda p: p % FEATURES))
    del pairs
    marks = np.zeros(FEATURES, bool)
    marks[toxic_features(d, v, y)] = True
    del d, v, spread
    marked = np.zeros(known, bool)
    np.logical_or.at(marked, owner, marks[feature])
    target = (marked[flat] & (y[doc] == 1)).astype(float)
    pair_target = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(pair_target, (target[inner - 1].astype(int), target[inner].astype(int)), 1)
    # Steps and the first word: relative counts with one added to each.
    smooth = pair_target + 1
    rows = smooth / smooth.sum(axis=1, keepdims=True)
    base = max(target.mean(), 1e-6)
    model.steps = rows / np.array([[1 - base, base]])
    model.bias = float(np.log(base / (1 - base)))
    model.start = 1.0
    seen, seen_b = np.full(FEATURES, 1e-4), 1e-4
    for _ in range(rounds):
        u = model.bias + np.bincount(owner, model.weights[feature], known)
        p = marginals(u[flat], first, model.start, model.steps)
        slope = np.bincount(flat, p - target, known)
        g = np.bincount(feature, slope[owner], FEATURES) + decay * len(flat) * model.weights
        seen += g ** 2
        seen_b += slope.sum() ** 2
        model.weights -= rate * g / np.sqrt(seen)
        model.bias -= 0.2 * rate * slope.sum() / np.sqrt(seen_b)
    u = model.bias + np.bincount(owner, model.weights[feature], known)
    p = marginals(u[flat], first, model.start, model.steps)
    x = aggregate(ends, p)
    scale = np.array([1.0, 4.0, 1.0])
    z, b = x / scale, np.zeros(3)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (weights * q * (1 - q))[:, None]).T @ z + 0.05 * np.eye(3)
        b -= np.linalg.solve(h, z.T @ (weights * (q - y)) + 0.05 * b)
    model.document = b / scale
    model.weights = model.weights.astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, longest: int | None = FIT_CHARS) -> Model:
    """Fit on a bounded sample of labelled documents that are not held out, of at most ``longest`` characters."""
    return fit(*labelled_sample(docs, labels, "toxic", per_class, longest=longest))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD,
             key: str = "doc_id", text: str = "text", longest: int | None = FIT_CHARS) -> DataFrame:
    """``doc_id, held_out, score, predicted, spans`` of every whole text.

    Words are tagged by forward-backward marginals, which are aggregated to the score; spans
    hold start and end (code points, end exclusive) and the largest marginal. Null and empty
    texts have a score and no span; null keys and repeated rows give a row each. The model
    has a fixed size and is broadcast.
    """
    from pyspark.sql import functions as F

    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in slices(batches, "text"):
            scores, spans = model.value.spans(strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32)), pa.array(spans, kind)],
                ["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[key].dataType.simpleString()}, held_out boolean, score double, "
                                "predicted int, spans array<struct<start: int, end: int, p: double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None, per_class: int = PER_CLASS,
               threshold: float = THRESHOLD, longest: int | None = FIT_CHARS) -> DataFrame:
    """The rows, all columns, whose text scores below ``threshold``; ``fit_on`` has the labelled texts."""
    fitted = train(docs if fit_on is None else fit_on, labels, per_class, longest)
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    return kept_rows(docs, lambda texts: model.value.scores(texts) < threshold)
