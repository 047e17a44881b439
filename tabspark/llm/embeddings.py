"""Near-duplicate vectors by spherical-cap filters with structured random product codes."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.scratch import materialise, release
from tabspark.operators.components import connected_components

COSINE = 0.93
# Filters that two vectors at the limit share on average, and vectors of a label that a filter shall hold.
SHARED = 8.0
BUCKET = 256
# The largest share of the sphere that a filter may hold; larger ones would be few and alike.
LARGEST_CAP = 0.03
# Filters that a vector may exceed on average.
MOST_CAPS = 2000
# Filters up to this number are independent; beyond, they are so many product codes with rotations of their own.
# Filters of one product code have words in common, so many pairs that share none stand beside pairs that share many.
ONE_BLOCK = 8192
CODES = 16
# Vectors of fewer dimensions have too little in a block for a product code.
LEAST_PRODUCT = 16
# Vectors that are compared with each other at once; fuller filters are cut into blocks of this size.
BLOCK = 1024
# Full filters up to this number are broadcast (a few bytes each); beyond, they are joined by shuffle.
FULL_FILTERS = 50_000
MARGIN = 1e-9


@functools.lru_cache(maxsize=64)
def _angles(dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles, and the share of the sphere that lies within each of them of a direction; 2 dimensions or more."""
    edges = np.linspace(0, math.pi, 40_001)
    middles = (edges[1:] + edges[:-1]) / 2
    weight = np.exp((dimension - 2) * np.log(np.sin(middles)))
    within = np.r_[0.0, np.cumsum(weight)]
    return edges, within / within[-1]


def cap_height(share: float, dimension: int) -> float:
    """The cosine to its centre at which a cap holds ``share`` of the sphere."""
    edges, within = _angles(dimension)
    first = max(1, int(np.searchsorted(within, share)))
    low, high = within[first - 1], within[first]
    return math.cos(edges[first - 1] + (edges[first] - edges[first - 1]) * (share - low) / (high - low))


def caps_needed(share: float, cosine: float, dimension: int, shared: float = SHARED) -> float:
    """Filters a vector must exceed on average so that two vectors at ``cosine`` share ``shared`` of them.

    For caps that hold ``share`` of the sphere: the chance that a neighbour of a vector in a cap
    lies in it too, by summing over the angles in the cap; infinite if none can. The part of
    the neighbour across the vector is uniform on a sphere of one dimension less.
    """
    t = cap_height(share, dimension)
    angle = (np.arange(4000) + 0.5) / 4000 * math.acos(t)
    weight = np.exp((dimension - 2) * (np.log(np.sin(angle)) - math.log(math.sin(angle[-1]))))
    across = (t - cosine * np.cos(angle)) / (math.sqrt(1 - cosine ** 2) * np.sin(angle))
    edges, within = _angles(dimension - 1)
    both = (weight * np.interp(np.arccos(np.clip(across, -1, 1)), edges, within)).sum()
    return shared * weight.sum() / both if both > 0 else math.inf


def filters_of(dimension: int, most: int, cosine: float = COSINE, shared: float = SHARED,
               bucket: int = BUCKET) -> tuple[float, float] | None:
    """Share of the sphere in a filter and filters of a vector, where the largest label has ``most`` vectors.

    Caps that neighbours seldom share are made larger. None where even the largest would need
    too many, as in few dimensions: all vectors are in one filter then.
    """
    if dimension < 3 or not 0 <= cosine < 1:
        return None
    share = min(LARGEST_CAP, max(1e-8, bucket / most))
    while True:
        caps = caps_needed(share, cosine, dimension, shared)
        if caps <= MOST_CAPS and (dimension >= LEAST_PRODUCT or caps / share <= ONE_BLOCK):
            return share, caps
        if share == LARGEST_CAP:
            return None
        share = min(LARGEST_CAP, 2 * share)


class Code:
    """A random product code: a rotation, then one small random code for each block of coordinates.

    A filter is one code word per block; its direction is their concatenation. A vector
    exceeds a filter when the sum of its block products reaches the threshold. The code is
    made from its seed alone, so every task has the same one.
    """

    def __init__(self, dimension: int, share: float, caps: float, blocks: int = 2, seed: int = 11):
        random = np.random.default_rng(seed)
        self.blocks = max(1, min(blocks, dimension))
        self.rotation = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
        cuts = np.linspace(0, dimension, self.blocks + 1).astype(int)
        self.cuts = list(zip(cuts[:-1], cuts[1:], strict=True))
        # As many filters that ``caps`` of them are exceeded where a cap holds ``share`` of the sphere.
        words = max(2, math.ceil((caps / share) ** (1 / self.blocks)))
        self.words = []
        for a, b in self.cuts:
            w = random.standard_normal((words, b - a))
            norm = np.linalg.norm(w, axis=1, keepdims=True)
            self.words.append(w / norm * math.sqrt((b - a) / dimension))
        self.threshold = cap_height(share, dimension)

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every exceeded filter, by rows of unit vectors.

        Blocks are added one after another; a partial sum is given up when even the best words
        of the blocks left cannot lift it over the threshold. Only filters that a row exceeds
        or nearly exceeds are ever formed.
        """
        turned = unit @ self.rotation
        products = [turned[:, a:b] @ w.T for (a, b), w in zip(self.cuts, self.words, strict=True)]
        best = [p.max(axis=1) for p in products]
        rows = np.arange(len(unit))
        sums, names = np.zeros(len(unit)), np.zeros(len(unit), np.int64)
        for k, p in enumerate(products):
            rest = sum((b for b in best[k + 1:]), np.zeros(len(unit)))
            nxt_rows, nxt_sums, nxt_names = [], [], []
            for at in range(0, len(rows), 4096):
                r = rows[at:at + 4096]
                total = sums[at:at + 4096, None] + p[r]
                i, j = np.nonzero(total + rest[r][:, None] >= self.threshold)
                nxt_rows.append(r[i])
                nxt_sums.append(total[i, j])
                nxt_names.append(names[at:at + 4096][i] * p.shape[1] + j)
            rows, sums, names = map(np.concatenate, (nxt_rows, nxt_sums, nxt_names))
        return rows, names


def codes_of(dimension: int, share: float, caps: float, seed: int = 11) -> list[Code]:
    """One code of independent filters, or several product codes that have the filters together."""
    if caps / share <= ONE_BLOCK:
        return [Code(dimension, share, caps, blocks=1, seed=seed)]
    return [Code(dimension, share, caps / CODES, seed=seed + 1000 * i) for i in range(CODES)]


def exceeded(codes: list[Code], unit: np.ndarray, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every exceeded filter of all codes, by rows of unit vectors."""
    rows, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(unit), step):
        before = 0
        for code in codes:
            r, c = code.decode(unit[at:at + step])
            rows.append(r + at)
            names.append(c + before)
            before += len(code.words[0]) ** code.blocks
    return np.concatenate(rows), np.concatenate(names)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of doubles; null vectors and null components as NaN, short ones padded with NaN."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.full((len(lengths), max(1, width)), np.nan)
    starts = np.cumsum(lengths) - lengths
    for i, (a, n) in enumerate(zip(starts, lengths, strict=True)):
        out[i, :n] = flat[a:a + n]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large and very small components do no harm."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _listed(cosine: float, shared: float, bucket: int, seed: int):
    codes: dict[tuple[int, int], list[Code] | None] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists: list = [None] * part.num_rows
                dims, sizes = part.column("dim").to_numpy(), part.column("most").to_numpy()
                for d, most in sorted(set(zip(dims.tolist(), sizes.tolist(), strict=True))):
                    here = np.flatnonzero((dims == d) & (sizes == most))
                    if (d, most) not in codes:
                        sized = filters_of(d, most, cosine, shared, bucket) if most else None
                        codes[d, most] = codes_of(d, *sized, seed) if sized else None
                    if codes[d, most] is None:
                        for i in here.tolist():
                            lists[i] = [0]
                        continue
                    rows, names = exceeded(codes[d, most], _unit(_matrix(part.column("v").take(pa.array(here)))))
                    order = np.lexsort((names, rows))
                    found = np.split(names[order], np.cumsum(np.bincount(rows, minlength=len(here)))[:-1])
                    for i, x in zip(here.tolist(), found, strict=True):
                        lists[i] = x
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("rep", "label", "dim", "copies", "v")]
                    + [pa.array(lists, pa.list_(pa.int64()))], ["rep", "label", "dim", "copies", "v", "caps"])

    return run


def _shared_before(caps_a: np.ndarray, caps_b: np.ndarray, cap: int, step: int = 4096) -> np.ndarray:
    """Whether two rows of padded, sorted filters share one that comes before ``cap``."""
    out = np.zeros(len(caps_a), bool)
    for at in range(0, len(caps_a), step):
        a, b = caps_a[at:at + step], caps_b[at:at + step]
        a = np.where(a < cap, a, -1)
        out[at:at + step] = ((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def _padded(column: pa.Array) -> np.ndarray:
    counts = column.value_lengths().to_numpy()
    out = np.full((len(counts), max(1, int(counts.max(initial=0)))), -2, np.int64)
    out[np.arange(out.shape[1])[None, :] < counts[:, None]] = column.flatten().to_numpy()
    return out


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that links lead to, after the links ``a - b`` are added."""
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def _verify(cosine: float):
    """Compare the two sides of a block pair; a pair counts at its first common filter only."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cap, i, j = (table.column(c)[0].as_py() for c in ("cap", "i", "j"))
        side, reps, copies = (table.column(c).to_numpy() for c in ("side", "rep", "copies"))
        x = _unit(_matrix(table.column("v").chunk(0)))
        caps = _padded(table.column("caps").chunk(0))
        left = np.flatnonzero(side == 0)
        right = left if i == j else np.flatnonzero(side == 1)
        gained, labels = np.zeros(len(reps), np.int64), np.arange(len(reps))
        for at in range(0, len(left), 256):
            rows = left[at:at + 256]
            a, b = np.nonzero(x[rows] @ x[right].T >= cosine - MARGIN)
            a, b = rows[a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            exact = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
            a, b = a[exact], b[exact]
            if len(a):
                labels = _joined(labels, a, b)
                first = ~_shared_before(caps[a], caps[b], cap)
                a, b = a[first], b[first]
                np.add.at(gained, a, copies[b])
                np.add.at(gained, b, copies[a])
        tied = np.flatnonzero(labels != np.arange(len(reps)))
        hit = np.flatnonzero(gained)
        return pa.table({
            "rep": pa.array(np.r_[reps[hit], reps[tied]], pa.int64()),
            "n": pa.array(np.r_[gained[hit], np.zeros(len(tied), np.int64)], pa.int64()),
            "b": pa.array([None] * len(hit) + reps[labels[tied]].tolist(), pa.int64())})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding",
                 label: str = "label", bucket: int = BUCKET, block: int = BLOCK, shared: float = SHARED,
                 seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors link when their labels are equal and not null and their cosine in double precision is
    at least ``cosine``. Copies of a vector become one with a count. Each remaining vector
    is decoded to the filters it exceeds; vectors meet in filters, pairs are verified exactly, and a
    pair counts in its first common filter. Links below the limit never appear; a pair is
    missed only where it shares no filter (``shared`` on average at the limit, see README for
    the measured recall). The filters of a label are sized by its own vectors, rounded up to a power of two; labels of
    at most ``block`` vectors and vectors of too few dimensions need none: they meet in one filter, and nothing is missed. Full filters are cut into blocks that meet pairwise in
    tasks of their own, so no pair is dropped.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without
    a label or an id, link with nothing. Vectors of different lengths never link. Repeated rows
    count as other vectors; an id repeated with other vectors has the links of all of them.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).alias("v"))
    sound = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0)
             & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
             & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.filter("sound")
    reps = materialise(good.groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                       .withColumn("dim", F.size("v")))
    n = F.col("count")
    sizes = reps.groupBy("label").count().select("label", F.when(n <= block, F.lit(0)).otherwise(
        F.pow(F.lit(2.0), F.ceil(F.log2(n)))).cast("long").alias("most"))
    kind = reps.schema["v"].dataType.simpleString()
    listed = materialise(reps.join(sizes, "label").select("rep", "label", "dim", "copies", "v", "most").mapInArrow(
        _listed(cosine, shared, bucket, seed),
        f"rep long, label long, dim int, copies long, v {kind}, caps array<long>"))
    sizes = listed.select("label", "dim", F.explode("caps").alias("cap")).groupBy("label", "dim", "cap").count()
    full = materialise(sizes.filter(F.col("count") > block).select(
        "label", "dim", "cap", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    n_full = full.count()
    members = listed.withColumn("cap", F.explode("caps"))
    joined = members.join(F.broadcast(full) if n_full <= FULL_FILTERS else full, ["label", "dim", "cap"], "left")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), F.when(own <= k, 0).otherwise(1).alias("side")))
    placed = joined.withColumn("at", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs)))
    met = (placed.select("label", "dim", "cap", "at.i", "at.j", "at.side", "rep", "copies", "v", "caps")
           .groupBy("label", "dim", "cap", "i", "j").applyInArrow(_verify(cosine), "rep long, n long, b long"))
    found = materialise(met)
    release(listed)
    release(full)
    groups = connected_components(reps.select(F.col("rep").alias("id")).distinct(),
                                  found.filter("b is not null").select(F.col("rep").alias("a"), "b"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    named = reps.join(counts, "rep", "left").join(groups, reps["rep"] == groups["id"]).select(
        "label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    linked = good.join(named, ["label", "v"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter(~F.col("sound")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
