"""SimHash near-duplicates with BK-trees over shards of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions.scratch import materialise
from tabspark.llm.common import slices, strings
from tabspark.operators.components import connected_components

RADIUS = 2
WORDS = 3
# Fingerprints that one tree may hold; fuller shards are cut again.
SHARD = 2048


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes.

    Ones are counted in bit planes: plane k holds bit k of 64 counters, one for each place.
    Halves of the array are added plane by plane, so the work is a few operations a hash.
    """
    n = len(hashes)
    if n == 0:
        return 0
    planes = [hashes]
    while len(planes[0]) > 1:
        m = len(planes[0])
        if m % 2:
            planes = [np.append(p, np.uint64(0)) for p in planes]
            m += 1
        left, right = [p[: m // 2] for p in planes], [p[m // 2:] for p in planes]
        carry, total = np.zeros(m // 2, np.uint64), []
        for a, b in zip(left, right, strict=True):
            either = a ^ b
            total.append(either ^ carry)
            carry = (a & b) | (carry & either)
        planes = [*total, carry]
    counts = sum(np.unpackbits(p.astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << k
                 for k, p in enumerate(planes))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the word shingles of a text, A-Z in lower case, words between ASCII blanks.

    Repeated shingles count as often as they occur. A text of fewer words is one shingle, a
    text without words has fingerprint 0. Bits are those set in over half of the XXH64 values.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), 42)
    shingles = map(b" ".join, zip(*[found[i:] for i in range(words)]))
    return _majority(np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(found) - words + 1))


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bits = np.array([fingerprint(x, words) for x in strings(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(bits.view(np.int64))],
                ["doc_id", "digest", "fp"])

    return run


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, digest, fp`` for every row: a hash of the whole text and the 64 bits as a signed integer.

    Null texts are empty.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _digest(text).alias("digest"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, digest long, fp long")


class Tree:
    """A BK-tree: the children of a node are keyed by their Hamming distance to it."""

    def __init__(self):
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, item: int) -> None:
        self.items.append(item)
        self.children.append({})
        new = len(self.items) - 1
        node = 0
        while new and node != new:
            node = self.children[node].setdefault((self.items[node] ^ item).bit_count(), new)

    def within(self, item: int, radius: int) -> list[int]:
        """Positions of the items at a distance of at most ``radius``: only edges within it are followed."""
        found, todo = [], [0] if self.items else []
        items, children = self.items, self.children
        while todo:
            node = todo.pop()
            d = (items[node] ^ item).bit_count()
            if d <= radius:
                found.append(node)
            below = children[node]
            if below:
                for edge in range(max(0, d - radius), d + radius + 1):
                    if edge in below:
                        todo.append(below[edge])
        return found


def _links_in_shard(items: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the items of one shard, each tied to its group's first item."""
    tree, parent = Tree(), list(range(len(items)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, item in enumerate(items):
        for j in tree.within(item, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(item)
    return [(items[i], items[root(i)]) for i in range(len(items)) if root(i) != i]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for shard in batch.column("fps"):
                items = np.sort(np.asarray(shard.values)).view(np.uint64).tolist()
                for x, y in _links_in_shard(items, radius):
                    a.append(x)
                    b.append(y)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)]
            yield pa.RecordBatch.from_arrays(signed, ["a", "b"])

    return run


def _cut(blocks: list[list[int]], radius: int) -> list[tuple[int, list[list[int]]]]:
    """For each way of agreeing in one more block of bits: the mask of that block and the bits left."""
    left = sorted(b for block in blocks for b in block)
    parts = [left[i * len(left) // (radius + 1):(i + 1) * len(left) // (radius + 1)] for i in range(radius + 1)]
    return [(sum(1 << b for b in part), [p for p in parts if p is not part]) for part in parts]


def _masked(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("long"))


def link_forest(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``a, b``: links within the radius that join every two linked fingerprints of ``distinct(fp)``.

    Two fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` blocks
    of bits. The values of a block name the shards, and each shard gets a BK-tree that its
    members are looked up in. Shards of more than ``shard`` fingerprints are cut again by
    blocks of the bits that are left, until at most that many can differ; nothing is dropped.
    Sizes are counted with partial sums, and a table of sized rows is written, so that a full
    shard is neither collected nor sorted in one task.
    """
    links, rest = None, distinct.select("fp", F.lit(0).alias("way"))
    level = [(0, [list(range(64))])]
    while True:
        options = [(mask | extra, left) for mask, blocks in level for extra, left in _cut(blocks, radius)]
        last = all(2 ** sum(map(len, left)) <= shard for _, left in options)
        # A row stays among the rows that agree with it so far: the new mask holds the bits of the old one.
        ways = len(options) // len(level)
        keys = F.array(*[F.struct(F.lit(i).alias("way"), _masked(F.col("fp"), mask).alias("bits"))
                         for i, (mask, _) in enumerate(options)])
        own = keys if len(level) == 1 else F.slice(keys, F.col("way") * ways + 1, F.lit(ways))
        keyed = rest.select("fp", F.explode(own).alias("key")).select("fp", "key.way", "key.bits")
        sizes = keyed.groupBy("way", "bits").agg(F.count("*").alias("n")).filter("n > 1")
        sized = materialise(keyed.join(sizes, ["way", "bits"]))
        small = sized if last else sized.filter(F.col("n") <= shard)
        found = (small.groupBy("way", "bits").agg(F.collect_list("fp").alias("fps")).select("fps")
                 .mapInArrow(_search(radius), "a long, b long"))
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        rest = sized.filter(F.col("n") > shard).select("fp", "way")
        if rest.isEmpty():
            return links
        level = options


def classes(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``fp, component_id, stays``: for each distinct fingerprint its component and the row that stands for it.

    The component is the smallest document id that links lead to. ``stays`` is the smallest
    (doc_id, digest) of the component; rows without an id come last. Copies meet as one
    fingerprint before anything is compared.
    """
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    firsts = materialise(prints.groupBy("fp").agg(F.min(row).alias("first")))
    links = link_forest(firsts.select("fp"), radius, shard)
    groups = connected_components(firsts.select(F.col("fp").alias("id")), links)
    named = materialise(firsts.join(groups, firsts["fp"] == groups["id"]).select("fp", "first", "component"))
    least = named.groupBy("component").agg(F.min("first").alias("stays"))
    return named.join(least, "component").select("fp", F.col("stays.doc_id").alias("component_id"), "stays")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                    radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Fingerprints link at ``radius`` or fewer differing bits; texts without words have
    fingerprint zero and link like any other. The component is the smallest document id
    reachable by links, null where no document of it has an id. Repeated rows stay. The
    texts are read once; fingerprints are written to the shared folder.
    """
    prints = materialise(fingerprints(docs, key, text, words))
    found = classes(prints, radius, shard)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
             radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: the smallest key, once.

    Chosen rows are found by key and a hash of the whole text, so rows that repeat a key
    with another text are told apart; exact repetitions of a row become one. Rows without
    a key stay only where their group has no row with a key.
    """
    prints = materialise(fingerprints(docs, key, text, words))
    stay = classes(prints, radius, shard).select("stays.doc_id", "stays.digest").distinct()
    known, digest = _free(docs, "id"), _free(docs, "digest")
    rows = docs.withColumns({known: F.col(f"`{key}`").cast("long"), digest: _digest(text)})
    kept = rows.join(stay, rows[known].eqNullSafe(stay["doc_id"]) & (rows[digest] == stay["digest"]), "left_semi")
    return kept.dropDuplicates([known, digest]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name
