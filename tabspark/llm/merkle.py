"""Merkle manifest of a table by time-forward processing: a digest for every document, source and the whole."""

from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabspark.functions.columns import col
from tabspark.functions.scratch import materialise
from tabspark.llm.sql import digits_crc32_sql

FAN = 3
# Levels that one task climbs: a task holds the FAN ** LEVELS nodes below one node, the rest of
# the queue lies in tables sorted by label.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, idx long, n long, digest string"
# What a node passes to its children beside the digests: the same for all nodes of a tree.
_PASSED = ("subroot", "root")
_PROVEN = "tree string, idx long, proof string, places string, subroot string, root string"
_AUDITED = ("tree string, key long, leaf string, subroot string, root string, proof string, proof_sha256 string, "
            "folded_root string")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of a row: each field as its length in UTF-8 bytes, a colon and the value, or ``-`` for null."""
    texts = [c.cast("string") for c in columns.values()]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_of(n: int, fan: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


def climb(digests: list[str], levels: int, fan: int = FAN) -> tuple[str, dict[int, list[str]]]:
    """Root of the nodes below one node, and the children that each inner node was sent.

    A node's label is its level and its place there, so every message goes to a label ahead.
    The queue holds the messages under way; the smallest label is next, and when it comes up
    all its children have reported, in their order.
    """
    width = len(digests) + 1
    queue = [(width + i // fan, i, d) for i, d in enumerate(digests)] if levels else []
    heapify(queue)
    sent: dict[int, list[str]] = {}
    root = digests[0]
    while queue:
        label = queue[0][0]
        own = sent[label] = []
        while queue and queue[0][0] == label:
            own.append(heappop(queue)[2])
        root = sha256("".join(own))
        level, place = divmod(label, width)
        if level < levels:
            heappush(queue, ((level + 1) * width + place // fan, place, root))
    return root, sent


def descend(n: int, levels: int, sent: dict[int, list[str]], proof: str, places: str,
            fan: int = FAN) -> list[tuple[str, str]]:
    """Proof of each of the ``n`` nodes, from that of the node above them: the sweep in reverse.

    Every node passes to each child the digests of the others and its own proof after them.
    ``places`` has two digits a level, the child's place and the size of its run.
    """
    width = n + 1
    queue = [(-levels * width, proof, places)]
    found = [(proof, places)] * n
    while queue:
        label, proof, places = heappop(queue)
        level, place = divmod(-label, width)
        if level == 0:
            found[place] = (proof, places)
            continue
        run = sent[-label]
        for k in range(len(run)):
            others = "".join(run[:k] + run[k + 1:])
            heappush(queue, (-((level - 1) * width + place * fan + k), others + proof, f"{k}{len(run)}{places}"))
    return found


def fold(digest: str, proof: str, places: str) -> str:
    """The root that a leaf and a proof lead to."""
    at = 0
    for i in range(0, len(places), 2):
        place, size = int(places[i]), int(places[i + 1])
        middle, at_end = at + 64 * place, at + 64 * (size - 1)
        digest = sha256(proof[at:middle] + digest + proof[middle:at_end])
        at = at_end
    return digest


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add idx, a row's place among those of its tree (nulls first), and n, how many there are.

    Rows are cut into ranges and numbered there; a small table of the rows before each range and tree
    is joined. A tree of any size is spread over many ranges.
    """
    by = [col(c).asc_nulls_first() for c in (tree, *order)]
    ranges = materialise(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    runs = ranges.groupBy(part.alias("part"), col(tree).alias("run_tree")).agg(
        F.count("*").alias("rows"), F.min("at").alias("first"))
    whole = Window.partitionBy("run_tree")
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("rows").over(whole))
    found = ranges.join(runs, (part == F.col("part")) & col(tree).eqNullSafe(F.col("run_tree")))
    idx = F.col("at") - F.col("first") + F.col("before")
    return found.select(*[col(c) for c in df.columns], idx.alias("idx"), "n")


def _height(n: int, fan: int, levels: int) -> int:
    """Levels to climb from a block of a tree with ``n`` nodes."""
    return levels if n > fan ** levels else levels_of(n, fan)


def _up(fan: int, levels: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        n = table.column("n")[0].as_py()
        root, _ = climb(table.column("digest").to_pylist(), _height(n, fan, levels), fan)
        return pa.table({"tree": table.column("tree")[:1], "idx": pa.array([table.column("idx")[0].as_py() // fan ** levels]),
                         "n": pa.array([-(-n // fan ** levels)]), "digest": pa.array([root])})

    return run


def _block(fan: int, levels: int) -> Column:
    return F.expr(f"idx div {fan ** levels}").alias("block")


def _proofs(table: pa.Table, fan: int, levels: int) -> tuple[pa.Table, list[tuple[str, str]], dict[str, pa.Array]]:
    """Nodes of a block in order, their proofs, and what their tree passes on."""
    # The message for the node above the block comes first: its idx is -1.
    table = table.sort_by("idx")
    proof, places = (table.column(c)[0].as_py() for c in ("proof", "places"))
    nodes = table.slice(1)
    height = _height(nodes.column("n")[0].as_py(), fan, levels)
    _, sent = climb(nodes.column("digest").to_pylist(), height, fan)
    passed = {c: pa.array([table.column(c)[0].as_py()] * len(nodes), pa.string()) for c in _PASSED}
    return nodes, descend(len(nodes), height, sent, proof, places, fan), passed


def _down(fan: int, levels: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, found, passed = _proofs(table, fan, levels)
        return pa.table({"tree": nodes.column("tree"), "idx": nodes.column("idx"),
                         "proof": pa.array([p for p, _ in found], pa.string()),
                         "places": pa.array([p for _, p in found], pa.string()), **passed})

    return run


def _audit(fan: int, levels: int):
    def run(table: pa.Table) -> pa.Table:
        nodes, found, passed = _proofs(table, fan, levels)
        now = nodes.column("now").to_pylist()
        roots = [fold(leaf, *proof) for leaf, proof in zip(now, found, strict=True)]
        return pa.table({"tree": nodes.column("tree"), "key": nodes.column("key"), "leaf": nodes.column("digest"), **passed,
                         "proof": pa.array([p for p, _ in found], pa.string()),
                         "proof_sha256": pa.array([sha256(p) for p, _ in found], pa.string()),
                         "folded_root": pa.array(roots, pa.string())})

    return run


def climb_trees(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """Tables of nodes (tree, idx, n, digest) at heights 0, ``levels``, 2 * ``levels`` ..., the last with the roots.

    A task climbs ``levels`` levels above a block of nodes; what it has for nodes beyond, one
    digest, waits in the table of the next height until the task of that block comes.
    """
    tables = [nodes.select("tree", "idx", "n", "digest")]
    while (tables[-1].agg(F.max("n")).first()[0] or 1) > 1:
        blocks = tables[-1].select("*", _block(fan, levels)).groupBy("tree", "block")
        tables.append(materialise(blocks.applyInArrow(_up(fan, levels), _NODE)))
    return tables


def _deliver(nodes: DataFrame, above: DataFrame, run, schema: str, fan: int, levels: int) -> DataFrame:
    """Bring each block of nodes the message of the node above it."""
    message = above.select("tree", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), "proof", "places",
                           *_PASSED)
    both = nodes.withColumn("block", _block(fan, levels)).unionByName(message, allowMissingColumns=True)
    return both.groupBy("tree", "block").applyInArrow(run(fan, levels), schema)


def descend_trees(tables: list[DataFrame], above: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """The messages for the blocks of height 0, from those of the roots (tree, idx, proof, places, subroot, root)."""
    for nodes in reversed(tables[1:-1]):
        above = materialise(_deliver(nodes, above, _down, _PROVEN, fan, levels))
    return above


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, tree: str = "source", key: str = "doc_id",
             fields: tuple[str, ...] = FIELDS, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Digests and proofs of all rows, and whether the rows as ``altered`` still lead to the root.

    A leaf is the digest of a row's ``fields``. The leaves of a tree ascend by key; ``fan``
    neighbours (nine at most) become one node, the last run may be shorter, until one is left, the subroot.
    Subroots, in order of their tree, likewise become the root. A row for each document:
    doc_id (the key), source (the tree), leaf, subroot, root, proof (digests of the siblings from the leaf to
    the root), proof_sha256, folded_root (from the leaf of the altered row and the proof) and
    verified (folded_root is the root). ``altered`` names the columns that changed since.

    Null keys and trees come first, equal keys ascend by their leaf; every row, repeated ones
    too, is a leaf of its own. An empty table gives no rows. Other columns do not matter. No
    task holds more than ``fan ** levels`` nodes; trees of any size are cut into such blocks.
    Only the root and the largest number of nodes reach the driver.
    """
    columns = {c: col(c) for c in fields}
    rows = docs.select(
        col(key).cast("long").alias("key"), col(tree).cast("string").alias("tree"),
        leaf_digest(columns).alias("digest"), leaf_digest(columns | (altered or {})).alias("now"))
    leaves = materialise(numbered(materialise(rows), "tree", ["key", "digest"]))
    heights = climb_trees(leaves, fan, levels)
    # The subroots are the leaves of one more tree.
    subroots = heights[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = materialise(numbered(subroots, "tree", ["name"]))
    crowns = climb_trees(tops, fan, levels)
    root = crowns[-1].first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _AUDITED).select(*_audited())
    begin = crowns[-1].select("tree", "idx", F.lit("").alias("proof"), F.lit("").alias("places"),
                              F.lit("").alias("subroot"), F.lit(root["digest"]).alias("root"))
    above = materialise(_deliver(tops, descend_trees(crowns, begin, fan, levels), _crown, _PROVEN, fan, levels))
    return _deliver(leaves, descend_trees(heights, above, fan, levels), _audit, _AUDITED, fan, levels).select(
        *_audited())


def _crown(fan: int, levels: int):
    """Proofs of the subroots, as messages for their own trees."""

    def run(table: pa.Table) -> pa.Table:
        nodes, found, passed = _proofs(table, fan, levels)
        return pa.table({"tree": nodes.column("name"), "idx": pa.array([0] * len(nodes), pa.int64()),
                         "proof": pa.array([p for p, _ in found], pa.string()),
                         "places": pa.array([p for _, p in found], pa.string()),
                         **passed, "subroot": nodes.column("digest")})

    return run


def _audited() -> list:
    return [F.col("key").alias("doc_id"), F.col("tree").alias("source"), "leaf", "subroot", "root", "proof", "proof_sha256",
            "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")]


def oracle() -> str:
    """The manifest in SQL: levels, runs and folds by recursion over whole tables."""
    def field(name: str) -> str:
        value = f"CAST({name} AS VARCHAR)"
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def levels(name: str, first: str) -> str:
        return f"""{name} AS (
  SELECT tree, 0 AS level, i, n, digest FROM {first}
  UNION ALL
  SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i))
  FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n),
{name}_runs AS (
  SELECT tree, level, i // 3 AS run, list(digest ORDER BY i) AS members FROM {name} WHERE n > 1
  GROUP BY tree, level, i // 3)"""

    def walk(name: str, nodes: str, first: str) -> str:
        others = "array_to_string(list_concat(members[1:i % 3], members[i % 3 + 2:]), '')"
        whole = "array_to_string(list_concat(list_concat(members[1:i % 3], [now]), members[i % 3 + 2:]), '')"
        return f"""{name} AS (
  SELECT r, tree, 0 AS level, i, now, proof FROM {first}
  UNION ALL
  SELECT r, w.tree, w.level + 1, i // 3, sha256({whole}), proof || {others}
  FROM {name} w JOIN {nodes}_runs u ON w.tree IS NOT DISTINCT FROM u.tree AND w.level = u.level AND i // 3 = u.run),
{name}_end AS (SELECT r, tree, now, proof FROM {name} QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)"""

    return f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS r, doc_id, source AS tree, {leaf("text")} AS digest,
    CASE WHEN ({digits_crc32_sql("doc_id")}) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS now
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n, '' AS proof FROM l),
{levels("nodes", "leaves")},
tops AS (
  SELECT tree AS name, '' AS tree, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
{levels("crowns", "tops")},
{walk("low", "nodes", "leaves")},
high_start AS (
  SELECT r, '' AS tree, t.i, now, proof FROM low_end e JOIN tops t ON e.tree IS NOT DISTINCT FROM t.name),
{walk("high", "crowns", "high_start")}
SELECT doc_id, leaves.digest AS leaf, tops.digest AS subroot, c.digest AS root, sha256(e.proof) AS proof_sha256,
  e.now AS folded_root, e.now = c.digest AS verified
FROM leaves JOIN tops ON leaves.tree IS NOT DISTINCT FROM tops.name JOIN high_end e USING (r), crowns c WHERE c.n = 1
"""
