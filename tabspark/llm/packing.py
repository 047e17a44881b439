"""First-fit-decreasing packing with a tournament tree of bin capacities, in random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import slices
from tabspark.llm.encoding import encoder

LENGTH = 2048
# Pieces that are packed together; a group that holds more is packed in parts of this size.
GROUP_PIECES = 4096
# Bytes of ids that a task reads.
PARTITION_BYTES = 64 << 20
# Bytes of text that a full piece stands for, to choose the number of groups.
BYTES_PER_TOKEN = 3
PIECE = "struct<doc_id: long, start: long, length: long, offset: long, doc_tokens: long>"
# Tokens are little-endian unsigned 32-bit integers. Sequences that a task hands on at once.
SEQUENCES = f"sequence_id long, tokens binary, padding int, pieces array<{PIECE}>"
HANDED_ON = 256


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions of the pieces of each bin: longest piece first, into the first bin with room.

    The tree is an array of maxima over pairs of bins. A piece walks from the root to the
    leftmost leaf that has room, and the maxima above that leaf are renewed: two walks of
    logarithmic length for each piece. Ties keep their order.
    """
    n = len(lengths)
    size = 1
    while size < n:
        size *= 2
    tree = [capacity] * (2 * size)
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        if node - size == len(bins):
            bins.append([])
        bins[node - size].append(i)
        tree[node] -= need
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins


def _pieces(tokenizer: str, end_id: int, capacity: int, groups: int, seed: int, kind: str):
    """Cut documents into pieces of at most ``capacity`` ids, each with a random group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode_all, np.array([end_id], kind).tobytes()
        part, nameless = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, counts = encode(batch.column("text"))
            data, width = memoryview(ids.astype(kind).tobytes()), np.dtype(kind).itemsize
            stops = (np.cumsum(counts) * width).tolist()
            doc, start, group, total, pieces = [], [], [], [], []
            for key, first, stop in zip(batch.column("doc_id").to_pylist(), [0, *stops], stops, strict=False):
                whole = bytes(data[first:stop]) + end
                place = ""
                if key is None:
                    # Rows without an id may all be alike, so their place in the task sets them apart.
                    nameless += 1
                    place = f"{part} {nameless}"
                for at in range(0, len(whole), capacity * width):
                    piece = whole[at:at + capacity * width]
                    doc.append(key)
                    start.append(at // width)
                    total.append(len(whole) // width)
                    pieces.append(piece)
                    # By key, place and content: the same row goes to the same group in every run.
                    name = f"{seed} {key} {place} {at} {zlib.crc32(piece)}"
                    group.append(zlib.crc32(name.encode()) % groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int32()), pa.array(doc, pa.int64()), pa.array(start, pa.int64()),
                 pa.array(total, pa.int64()), pa.array(pieces, pa.binary())],
                ["grp", "doc_id", "start", "doc_tokens", "ids"])

    return run


def _pack(capacity: int, kind: str, most: int):
    width = np.dtype(kind).itemsize

    def sequences(rows: list[tuple], first: int) -> pa.RecordBatch:
        bins = first_fit_decreasing(np.array([len(r[4]) // width for r in rows]), capacity)
        tokens, counts, pieces = [], [], []
        for members in bins:
            offset, parts, held = 0, [], []
            for i in members:
                _, doc, start, total, ids = rows[i]
                n = len(ids) // width
                parts.append({"doc_id": doc, "start": start, "length": n, "offset": offset, "doc_tokens": total})
                held.append(ids)
                offset += n
            tokens.append(np.frombuffer(b"".join(held), kind).astype("<u4").tobytes())
            counts.append(offset)
            pieces.append(parts)
        fields = [(c, pa.int64()) for c in ("doc_id", "start", "length", "offset", "doc_tokens")]
        return pa.RecordBatch.from_arrays(
            [pa.array(range(first, first + len(bins)), pa.int64()),
             pa.array(tokens, pa.binary()),
             pa.array([capacity - n for n in counts], pa.int32()),
             pa.array(pieces, pa.list_(pa.struct(fields)))],
            ["sequence_id", "tokens", "padding", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, made = None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("grp", "doc_id", "start", "doc_tokens", "ids")]
            for row in zip(*columns, strict=True):
                if held and (row[0] != group or len(held) >= most):
                    out = sequences(held, (group << 32) + made)
                    made += out.num_rows
                    held = []
                    yield from (out.slice(i, HANDED_ON) for i in range(0, out.num_rows, HANDED_ON))
                if row[0] != group:
                    group, made = row[0], 0
                held.append(row)
        if held:
            out = sequences(held, (group << 32) + made)
            yield from (out.slice(i, HANDED_ON) for i in range(0, out.num_rows, HANDED_ON))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end_id: int = 1, seed: int = 7,
         group_pieces: int = GROUP_PIECES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids with little padding.

    Every document becomes its ids followed by ``end_id`` and is cut into pieces of
    ``capacity`` ids and a rest. Pieces are dealt to random groups; each group is packed by
    :func:`first_fit_decreasing`. Result, a row per sequence: sequence_id, tokens (binary,
    little-endian unsigned 32-bit, unpadded; ``padding`` tells what is missing to ``capacity``) and pieces (doc_id, start in the
    document, length, offset in the sequence, doc_tokens), gapless from offset 0.

    Null texts are empty documents (only the end id), null keys and repeated rows are kept,
    an empty table gives no sequence. A task holds one group at a time, and a group that
    has grown beyond ``group_pieces`` is packed in parts, so memory is bounded.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    pieces = (n or 0) + (size or 0) / (BYTES_PER_TOKEN * capacity)
    groups = max(1, min(1 << 30, round(pieces / (0.9 * group_pieces))))
    kind = "<u4" if encoder(tokenizer).wide else "<u2"
    cut = rows.mapInArrow(_pieces(tokenizer, end_id, capacity, groups, seed, kind),
                          "grp int, doc_id long, start long, doc_tokens long, ids binary")
    # Ids are about half as large as the texts; more partitions than the session's own only where they would grow.
    parts = (size or 0) // (2 * PARTITION_BYTES)
    wide = parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(parts, "grp") if wide else cut.repartition("grp")
    dealt = dealt.sortWithinPartitions("grp", "doc_id", "start")
    return dealt.mapInArrow(_pack(capacity, kind, group_pieces), SEQUENCES)


def piece_digests(sequences: DataFrame) -> DataFrame:
    """A row per piece with the checksum of its ids as they lie in the packed sequence."""
    rows = sequences.select("sequence_id", "tokens", F.explode("pieces").alias("p"))
    ids = F.substring("tokens", (4 * F.col("p.offset") + 1).cast("int"), (4 * F.col("p.length")).cast("int"))
    return rows.select("p.doc_id", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "p.doc_tokens",
                       "sequence_id", "p.offset")
