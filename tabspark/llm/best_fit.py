"""Best-fit-decreasing packing whose bin counts are certified by dual feasible functions."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.functions.scratch import materialise
from tabspark.llm.common import slices
from tabspark.llm.encoding import encoder

LENGTH = 4096
# Pieces that are packed together.
GROUP_PIECES = 4096
# Groups, of some MB each, that a task reads.
GROUPS_A_TASK = 8
# Times that groups exchange the documents of bins with room.
ROUNDS = 8
# A certified group gives up one of so many bins, the loosest.
LOOSEST = 16
# Stair functions that a bound tries.
STAIRS = 16
PIECE = "struct<doc_id: long, piece: int, start: long, length: long, offset: long>"
SEQUENCES = f"sequence_id long, tokens binary, padding int, pieces array<{PIECE}>"
_FIELDS = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("offset", pa.int64())])
# A bin on its way: at first one piece, tokens in the width of the vocabulary.
_BINS = f"grp long, bin long, tokens binary, pieces array<{PIECE}>"
_PACKED = f"bin long, tokens binary, pieces array<{PIECE}>, loose boolean, round int, grp long, part int, n_bins int, bound int"
HANDED_ON = 256
# Bytes of text that a full piece stands for, to choose the number of groups.
BYTES_PER_TOKEN = 4


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and the room left in each bin: longest first, into the fullest bin with room.

    Bins with equal room are alike, so they wait in one stack for each room; the rooms that
    occur are a sorted list of at most ``capacity`` numbers.
    """
    places = np.empty(len(lengths), np.int64)
    rooms: list[int] = []
    stacks: dict[int, list[int]] = {}
    left: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect_left(rooms, need)
        if at == len(rooms):
            home, room = len(left), capacity
            left.append(capacity)
        else:
            room = rooms[at]
            stack = stacks[room]
            home = stack.pop()
            if not stack:
                del rooms[at], stacks[room]
        places[i] = home
        room -= need
        left[home] = room
        if room:
            if room not in stacks:
                stacks[room] = []
                insort(rooms, room)
            stacks[room].append(home)
    return places, np.array(left, np.int64)


def lower_bound(counts: np.ndarray, capacity: int, stairs: int = STAIRS) -> int:
    """No packing needs fewer bins than this; ``counts[w]`` pieces have length ``w``, up to ``capacity``.

    A dual feasible function f maps lengths so that any lengths that fit into one bin have
    values that sum to 1 at most; the sum of all values then bounds the bins. Tried are the
    identity and the stairs u(k) for k up to ``stairs`` (x stays where (k+1)x is whole, else
    floor((k+1)x)/k), each after every threshold function (above 1-t counts as 1, below t as
    0). Whole numbers throughout, so the bound is exact.
    """
    lengths = np.arange(capacity + 1, dtype=np.int64)
    counts = np.asarray(counts, np.int64)
    limits = np.arange(0, capacity // 2 + 1)
    number = np.r_[0, np.cumsum(counts)]
    # Above capacity - t, and between t and capacity - t, both ends included.
    large = number[-1] - number[capacity - limits + 1]
    best = 0
    for k in range(0, stairs + 1):
        if k == 0:
            values, unit = lengths, capacity
        else:
            steps = (k + 1) * lengths
            values, unit = np.where(steps % capacity == 0, k * lengths, capacity * (steps // capacity)), k * capacity
        sums = np.r_[0, np.cumsum(counts * values)]
        middle = sums[capacity - limits + 1] - sums[limits]
        best = max(best, int(np.max(-(-(unit * large + middle) // unit))))
    return best


def _cut(tokenizer: str, end_id: int, capacity: int, groups: int, seed: int, kind: str):
    """Documents as pieces, each a bin of its own, with a random group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer).encode_all, np.array([end_id], kind).tobytes()
        width, task, nameless = np.dtype(kind).itemsize, TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            ids, counts = encode(batch.column("text"))
            data, stops = memoryview(ids.astype(kind).tobytes()), (np.cumsum(counts) * width).tolist()
            rows, tokens, group = [], [], []
            keys = batch.column("doc_id").to_pylist()
            for key, first, stop in zip(keys, [0, *stops], stops, strict=False):
                whole = bytes(data[first:stop]) + end
                place = ""
                if key is None:
                    # Rows without an id may all be alike, so their place in the task sets them apart.
                    nameless += 1
                    place = f"{task} {nameless}"
                for n, at in enumerate(range(0, len(whole), capacity * width)):
                    piece = whole[at:at + capacity * width]
                    rows.append((key, n, at // width, len(piece) // width, 0))
                    tokens.append(piece)
                    # By key, place and content: the same row goes to the same group in every run.
                    group.append(zlib.crc32(f"{seed} {key} {place} {n} {zlib.crc32(piece)}".encode()) % groups)
            fields = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
            pieces = pa.StructArray.from_arrays(fields, fields=list(_FIELDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group, pa.int64()), pa.array(np.full(len(rows), -1)), pa.array(tokens, pa.binary()),
                 pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32), pieces)],
                ["grp", "bin", "tokens", "pieces"])

    return run


def _repack(rows: list[tuple], capacity: int, width: int, first_name: int, last: bool):
    """Pack the pieces of some bins anew, keep the bins unless there are fewer new ones, and certify the count."""
    pieces = [(p, tokens[p["offset"] * width:(p["offset"] + p["length"]) * width]) for _, tokens, own in rows for p in own]
    lengths = np.array([p["length"] for p, _ in pieces], np.int64)
    places, room = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    if rows[0][0] >= 0 and len(room) >= len(rows):
        packed = rows
        room = np.array([capacity - len(tokens) // width for _, tokens, _ in rows])
    else:
        members: list[list] = [[] for _ in room]
        for (piece, ids), home in zip(pieces, places.tolist(), strict=True):
            members[home].append((piece, ids))
        packed = []
        for home, own in enumerate(members):
            at, placed = 0, []
            for piece, _ in own:
                placed.append(piece | {"offset": at})
                at += piece["length"]
            packed.append((first_name + home, b"".join(ids for _, ids in own), placed))
    loose = np.zeros(len(room), bool)
    if not last and len(room) > bound:
        loose = room > 0
    elif not last:
        # Certified for itself; its loosest bins may still be saved by other groups.
        loose[np.argsort(-room, kind="stable")[:max(1, len(room) // LOOSEST)]] = True
        loose &= room > 0
    return packed, loose, bound


def _pack(capacity: int, kind: str, number: int, most: int, last: bool):
    """One round: a task holds one group, or ``most`` bins of a group that has grown beyond."""
    width = np.dtype(kind).itemsize

    def written(rows: list[tuple], group: int, part: int, made: int) -> tuple[int, list[pa.RecordBatch]]:
        packed, loose, bound = _repack(rows, capacity, width, (number << 58) + (group << 24) + made, last)
        n = len(packed)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in packed], pa.int64()), pa.array([t for _, t, _ in packed], pa.binary()),
             pa.array([p for _, _, p in packed], pa.list_(_FIELDS)), pa.array(loose),
             pa.array(np.full(n, number, np.int32)), pa.array(np.full(n, group)), pa.array(np.full(n, part, np.int32)),
             pa.array(np.full(n, n, np.int32)), pa.array(np.full(n, bound, np.int32))],
            ["bin", "tokens", "pieces", "loose", "round", "grp", "part", "n_bins", "bound"])
        return made + n, [batch.slice(i, HANDED_ON) for i in range(0, n, HANDED_ON)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group, part, made = None, 0, 0
        for batch in batches:
            for at, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "bin", "tokens", "pieces")), strict=True):
                if held and (at != group or len(held) >= 2 * most):
                    made, out = written(held, group, part, made)
                    yield from out
                    held, part = [], part + 1
                if at != group:
                    group, part, made = at, 0, 0
                held.append(tuple(row))
        if held:
            yield from written(held, group, part, made)[1]

    return run


def _widened(capacity: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(x, kind).astype("<u4") for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bin"), pa.array([x.tobytes() for x in tokens], pa.binary()),
                 pa.array([capacity - len(x) for x in tokens], pa.int32()), batch.column("pieces")],
                ["sequence_id", "tokens", "padding", "pieces"])

    return run


def exchange(dealt: DataFrame, kind: str, groups: int, capacity: int = LENGTH, group_pieces: int = GROUP_PIECES,
             rounds: int = ROUNDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Pack dealt bins of one piece each; sequences, and the certificates of all groups and rounds.

    Each group is packed best-fit decreasing, and its count is certified if it equals the
    group's :func:`lower_bound`. Groups with a gap then give up all bins with room, certified
    groups their loosest ones; these bins are dealt, whole, to fewer groups and packed again,
    and a group keeps what it was given unless it needs fewer bins now. That ends when one
    group was left, when all bins together are at the bound of the whole table, when a round
    saved nothing, or after ``rounds``. With certified groups what moves falls about tenfold
    each time, so the ids are shuffled little more than once.

    Certificates: round, grp, part, n_pieces, n_bins, bound. Only counts by length
    (``capacity`` of them at most) and totals reach the driver.
    """
    tables: list[DataFrame] = []
    least = before = None
    for number in range(rounds):
        last = groups == 1 or number == rounds - 1
        own = F.col("pieces")[0]
        # More partitions than the session's own only where each would hold more than some groups.
        parts = groups // GROUPS_A_TASK
        wide = parts > int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        grouped = dealt.repartition(parts, "grp") if wide else dealt.repartition("grp")
        ordered = grouped.sortWithinPartitions("grp", own["doc_id"], own["start"], "bin")
        packed = materialise(ordered.mapInArrow(_pack(capacity, kind, number, group_pieces, last), _PACKED))
        tables.append(packed)
        if last:
            break
        if least is None:
            counts = np.zeros(capacity + 1, np.int64)
            for r in packed.select(F.explode("pieces.length").alias("n")).groupBy("n").count().collect():
                counts[r["n"]] = r["count"]
            least = lower_bound(counts, capacity)
        held = packed.agg(F.count("*").alias("all"), F.count_if("loose").alias("loose"),
                          F.sum(F.when(F.col("loose"), F.size("pieces"))).alias("pieces")).first()
        total = held["all"] if before is None else before["total"] - before["loose"] + held["all"]
        if not held["loose"] or total <= least or before and total == before["total"]:
            break
        before = {"total": total, "loose": held["loose"]}
        groups = -(-held["pieces"] // group_pieces)
        grp = F.pmod(F.xxhash64("bin", F.lit(seed + number)), F.lit(groups)).alias("grp")
        dealt = packed.filter("loose").select(grp, "bin", "tokens", "pieces")
    # What a round let go is in the next round's table; the last round holds the rest.
    kept = reduce(DataFrame.unionByName, [t.filter("not loose") for t in tables[:-1]] + [tables[-1]])
    sequences = kept.select("bin", "tokens", "pieces").mapInArrow(_widened(capacity, kind), SEQUENCES)
    certificates = reduce(DataFrame.unionByName, tables).groupBy("round", "grp", "part").agg(
        F.sum(F.size("pieces")).alias("n_pieces"), F.max("n_bins").alias("n_bins"), F.max("bound").alias("bound"))
    return sequences, certificates


def pack_best_fit(docs: DataFrame, tokenizer: str, capacity: int = LENGTH, end_id: int = 1,
                  group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS, seed: int = 7,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids; only longer ones are cut.

    Every document becomes its ids followed by ``end_id``; longer ones are cut into pieces of
    ``capacity`` ids and a rest. Pieces are dealt to random groups of about ``group_pieces``
    and packed by :func:`exchange`. A row per sequence: sequence_id, tokens (binary,
    little-endian unsigned 32-bit), padding (what is missing to ``capacity``) and pieces
    (doc_id, piece, start in the document, length, offset in the sequence), gapless from
    offset 0.

    Null texts are empty documents (only the end id), null keys and repeated rows are kept,
    an empty table gives no sequence; other columns do not matter. A group that has grown
    beyond twice ``group_pieces`` is packed in parts, so memory is bounded.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    groups = max(1, min(1 << 30, round(((n or 0) + (size or 0) / (BYTES_PER_TOKEN * capacity)) / group_pieces)))
    kind = "<u4" if encoder(tokenizer).wide else "<u2"
    dealt = rows.mapInArrow(_cut(tokenizer, end_id, capacity, groups, seed, kind), _BINS)
    return exchange(dealt, kind, groups, capacity, group_pieces, rounds, seed)[0]


def piece_digests(sequences: DataFrame) -> DataFrame:
    """A row per piece with the checksum of its ids as they lie in the packed sequence."""
    rows = sequences.select("sequence_id", "tokens", F.explode("pieces").alias("p"))
    ids = F.substring("tokens", (4 * F.col("p.offset") + 1).cast("int"), (4 * F.col("p.length")).cast("int"))
    return rows.select("p.doc_id", "p.piece", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "sequence_id",
                       "p.offset")
