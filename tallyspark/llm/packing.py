"""Packing documents into sequences by linear grouping, then best fit.

A document of more than CAPACITY tokens is cut into pieces of CAPACITY, the
first of which may be shorter. What decides is the histogram of piece lengths,
at most CAPACITY numbers whatever the size of the corpus:

1. large pieces (over LARGE tokens) are put, by length, into GROUPS groups of
   equal cardinality, and each length is rounded up to its group's largest;
2. configurations, multisets of the few rounded sizes that fill a sequence
   best, are found by a knapsack over what is left of each size and used as
   often as the sizes allow, until no large piece is left;
3. actual pieces take the places of their group's size, which leaves what the
   rounding added;
4. small pieces go, longest first, each into the least remaining room that
   holds it, else into new sequences; this too is planned on the histogram
   of rooms.

A plan is a list of runs: so many sequences get one piece of a group. Pieces
find their places by their rank in their group: ranks are counted within
blocks of documents and shifted by the blocks before, so no group meets in
one task.

Null and empty texts make one piece, the separator id alone. Rows with the
same doc_id and text, and rows with a null doc_id, are packed each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved
from tallyspark.llm.tokens import SpacedEncoder, with_end
from tallyspark.llm.words import freed, portions

CAPACITY = 2048
LARGE = 192
GROUPS = 256


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """(keep.., piece, start, length, ids_crc32) of every piece; keep is doc_id by default."""
    keep = keep or ["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpacedEncoder(vocabulary)
        for batch in portions(batches, "_text"):
            ids, begin = with_end(*encoder.encode(batch.column("_text")), end_id)
            n = np.diff(begin)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * capacity
            start = np.where(number == 0, 0, first[row] + (number - 1) * capacity)
            length = np.where(number == 0, first[row], capacity)
            raw = ids.astype("<u4").tobytes()
            at = (begin[row] + start) * 4
            crc = [zlib.crc32(raw[a : a + 4 * m]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in keep), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], [*keep, "piece", "start", "length", "ids_crc32"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(freed(cut), f"{kinds}, piece int, start long, length long, ids_crc32 long")


def groups(histogram: np.ndarray, large: int = LARGE, number: int = GROUPS) -> np.ndarray:
    """The group size that each length over large is rounded up to, 0 for the others."""
    size = np.zeros(len(histogram), np.int64)
    lengths = np.flatnonzero(histogram)
    lengths = lengths[lengths > large]
    if not len(lengths):
        return size
    rank = np.cumsum(histogram[lengths])
    group = ((rank - 1) * number) // rank[-1]  # of the last piece of each length
    top = {g: int(n) for g, n in zip(group.tolist(), lengths.tolist(), strict=True)}
    size[lengths] = [top[g] for g in group.tolist()]
    return size


def configurations(left: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, sizes) that use up the sizes: the largest left, with the best filling of the rest."""
    left = {s: n for s, n in left.items() if n}
    out = []
    while left:
        largest = max(left)
        room = capacity - largest
        # reach[r]: the size added last on the way to exactly r tokens
        reach = np.zeros(room + 1, np.int64)
        reach[0] = -1
        for s in sorted((s for s in left if s <= room), reverse=True):
            for _ in range(min(left[s] - (s == largest), room // s)):
                new = np.flatnonzero((reach[s:] == 0) & (reach[: room + 1 - s] != 0))
                if not len(new):
                    break
                reach[new + s] = s
        fill, sizes = int(np.flatnonzero(reach)[-1]), [largest]
        while fill:
            sizes.append(int(reach[fill]))
            fill -= int(reach[fill])
        need = {s: sizes.count(s) for s in set(sizes)}
        if any(left[s] < k for s, k in need.items()):  # a way back that uses a size too often
            sizes, need = [largest], {largest: 1}
        times = min(left[s] // k for s, k in need.items())
        out.append((times, sizes))
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return out


def best_fit(rooms: np.ndarray, small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, list[int]]]]:
    """Small pieces, longest first, into the least room that holds them.

    rooms[r] is how many sequences have room r. Gives moves (room, length, count) in the order
    they are made, and the new sequences as (times, lengths)."""
    rooms, moves, fresh = rooms.copy(), [], {}
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            at = np.flatnonzero(rooms[length:])
            if not len(at):
                break
            room = length + int(at[0])
            each = room // length  # the same room can take several of the same length
            count = min(n, int(rooms[room]))
            if count * each > n and each > 1:
                each = max(1, n // count)
            for k in range(each):
                moves.append((room - k * length, length, count))
            rooms[room] -= count
            rooms[room - each * length] += count
            n -= count * each
        if n:
            fresh[length] = n
    return moves, configurations(fresh, capacity)


def _ranked(rows: DataFrame, group: Column, blocks: int) -> DataFrame:
    """rows with rank, from 0, within the group; no window holds more than a block of a group."""
    rows = rows.withColumn("_g", group).withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(blocks)))
    inner = Window.partitionBy("_g", "_b").orderBy(F.desc("length"), "_id", "piece")
    counts = rows.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    ranked = rows.withColumn("_r", F.row_number().over(inner) - 1)
    return ranked.join(shifts, ["_g", "_b"]).withColumn("rank", F.col("_r") + F.col("_shift")).drop("_r", "_shift", "_b")


def _placed(rows: DataFrame, runs: list[tuple[int, int, int, int]]) -> DataFrame:
    """rows (_g, rank) with the sequence of their run (group, first rank, count, first sequence)."""
    spark = rows.sparkSession
    plan: dict[int, list[tuple[int, int, int]]] = {}
    for g, first, count, sequence in runs:
        plan.setdefault(g, []).append((first, count, sequence))
    known = {g: tuple(np.array(c) for c in zip(*sorted(own), strict=True)) for g, own in plan.items()}
    shared = spark.sparkContext.broadcast(known)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, rank = (batch.column(c).to_numpy() for c in ("_g", "rank"))
            sequence = np.full(len(group), -1)
            for g in np.unique(group):
                of = np.flatnonzero(group == g)
                first, _, base = shared.value[int(g)]
                at = np.searchsorted(first, rank[of], side="right") - 1
                sequence[of] = base[at] + rank[of] - first[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence)], [*batch.schema.names, "sequence_id"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(place, f"{kinds}, sequence_id long")


def _histogram(rows: DataFrame, column: str, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).collect():
        out[r[column]] = r["n"]
    return out


def packed(cut: DataFrame, keep: list[str], capacity: int = CAPACITY, large: int = LARGE, number: int = GROUPS, block_rows: int = 4096) -> DataFrame:
    """Saved pieces (keep.., piece, length, ..) with sequence_id and offset."""
    cut = cut.withColumn("_id", F.struct(*[F.col(c) for c in keep if dict(cut.dtypes)[c] in ("bigint", "int", "string")], "start", "ids_crc32"))
    histogram = _histogram(cut, "length", capacity + 1)
    blocks = max(1, int(histogram.sum()) // block_rows)
    size = groups(histogram, large, number)
    left: dict[int, int] = {}
    for length in np.flatnonzero(size):
        left[int(size[length])] = left.get(int(size[length]), 0) + int(histogram[length])
    used: dict[int, int] = {}
    runs, sequence = [], 0
    for times, sizes in configurations(left, capacity):
        for s in sizes:
            runs.append((s, used.get(s, 0), times, sequence))
            used[s] = used.get(s, 0) + times
        sequence += times
    rounded = F.try_element_at(F.array(*[F.lit(int(s)) for s in size]), (F.col("length") + 1).cast("int"))
    big = _placed(_ranked(cut.filter(rounded > 0), rounded.cast("long"), blocks), runs)
    big = saved(big.drop("_g", "rank"), "packed-large")

    # what is left of each sequence, and the rank of the sequences that have the same room
    filled = big.groupBy("sequence_id").agg(F.sum("length").alias("_sum"))
    rooms = filled.select("sequence_id", (F.lit(capacity) - F.col("_sum")).cast("long").alias("length"), F.lit(0).alias("piece"), F.struct("sequence_id").alias("_id"))
    rooms = saved(_ranked(rooms, F.col("length"), blocks).select("sequence_id", F.col("length").alias("room"), "rank"), "packed-rooms")
    small = {int(n): int(histogram[n]) for n in np.flatnonzero(histogram) if not size[n]}
    by_room = _histogram(rooms, "room", capacity + 1)
    moves, fresh = best_fit(by_room, small, capacity)

    # follow the sequences through the moves, as intervals of equal room: (room first had, first rank, count)
    many = {int(r): int(n) for r, n in enumerate(by_room) if n}
    waiting = {r: [[r, 0, n]] for r, n in many.items()}
    taken: dict[int, int] = {}
    targets = []  # (length, first rank of the pieces, count, room first had, first rank of the sequences)
    for room, length, count in moves:
        while count:
            room0, first, n = waiting[room].pop()
            k = min(n, count)
            if n > k:
                waiting[room].append([room0, first + k, n - k])
            waiting.setdefault(room - length, []).append([room0, first, k])
            targets.append((length, taken.get(length, 0), k, room0, first))
            taken[length] = taken.get(length, 0) + k
            count -= k
    # a number for each (room, rank): their place in the list of rooms
    base, total = {}, 0
    for r, n in many.items():
        base[r] = total
        total += n
    runs = [(length, first, k, base[room0] + rank0) for length, first, k, room0, rank0 in targets]
    new = total
    for times, sizes in fresh:
        for s in sizes:
            runs.append((s, taken.get(s, 0), times, new))
            taken[s] = taken.get(s, 0) + times
        new += times
    little = _placed(_ranked(cut.filter(rounded <= 0), F.col("length"), blocks), runs).withColumnRenamed("sequence_id", "_slot").drop("_g", "rank")
    shift = F.create_map(*[F.lit(int(v)).cast("long") for r, b in base.items() for v in (r, b)]) if base else F.create_map(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    named = rooms.select("sequence_id", (F.try_element_at(shift, F.col("room")) + F.col("rank")).alias("_slot"))
    little = little.join(named, "_slot", "left").withColumn("sequence_id", F.coalesce("sequence_id", F.col("_slot") - total + sequence)).drop("_slot")
    every = big.unionByName(little)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")).drop("_id")
