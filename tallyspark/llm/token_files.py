"""Token ids in files: an adaptive context-mixing range coder over independent blocks.

Blocks of BLOCK ids are coded each on its own, with a model that starts anew
and a CRC-32 of its ids. An id is known in its block by its place in the
order of first appearance. Three models predict the next one: the id that
last followed the two ids before it (order 2), the one that last followed the
id before it (order 1), and the counts of all ids of the block so far (order
0). A mixture gives every id its probability: of four events (the order-2
prediction is right, else the order-1 one, else an id of the block so far,
else a new one) each model has its own probabilities, those of orders 2 and 1
by how often that context was right lately. These adapt at every id, as do
the weights they are mixed with, which follow how well each model has done.
An id of the block so far is then coded by its count, updated at every id,
and a new one by the counts of RANGES of ids that new ones fell into, then by
its place in the range. All of it goes through one carry-less range coder;
nothing is written beside it. All arithmetic is on integers, so reading
repeats writing exactly.

About LANES blocks of a segment are coded side by side, one numpy lane for each;
how many they are changes nothing in the file. A step costs nearly as much for
few lanes as for many, so no blocks are left over for a call of their own.

A block in a file: MAGIC, number of ids, of code words, CRC-32 (unsigned
32-bit, little-endian), then the code words (unsigned 16-bit). A segment is a
row of a Parquet file: the blocks of consecutive documents with their ids and
lengths; segments are in ascending order of doc_id. Ids must be under 65,536;
a larger one raises ValueError.

Null texts are empty: such a document holds its end id alone. Rows with a null
doc_id come first; rows with the same doc_id are ordered by a hash of their
text and written each for itself. An empty table has no segments and gives no
rows. Other columns than doc_id and text are not read. Memory follows the
size of a segment and, for a text longer than that, the length of the text,
which is tokenized whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved
from tallyspark.llm.tokens import WordEncoder, with_end
from tallyspark.llm.words import freed, portions

#: Ids of a block, 8 to the power of LEVELS.
LEVELS = 4
BLOCK = 8**LEVELS
MAGIC = 0x32425444
HEAD = struct.Struct("<4I")
#: Blocks coded side by side; at most half as many again.
LANES = 1536
#: Ids buffered for a segment, which bounds memory. A shard has about two thirds of them, so that its last blocks
#: share the lanes of the others and are no segment of their own.
SEGMENT_IDS = 3 * LANES * BLOCK
#: Lanes turned at a time between rows of lanes and rows of steps, so that both stay in the cache.
TURNED = 64
#: Bytes of text that make about a shard.
SHARD_BYTES = 32 << 20
LARGEST = 1 << 16
BITS = 12
_TOP, _BOTTOM, _HIGH = np.uint64(1 << 48), np.uint64(1 << 40), np.uint64(48)
_WORD, _LEAST = np.uint64(16), 8
#: What counting a digit adds to running counts before each digit; as rows and as one number a row.
_ADDED = (np.arange(8)[:, None] < np.arange(8)).astype(np.uint16)
_ADDED_ROW = _ADDED.view(np.complex128).ravel()
_STATES, _STATE = np.uint16(3), np.uint16(7)
_HASH = np.int64(40503)
#: Cumulative probabilities of the first three events side by side, FIELD bits each: of FINE bits, with room for a weight of 8.
FIELD, FINE, WEIGHT = 21, 13, 8
#: Ranges of ids: by their number of bits and the two bits after the first.
RANGES = 64


def _fields(*values: int) -> np.uint64:
    return np.uint64(sum(v << (FIELD * k) for k, v in enumerate(values)))


_ONE = (1 << FINE) - 1
_FINE = np.uint64(_ONE)
#: How fast the probabilities adapt, and what an event adds to them: to those at or above it.
_FAST, _KEPT = np.uint64(5), _fields(*[_ONE >> 5] * 3)
_TO = np.array([_fields(*[(_ONE >> 5) * (e <= k) for k in range(3)]) for e in range(4)], np.uint64)
#: Where an event begins and ends among the fields; before the first and after the last there is 0, as in the bit above the fields.
_BEGIN, _END = np.array([3 * FIELD, 0, FIELD, 2 * FIELD], np.uint64), np.array([0, FIELD, 2 * FIELD, 3 * FIELD], np.uint64)
#: From the mixture to frequencies of BITS bits of which each event has _LEAST at least.
_COARSE, _MIXED = np.uint64(FIELD - BITS), _fields(*[(1 << BITS) - 1] * 3)
_CUT, _CUTS, _FLOOR = np.uint64(7), _fields(*[((1 << BITS) - 1) >> 7] * 3), _fields(_LEAST, 2 * _LEAST, 3 * _LEAST)
_FREQ = np.uint64((1 << BITS) - 1)


def _range_starts() -> np.ndarray:
    """The first id of each range and, at the end, the number of ids."""
    starts = [0, 1, 2, 3, *((4 + part) << (bits - 3) for bits in range(3, 17) for part in range(4))]
    return np.array([*starts, *[LARGEST] * (RANGES + 1 - len(starts))], np.int64)


_STARTS = _range_starts()
_RANGE = np.searchsorted(_STARTS[: np.searchsorted(_STARTS, LARGEST)], np.arange(LARGEST), side="right") - 1
_NEW = (np.arange(RANGES)[:, None] <= np.arange(RANGES)).astype(np.uint16)


class Counts:
    """How often each place of each lane occurred: a tree of LEVELS digits of three bits, whose rows
    hold what came before each digit. Eight places share 64 bytes: their row of the tree, the count of
    each, what last followed each and the id of each, so an id takes one line of the processor's
    cache and not four."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.base = self.lane * (BLOCK * 4)
        room = np.zeros(lanes * BLOCK * 4 + 32, np.uint16)
        skip = -room.ctypes.data % 64 // 2
        lines = room[skip : skip + lanes * BLOCK * 4]
        self.own, self.last, self.ids = lines[8:], lines[16:], lines[24:]
        self.before = [*(np.zeros(lanes << (3 * k + 3), np.uint16) for k in range(LEVELS - 1)), lines]
        self.rows = [x.view(np.complex128) for x in self.before]  # a row of eight as one number of 16 bytes

    def at(self, place: np.ndarray) -> np.ndarray:
        """Where a place of each lane is in own, last, ids and the last of before."""
        return self.base + place + (place & -8) * 3

    def go(self, place: np.ndarray) -> np.ndarray:
        """These places are the next that add() counts; gives at() of them."""
        self.place, self.here = place, self.at(place)
        return self.here

    def span(self, place: np.ndarray, lanes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts before the place of each lane and of it, or those of some lanes; these places are the next
        that add() counts."""
        lanes, here = self.lane if lanes is None else lanes, self.go(place)
        here, place = here.take(lanes), place.take(lanes)
        below = self.before[-1].take(here)
        for k, x in enumerate(self.before[:-1]):
            below += x.take((lanes << (3 * k + 3)) + (place >> (3 * (LEVELS - 1 - k))))
        return below.astype(np.uint64), self.own.take(here).astype(np.uint64)

    def find(self, target: np.ndarray, lanes: np.ndarray | None = None) -> np.ndarray:
        """The place whose counts hold the target of each lane, or of some lanes; targets are under a lane's
        total. What is left of each target in its place stays in left."""
        lanes = self.lane if lanes is None else lanes
        at, self.left = lanes, target
        for k, (x, rows) in enumerate(zip(self.before, self.rows)):
            row, next_ = (at << 2, at << 5) if k == LEVELS - 1 else (at, at << 3)
            row = rows.take(row).view(np.uint16).reshape(-1, 8)
            digit = np.bitwise_count((row <= self.left[:, None]).view(np.uint64).ravel()) - np.uint8(1)
            at = next_ + digit
            self.left = self.left - x.take(at)
        at = at - self.base.take(lanes)
        return (at >> 5 << 3) + (at & 7)

    def add(self) -> None:
        self.before[0] += _ADDED_ROW.take(self.place >> (3 * (LEVELS - 1))).view(np.uint16)
        for k in range(1, LEVELS):
            path = self.place >> (3 * (LEVELS - 1 - k))
            row = (self.lane << (3 * k)) + (path >> 3)
            if k == LEVELS - 1:
                row <<= 2
            new = self.rows[k].take(row)
            counts = new.view(np.uint16)
            counts += _ADDED_ROW.take(path & 7).view(np.uint16)
            self.rows[k][row] = new
        self.own[self.here] = self.own.take(self.here) + np.uint16(1)


class Mixer:
    """Probabilities of the four events for a number of lanes; predict() gives them, update() learns.

    A context's entry is the place of its last id, from 1, shifted by three bits, with how sure it
    is in them; those of order 1 are kept beside the counts. The mixture has the cumulative frequencies
    of the first three events in its fields."""

    def __init__(self, lanes: int, counts: Counts | None = None):
        self.counts, lane = counts or Counts(lanes), np.arange(lanes)
        self.base, self.at1 = lane * BLOCK, self.counts.base
        self.states = np.stack([lane << 3, (lanes + lane) << 3])
        self.last = np.zeros(lanes * BLOCK, np.uint16)
        self.key1, self.key2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        # an id of the block so far is likeliest at first
        first = _fields(_ONE // 16, _ONE // 8, _ONE * 13 // 16)
        self.p = np.full(lanes << 4, first)
        self.own = np.full((3, lanes), first)
        self.done = np.full((3, lanes), 1 << (FINE - 2), np.int32)
        self.entry = np.empty((2, lanes), np.uint16)

    def predict(self) -> np.ndarray:
        self.at2 = self.base + ((self.key1 * _HASH + self.key2) & (BLOCK - 1))
        self.entry[0] = self.last.take(self.at2)
        self.entry[1] = self.counts.last.take(self.at1)
        self.sure, self.guess = self.entry & _STATE, self.entry >> _STATES
        self.row = self.states + self.sure
        self.own[:2] = self.p.take(self.row)
        # divisions of whole numbers as IEEE doubles give the same everywhere
        weights = self.done.astype(np.float64)
        weights *= float(1 << WEIGHT) / (weights[0] + weights[1] + weights[2])
        parts = self.own * weights.astype(np.int32).astype(np.uint64)
        mixed = ((parts[0] + parts[1] + parts[2]) >> _COARSE) & _MIXED
        return mixed + (_FLOOR - ((mixed >> _CUT) & _CUTS))

    def update(self, place: np.ndarray, event: np.ndarray) -> None:
        share = ((self.own >> _END.take(event)) - (self.own >> _BEGIN.take(event))) & _FINE
        share = share.astype(np.int32)
        share -= event == 3  # which ends at _ONE, not at 2**FINE
        self.done = (self.done * np.int32(31) + share + np.int32(16)) >> np.int32(5)
        self.own += _TO.take(event) - ((self.own >> _FAST) & _KEPT)
        self.p[self.row] = self.own[:2]
        entry = (place + 1).astype(np.uint16)
        # how sure a context is: one more after a right prediction, 1 after a wrong one
        self.entry = (entry << _STATES) + (np.minimum(self.sure, np.uint16(6)) * (self.guess == entry) + np.uint16(1))
        self.last[self.at2] = self.entry[0]
        self.counts.last[self.at1] = self.entry[1]
        self.key2 = self.key1
        self.key1, self.at1 = place, self.counts.at(place)


class News:
    """Counts of the ranges that new ids fell into; every range has one to start with."""

    def __init__(self, lanes: int):
        self.counts = np.tile(np.arange(1, RANGES + 1, dtype=np.uint16), (lanes, 1))

    def span(self, lanes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts before the range of each lane, of it, and in all."""
        before = np.where(part > 0, self.counts[lanes, part - 1], np.uint16(0)).astype(np.uint64)
        return before, self.counts[lanes, part] - before, self.total(lanes)

    def total(self, lanes: np.ndarray) -> np.ndarray:
        return self.counts[lanes, RANGES - 1].astype(np.uint64)

    def find(self, lanes: np.ndarray, target: np.ndarray) -> np.ndarray:
        return (self.counts[lanes] > target[:, None]).argmax(axis=1)

    def add(self, lanes: np.ndarray, part: np.ndarray) -> None:
        self.counts[lanes] += _NEW[part]


def _bounds(mixed: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where an event begins in the frequencies, and how many it has."""
    start = (mixed >> _BEGIN.take(event)) & _FREQ
    # the last one ends at 2**BITS, which is 0 in as many bits
    return start, ((mixed >> _END.take(event)) - start) & _FREQ


def _shifted(low: np.ndarray, width: np.ndarray, step) -> None:
    """step(lanes, low) for each word that leaves, until no lane is ready: lanes whose top word is
    settled or, where the width is small, must be cut short."""
    at = np.flatnonzero(width < _TOP)  # others can't be ready
    while len(at):
        lo, wide = low[at], width[at]
        settled, narrow = (lo ^ (lo + wide)) < _TOP, wide < _BOTTOM
        if narrow.any():
            wide = np.where(narrow & ~settled, (np.uint64(0) - lo) & (_BOTTOM - np.uint64(1)), wide)
            settled |= narrow
        at, lo, wide = at[settled], lo[settled], wide[settled]
        step(at, lo)
        wide <<= _WORD
        low[at] = lo << _WORD
        width[at] = wide
        at = at[wide < _TOP]


def _appearance(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each id of a block in the order of first appearance, and whether it is new there."""
    _, first, inverse = np.unique(own, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    new = np.zeros(len(own), bool)
    new[first] = True
    return rank[inverse], new


def turned(rows: np.ndarray) -> np.ndarray:
    """The transposed array, in order of its own rows."""
    out = np.empty(rows.shape[::-1], rows.dtype)
    for x in range(0, len(rows), TURNED):
        for y in range(0, len(out), TURNED):
            out[y : y + TURNED, x : x + TURNED] = rows[x : x + TURNED, y : y + TURNED].T
    return out


def side_by_side(blocks: int) -> list[tuple[int, int]]:
    """(first, stop) of the blocks of each call: equal shares of about LANES, or fewer in one call."""
    calls = max(1, (blocks + LANES // 2) // LANES)
    return [(blocks * k // calls, blocks * (k + 1) // calls) for k in range(calls)]


def encoded(ids: np.ndarray) -> bytes:
    """The blocks of an array of ids."""
    if len(ids) and int(ids.max()) >= LARGEST:
        raise ValueError(f"ids must be under {LARGEST}: {int(ids.max())}")
    ids = ids.astype(np.uint16)
    if not len(ids):
        return b""
    return b"".join(x for i, j in side_by_side(-(-len(ids) // BLOCK)) for x in _encoded(ids[i * BLOCK : j * BLOCK]))


def _encoded(ids: np.ndarray) -> list[bytes]:
    n = len(ids)
    lanes, steps = -(-n // BLOCK), min(n, BLOCK)
    table = np.zeros((lanes, steps), np.uint16)  # a short last block is filled up; its length tells
    table.ravel()[:n] = ids
    places, news = np.empty((lanes, steps), np.int16), np.empty((lanes, steps), bool)
    for j in range(lanes):
        places[j], news[j] = _appearance(table[j])
    table, places, news = map(turned, (table, places, news))
    counts, ranges = Counts(lanes), News(lanes)
    mixer = Mixer(lanes, counts)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words = np.zeros((lanes, 3 * BLOCK + 16), np.uint16)
    flat, first = words.ravel(), np.arange(lanes) * words.shape[1]
    count = first.copy()

    def put(ready: np.ndarray, lo: np.ndarray) -> None:
        at = count[ready]
        flat[at] = lo >> _HIGH
        count[ready] = at + 1

    for i in range(steps):
        place = places[i].astype(np.int64)
        mixed = mixer.predict()
        hit2, hit1 = mixer.guess == place + 1
        event = np.where(hit2, 0, np.where(hit1, 1, 2 + news[i]))
        start, part = _bounds(mixed, event)
        unit = width >> np.uint64(BITS)
        low += start * unit
        width = part * unit
        known = np.flatnonzero(event == 2)
        start, part = counts.span(place, known)
        if len(known):
            unit = width[known] // np.uint64(i)
            low[known] += start * unit
            width[known] = part * unit
        at = np.flatnonzero(event == 3)
        if len(at):
            value = table[i, at].astype(np.int64)
            kind = _RANGE[value]
            start, part, total = ranges.span(at, kind)
            unit = width[at] // total
            lo, wd = low[at] + start * unit, part * unit
            unit = wd // (_STARTS[kind + 1] - _STARTS[kind]).astype(np.uint64)
            low[at], width[at] = lo + (value - _STARTS[kind]).astype(np.uint64) * unit, unit
            ranges.add(at, kind)
        _shifted(low, width, put)
        counts.add()
        mixer.update(place, event)
    for k in range(4):  # the rest of low
        flat[count + k] = (low >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)
    count += 4 - first
    out = []
    for j in range(lanes):
        own = ids[j * BLOCK : (j + 1) * BLOCK]
        out += [HEAD.pack(MAGIC, len(own), count[j], zlib.crc32(own.astype("<u4").tobytes())), words[j, : count[j]].astype("<u2").tobytes()]
    return out


def decoded(data: bytes) -> np.ndarray:
    """The ids of blocks in a row; raises ValueError where a block is damaged."""
    at, blocks = 0, []
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError("not a block of token ids")
        magic, n, w, crc = HEAD.unpack_from(data, at)
        at += HEAD.size
        if magic != MAGIC or not 0 < n <= BLOCK or w < 4 or at + 2 * w > len(data):
            raise ValueError("not a block of token ids")
        blocks.append((n, crc, np.frombuffer(data, "<u2", w, at)))
        at += 2 * w
    return np.concatenate([np.zeros(0, np.uint32), *(x for i, j in side_by_side(len(blocks)) if blocks for x in _decoded(blocks[i:j], i))])


def _decoded(blocks: list[tuple], first: int) -> list[np.ndarray]:
    lanes = len(blocks)
    begin = np.cumsum([0, *(len(b[2]) for b in blocks)])[:-1]
    code = np.concatenate([*(b[2] for b in blocks), np.zeros(8, np.uint16)]).astype(np.uint64)
    at_code = begin + 4
    value = (code[begin] << np.uint64(48)) | (code[begin + 1] << np.uint64(32)) | (code[begin + 2] << np.uint64(16)) | code[begin + 3]
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    steps = max(b[0] for b in blocks)
    counts, ranges = Counts(lanes), News(lanes)
    mixer = Mixer(lanes, counts)
    out, distinct = np.zeros((steps, lanes), np.uint16), np.zeros(lanes, np.int64)

    def take(ready: np.ndarray, lo: np.ndarray) -> None:
        at = at_code[ready]
        value[ready] = (value[ready] << _WORD) | code.take(at, mode="clip")
        at_code[ready] = at + 1

    for i in range(steps):
        mixed = mixer.predict()
        unit = width >> np.uint64(BITS)
        off = value - low
        event = (off >= (mixed & _FREQ) * unit).astype(np.int64)
        for k in (1, 2):
            event += off >= ((mixed >> np.uint64(k * FIELD)) & _FREQ) * unit
        start, part = _bounds(mixed, event)
        low += start * unit
        width = part * unit
        place = np.where(event < 2, np.where(event == 0, mixer.guess[0], mixer.guess[1]).astype(np.int64) - 1, distinct)
        known = np.flatnonzero(event == 2) if i else at_code[:0]
        if len(known):
            unit, lo = width[known] // np.uint64(i), low[known]
            target = np.minimum((value[known] - lo) // np.maximum(unit, np.uint64(1)), np.uint64(i - 1)).astype(np.uint16)
            place[known] = counts.find(target, known)
        np.clip(place, 0, BLOCK - 1, out=place)  # for damaged blocks
        here = counts.go(place)
        if len(known):
            low[known] = lo + (target - counts.left) * unit
            width[known] = counts.own.take(here[known]) * unit
        at = np.flatnonzero(event == 3)
        if len(at):
            total = ranges.total(at)
            unit = np.maximum(width[at] // total, np.uint64(1))
            lo = low[at]
            kind = ranges.find(at, np.minimum((value[at] - lo) // unit, total - np.uint64(1)).astype(np.uint16))
            start, part, _ = ranges.span(at, kind)
            lo, wd = lo + start * unit, part * unit
            size = np.maximum(_STARTS[kind + 1] - _STARTS[kind], 1).astype(np.uint64)
            unit = np.maximum(wd // size, np.uint64(1))
            off = np.minimum((value[at] - lo) // unit, size - np.uint64(1))
            low[at], width[at] = lo + off * unit, unit
            counts.ids[here[at]] = _STARTS[kind] + off.astype(np.int64)
            distinct[at] += 1
            ranges.add(at, kind)
        _shifted(low, width, take)
        out[i] = counts.ids.take(here)
        counts.add()
        mixer.update(place, event)
    out = turned(out)
    parts = []
    for j, (n, crc, *_) in enumerate(blocks):
        own = out[j, :n].astype("<u4")
        if zlib.crc32(own) != crc:
            raise ValueError(f"block {first + j} is damaged")
        parts.append(own)
    return parts


def written(docs: DataFrame, vocabulary: str, end_id: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The files as a table: (shard, segment, doc_ids, lengths, n_ids, payload), saved.

    A shard holds about shard_bytes bytes of text whatever the size of the table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, segment = WordEncoder(vocabulary), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[pa.Array] = []
        lengths: list[np.ndarray] = []

        def row() -> pa.RecordBatch:
            nonlocal segment
            ids = np.concatenate(held)
            held.clear()
            segment += 1
            out = [pa.array([shard]), pa.array([segment - 1]), pa.array([pa.concat_arrays(names).to_pylist()], pa.list_(pa.int64())), pa.array([np.concatenate(lengths)]), pa.array([len(ids)]), pa.array([encoded(ids)], pa.binary())]
            names.clear()
            lengths.clear()
            return pa.RecordBatch.from_arrays(out, ["shard", "segment", "doc_ids", "lengths", "n_ids", "payload"])

        for batch in portions(batches, "text"):
            ids, start = with_end(*encoder.encode(batch.column("text")), end_id)
            if int(ids.max()) >= LARGEST:
                raise ValueError(f"ids must be under {LARGEST}: {int(ids.max())}")
            held.append(ids.astype(np.uint16))
            names.append(batch.column("doc_id"))
            lengths.append(np.diff(start))
            if sum(map(len, held)) >= SEGMENT_IDS - SEGMENT_IDS // 16:
                yield row()
        if held:
            yield row()

    size = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    # rows without an id or with the same one are dealt out by what else they hold
    order = [F.asc_nulls_first("doc_id"), F.asc("_text"), F.asc("_row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"), F.xxhash64(F.monotonically_increasing_id()).alias("_row"))
    ordered = rows.repartitionByRange(max(1, -(-int(size) // shard_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return saved(ordered.mapInArrow(freed(write), "shard long, segment long, doc_ids array<long>, lengths array<long>, n_ids long, payload binary"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the ids in the files."""
    # the ids before a segment: those of the shards before and of the segments before in its shard
    sizes = files.select("shard", "segment", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(shards, "shard")
    starts = starts.select("shard", "segment", (F.col("_before") + F.col("_inside")).alias("first"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = memoryview(decoded(batch.column("payload")[r].as_py()).astype("<u4", copy=False)).cast("B")
                size = np.asarray(batch.column("lengths")[r].values, dtype=np.int64)
                end = np.cumsum(size)
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(size.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[r].values, pa.array(batch.column("first")[r].as_py() + end - size), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(starts, ["shard", "segment"]).mapInArrow(freed(back), "doc_id long, start long, n_tokens long, ids_crc32 long")
