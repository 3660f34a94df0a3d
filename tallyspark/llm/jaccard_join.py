"""Exact n-gram Jaccard self-join in the metric space of shingle sets.

The Jaccard distance is a metric; two texts link at a distance of at most
R = 1 - THRESHOLD. Copies with equal sets are one point from the start.

1. Cells. The first pivots are single shingles in an order that puts shingles
   known to be frequent last. A set's own cell is that of its first shingle;
   a set within R of it can begin no later than at place n - ceil(T n), so a
   set is replicated into the cells of its first n - ceil(T n) + 1 shingles,
   and linked sets share a cell for certain. Sets joined by cells form a
   region, and every link lies within a region.
2. Regions. Pivots are now sets: one pivot at the middle of the region, the
   others where the region isn't decided. Distances to a pivot link what is
   within R; what the pivot's component doesn't reach is made pivot in turn.
   A pair inside the component of the first pivot needs no comparison, every
   other pair is compared or ruled out by the triangle inequality, as
   distances to a common pivot that differ by more than R exclude a link.
3. A region of more than SMALL sets is not given to one task. It is divided
   into the Voronoi cells of several pivots, sets that aren't decided are
   replicated into the cells within their triangle windows, and each cell is
   joined on its own.

The order of shingles only steers the work; the result is exact in any order.

Null and empty texts have no shingles, link with nothing and are their own
component. A text with fewer words than N has its whole sequence as its one
shingle. Rows with the same text are copies of each other; rows with a null
doc_id take part but give no component its name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import HUBS, components, with_hubs
from tallyspark.llm.tables import saved
from tallyspark.llm.words import SPACED, freed, portions, windows, word_hashes

N = 5
#: Sets link when HUNDRED * intersection >= PERCENT * union.
PERCENT, HUNDRED = 75, 100
SMALL = 160
#: Cells of more sets than this give no pairs.
CELL = 32
#: Shingles of cells of more sets than this come later in the order when the cells are made anew, so that the
#: pairs of a cell, which grow with its square, stay few. It only steers, as any order is exact.
FULL = 8
CHUNK = 64
PIVOTS = 16
ROUNDS = 2
#: A shingle that this many sets of one task share counts as frequent there.
LOCAL_FREQUENT = 3
#: At most so many frequent shingles are broadcast; beyond, less frequent ones keep their place in the order.
MAX_FREQUENT = 500_000
TASK_SHINGLES = 2_000_000
#: Entries of cells that a task gathers before it gives them out.
ENTRIES = 500_000
BUCKET_ENTRIES = 400_000
BROADCAST_IDS = 500_000


def flat_sets(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of each text's distinct shingles in one flat array, and where each text's begin."""
    h, starts = word_hashes(texts, SPACED)
    runs = windows(h, n)
    words = np.diff(starts)
    size = np.where(words < n, np.minimum(words, 1), words - n + 1)
    begin = np.concatenate([[0], np.cumsum(size)])
    whole = np.flatnonzero(size)
    # the places of each text's runs; a text of fewer than n words has one, the hash of all
    out = np.empty(int(begin[-1]), np.uint64)
    for i, a, z, w in zip(whole.tolist(), begin[whole].tolist(), begin[whole + 1].tolist(), starts[whole].tolist(), strict=True):
        own = out[a:z]
        if words[i] >= n:
            own[:] = runs[w : w + z - a]
            own.sort()
        else:
            own[:] = windows(h[w : w + words[i]], int(words[i]))
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[whole]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[begin]


def shingle_sets(texts: pa.Array, n: int = N) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles; copies, as a view would keep the whole portion."""
    flat, begin = flat_sets(texts, n)
    return [flat[a:z].copy() for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def node(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def linked(common: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
    return HUNDRED * common >= PERCENT * (a + b - common)


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // HUNDRED) + 1


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """Saved rows of two kinds: the texts of one task with equal sets (key, n_shingles, doc_ids;
    key null for texts without words) and shingles frequent in one task (shingle, sets)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes | None, list] = {}
        sets: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            flat.sort()
            edge = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]])) if len(flat) else np.zeros(1, np.int64)
            count = np.diff(edge)
            often = count >= LOCAL_FREQUENT
            shingle, times = flat[edge[:-1][often]].view(np.int64), count[often]
            keys = list(held)
            blank = len(times)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*keys, *[None] * blank], pa.binary()),
                    pa.array([*(held[k][0] for k in keys), *[None] * blank], pa.int64()),
                    pa.array([*(held[k][1] for k in keys), *[None] * blank], pa.list_(pa.int64())),
                    pa.array([*[None] * len(keys), *shingle.tolist()], pa.int64()),
                    pa.array([*[None] * len(keys), *times.tolist()], pa.int64()),
                ],
                ["key", "n_shingles", "doc_ids", "shingle", "sets"],
            )
            held.clear()
            sets.clear()
            return out

        for batch in portions(batches, "_text"):
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("_text"), n), strict=True):
                key = set_key(s) if len(s) else None
                if key in held:
                    held[key][1].append(doc)
                    size += 1
                else:
                    held[key] = [len(s), [doc]]
                    sets.append(s)
                    size += len(s)
            if size >= TASK_SHINGLES:
                size = 0
                yield rows()
        yield rows()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return saved(source.mapInArrow(freed(scan), "key binary, n_shingles long, doc_ids array<long>, shingle long, sets long"), "jaccard-classes")


def cells(docs: DataFrame, frequent: np.ndarray, buckets: int, pairs: bool, n: int = N) -> DataFrame:
    """What the cells hold. frequent: shingles in descending order of frequency.

    frequent and a hold the first 32 bits of shingles and sets are told apart by 8 bits
    where they only steer. Without pairs: (a, b) with a the shingle and b the number of
    sets of each cell of more than FULL sets. With pairs: (a, b, cells, n_a, n_b) for
    every pair of nodes in cells of at most CELL sets whose sizes n_a and n_b allow a
    link, with the number of those they share (in one bucket; to be summed), and with
    cells null for the nodes of larger ones, each with the least. Entries travel packed
    by bucket, so Spark moves few large rows."""
    place = np.argsort(frequent)
    known, rank = frequent[place], place
    maybe = np.zeros(1 << 20, bool)
    maybe[(known >> np.uint64(12)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((known, rank, maybe))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, maybe = shared.value
        seen: set[bytes] = set()
        entries: list[np.ndarray] = []
        owners: list[tuple[int, int, int]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            cell, held = np.concatenate(entries), np.array(owners, np.int64).reshape(-1, 3)
            owner, large = (np.repeat(held[:, i], held[:, 2]) for i in (0, 1))
            bucket = ((cell * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            packed = [cell[order], owner[order], large[order].astype(np.uint32)] if pairs else [(cell[order] >> np.uint64(32)).astype(np.uint32), owner[order].astype(np.uint8)]
            full = [b for b in range(buckets) if edge[b + 1] > edge[b]]
            entries.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([b"".join(x[edge[b] : edge[b + 1]].tobytes() for x in packed) for b in full], pa.binary())], ["bucket", "entries"])

        for batch in portions(batches, "_text"):
            flat, begin = flat_sets(batch.column("_text"), n)
            order = flat >> np.uint64(1)
            if len(known):
                some = np.flatnonzero(maybe[(flat >> np.uint64(44)).astype(np.int64)])
                begins = flat[some] >> np.uint64(32)
                at = np.minimum(np.searchsorted(known, begins), len(known) - 1)
                hit = known[at] == begins
                # frequent ones last, the most frequent at the very end
                order[some[hit]] = np.uint64(1 << 63) + ((len(known) - rank[at[hit]]).astype(np.uint64) << np.uint64(32)) + (flat[some[hit]] & np.uint64(0xFFFFFFFF))
            for a, z in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if a == z:
                    continue
                s = flat[a:z]
                key = set_key(s)
                if key in seen:
                    continue
                seen.add(key)
                k = prefix_size(z - a)
                entries.append(s[np.argpartition(order[a:z], k - 1)[:k]] if k < z - a else s.copy())
                owners.append((node(key), z - a, k))
                size += k
            if size >= ENTRIES:
                size = 0
                yield rows()
        if entries:
            yield rows()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, e in zip(batch.column("bucket").to_pylist(), batch.column("entries").to_pylist(), strict=True):
                held.setdefault(b, []).append(e)
        width = [8, 8, 4] if pairs else [4, 1]
        kinds = [np.int64, np.int64, np.uint32] if pairs else [np.uint32, np.uint8]
        for parts in held.values():
            counts = [len(e) // sum(width) for e in parts]
            read = [np.concatenate([np.frombuffer(e, kind, c, c * at) for e, c in zip(parts, counts, strict=True)]) for kind, at in zip(kinds, np.cumsum([0, *width[:-1]]).tolist(), strict=True)]
            order = np.lexsort((read[1], read[0]))
            read = [x[order] for x in read]
            cell, owner = read[0], read[1]
            once = np.concatenate([[True], (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])])
            cell, owner = cell[once], owner[once]
            begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.append(begin, len(cell)))
            large = np.flatnonzero(size > (CELL if pairs else FULL))
            if not pairs:
                if len(large):
                    yield out(cell[begin[large]], size[large])
                continue
            n, found = read[2][once].astype(np.int64), []
            for m in range(2, CELL + 1):
                of = begin[size == m]
                if len(of):
                    i, j = np.triu_indices(m, 1)
                    i, j = (of[:, None] + i).ravel(), (of[:, None] + j).ravel()
                    fits = PERCENT * np.maximum(n[i], n[j]) <= HUNDRED * np.minimum(n[i], n[j])
                    found.append(np.stack([owner[i[fits]], owner[j[fits]], n[i[fits]], n[j[fits]]], axis=1))
            if found:
                pair = np.concatenate(found)
                pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                edge = np.flatnonzero(np.concatenate([[True], (pair[1:, :2] != pair[:-1, :2]).any(axis=1)])) if len(pair) else np.zeros(0, np.int64)
                yield out(pair[edge, 0], pair[edge, 1], np.diff(np.append(edge, len(pair))), pair[edge, 2], pair[edge, 3])
            if len(large):
                star = np.concatenate([np.stack([owner[begin[c] + 1 : begin[c] + size[c]], np.full(size[c] - 1, owner[begin[c]])], axis=1) for c in large])
                star = np.unique(star, axis=0)
                yield out(star[:, 0], star[:, 1], None, None, None)

    names = ["a", "b", "cells", "n_a", "n_b"] if pairs else ["a", "b"]

    def out(*columns: np.ndarray | None) -> pa.RecordBatch:
        rows = len(columns[0])
        return pa.RecordBatch.from_arrays([pa.nulls(rows, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in columns], names)

    source = docs.select(F.col("text").cast("binary").alias("_text"))
    packed = source.mapInArrow(freed(enter), "bucket int, entries binary")
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(freed(meet), ", ".join(f"{x} long" for x in names))


def candidate_edges(found: DataFrame) -> DataFrame:
    """(a, b) of the pairs that the shared cells leave possible.

    Of two sets with c common shingles among their first ones, the one whose first
    ones end earlier has no common ones but those and what comes after its first
    ones. Pairs of nodes of large cells, whose pairs aren't counted there, are kept."""
    stars = found.filter("cells is null").select("a", "b").distinct()
    pairs = found.filter("cells is not null").groupBy("a", "b").agg(F.sum("cells").alias("c"), F.min("n_a").alias("n_a"), F.min("n_b").alias("n_b"))
    most = F.col("c") + F.greatest(*[F.col(f"n_{x}") - _prefix_column(F.col(f"n_{x}")) for x in "ab"])
    enough = HUNDRED * most >= PERCENT * (F.col("n_a") + F.col("n_b") - most)
    possible = pairs.filter(enough).select("a", "b").unionByName(stars)
    if stars.limit(1).count():
        crowded = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        rest = pairs.filter(~enough).select("a", "b")
        for side in ("a", "b"):
            rest = rest.join(crowded.select(F.col("node").alias(side)), side, "left_semi")
        possible = possible.unionByName(rest)
    return possible


def _prefix_column(n):
    return n - F.ceil(PERCENT * n / HUNDRED) + 1


class Sets:
    """Some sets with their shingles numbered; intersections of one with all are one lookup."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        values, self.flat = np.unique(flat, return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(len(values), np.int32)
        self.shared = np.bincount(self.flat, minlength=len(values))

    def common(self, i: int) -> np.ndarray:
        own = self.flat[self.begin[i] : self.begin[i + 1]]
        self.mark[own] = 1
        out = np.add.reduceat(self.mark[self.flat], self.begin[:-1])
        self.mark[own] = 0
        return out

    def middle(self) -> int:
        """The set whose shingles most others share."""
        return int(np.add.reduceat(self.shared[self.flat], self.begin[:-1]).argmax())


def joined(sets: list[np.ndarray]) -> np.ndarray:
    """The component, as the number of one of its sets, of each set of a region that fits a task."""
    n = len(sets)
    label = np.arange(n)
    if n < 2:
        return label
    all_ = Sets(sets)
    first = all_.middle()
    far = np.full(n, np.nan)  # distance to the first pivot
    for i in [first, *(j for j in range(n) if j != first)]:
        if i != first and label[i] == label[first]:
            continue
        other = np.flatnonzero(label != label[i])
        if i != first:
            other = other[np.abs(far[other] - far[i]) <= 1 - PERCENT / HUNDRED + 1e-9]
        if not len(other):
            continue
        common = all_.common(i)
        if i == first:
            far = 1 - common / (all_.size + all_.size[i] - common)
        link = other[linked(common[other], int(all_.size[i]), all_.size[other])]
        for old in np.unique(label[link]):
            label[label == old] = label[i]
    return label


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """work() for each run of rows with the same keys; the rows come sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        first = 0
        while first < len(names):
            stop = first + 1
            while stop < len(names) and names[stop] == names[first]:
                stop += 1
            if held and names[first] != last:
                yield from work(_whole(held))
                held = []
            held.append(batch.slice(first, stop - first))
            last, first = names[first], stop
    if held:
        yield from work(_whole(held))


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def small_regions(members: DataFrame, parts: int) -> DataFrame:
    """(node, component) of the members (region, node, shingles) of regions that fit a task."""

    def solve(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes = np.array(group.column("node").to_pylist(), dtype=np.int64)
        label = joined(_sets(group.column("shingles")))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])

    dealt = members.repartition(parts, "region").sortWithinPartitions("region")
    return dealt.mapInArrow(lambda b: _grouped(b, ["region"], solve), "node long, component long")


def _compared(members: DataFrame, pivots: DataFrame, parts: int, profile: bool) -> DataFrame:
    """What comparing every pivot with every member of its chunk shows, both as rows of
    (region, chunk, node, component, shingles).

    (a, b) are links between components, a spanning forest of those found in a chunk, and
    with profile there is (node, far) of each member with its distance to each pivot. Members
    of one component need no comparison, and no chunk gives more links than it has components."""
    kinds = ["region", "chunk", "node", "component", "shingles"]
    rows = members.select(*kinds, F.lit(False).alias("pivot")).unionByName(pivots.select(*kinds, F.lit(True).alias("pivot")))

    def solve(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = Sets(_sets(group.column("shingles")))
        nodes, component = (np.array(group.column(c).to_pylist(), dtype=np.int64) for c in ("node", "component"))
        pivot = np.array(group.column("pivot").to_pylist(), dtype=bool)
        names, label = np.unique(component, return_inverse=True)
        plain, far, links = np.flatnonzero(~pivot), [], []
        for i in np.flatnonzero(pivot):
            if not profile and (label[plain] == label[i]).all():
                continue
            common = sets.common(int(i))[plain]
            if profile:
                far.append(1 - common / (sets.size[i] + sets.size[plain] - common))
            for other in np.unique(label[plain[linked(common, int(sets.size[i]), sets.size[plain])]]):
                if other != label[i]:
                    links.append((int(names[other]), int(names[label[i]])))
                    label[label == other] = label[i]
        members_ = nodes[plain].tolist() if profile else []
        ids = nodes[pivot].tolist()
        distances = [list(zip(ids, own, strict=True)) for own in np.stack(far, axis=1).tolist()] if far else [[] for _ in members_]
        blank = [None] * len(links)
        out = [
            pa.array([*members_, *blank], pa.int64()),
            pa.array([*(distances if profile else []), *blank], pa.map_(pa.int64(), pa.float64())),
            *(pa.array([*[None] * len(members_), *(x[k] for x in links)], pa.int64()) for k in (0, 1)),
        ]
        yield pa.RecordBatch.from_arrays(out, ["node", "far", "a", "b"])

    dealt = rows.repartition(parts, "region", "chunk").sortWithinPartitions("region", "chunk")
    return dealt.mapInArrow(lambda b: _grouped(b, ["region", "chunk"], solve), "node long, far map<long,double>, a long, b long")


def _relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (region, node, component) after joining the components that the links connect."""
    new = components(links).select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return saved(label.join(new, "component", "left").select("region", "node", F.coalesce("_new", "component").alias("component")), "jaccard-labels")


def _cores(label: DataFrame) -> DataFrame:
    """(region, core, most): the component that holds most of each region, and how many sets it has."""
    sizes = label.groupBy("region", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("region").agg(F.max_by("component", F.struct("n", "component")).alias("core"), F.max("n").alias("most"))


def large_regions(members: DataFrame, parts: int) -> DataFrame:
    """(node, component) of the members (region, node, shingles, sets) of regions of more than SMALL sets."""
    radius = 1 - PERCENT / HUNDRED + 1e-9
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("sets") / CHUNK))
    members = saved(members.withColumn("chunk", chunk), "jaccard-members")
    label = members.select("region", "node", F.col("node").alias("component"))
    profile = None
    for round_ in range(ROUNDS):
        # pivots: sets outside the component that holds most of the region, least hash first
        outside = label.join(_cores(label), "region").filter((F.col("component") != F.col("core")) | (F.col("most") == 1))
        now = members.join(label, ["region", "node"])
        chosen = now.join(_least_hashed(outside, round_), ["region", "node"], "left_semi")
        spread = chosen.drop("chunk").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("sets") / CHUNK) - 1)))
        found = saved(_compared(now, spread, parts, round_ == 0), "jaccard-distances")
        if round_ == 0:
            profile = found.filter("node is not null").select("node", "far")
        label = _relabelled(label, found.filter("a is not null").select("a", "b"))

    # Voronoi cells of the first pivots, in chunks; what isn't in the core is replicated into the chunks within its windows
    placed = members.drop("chunk").join(profile, "node").join(label, ["region", "node"]).join(_cores(label).drop("most"), "region")
    nearest = F.array_min(F.transform(F.map_entries("far"), lambda e: F.struct(e["value"].alias("d"), e["key"].alias("p"))))["p"]
    placed = placed.withColumn("cell", nearest)
    many = placed.groupBy("region", "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    placed = placed.join(many, ["region", "cell"]).withColumn("chunk", F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.ceil(F.col("in_cell") / CHUNK))))
    placed = saved(placed.select("region", "chunk", "node", "component", "shingles", "far", (F.col("component") != F.col("core")).alias("open")), "jaccard-cells")
    each = placed.select("region", "chunk", F.explode("far").alias("p", "d")).groupBy("region", "chunk", "p").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    windows_ = each.groupBy("region", "chunk").agg(F.map_from_entries(F.collect_list(F.struct("p", F.struct("lo", "hi").alias("w")))).alias("w"))
    undecided = placed.filter("open").select("region", "node", "component", "shingles", "far")
    reach = undecided.join(windows_, "region").filter(
        F.forall(F.map_entries("far"), lambda e: (e["value"] >= F.element_at("w", e["key"])["lo"] - radius) & (e["value"] <= F.element_at("w", e["key"])["hi"] + radius))
    )
    last = _compared(placed, reach.select("region", "chunk", "node", "component", "shingles"), parts, False)
    return _relabelled(label, saved(last.select("a", "b"), "jaccard-links")).select("node", "component")


def _least_hashed(rows: DataFrame, seed: int) -> DataFrame:
    """(region, node) of about PIVOTS nodes of each region, one at least: those under a share of the hashes."""
    rows = rows.withColumn("_unit", F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 30)) / float(1 << 30))
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("_n"), F.min("_unit").alias("_least"))
    return rows.join(sizes, "region").filter((F.col("_unit") * F.col("_n") < PIVOTS) | (F.col("_unit") == F.col("_least"))).select("region", "node")


def clustered(docs: DataFrame, n: int = N) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return _clustered(docs, n).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _clustered(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, n_shingles, component_id) of every document; component_id is null where no id is known."""
    spark = docs.sparkSession
    rows = classes(docs, n)
    local = rows.filter("doc_ids is not null").select("key", "n_shingles", "doc_ids")
    often = rows.filter("shingle is not null").groupBy(F.shiftrightunsigned("shingle", 32).alias("shingle")).agg(F.sum("sets").alias("sets")).orderBy(F.desc("sets"), "shingle").limit(MAX_FREQUENT).select("shingle").toArrow()
    frequent = np.asarray(often.column(0).combine_chunks(), dtype=np.int64).astype(np.uint64)
    entries = local.filter("key is not null").agg(F.sum(F.floor(F.col("n_shingles") / 4) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // BUCKET_ENTRIES))
    reps = local.filter("key is not null").groupBy("key").agg(F.min(F.array_min("doc_ids")).alias("rep"), F.first("n_shingles").alias("n_shingles"))
    first8 = F.concat(*[F.substring(F.hex("key"), 15 - 2 * i, 2) for i in range(8)])
    known = saved(reps.withColumn("node", F.conv(first8, 16, -10).cast("long")), "jaccard-keys")
    # the shingles of cells found crowded join the frequent ones, and the cells are made anew
    crowded = cells(docs, frequent, buckets, False, n).groupBy("a").agg(F.max("b").alias("b")).orderBy(F.desc("b"), "a").limit(MAX_FREQUENT).select("a").toArrow()
    more = np.asarray(crowded.column(0).combine_chunks(), dtype=np.int64).astype(np.uint64)
    frequent = np.concatenate([frequent, more[~np.isin(more, frequent)]])
    found = saved(cells(docs, frequent, buckets, True, n), "jaccard-cells")
    edges = saved(candidate_edges(found), "jaccard-edges")

    regions = saved(components(edges).select("node", F.col("component").alias("region")), "jaccard-regions")
    sizes = saved(regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")).withColumn("sets", F.col("n")), "jaccard-sizes")
    wanted = saved(with_hubs(known.join(regions, "node"), sizes, "region", regions.count() / HUBS).select("region", "node", "rep", "sets"), "jaccard-wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("_text"))
    some = F.broadcast(wanted.filter("rep is not null")) if wanted.count() <= BROADCAST_IDS else wanted.filter("rep is not null")
    whole = texts.join(some, "rep").select("region", "node", "sets", "_text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows with the same id may hold other texts, which are other nodes
        for batch in portions(batches, "_text"):
            sets = shingle_sets(batch.column("_text"), n)
            own = [node(set_key(s)) if len(s) else None for s in sets]
            keep = pa.array([a is not None and b in (a, None) for a, b in zip(own, batch.column("node").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("region"), pa.array(own, pa.int64()), batch.column("sets"), pa.array([s.tobytes() for s in sets], pa.binary())], ["region", "node", "sets", "shingles"])
            yield out.filter(keep)

    kinds = "region long, node long, sets long, shingles binary"
    members = whole.mapInArrow(freed(shingled), kinds)
    if wanted.filter("rep is null").limit(1).count():
        # texts that only rows without an id hold are found by their shingles
        nameless = texts.filter("rep is null").select(F.lit(0).cast("long").alias("region"), F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("sets"), "_text").mapInArrow(freed(shingled), kinds)
        members = members.unionByName(nameless.select("node", "shingles").join(wanted.filter("rep is null").select("region", "node", "sets"), "node").select("region", "node", "sets", "shingles"))
    members = saved(members.dropDuplicates(["node"]), "jaccard-sets")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // 2000))
    label = small_regions(members.filter(F.col("sets") <= SMALL), parts)
    big = members.filter(F.col("sets") > SMALL)
    if big.limit(1).count():
        label = label.unionByName(large_regions(big, parts))
    label = saved(label, "jaccard-label")
    named = saved(wanted.select("node", "rep").join(label, "node"), "jaccard-named")
    smallest = saved(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "jaccard-smallest")
    resolved = with_hubs(named, smallest, "component", named.count() / HUBS).select("node", "component_id")
    ids = known.join(resolved, "node", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    return local.join(ids, "key", "left").select("key", "n_shingles", "component_id", F.explode("doc_ids").alias("doc_id"))


def representatives(docs: DataFrame, n: int = N) -> DataFrame:
    """The documents, all columns, with the smallest doc_id of each component; rows without a doc_id stay.
    Of the rows with the same doc_id one stays, of those whose own component has it for its smallest."""
    found = saved(_clustered(docs, n).filter("doc_id is not null").select("doc_id", "key", F.coalesce("component_id", "doc_id").alias("component_id")), "jaccard-found")
    ids = found.select(F.col("doc_id").alias("_id"), "component_id")
    if not ids.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        gone = ids.filter(F.col("_id") != F.col("component_id")).select("_id")
        some = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
        return docs.join(some, docs["doc_id"] == some["_id"], "left_anti")

    # ids repeat: rows are told apart by their shingles
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            keys = pa.array([set_key(s) if len(s) else None for s in shingle_sets(batch.column("text"), n)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, mark])

    mark = "_key"
    while any(c.startswith(mark) for c in docs.columns):
        mark = "_" + mark
    rows = docs.filter("doc_id is not null").mapInArrow(freed(keyed), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", {mark} binary")
    stays = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(f"{mark}_id")).agg(F.min("key").alias(f"{mark}_stays"))
    kept = rows.join(stays, (F.col("doc_id") == F.col(f"{mark}_id")) & F.col(mark).eqNullSafe(F.col(f"{mark}_stays")))
    return docs.filter("doc_id is null").unionByName(kept.dropDuplicates(["doc_id"]).select(docs.columns))
