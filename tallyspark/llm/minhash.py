"""Near-duplicate texts by MinHash with sequential Bayesian verification.

1. Classes. Texts with equal shingle sets are one node from the start. A node of LEAST
   shingles or more has a signature of BANDS * ROWS minima; smaller sets can only link with
   equal ones.
2. Bands. Nodes that agree in all ROWS minima of a band share a bucket. Of a pair as similar
   as the threshold a share of (1 - T^ROWS)^BANDS, 4e-8, meets in no bucket. Every member
   of a bucket is a candidate with the bucket's centre, a member that a hash of node and
   bucket picks, so each bucket has its own.
3. Sequential verification. Signatures are compared BATCH minima at a time. With m of n
   equal, the similarity has the posterior Beta(m + 1, n - m + 1); a pair is pruned as soon
   as the posterior probability of reaching the threshold is under `miss`. The minima are
   kept as a byte each, which only raises m, and so prunes less.
4. Exact verification. What survives is compared on whole shingle sets: first each node's
   likeliest pair, then what that left in different components.
5. Buckets whose members are now in several components have pairs that no centre has
   decided. In buckets of up to FEW members they are candidates for steps 3 and 4. In
   larger ones what is outside the bucket's largest component is compared with all of it
   in blocks of BLOCK by BLOCK signatures, each block a group of its own. A block gives
   no pairs but a spanning forest of those not pruned; the forests' components are crowds,
   and every undecided pair is within one. A crowd is verified like a bucket, what is
   outside its largest component against all of it, in blocks of whole sets, and a block
   gives at most a link less than it has components. So a bucket of any size is worked
   through whole, and no table has a row for each pair of a group.

Links are confirmed on full sets, so none is wrong; one is missed with the chance that
`miss` and the bands leave.

Defined cases: null and empty texts, and those of white space only, have no shingles, link
with nothing and are their own component. Fewer words than a shingle are one shingle. Rows
with a null doc_id take part but name no component; where no id is known component_id is
null, and the row is kept. Rows that repeat an id with other texts are told apart by their
texts. Very long texts are one set in one task, of 8 bytes a word and 1 kB of signature.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.components import HUBS, components, with_hubs
from tallyspark.llm.jaccard_join import BROADCAST_IDS, TASK_SHINGLES, Sets, _grouped, set_key, shingle_sets
from tallyspark.llm.tables import saved
from tallyspark.llm.words import freed, joined, portions

N = 2
#: Sets link when HUNDRED * intersection >= PERCENT * union.
PERCENT, HUNDRED = 80, 100
#: A smaller set that links has the same shingles: of n and n + 1 shingles n are too few in common.
LEAST = PERCENT // (HUNDRED - PERCENT)
ROWS, BANDS = 6, 56
MINIMA = ROWS * BANDS
BATCH = 48
#: Chance of a linked pair to be pruned, at each look.
MISS = 1e-9
FEW, BLOCK = 32, 256
#: Shingles of a block of whole sets.
WEIGHT = 200_000
SEED = 12


def constants(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """What the hash of each minimum is masked and multiplied with."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, MINIMA, np.uint32), rng.integers(0, 1 << 31, MINIMA, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(bands, bytes) of non-empty sets: BANDS keys of buckets and MINIMA bytes of each."""
    mask, factor = constants()
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    low = np.empty((MINIMA, len(sets)), np.uint32)
    work = np.empty_like(flat)
    for k in range(MINIMA):
        np.bitwise_xor(flat, mask[k], out=work)
        np.multiply(work, factor[k], out=work)
        low[k] = np.minimum.reduceat(work, begin)
    bands = np.empty((len(sets), BANDS), np.int64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for row in low[b * ROWS : (b + 1) * ROWS]:
            key = joined(key, row.astype(np.uint64))
        bands[:, b] = key.view(np.int64)
    return bands, (low & np.uint32(0xFF)).astype(np.uint8).T


def fewest(n: int, miss: float = MISS) -> int:
    """The fewest equal minima of n with which the similarity reaches the threshold with a posterior
    probability of `miss`. Beta(m + 1, n - m + 1) is over t as often as of n + 1 draws at t at most m succeed."""
    t, below = PERCENT / HUNDRED, 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def looks(miss: float = MISS) -> list[tuple[int, int, int]]:
    """(from, to, fewest equal up to there) of each batch of minima."""
    return [(n, min(n + BATCH, MINIMA), fewest(min(n + BATCH, MINIMA), miss)) for n in range(0, MINIMA, BATCH)]


def surviving(left: np.ndarray, right: np.ndarray, plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of rows (left[i], right[i]) of signatures those not pruned, and how many minima they share."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int64)
    for first, last, least in plan:
        equal += (left[alive, first:last] == right[alive, first:last]).sum(axis=1)
        stay = equal >= least
        alive, equal = alive[stay], equal[stay]
        if not len(alive):
            break
    return alive, equal


def classes(docs: DataFrame, n: int = N) -> DataFrame:
    """Saved rows (key, n_shingles, doc_ids, bands, signature): the texts of a task with equal sets.
    key is null for texts without words, bands and signature for sets under LEAST."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes | None, list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.binary()),
                    *(pa.array([v[i] for v in held.values()], kind) for i, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))),
                ],
                ["key", "n_shingles", "doc_ids", "bands", "signature"],
            )
            held.clear()
            return out

        for batch in portions(batches, "_text"):
            fresh: list[tuple[list, np.ndarray]] = []
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("_text"), n), strict=True):
                key = set_key(s) if len(s) else None
                if key in held:
                    held[key][1].append(doc)
                    size += 1
                    continue
                held[key] = [len(s), [doc], None, None]
                size += len(s) + MINIMA
                if len(s) >= LEAST:
                    fresh.append((held[key], s))
            if fresh:
                bands, low = signatures([s for _, s in fresh])
                for (row, _), b, v in zip(fresh, bands, low, strict=True):
                    row[2], row[3] = b.tolist(), v.tobytes()
            if size >= TASK_SHINGLES:
                size = 0
                yield rows()
        if held:
            yield rows()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return saved(source.mapInArrow(freed(scan), "key binary, n_shingles long, doc_ids array<long>, bands array<long>, signature binary"), "minhash-classes")


def _small(rows: DataFrame) -> DataFrame:
    """The saved rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _hubs(pairs: DataFrame, key: str, total: int) -> DataFrame:
    """(key, _copies): the nodes on more than a thousandth of the `total` pairs, and how many thousandths."""
    many = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * HUBS > total)
    return many.select(key, F.ceil(F.col("_n") * HUBS / total).alias("_copies"))


def _beside(rows: DataFrame, facts: DataFrame, hubs: DataFrame, key: str, other: str) -> DataFrame:
    """rows joined with facts, one row a key. The rows of a hub are dealt, by `other`, over copies of its facts."""
    few = F.broadcast(hubs)
    copies = F.coalesce("_copies", F.lit(1).cast("long"))
    left = rows.join(few, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), copies)).drop("_copies")
    right = facts.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_copies")
    return left.join(right, [key, "_salt"]).drop("_salt")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINIMA)


def sifted(pairs: DataFrame, known: DataFrame, miss: float = MISS) -> DataFrame:
    """(a, b, equal) of the saved pairs (a, b) that sequential verification doesn't prune."""
    plan = looks(miss)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            alive, equal = surviving(_matrix(batch.column("s_a")), _matrix(batch.column("s_b")), plan)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive)), pa.array(equal)], ["a", "b", "equal"])

    rows, total = pairs, max(pairs.count(), 1)
    for x, other in (("a", "b"), ("b", "a")):
        rows = _beside(rows, known.select(F.col("node").alias(x), F.col("signature").alias(f"s_{x}")), _hubs(pairs, x, total), x, other)
    return rows.select("a", "b", "s_a", "s_b").mapInArrow(freed(verify), "a long, b long, equal long")


def _texts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, text): one text of each of the saved nodes wanted (key, node, rep). Only rows with a node's rep for
    their id are read through, and rows without an id where a node has no rep."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in portions(batches, "text"):
            keys = [set_key(s) if len(s) >= LEAST else None for s in shingle_sets(batch.column("text"), n)]
            first = []
            for key in keys:
                first.append(key is not None and key not in seen)
                seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("text")], ["key", "text"]).filter(pa.array(first, pa.bool_()))

    small = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda rows: rows
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    own = rows.join(small(wanted.select("rep").filter("rep is not null").distinct()), "rep", "left_semi")
    if wanted.filter("rep is null").limit(1).count():
        own = own.unionByName(rows.filter("rep is null"))
    found = own.select("text").mapInArrow(freed(keyed), "key binary, text binary")
    return found.join(small(wanted.select("key", "node")), "key").groupBy("node").agg(F.first("text").alias("text"))


def confirmed(pairs: DataFrame, texts: DataFrame, n: int = N) -> DataFrame:
    """The saved pairs (a, b) whose whole sets link; texts (node, text) holds both."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(portions(batches, "t_a"), "t_b"):
            of: dict[int, np.ndarray] = {}
            for x in "ab":
                first: dict[int, int] = {}
                for i, k in enumerate(batch.column(x).to_pylist()):
                    if k not in of:
                        first.setdefault(k, i)
                sets = shingle_sets(batch.column(f"t_{x}").take(pa.array(list(first.values()), pa.int64())), n)
                of |= zip(first, sets, strict=True)
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                common = len(np.intersect1d(of[a], of[b], assume_unique=True))
                keep.append(HUNDRED * common >= PERCENT * (len(of[a]) + len(of[b]) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows, total = pairs, max(pairs.count(), 1)
    for x, other in (("a", "b"), ("b", "a")):
        rows = _beside(rows, texts.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}")), _hubs(pairs, x, total), x, other)
    return rows.select("a", "b", "t_a", "t_b").mapInArrow(freed(compare), "a long, b long")


def _labelled(rows: DataFrame, label: DataFrame, *columns: str) -> DataFrame:
    """rows with l_<column>: the component of the node in each column, itself where it has no links."""
    label = _small(label)
    for c in columns:
        rows = rows.join(label.select(F.col("node").alias(c), F.col("component").alias("_l")), c, "left")
        rows = rows.withColumn(f"l_{c}", F.coalesce("_l", c)).drop("_l")
    return rows


def settled(near: DataFrame, known: DataFrame, docs: DataFrame, links: DataFrame | None, n: int = N) -> DataFrame:
    """Saved links (a, b) after exact verification of the saved pairs near (a, b, equal): links and a set of
    new ones that connects what near connects."""
    nodes = near.select(F.explode(F.array("a", "b")).alias("node"))
    nodes = F.broadcast(nodes) if 2 * near.count() <= BROADCAST_IDS else nodes
    wanted = saved(known.select("key", "node", "rep").join(nodes, "node", "left_semi"), "minhash-wanted")
    texts = saved(_texts(docs, wanted, n), "minhash-texts")
    ends = near.select(F.col("a").alias("node"), "a", "b", "equal").unionByName(near.select(F.col("b").alias("node"), "a", "b", "equal"))
    best = ends.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("equal", "a", "b")).alias("p"))
    best = saved(best.select("p.*").distinct(), "minhash-best")
    sure = confirmed(best, texts, n)
    sure = saved(sure if links is None else sure.unionByName(links), "minhash-links")
    rest = _labelled(near.select("a", "b").join(best, ["a", "b"], "left_anti"), components(sure), "a", "b").filter("l_a <> l_b").select("a", "b")
    rest = saved(rest, "minhash-rest")
    if not rest.limit(1).count():
        return sure
    return saved(sure.unionByName(confirmed(rest, texts, n)), "minhash-links")


def _dealt(rows: DataFrame, group: str, extra: list[str], per_block: int, weights: str | None = None) -> DataFrame:
    """(group, x, y, open, node, label, *extra): the saved rows of groups of several labels, so dealt that each row
    outside its group's largest label (open) meets every row of the group in one group of (group, x, y).

    A block has about per_block rows or, with weights, as many as weigh that much if those are fewer."""
    spark = rows.sparkSession
    weight = F.col(weights) if weights else F.lit(0)
    sizes = rows.groupBy(group, "label").agg(F.count(F.lit(1)).alias("_m"), F.sum(weight).alias("_w"))
    sizes = sizes.groupBy(group).agg(
        F.max_by("label", F.struct("_m", "label")).alias("core"), F.max(F.struct("_m", "label"))["_m"].alias("most"), F.sum("_m").alias("n"), F.sum("_w").alias("weight"), F.max_by("_w", F.struct("_m", "label")).alias("core_weight")
    )
    sizes = saved(sizes.withColumn("members", F.col("n")).filter("members > most"), "minhash-sizes")
    placed = with_hubs(rows, sizes, group, rows.count() / HUBS).withColumn("open", F.col("label") != F.col("core"))
    blocks = []
    for count, load in ((F.col("members"), F.col("weight")), (F.col("members") - F.col("most"), F.col("weight") - F.col("core_weight"))):
        blocks.append(F.greatest(F.ceil(count / per_block), F.ceil(load / WEIGHT), F.lit(1)))
    own = [F.pmod(F.xxhash64(F.lit(i), "node"), k) for i, k in enumerate(blocks)]
    each = [F.explode(F.sequence(F.lit(0).cast("long"), k - 1)) for k in blocks]
    kinds = [group, "node", "label", *extra]
    home = placed.select(*kinds, F.lit(False).alias("open"), own[0].alias("x"), each[1].alias("y"))
    away = placed.filter("open").select(*kinds, F.lit(True).alias("open"), each[0].alias("x"), own[1].alias("y"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return home.unionByName(away).repartition(parts, group, "x", "y").sortWithinPartitions(group, "x", "y")


def _of_block(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, label, rows that are open, all others) of a block."""
    is_open = np.array(group.column("open").to_pylist(), bool)
    node, label = (np.array(group.column(c).to_pylist(), np.int64) for c in ("node", "label"))
    return node, label, np.flatnonzero(is_open), np.flatnonzero(~is_open)


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def crowds(rows: DataFrame, known: DataFrame, miss: float = MISS) -> DataFrame:
    """(node, component): the undecided nodes of the saved bucket members (bucket, node, label), by crowd."""
    plan = looks(miss)

    def sift(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, label, away, home = _of_block(group)
        low = _matrix(group.column("signature"))
        place = np.searchsorted(np.unique(node), node)
        crowd = np.arange(len(node))  # by place
        found = []
        for i in away:
            # what is in i's crowd already needs no look
            other = home[(label[home] != label[i]) & (crowd[place[home]] != crowd[place[i]])]
            alive, _ = surviving(np.broadcast_to(low[i], (len(other), MINIMA)), low[other], plan)
            for j in other[alive]:
                x, y = crowd[place[i]], crowd[place[j]]
                if x != y:
                    found.append((int(node[i]), int(node[j])))
                    crowd[crowd == y] = x
        yield _edges(found)

    rows = saved(rows.join(known.select("node", "signature"), "node"), "minhash-signed")
    dealt = _dealt(rows, "bucket", ["signature"], BLOCK)
    return components(dealt.mapInArrow(freed(lambda b: _grouped(b, ["bucket", "x", "y"], sift)), "a long, b long"))


def crowd_links(members: DataFrame, n: int = N) -> DataFrame:
    """(a, b): links between labels that connect what links the saved members (crowd, node, label, n_shingles, text)."""

    def compare(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        node, label, away, home = _of_block(group)
        sets = Sets(shingle_sets(group.column("text"), n))
        names, own = np.unique(label, return_inverse=True)
        found = []
        for i in away:
            size = int(sets.size[i])
            fits = HUNDRED * np.minimum(sets.size[home], size) >= PERCENT * np.maximum(sets.size[home], size)
            other = home[(own[home] != own[i]) & fits]
            if not len(other):
                continue
            common = sets.common(int(i))[other]
            for j in np.unique(own[other[HUNDRED * common >= PERCENT * (size + sets.size[other] - common)]]):
                if j != own[i]:
                    found.append((int(names[own[i]]), int(names[j])))
                    own[own == j] = own[i]
        yield _edges(found)

    dealt = _dealt(members, "crowd", ["text"], BLOCK, "n_shingles")
    return dealt.mapInArrow(freed(lambda b: _grouped(b, ["crowd", "x", "y"], compare)), "a long, b long")


def clustered(docs: DataFrame, n: int = N, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    local = classes(docs, n)
    known = local.filter("key is not null").groupBy("key").agg(
        F.min(F.array_min("doc_ids")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("signature").alias("signature")
    )
    known = saved(known.withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")

    entries = known.filter("bands is not null").select("node", F.explode("bands").alias("bucket"))
    drawn = F.struct(F.xxhash64("node", "bucket").alias("h"), F.col("node").alias("centre"))
    buckets = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(drawn)["centre"].alias("centre")).filter("n > 1")
    buckets = saved(buckets.withColumn("members", F.col("n")), "minhash-buckets")
    members = saved(with_hubs(entries, buckets, "bucket", known.count() * BANDS / HUBS), "minhash-members")
    pairs = members.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pairs = saved(pairs, "minhash-pairs")
    near = saved(sifted(pairs, known, miss), "minhash-near")
    links = settled(near, known, docs, None, n)

    # buckets that still hold several components
    labelled = saved(_labelled(members, components(links), "node"), "minhash-labelled")
    several = labelled.groupBy("bucket").agg(F.min("l_node").alias("lo"), F.max("l_node").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    several = saved(several, "minhash-several")
    left = labelled.filter(F.col("members") <= FEW).join(several.filter(F.col("n") <= FEW).select("bucket"), "bucket").filter("node <> centre").select("bucket", "node", "l_node")
    right = left.select("bucket", F.col("node").alias("other"), F.col("l_node").alias("l_other"))
    more = left.join(right, "bucket").filter("node < other and l_node <> l_other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    more = saved(more.join(pairs, ["a", "b"], "left_anti"), "minhash-pairs")
    late = saved(sifted(more, known, miss), "minhash-near")
    if late.limit(1).count():
        links = settled(late, known, docs, links, n)
    hot = several.filter(F.col("n") > FEW)
    if hot.limit(1).count():
        label = components(links)
        crowd = with_hubs(members.select("bucket", "node"), hot.select("bucket", "n"), "bucket", known.count() * BANDS / HUBS)
        crowd = saved(_labelled(crowd, label, "node").withColumnRenamed("l_node", "label"), "minhash-crowd")
        of = saved(known.select("key", "node", "rep", "n_shingles").join(_small(crowds(crowd, known, miss)).withColumnRenamed("component", "crowd"), "node"), "minhash-wanted")
        whole = _labelled(of.drop("key", "rep").join(_texts(docs, of.select("key", "node", "rep"), n), "node"), label, "node").withColumnRenamed("l_node", "label")
        links = saved(links.unionByName(crowd_links(saved(whole, "minhash-texts"), n)), "minhash-links")

    label = saved(components(links), "minhash-label")
    named = saved(known.select("node", "rep").join(_small(label), "node"), "minhash-named")
    smallest = saved(named.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")), "minhash-smallest")
    count = named.count()
    if count <= BROADCAST_IDS:
        found = F.broadcast(named.join(F.broadcast(smallest), "component").select("node", "component_id"))
    else:
        found = with_hubs(named, smallest, "component", count / HUBS).select("node", "component_id")
    ids = known.select("key", "node", "rep").join(found, "node", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    rows = local.select("key", "n_shingles", "doc_ids").join(ids, "key", "left").select("n_shingles", "component_id", F.explode("doc_ids").alias("doc_id"))
    rows = rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
