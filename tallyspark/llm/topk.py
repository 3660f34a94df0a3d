"""Exact top-k search by columnar branch and bound.

Each task lays its vectors out dimension by dimension and adds up the inner
products with a query one block of dimensions after the other. What the
remaining dimensions can still add is at most the product of the two
remaining norms; candidates whose sum plus that bound can't reach the k-th
best score known so far are dropped and the survivors compacted, so later
blocks touch few columns. Scores are integers and exact: norms whose product
reaches 2**52 raise ValueError, as doubles could not hold the sums.

Queries come in blocks of a fixed size, each broadcast to a job of its own
whose result is a table before the next block is collected, so the driver
holds one block at a time. Vectors that are null or hold a null, NaN or
infinite component take no part, neither do rows without an id; a query is
compared with vectors of its own width only. Rows with the query's id are the
query's own and never its candidates. Rows with the same id and vector are
one query; where the vectors of an id differ, each has ranks of its own.
Repeated candidates each take a rank, ties go to the smaller id. An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved

#: Dimensions added before survivors are compacted.
BLOCK = 8


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, q): floor(scale * x) of each component, for the vectors that take part."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("q")
    )


def _tails(m: np.ndarray) -> np.ndarray:
    """Norm of what is left of each column after each block of dimensions, rounded up."""
    squares = np.add.reduceat(m * m, np.arange(0, len(m), BLOCK), axis=0)
    left = squares[::-1].cumsum(axis=0)[::-1]
    return np.sqrt(np.concatenate([left[1:], np.zeros((1, m.shape[1]))]))


def best(queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (a row) its k best columns with a score of at least floor: number, ids, scores."""
    tails, query_tails = _tails(columns), _tails(queries.T)
    starts = range(0, len(columns), BLOCK)
    for i, query in enumerate(queries):
        alive = np.flatnonzero(ids != query_ids[i])
        score = np.zeros(len(alive))
        for b, d in enumerate(starts):
            part = columns[d : d + BLOCK] if len(alive) == columns.shape[1] else columns[d : d + BLOCK, alive]
            score = score + query[d : d + BLOCK] @ part
            rest = query_tails[b, i] * tails[b, alive]
            bar = floor[i]
            if len(alive) > k:
                bar = max(bar, np.partition(score - rest, -k)[-k] - 1)
            keep = score + rest + 1 >= bar
            if not keep.all():
                alive, score = alive[keep], score[keep]
        order = np.lexsort((ids[alive], -score))[:k]
        order = order[score[order] >= floor[i]]
        yield i, ids[alive][order], score[order].astype(np.int64)


def search(vectors: DataFrame, is_query, k: int = 5, block_queries: int = 4096, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best others for each row where is_query holds."""
    spark = vectors.sparkSession
    points = saved(quantised(vectors, scale), "points")
    norm = F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    largest = points.agg(F.max(norm)).first()[0]
    if largest is not None and largest >= 2.0**52:
        raise ValueError(f"vectors of a squared norm of {largest:g} are too long for exact scores")
    queries = saved(points.filter(is_query).dropDuplicates(["vec_id", "q"]), "queries")
    blocks = max(1, -(-queries.count() // block_queries))
    block = F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks))
    near = None
    for b in range(blocks):
        rows = queries.filter(block == b).select("vec_id", "q", F.xxhash64("q").alias("query")).toArrow()
        by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lists, qid, own = rows.column("q").to_pylist(), *(np.array(rows.column(c).to_pylist(), dtype=np.int64) for c in ("vec_id", "query"))
        widths = np.array([len(x) for x in lists], dtype=np.int64)
        for w in np.unique(widths[widths > 0]):
            of = np.flatnonzero(widths == w)
            by_width[int(w)] = (np.array([lists[i] for i in of], dtype=np.float64), qid[of], own[of])
        shared = spark.sparkContext.broadcast(by_width)
        found = points.mapInArrow(lambda batches, shared=shared: _scan(batches, shared.value, k), "query_id long, query long, vec_id long, score long")
        if blocks > 1:
            found = saved(found, "near")
            shared.destroy()
        near = found if near is None else near.unionByName(found)
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(batches: Iterator[pa.RecordBatch], queries: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's candidates for each query of a block."""
    top: dict[tuple[int, int], list[tuple[int, int]]] = {}
    floors = {w: np.full(len(q), -np.inf) for w, (q, *_) in queries.items()}
    for batch in batches:
        lists = batch.column("q")
        width = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten(), dtype=np.float64)
        begin = np.cumsum(width) - width
        ids = np.asarray(batch.column("vec_id"))
        for w, (q, qids, _) in queries.items():
            of = np.flatnonzero(width == w)
            if not len(of):
                continue
            columns = np.ascontiguousarray(flat[begin[of][None, :] + np.arange(w)[:, None]])
            for i, vec, score in best(q, qids, columns, ids[of], k, floors[w]):
                own = top.setdefault((w, i), [])
                own += zip((-score).tolist(), vec.tolist(), strict=True)
                own.sort()
                del own[k:]
                if len(own) == k:
                    floors[w][i] = -own[-1][0]
    out = [(int(queries[w][1][i]), int(queries[w][2][i]), v, -s) for (w, i), own in top.items() for s, v in own]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], ["query_id", "query", "vec_id", "score"])
