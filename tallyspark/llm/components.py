"""Connected components of a graph given as edges, as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved
from tallyspark.llm.words import freed

#: Edges that a task turns into stars at a time.
TASK_EDGES = 1_000_000
#: A node on more than this share of all edges is a hub; there are at most 2 * HUBS.
HUBS = 1000


def stars(u: np.ndarray, v: np.ndarray, roots: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node it reaches) that connect the same nodes as the edges (u, v); with roots
    the least nodes have a row too."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        least = np.minimum(root[a], root[b])
        hooked = root.copy()
        np.minimum.at(hooked, root[a], least)
        np.minimum.at(hooked, root[b], least)
        while (hooked[hooked] != hooked).any():
            hooked = hooked[hooked]
        if (hooked == root).all():
            own = np.full(len(names), True) if roots else root != np.arange(len(names))
            return names[own], names[root[own]]
        root = hooked


def _starred(edges: DataFrame, most: int, roots: bool = False) -> DataFrame:
    """(u, v) with v < u: the edges (u, v) of each task as stars, `most` edges at a time; with roots also (u, u)."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            node, root = stars(*(np.concatenate(x) for x in zip(*held, strict=True)), roots)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])

        for batch in batches:
            held.append(tuple(np.asarray(batch.column(k), dtype=np.int64) for k in ("u", "v")))
            size += batch.num_rows
            if size >= most:
                size = 0
                yield rows()
        if held:
            yield rows()

    return edges.mapInArrow(freed(turn), "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = TASK_EDGES, hubs: int = HUBS) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches.

    Edges with a null end or equal ends connect nothing. First each task turns its edges into
    stars. Then every round points each node at the smallest node around it and around those it
    points at (alternating large and small stars), so chains halve; a round without a change
    ends it. Edges are kept in tables of their own. Edges of a hub meet what is known of it by
    broadcast, which has at most 2 * hubs rows, so no task gets all edges of one node. At most
    task_edges edges, as many as a task turns into stars at a time, need no round: they are one
    portion of one task, whose stars are the components.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b")
    pairs = saved(_starred(pairs, task_edges).distinct(), "edges")
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        count = pairs.count()
        if count <= task_edges:
            return saved(_starred(pairs.coalesce(1), task_edges, True).toDF("node", "component"), "components")
        hub = count / hubs
        near = saved(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        # done when every node has one edge, to a root: a node above another is a leaf
        if not near.filter("m < u and n > 1").limit(1).count():
            break
        least = near.select("u", F.least("u", "m").alias("m"), "n")
        large = with_hubs(both.filter("v > u"), least, "u", hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct(), "edges")
        hub = large.count() / hubs
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_hubs(large, least, "u", hub).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def with_hubs(rows: DataFrame, facts: DataFrame, key: str, hub: float) -> DataFrame:
    """rows joined with facts, which has one row of each key and in n how many rows have it. Keys on more
    than hub rows, at most rows / hub of them, are joined by broadcast and don't meet in one task."""
    hot = F.broadcast(facts.filter(F.col("n") > hub).drop("n"))
    cold = facts.filter(F.col("n") <= hub).drop("n")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
