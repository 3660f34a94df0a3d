"""Shortest paths between entities over their relationships, by joins of the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entity with more relationships than this is split into parts of about this size.
HUB = 100_000
MOST_STEPS = 4


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, confidence) in both directions; of parallel relationships the surest stays, loops go."""
    kept = edges.filter("src is not null and dst is not null and src <> dst").select("src", "dst", "confidence")
    back = kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "confidence")
    return kept.unionByName(back).groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def shortest(edges: DataFrame, pairs: DataFrame, most: int = MOST_STEPS, hub: int = HUB) -> DataFrame:
    """(start, end, steps, confidence, path) for every pair (start, end) with a path of at most `most` steps.

    Of paths with the fewest steps it is the one whose nodes come first in order; the confidence is the rounded
    mean of its relationships'. A pair with a null, of one node twice or without a path gives no row; repeated
    pairs give one. Each level is one join of the nodes reached last and one aggregate by (start, node). The
    last step is a join on both its ends, so the widest level is never made. Relationships of a hub lie in
    parts, and the paths that reach it go to each part, so no task holds a hub whole.
    """
    ways = both_ways(edges)
    pairs = pairs.filter("start is not null and end is not null and start <> end").select("start", "end").distinct()
    parts = ways.groupBy("src").count().filter(F.col("count") > hub).select("src", F.ceil(F.col("count") / hub).cast("int").alias("parts"))
    split = ways.join(parts, "src", "left").select("src", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "dst", "confidence")
    nothing = F.array().cast("array<int>")
    reached = pairs.select("start", F.col("start").alias("node"), F.struct(F.lit(0).alias("steps"), F.array("start").alias("path"), nothing.alias("sure")).alias("best")).distinct()
    for level in range(most - 1):
        # nodes reached before stay as they are: they meet no relationship, and a path that comes back is longer
        last = F.col("best.steps") == level
        at = reached.join(parts.withColumnRenamed("src", "node"), "node", "left")
        # every path has a row that goes on as it is (part -1), those reached last one more for each part of their node
        at = at.select("start", "node", "best", F.explode(F.when(last, F.sequence(F.lit(-1), F.coalesce("parts", F.lit(1)) - 1)).otherwise(F.array(F.lit(-1)))).alias("part"))
        found = at.join(split.withColumnRenamed("src", "node"), ["node", "part"], "left").filter("part = -1 or dst is not null")
        further = F.struct((F.col("best.steps") + 1).alias("steps"), F.concat("best.path", F.array("dst")).alias("path"), F.concat("best.sure", F.array(F.col("confidence").cast("int"))).alias("sure"))
        reached = found.select("start", F.coalesce("dst", "node").alias("node"), F.when(F.col("dst").isNull(), F.col("best")).otherwise(further).alias("best"))
        reached = reached.groupBy("start", "node").agg(F.min("best").alias("best"))
    ends = reached.join(pairs, "start").join(ways.select(F.col("src").alias("node"), F.col("dst").alias("end"), "confidence"), ["node", "end"])
    whole = F.struct((F.col("best.steps") + 1).alias("steps"), F.concat("best.path", F.array("end")).alias("path"), F.concat("best.sure", F.array(F.col("confidence").cast("int"))).alias("sure"))
    best = ends.groupBy("start", "end").agg(F.min(whole).alias("best"))
    mean = F.aggregate("best.sure", F.lit(0), lambda a, x: a + x) / F.size("best.sure")
    return best.select("start", "end", "best.steps", F.bround(mean, 0).cast("int").alias("confidence"), F.col("best.path").alias("path"))
