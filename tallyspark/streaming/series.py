"""Windowed sums of an event stream, kept as the points of a series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["event_type", "period"]


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(event_type, period, n, total) of each window; events later than the watermark are dropped by a
    stream, and a batch takes all. State is one row a window and type."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("event_type", F.col("window.start").alias("period"), "n", "total")


def run(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, size: str = "1 day") -> StreamingQuery:
    """Starts the stream over what is there; write gets the windows that each batch changed, to be
    upserted by KEYS. A restart goes on from the checkpoint, in a shared folder."""
    return windowed(events, size).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
