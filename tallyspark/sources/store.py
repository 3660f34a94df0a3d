"""Tables that outlive a query: merged by key or replaced by group, and a series cached in one.

A table is Parquet under one path, partitioned by some of its columns. A change first writes the rows of
the partitions it touches to a folder beside the table and only then swaps those partitions in, so a
change whose rows can't be computed leaves the table as it was, and the rows swapped in are never read
from what they replace. Partitions that it doesn't touch are neither read nor written. Two changes of
the same partitions must not run at the same time; the swap is atomic for a partition, not for several.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points from which on a stored series answers a request.
LEAST_POINTS = 4
NO_SIGNATURE, ENTERPRISE = "none", "enterprise"


class Store(NamedTuple):
    path: str
    schema: str
    #: What tells rows apart; no part of it may be null.
    keys: tuple[str, ...]
    #: The columns of the partitions.
    parts: tuple[str, ...]


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's spark.checkpoint.dir, or on a single machine one of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read(spark: SparkSession, store: Store) -> DataFrame:
    """The rows of a table; one that was never written is empty."""
    files, path = _file_system(spark, store.path)
    if not files.exists(path):
        return spark.createDataFrame([], store.schema)
    return spark.read.schema(store.schema).parquet(store.path)


def _staged(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _swapped(spark: SparkSession, store: Store, touched: DataFrame, kept: DataFrame, new: DataFrame) -> int:
    """Stage kept and new rows, then put them in place of the touched partitions; how many rows those hold now."""
    staging = f"{store.path}-staging-{uuid.uuid4().hex[:12]}"
    files, path = _file_system(spark, staging)
    columns = spark.createDataFrame([], store.schema).columns
    try:
        # nothing below is worked out again from rows that the swap replaces
        kept.select(columns).unionByName(new.select(columns)).write.parquet(f"{staging}/rows")
        touched = _staged(spark, touched, f"{staging}/touched")
        rows = spark.read.schema(store.schema).parquet(f"{staging}/rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*store.parts).parquet(store.path)
        # a partition that no row is left of isn't overwritten, it goes
        gone = touched.join(rows.select(*store.parts).distinct(), list(store.parts), "left_anti").collect()
        for row in gone:
            own, at = _file_system(spark, store.path + "".join(f"/{c}={row[c]}" for c in store.parts))
            own.delete(at, True)
        return rows.count()
    finally:
        files.delete(path, True)


def merge(spark: SparkSession, store: Store, new: DataFrame, order: str | None = None) -> int:
    """New rows take the place of stored ones with the same key, others are added; rows with a null in their key
    are left out. Of new rows with the same key that with the greatest `order` counts, or the greatest row."""
    for k in store.keys:
        new = new.filter(F.col(k).isNotNull())
    columns = spark.createDataFrame([], store.schema).columns
    rest = [c for c in columns if c not in store.keys]
    by = F.struct(*([order] if order else []), *rest)
    new = new.groupBy(*store.keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*store.keys, "_r.*")
    touched = new.select(*store.parts).distinct()
    old = read(spark, store).join(touched, list(store.parts), "left_semi")
    return _swapped(spark, store, touched, old.join(new.select(*store.keys), list(store.keys), "left_anti"), new)


def append_once(spark: SparkSession, store: Store, new: DataFrame) -> None:
    """Add the new rows whose key the table lacks; stored rows never change. Of new rows with the same key the least
    counts, those with a null in their key are left out. Called again with the same rows it adds what is missing.
    Only the partitions of new rows are looked at, and only their keys are read."""
    for k in store.keys:
        new = new.filter(F.col(k).isNotNull())
    empty = spark.createDataFrame([], store.schema)
    rest = [c for c in empty.columns if c not in store.keys]
    new = new.groupBy(*store.keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*store.keys, "_r.*")
    new = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema])
    stored = read(spark, store).join(new.select(*store.parts).distinct(), list(store.parts), "left_semi").select(*store.keys)
    # few files a partition, and a hot one split by size
    fresh = new.join(stored, list(store.keys), "left_anti").hint("rebalance", *store.parts)
    fresh.write.mode("append").partitionBy(*store.parts).parquet(store.path)


def replace(spark: SparkSession, store: Store, groups: DataFrame, new: DataFrame, replaceable: Column, log: str) -> int:
    """What is replaceable of the groups (the columns of groups, partitions included) goes, and new takes its place.

    What isn't replaceable stays, and a new row with its key is left out. A status row for each
    group is added to the log, done or failed; a failure is raised again and leaves the stored rows as they were."""
    run, names = uuid.uuid4().hex[:12], groups.columns
    kept_groups = f"{log}-groups-{run}"
    groups = _staged(spark, groups.distinct(), kept_groups)
    count = None
    try:
        touched = groups.select(*store.parts).distinct()
        old = read(spark, store).join(touched, list(store.parts), "left_semi")
        going = old.join(groups.withColumn("_going", F.lit(True)), names, "left").withColumn("_going", F.coalesce("_going", F.lit(False)) & replaceable)
        kept = going.filter(~F.col("_going")).drop("_going")
        fresh = new.join(groups, names, "left_semi").join(kept.select(*store.keys), list(store.keys), "left_anti").dropDuplicates(list(store.keys))
        count = _swapped(spark, store, touched, kept, fresh)
    finally:
        status = groups.select(*names, F.lit(run).alias("run"), F.lit("failed" if count is None else "done").alias("status"), F.lit(datetime.datetime.now(datetime.UTC).isoformat()).alias("at"))
        status.write.mode("append").parquet(log)
        files, path = _file_system(spark, kept_groups)
        files.delete(path, True)
    return count


def signature(value: Any, default: str = NO_SIGNATURE) -> str:
    """The same for equal values, whatever the order of their keys; nothing at all has the default."""
    if value is None or value == "" or value == {} or value == []:
        return default
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def signature_of(values: Column, default: str = NO_SIGNATURE) -> Column:
    """signature() of a map column from text to text."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(values)))
    return F.when(F.size(F.map_keys(values)) > 0, F.sha2(F.to_json(ordered).cast("binary"), 256)).otherwise(default)


_KEY = ("business_measure_id", "period_grain", "dimension_signature", "filter_signature", "scope_signature")
_SERIES = "business_measure_id long, period_grain string, dimension_signature string, filter_signature string, scope_signature string, period_key string, value double, source string, batch long"


def series_store(path: str) -> Store:
    """Points of series; a partition holds a measure's series of one grain."""
    return Store(path, _SERIES, (*_KEY, "period_key"), ("business_measure_id", "period_grain"))


class SeriesKey(NamedTuple):
    business_measure_id: int
    period_grain: str
    dimension_signature: str = NO_SIGNATURE
    filter_signature: str = NO_SIGNATURE
    scope_signature: str = ENTERPRISE


def series(spark: SparkSession, store: Store, key: SeriesKey) -> DataFrame:
    """The points of one series, read by its five keys; only its partition is read."""
    rows = read(spark, store)
    for name, value in key._asdict().items():
        rows = rows.filter(F.col(name) == value)
    return rows


def add_points(spark: SparkSession, store: Store, key: SeriesKey, points: DataFrame, source: str, batch: int) -> int:
    """Merge points (period_key, value) of a series; those with a null are left out."""
    named = points.filter("period_key is not null and value is not null").select(
        *[F.lit(v).cast("long" if n == "business_measure_id" else "string").alias(n) for n, v in key._asdict().items()],
        F.col("period_key").cast("string").alias("period_key"),
        F.col("value").cast("double").alias("value"),
        F.lit(source).alias("source"),
        F.lit(batch).cast("long").alias("batch"),
    )
    return merge(spark, store, named)


def cached_series(spark: SparkSession, store: Store, key: SeriesKey, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], source: str, batch: int) -> tuple[DataFrame, str]:
    """The points of the wanted periods (period_key) and where they came from: hit, extended or stored.

    From LEAST_POINTS stored points on, only the periods the series lacks are computed; under that,
    all are. compute gets the periods and gives (period_key, value) of those that have one."""
    known = series(spark, store, key).join(wanted, "period_key", "left_semi")
    enough = known.count() >= LEAST_POINTS
    missing = wanted.join(known, "period_key", "left_anti") if enough else wanted
    status = "hit"
    if missing.limit(1).count():
        add_points(spark, store, key, compute(missing), source, batch)
        status = "extended" if enough else "stored"
    return series(spark, store, key).join(wanted, "period_key", "left_semi"), status
