"""Reading inputs and keeping intermediate tables where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors see.

    Unset, it is an error: a folder of one machine would lose rows on a cluster. A session that runs
    on this machine alone, as in tests, gets one of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table in the shared folder and read again, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyspark/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(fold_count: int, fold: int, column: str = "doc_id"):
    """True where crc32 of the id as text leaves the remainder fold."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % fold_count) == fold
