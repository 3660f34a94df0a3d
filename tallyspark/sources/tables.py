"""Sources and sinks as a Spark user writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How each kind of database is reached.
JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{service}",
    "mssql": "jdbc:sqlserver://{host}:{port};databaseName={database}",
}
CONNECT_SECONDS = 15


def jdbc_options(kind: str, host: str, port: int, database: str = "", service: str = "") -> dict[str, str]:
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown kind of database: {kind}")
    if kind == "oracle" and not service:
        raise ValueError("an oracle source needs a service name")
    return {"url": JDBC_URLS[kind].format(host=host, port=port, database=database, service=service), "loginTimeout": str(CONNECT_SECONDS)}


def jdbc_table(spark: SparkSession, options: dict[str, str], name: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table over JDBC; partition (column, least, most, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", name)
    if partition:
        column, least, most, parts = partition
        reader = reader.option("partitionColumn", column).option("lowerBound", least).option("upperBound", most).option("numPartitions", parts)
    return reader.load()


def add_source(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Parquet tables as temporary views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def csv_sink(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, and those of old whose keys it lacks; rows of new with a null key are left out."""
    for k in keys:
        new = new.filter(F.col(k).isNotNull())
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
