import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tallyspark.plans.stores import learning_store
from tallyspark.sources import store as S

KEY = S.SeriesKey(7, "day", filter_signature=S.signature({"b": 1, "a": [2]}))


def points(spark, rows):
    return spark.createDataFrame(rows, "period_key string, value double")


def held(df):
    return {r["period_key"]: r["value"] for r in df.collect()}


def test_signatures(spark):
    assert S.signature({"a": 1, "b": {"y": 2, "x": 3}}) == S.signature({"b": {"x": 3, "y": 2}, "a": 1}) != S.signature({"a": 1})
    assert [S.signature(x) for x in (None, "", {}, [])] == ["none"] * 4 and S.signature(None, "enterprise") == "enterprise"
    df = spark.createDataFrame([(1, {"b": "1", "a": "é"}), (2, {"a": "é", "b": "1"}), (3, {}), (4, None)], "i int, m map<string,string>")
    got = {r["i"]: r["s"] for r in df.select("i", S.signature_of(F.col("m")).alias("s")).collect()}
    assert got[1] == got[2] and got[3] == got[4] == "none" and len(got[1]) == 64


def test_points_are_merged_by_all_keys(spark, tmp_path):
    store = S.series_store(f"file://{tmp_path}/series")
    assert S.series(spark, store, KEY).collect() == []
    S.add_points(spark, store, KEY, points(spark, [("d1", 1.0), ("d2", 2.0), (None, 3.0), ("d4", None)]), "t", 1)
    S.add_points(spark, store, KEY._replace(scope_signature="branch 5"), points(spark, [("d1", 50.0)]), "t", 1)
    S.add_points(spark, store, KEY._replace(business_measure_id=8), points(spark, [("d1", 80.0)]), "t", 1)
    S.add_points(spark, store, KEY, points(spark, [("d2", 20.0), ("d3", 3.0), ("d3", 5.0)]), "t", 2)
    assert held(S.series(spark, store, KEY)) == {"d1": 1.0, "d2": 20.0, "d3": 5.0}
    assert held(S.series(spark, store, KEY._replace(scope_signature="branch 5"))) == {"d1": 50.0}
    assert held(S.series(spark, store, KEY._replace(business_measure_id=8))) == {"d1": 80.0}
    plan = S.series(spark, store, KEY)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(business_measure_id" in plan
    assert not list(tmp_path.glob("*staging*"))


def test_second_call_reads_only_what_the_cache_lacks(spark, tmp_path):
    store = S.series_store(f"file://{tmp_path}/series")
    source = spark.range(600).select(F.concat(F.lit("d"), (F.col("id") % 6).cast("string")).alias("period_key"), F.lit(1.0).alias("value"))
    read_rows = []

    def call(days):
        seen = Observation()

        def compute(periods):
            rows = source.join(periods, "period_key", "left_semi").observe(seen, F.count(F.lit(1)).alias("n"))
            call.ran = True
            return rows.groupBy("period_key").agg(F.sum("value").alias("value"))

        call.ran = False
        out, status = S.cached_series(spark, store, KEY, spark.createDataFrame([(x,) for x in days], "period_key string"), compute, "t", 1)
        read_rows.append(seen.get["n"] if call.ran else 0)
        return held(out), status

    assert call(["d0", "d1", "d2"]) == ({"d0": 100.0, "d1": 100.0, "d2": 100.0}, "stored")
    # three points are too few to answer by
    assert call(["d0", "d1", "d2", "d3"])[1] == "stored"
    assert call(["d0", "d1", "d2", "d3", "d4", "d9"]) == ({f"d{i}": 100.0 for i in range(5)}, "extended")
    assert call(["d1", "d2", "d3", "d4"]) == ({f"d{i}": 100.0 for i in range(1, 5)}, "hit")
    assert read_rows == [300, 400, 100, 0]


def learned(spark, rows):
    return spark.createDataFrame([(d, "term", k, k, 1, by, d % 2) for d, k, by in rows], "doc_id long, learning_type string, learning_key string, learning_value string, confidence long, learned_by string, bucket long")


def all_of(spark, store):
    return sorted((r["doc_id"], r["learning_key"], r["learned_by"]) for r in S.read(spark, store).collect())


def test_replace_then_insert_and_failure(spark, tmp_path):
    store, log = learning_store(f"file://{tmp_path}/learning"), f"file://{tmp_path}/log"
    S.merge(spark, store, learned(spark, [(1, "a", "automatic"), (1, "h", "steward"), (2, "b", "automatic"), (3, "c", "automatic")]))
    automatic = F.col("learned_by") == "automatic"
    groups = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, bucket long")
    S.replace(spark, store, groups, learned(spark, [(1, "x", "automatic"), (1, "h", "automatic"), (9, "no group", "automatic")]), automatic, log)
    after = [(1, "h", "steward"), (1, "x", "automatic"), (3, "c", "automatic")]
    assert all_of(spark, store) == after
    assert not list((tmp_path / "learning").glob("bucket=0"))
    broken = learned(spark, [(1, "y", "automatic"), (2, "z", "automatic")]).withColumn("learning_value", F.when(F.col("doc_id") == 2, F.raise_error(F.lit("no value"))).otherwise(F.col("learning_value")))
    with pytest.raises(Exception, match="no value"):
        S.replace(spark, store, groups, broken, automatic, log)
    assert all_of(spark, store) == after
    assert not list(tmp_path.glob("*staging*"))
    said = sorted((r["doc_id"], r["status"]) for r in spark.read.parquet(log).collect())
    assert said == [(1, "done"), (1, "failed"), (2, "done"), (2, "failed")]
