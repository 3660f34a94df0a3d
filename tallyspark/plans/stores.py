"""Series and learned rows that are stored, read back and changed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.sources import store as S
from tallyspark.sources import table


def _new_path(spark, name):
    return f"{S.shared_folder(spark)}/tallyspark/{name}-{uuid.uuid4().hex[:12]}"


_DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS period_key, round(sum(value), 4) AS value FROM events GROUP BY 1"


@query(f"""WITH d AS ({_DAYS}), c AS (SELECT period_key, value, CASE WHEN period_key < '2024-01-16' THEN 1 ELSE 2 END AS batch FROM d)
    SELECT period_key, CASE WHEN CAST(substr(period_key, 9) AS INTEGER) % 7 = 0 THEN -1.0 ELSE value END AS value, CAST(CASE WHEN CAST(substr(period_key, 9) AS INTEGER) % 7 = 0 THEN 3 ELSE batch END AS BIGINT) AS batch,
        CASE WHEN CAST(substr(period_key, 9) AS INTEGER) % 7 = 0 THEN 'correction' ELSE 'events' END AS source FROM c""")
def s_stored_series(spark, d):
    """A daily series asked for twice and then corrected, read back by its five keys; batch tells which call stored a point."""
    events = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("period_key"), "value")
    days = events.select("period_key").distinct()
    compute = lambda periods: events.join(periods, "period_key", "left_semi").groupBy("period_key").agg(F.round(F.sum("value"), 4).alias("value"))
    points = S.series_store(_new_path(spark, "series"))
    key = S.SeriesKey(1, "day", filter_signature=S.signature({"table": "events"}))
    S.cached_series(spark, points, key, days.filter("period_key < '2024-01-16'"), compute, "events", 1)
    S.cached_series(spark, points, key, days, compute, "events", 2)
    corrected = days.filter(F.substring("period_key", 9, 2).cast("int") % 7 == 0).withColumn("value", F.lit(-1.0))
    S.add_points(spark, points, key, corrected, "correction", 3)
    return S.series(spark, points, key).select("period_key", "value", "batch", "source")


_BUCKETS = 8
_LEARNED = "doc_id long, learning_type string, learning_key string, learning_value string, confidence long, learned_by string, bucket long"


def learning_store(path):
    """Learned rows of documents, in buckets of documents."""
    return S.Store(path, _LEARNED, ("doc_id", "learning_type", "learning_key"), ("bucket",))


_W = "string_split(regexp_replace(trim(lower(text)), '\\s+', ' ', 'g'), ' ')"


@query(f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, w, CASE WHEN doc_id % 3 = 0 THEN w[len(w)] ELSE w[1] END AS t, doc_id % 3 = 0 AS again FROM w),
    m AS (SELECT doc_id, 'alias' AS learning_type, w[2] AS learning_key FROM w WHERE doc_id % 5 = 0 AND len(w) > 1)
    SELECT doc_id, 'term' AS learning_type, t AS learning_key, concat(t, ' of ', CAST(doc_id AS VARCHAR)) AS learning_value, CAST(len(list_filter(w, lambda x: x = t)) AS BIGINT) AS confidence, 'automatic' AS learned_by FROM f WHERE NOT (again AND doc_id % 4 = 0)
    UNION ALL SELECT doc_id, learning_type, learning_key, concat(learning_key, ' by hand'), CAST(100 AS BIGINT), 'steward' FROM m""")
def l_replaced_learning(spark, d):
    """Learned terms after some documents are learned anew: a third get another term, some of those none; what was entered by hand stays."""
    w = F.split(F.regexp_replace(F.trim(F.lower("text")), r"\s+", " "), " ")
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", w.alias("w"), F.pmod("doc_id", F.lit(_BUCKETS)).alias("bucket"))

    def rows(kind, key, value, confidence, by):
        return ["doc_id", F.lit(kind).alias("learning_type"), key.alias("learning_key"), value.alias("learning_value"), confidence.cast("long").alias("confidence"), F.lit(by).alias("learned_by"), "bucket"]

    def terms(some, term):
        return some.withColumn("t", term).select(*rows("term", F.col("t"), F.concat("t", F.lit(" of "), F.col("doc_id").cast("string")), F.size(F.filter("w", lambda x: x == F.col("t"))), "automatic"))

    learned, log = learning_store(_new_path(spark, "learning")), _new_path(spark, "learning-status")
    second = F.get("w", F.lit(1))
    by_hand = docs.filter("doc_id % 5 = 0 and size(w) > 1").select(*rows("alias", second, F.concat(second, F.lit(" by hand")), F.lit(100), "steward"))
    S.merge(spark, learned, terms(docs, F.get("w", F.lit(0))).unionByName(by_hand))
    again = docs.filter("doc_id % 3 = 0")
    new = terms(again.filter("doc_id % 4 <> 0"), F.element_at("w", -1))
    S.replace(spark, learned, again.select("doc_id", "bucket").distinct(), new, F.col("learned_by") == "automatic", log)
    return S.read(spark, learned).drop("bucket")


@query("""SELECT conv_id, turn, CASE WHEN role IS NULL AND text IS NULL THEN 'none' ELSE sha256(concat('{', array_to_string(list_filter([CASE WHEN role IS NOT NULL THEN concat('"role":', to_json(role)) END, CASE WHEN n IS NOT NULL THEN concat('"words":"', n, '"') END], lambda x: x IS NOT NULL), ','), '}')) END AS signature
    FROM (SELECT *, len(string_split(text, ' ')) AS n FROM conversations)""")
def s_signatures(spark, d):
    """The signature of each turn's properties, given in any order."""
    rows = table(spark, d, "conversations").withColumn("n", F.size(F.split("text", " ")).cast("string"))
    pairs = F.filter(F.array(F.struct(F.lit("words").alias("key"), F.col("n").alias("value")), F.struct(F.lit("role").alias("key"), F.col("role").alias("value"))), lambda p: p["value"].isNotNull())
    return rows.select("conv_id", "turn", S.signature_of(F.map_from_entries(pairs)).alias("signature"))
