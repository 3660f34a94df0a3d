"""Windows, time series and trade statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.functions.dates import time_grain
from tallyspark.operators import series, trading
from tallyspark.sources import table, upsert
from tallyspark.streaming.series import windowed

_TRADES = "SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN -value ELSE value END AS pnl FROM events WHERE event_type IN ('purchase', 'error')"
_RUNNING = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


def _trades(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error"))
    return e.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("pnl"))


@query(f"SELECT user_id, event_id, round(sum(pnl) {_RUNNING}, 4) AS equity FROM ({_TRADES})")
def w_equity_curve(spark, d):
    return trading.equity(_trades(spark, d), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.round("equity", 4).alias("equity"))


@query(f"""WITH e AS (SELECT user_id, event_id, ts, sum(pnl) {_RUNNING} AS equity FROM ({_TRADES})), p AS (SELECT user_id, equity - greatest(0, max(equity) {_RUNNING}) AS dd FROM e)
    SELECT user_id, round(min(dd), 4) AS max_drawdown FROM p GROUP BY user_id""")
def w_drawdown(spark, d):
    return trading.equity(_trades(spark, d), ["user_id"], ["ts", "event_id"]).groupBy("user_id").agg(F.round(F.min("drawdown"), 4).alias("max_drawdown"))


@query(f"""WITH r AS (SELECT user_id, pnl, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) {_RUNNING} AS run FROM ({_TRADES})), n AS (SELECT user_id, run, count(*) FILTER (WHERE pnl < 0) AS n FROM r GROUP BY ALL)
    SELECT user_id, CAST(max(n) AS BIGINT) AS streak FROM n GROUP BY user_id""")
def w_max_losing_streak(spark, d):
    return trading.losing_streak(_trades(spark, d), ["user_id"], ["ts", "event_id"])


@query(f"""SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) FILTER (WHERE pnl > 0) / count(*), 4) AS win_rate,
    round(CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / sum(CASE WHEN pnl < 0 THEN -pnl ELSE 0 END) ELSE 0 END, 4) AS profit_factor
    FROM ({_TRADES}) GROUP BY user_id""")
def w_profit_factor(spark, d):
    return trading.summary(_trades(spark, d), ["user_id"])


_MONTHLY = "SELECT o_orderpriority AS key, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, sum(o_totalprice) AS value FROM orders WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY ALL"


def _monthly(spark, d):
    o = table(spark, d, "orders")
    points = o.groupBy(F.col("o_orderpriority").alias("key"), time_grain("o_orderdate", "month").alias("period")).agg(F.sum("o_totalprice").alias("value"))
    return series.completed(points, "period", F.lit(date(2001, 7, 1)).cast("timestamp_ntz"))


@query(f"""SELECT key, round((arg_max(value, period) - arg_min(value, period)) * 100 / abs(arg_min(value, period)), 4) AS change FROM ({_MONTHLY}) GROUP BY key""")
def w_first_last_change(spark, d):
    return _monthly(spark, d).groupBy("key").agg(F.round(series.change(F.min_by("value", "period"), F.max_by("value", "period")), 4).alias("change"))


@query(f"SELECT key, arg_max(period, value) AS best, arg_min(period, value) AS worst, round(avg(value), 4) AS mean FROM ({_MONTHLY}) GROUP BY key")
def w_argmax_argmin(spark, d):
    return _monthly(spark, d).groupBy("key").agg(F.max_by("period", "value").alias("best"), F.min_by("period", "value").alias("worst"), F.round(F.avg("value"), 4).alias("mean"))


@query("""WITH t AS (SELECT n_name, n_regionkey, sum(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT n_regionkey, n_name, round(value * 100 / sum(value) OVER (PARTITION BY n_regionkey), 4) AS share, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY value DESC, n_name) AS INTEGER) AS rank FROM t""")
def w_share_of_total(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    totals = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_name", "n_regionkey").agg(F.sum("c_acctbal").alias("value"))
    return series.shares(totals, ["n_regionkey"], "value").select("n_regionkey", "n_name", F.round("share", 4).alias("share"), "rank")


@query(f"SELECT key, CAST(count(*) AS BIGINT) AS n, max(period) AS last_period FROM ({_MONTHLY}) GROUP BY key")
def w_partial_excluded(spark, d):
    return _monthly(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("period").alias("last_period"))


_LAST = f"(SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY period) - 1 AS INTEGER) AS x FROM (SELECT * FROM ({_MONTHLY}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY period DESC) <= 12))"


@query(f"SELECT key, period, x FROM {_LAST}")
def w_last_k_points(spark, d):
    return series.last_points(_monthly(spark, d), ["key"], "period").select("key", "period", "x")


@query("""SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role IN ('user', 'assistant')) WHERE r <= 8""")
def w_last_8_messages(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = table(spark, d, "conversations").filter(F.col("role").isin("user", "assistant"))
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= 8").select("conv_id", "turn", "role")


@query(f"SELECT key, round(regr_slope(value, x), 4) AS slope, round(regr_intercept(value, x), 4) AS intercept, round(regr_r2(value, x), 6) AS r2 FROM {_LAST} GROUP BY key")
def ts_ols(spark, d):
    fit = series.trend(series.last_points(_monthly(spark, d), ["key"], "period"), ["key"], "value")
    return fit.select("key", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@query(f"""WITH f AS (SELECT key, count(*) AS n, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, max(period) AS p FROM {_LAST} GROUP BY key)
    SELECT key, CAST(p + to_months(CAST(step AS INTEGER)) AS DATE) AS period, round(greatest(0, a + b * (n - 1 + step)), 2) AS forecast FROM f, range(1, 4) AS s(step)""")
def ts_forecast(spark, d):
    return series.forecast(_monthly(spark, d), ["key"], "value", 3).select("key", "period", F.round("forecast", 2).alias("forecast"))


@query(f"""WITH f AS (SELECT key, count(*) AS n, regr_r2(value, x) AS r2 FROM {_LAST} GROUP BY key)
    SELECT key, CASE WHEN n >= 9 AND r2 >= 0.7 THEN 'high' WHEN n >= 6 AND r2 >= 0.35 THEN 'medium' ELSE 'low' END AS confidence FROM f""")
def ts_confidence_label(spark, d):
    fit = series.trend(series.last_points(_monthly(spark, d), ["key"], "period"), ["key"], "value")
    return fit.select("key", series.confidence(F.col("n"), F.col("r2")).alias("confidence"))


@query("""WITH o AS (SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS v FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
    n AS (SELECT CAST(ts AS DATE) AS day, CAST(2 * count(*) AS BIGINT) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE day NOT IN (SELECT day FROM n)""")
def ts_cache_upsert(spark, d):
    e = table(spark, d, "events")
    day = lambda f, times: e.filter(f).groupBy(F.to_date("ts").alias("day")).agg((F.count(F.lit(1)) * times).alias("v"))
    return upsert(day("ts < timestamp_ntz'2024-01-20'", 1), day("ts >= timestamp_ntz'2024-01-15'", 2), ["day"])


@query(f"""SELECT key, arg_min(value, period) < arg_max(value, period) AS rising, CAST(count(*) FILTER (WHERE value > before) AS BIGINT) AS ups
    FROM (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY period) AS before FROM ({_MONTHLY})) GROUP BY key""")
def ts_trend_facts(spark, d):
    w = Window.partitionBy("key").orderBy("period")
    points = _monthly(spark, d).withColumn("before", F.lag("value").over(w))
    return points.groupBy("key").agg((F.min_by("value", "period") < F.max_by("value", "period")).alias("rising"), F.count_if(F.col("value") > F.col("before")).alias("ups"))


@query("SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def s_windowed(spark, d):
    """Daily windows of events, by the function that also runs as a stream."""
    out = windowed(table(spark, d, "events"))
    return out.select("event_type", F.date_format("period", "yyyy-MM-dd").alias("period"), "n", F.round("total", 4).alias("total"))


_CACHED = "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS period, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(f"SELECT *, CASE WHEN period < '2024-01-16' THEN 'cached' ELSE 'computed' END AS origin FROM ({_CACHED})")
def s_cache_aside(spark, d):
    """A series from its cached points; only the periods that the cache lacks are computed from the events."""
    events = table(spark, d, "events").withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    points = lambda rows: rows.groupBy("event_type", "period").agg(F.round(F.sum("value"), 4).alias("total"))
    cache = points(events.filter("period < '2024-01-16'")).withColumn("origin", F.lit("cached"))
    missing = events.join(F.broadcast(cache.select("period").distinct()), "period", "left_anti")
    return cache.unionByName(points(missing).withColumn("origin", F.lit("computed")))


@query(f"SELECT period, total FROM ({_CACHED}) WHERE event_type = 'purchase' AND period BETWEEN '2024-01-05' AND '2024-01-09'")
def s_lookup(spark, d):
    """A stretch of one series, by its key."""
    points = table(spark, d, "events").withColumn("period", F.date_format("ts", "yyyy-MM-dd"))
    found = points.filter((F.col("event_type") == "purchase") & F.col("period").between("2024-01-05", "2024-01-09"))
    return found.groupBy("period").agg(F.round(F.sum("value"), 4).alias("total"))


#: Measures by the phrases that ask for them.
MEASURES = {"total price": "sum", "average price": "avg", "number of orders": "count"}


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'sum' WHEN 1 THEN 'avg' WHEN 2 THEN 'count' END AS measure FROM orders")
def s_measure(spark, d):
    """The measure whose phrase a request holds; the longest phrase wins, none is null."""
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, "show the total price by month").when(k == 1, "Average price, please").when(k == 2, "number of orders per total").otherwise("hello")
    out = F.lit(None).cast("string")
    for phrase, measure in sorted(MEASURES.items(), key=lambda p: len(p[0])):
        out = F.when(F.lower(asked).contains(phrase), measure).otherwise(out)
    return table(spark, d, "orders").select("o_orderkey", out.alias("measure"))
