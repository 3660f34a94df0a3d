"""Scan, filter, join, aggregate and order queries over the star schema."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.functions import dates
from tallyspark.operators.predicates import any_contains, implies, predicate
from tallyspark.operators.report import Join, Measure, Report, latest_per_period, run
from tallyspark.sources import table

#: The approved joins of the star schema.
JOINS = [
    Join("orders", "o_custkey", "customer", "c_custkey"),
    Join("customer", "c_nationkey", "nation", "n_nationkey"),
    Join("nation", "n_regionkey", "region", "r_regionkey"),
    Join("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Join("lineitem", "l_partkey", "part", "p_partkey"),
    Join("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
AS_OF = date(1998, 7, 15)


def frames(spark, d):
    return {t: table(spark, d, t) for t in TABLES}


def report(spark, d, r: Report, scope=None):
    return run(r, frames(spark, d), JOINS, scope)


# scans and projections


@query("SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total_price FROM orders")
def scan_project_alias(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total_price"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 100")
def choose_display_limit(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").orderBy("c_custkey").limit(100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20")
def paginate_page_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").offset(20).limit(10)


@query("SELECT DISTINCT strftime(o_orderdate, '%b, %Y') AS label FROM orders")
def result_period_label(spark, d):
    return table(spark, d, "orders").select(F.date_format("o_orderdate", "MMM, yyyy").alias("label")).distinct()


# filters


def _filter(name, source, columns, condition, sql):
    query(f"SELECT {', '.join(columns)} FROM {source} WHERE {sql}", name)(lambda spark, d: table(spark, d, source).filter(condition()).select(*columns))


_O, _C = ["o_orderkey", "o_orderstatus", "o_totalprice"], ["c_custkey", "c_name", "c_acctbal"]
_filter("f_eq", "orders", _O, lambda: predicate("o_orderstatus", "=", "F"), "o_orderstatus = 'F'")
_filter("f_ne", "orders", _O, lambda: predicate("o_orderstatus", "!=", "F"), "o_orderstatus <> 'F'")
_filter("f_gt", "orders", _O, lambda: predicate("o_totalprice", ">", 200000.0), "o_totalprice > 200000.0")
_filter("f_ge", "customer", _C, lambda: predicate("c_acctbal", ">=", 5000.0), "c_acctbal >= 5000.0")
_filter("f_lt", "customer", _C, lambda: predicate("c_acctbal", "<", 0.0), "c_acctbal < 0.0")
_filter("f_le", "part", ["p_partkey", "p_size"], lambda: predicate("p_size", "<=", 10), "p_size <= 10")
_filter("f_in", "orders", _O, lambda: predicate("o_orderstatus", "in", ["F", "P"]), "o_orderstatus IN ('F', 'P')")
_filter("f_contains", "part", ["p_partkey", "p_name"], lambda: predicate("p_name", "contains", "1"), "contains(p_name, '1')")
_filter("f_like", "customer", _C, lambda: predicate("c_name", "like", "%1_"), "c_name LIKE '%1_'")
_filter("f_not_like", "customer", _C, lambda: predicate("c_name", "not_like", "%9%"), "c_name NOT LIKE '%9%'")
_filter("f_is_null", "events", ["event_id"], lambda: predicate("props", "is_null"), "props IS NULL")
_filter("f_is_not_null", "events", ["event_id"], lambda: predicate("props", "is_not_null"), "props IS NOT NULL")
_filter("f_between_or_between_num", "part", ["p_partkey", "p_size"], lambda: predicate("p_size", "between_or_between", "1,5|40,45"), "p_size BETWEEN 1 AND 5 OR p_size BETWEEN 40 AND 45")
_filter("f_between_or_between_text", "customer", ["c_custkey", "c_mktsegment"], lambda: predicate("c_mktsegment", "between_or_between", "A,B|M,Z"), "c_mktsegment BETWEEN 'A' AND 'B' OR c_mktsegment BETWEEN 'M' AND 'Z'")
_filter("f_implies", "customer", _C, lambda: implies(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 0), "c_mktsegment <> 'BUILDING' OR c_acctbal > 0")
_filter("f_ci_multi_search", "part", ["p_partkey"], lambda: any_contains(["p_name", "p_brand", "p_type"], "BRAND#1"), "contains(lower(p_name), 'brand#1') OR contains(lower(p_brand), 'brand#1') OR contains(lower(p_type), 'brand#1')")
_filter("f_trim_nonempty", "documents", ["doc_id"], lambda: F.col("text").isNotNull() & (F.trim("text") != ""), "text IS NOT NULL AND trim(text) <> ''")
_filter("f_expired", "orders", ["o_orderkey"], lambda: F.col("o_orderdate") < F.lit(AS_OF).cast("timestamp_ntz"), f"o_orderdate < TIMESTAMP '{AS_OF}'")

RANGES = [f"{w}_{u}" for w in ("this", "last", "next") for u in ("day", "week", "month", "year")]


def _range(op, months=1):
    start, end = dates.date_range(op, AS_OF, months)
    query(f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '{start}' AND o_orderdate < TIMESTAMP '{end}'", f"dr_{op}")(
        lambda spark, d: table(spark, d, "orders").filter(dates.within("o_orderdate", op, AS_OF, months)).select("o_orderkey", "o_orderdate")
    )


for _op in RANGES:
    _range(_op)
_range("rolling_months", 6)


def _ymd(column):
    return F.date_format(column, "yyyyMMdd").cast("int")


@query("SELECT o_orderkey FROM orders WHERE CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) >= 19980601 AND CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) < 19980701")
def dr_numeric_yyyymmdd(spark, d):
    return table(spark, d, "orders").filter(dates.within_numeric(_ymd("o_orderdate"), "last_month", AS_OF)).select("o_orderkey")


#: Named predicates: what a phrase stands for.
RULES = {"finished": ("o_orderstatus", "=", "F"), "open": ("o_orderstatus", "=", "O"), "pending": ("o_orderstatus", "=", "P")}


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def f_rule_named(spark, d):
    return table(spark, d, "orders").filter(predicate(*RULES["pending"])).select("o_orderkey")


# joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j_inner(spark, d):
    return report(spark, d, Report(["orders", "customer"], dimensions={"o_orderkey": F.col("o_orderkey"), "c_name": F.col("c_name")}))


def _outer(name, how):
    @query(f"SELECT c_custkey, o_orderkey FROM customer {how.upper()} JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o_custkey", name)
    def outer(spark, d):
        pending = table(spark, d, "orders").filter("o_orderstatus = 'P'")
        customer = table(spark, d, "customer")
        return customer.join(pending, customer.c_custkey == pending.o_custkey, how).select("c_custkey", "o_orderkey")


_outer("j_left", "left")
_outer("j_right", "right")
_outer("j_full", "full")


@query("""SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def j_bridge_multihop(spark, d):
    return report(spark, d, Report(["orders", "region"], [Measure("n", "count")], {"r_name": F.col("r_name")}))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
def j_left_then_filter(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").filter("o_orderstatus = 'F'").select("c_custkey", "o_orderkey")


# aggregates


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
def a_count(spark, d):
    return report(spark, d, Report(["orders"], [Measure("n", "count")]))


def _aggregate(f):
    query(f"SELECT round({f}(o_totalprice), 2) AS v FROM orders", f"a_{f}")(lambda spark, d: report(spark, d, Report(["orders"], [Measure("v", f, "o_totalprice", 2)])))


for _f in ("sum", "avg", "min", "max"):
    _aggregate(_f)


@query("SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority")
def a_multi_measure(spark, d):
    return report(spark, d, Report(["orders"], [Measure("n", "count"), Measure("total", "sum", "o_totalprice", 2), Measure("mean", "avg", "o_totalprice", 4)], {"o_orderpriority": F.col("o_orderpriority")}))


@query("SELECT c_mktsegment, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY c_mktsegment")
def a_group_one(spark, d):
    return report(spark, d, Report(["customer"], [Measure("balance", "sum", "c_acctbal", 2)], {"c_mktsegment": F.col("c_mktsegment")}))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def a_group_two(spark, d):
    return report(spark, d, Report(["lineitem"], [Measure("quantity", "sum", "l_quantity", 2), Measure("n", "count")], {"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus")}))


@query("SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS open, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS closed FROM orders")
def a_filtered_counts(spark, d):
    return table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))


@query("SELECT user_id, round(coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0), 2) AS bought FROM events GROUP BY user_id")
def a_coalesced_filtered_sum(spark, d):
    bought = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.coalesce(bought, F.lit(0.0)), 2).alias("bought"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem")
def a_high_volume_count(spark, d):
    return report(spark, d, Report(["lineitem"], [Measure("n", "count")]))


@query("SELECT n_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING sum(c_acctbal) IS NOT NULL ORDER BY balance DESC NULLS LAST, n_name LIMIT 5")
def a_ranking_having_not_null(spark, d):
    r = Report(["customer", "nation"], [Measure("balance", "sum", "c_acctbal", 2)], {"n_name": F.col("n_name")})
    return report(spark, d, r).filter("balance is not null").orderBy(F.desc_nulls_last("balance"), "n_name").limit(5)


@query("""SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name ORDER BY total DESC NULLS LAST, n_name LIMIT 10""")
def a_top_nations(spark, d):
    return report(spark, d, Report(["orders", "nation"], [Measure("total", "sum", "o_totalprice", 2)], {"n_name": F.col("n_name")}, [dates.within("o_orderdate", "this_year", date(1996, 6, 1))], [F.desc_nulls_last("total"), F.col("n_name")], 10))


def _grain(g):
    query(f"SELECT CAST(date_trunc('{g}', o_orderdate) AS TIMESTAMP) AS period, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", f"tg_{g}")(
        lambda spark, d: report(spark, d, Report(["orders"], [Measure("total", "sum", "o_totalprice", 2)], {"period": dates.time_grain("o_orderdate", g)}))
    )


_NUMERIC = {
    "day": "CAST(x AS INTEGER)",
    "month": "CAST(floor(x / 100) AS INTEGER)",
    "year": "CAST(floor(x / 10000) AS INTEGER)",
    "week": "CAST(date_trunc('week', strptime(CAST(x AS VARCHAR), '%Y%m%d')) AS DATE)",
    "quarter": "concat(CAST(CAST(floor(x / 10000) AS INTEGER) AS VARCHAR), '-Q', CAST(CAST(ceil((x // 100 % 100) / 3.0) AS INTEGER) AS VARCHAR))",
}


def _numeric_grain(g):
    query(f"SELECT {_NUMERIC[g]} AS period, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS x FROM orders) GROUP BY 1", f"tgnum_{g}")(
        lambda spark, d: table(spark, d, "orders").groupBy(dates.numeric_grain(_ymd("o_orderdate"), g).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    )


for _g in ("day", "week", "month", "quarter", "year"):
    _grain(_g)
    _numeric_grain(_g)


@query("""SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, (ts, event_id)) AS close, round(sum(value), 2) AS volume FROM events GROUP BY 1, 2""")
def a_ohlc_5m(spark, d):
    at = F.struct("ts", "event_id")
    bars = table(spark, d, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"].cast("timestamp_ntz").alias("bucket"))
    return bars.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.round(F.sum("value"), 2).alias("volume"))


@query("""WITH s AS (SELECT source, 100.0 * count(*) FILTER (WHERE lang = 'en') / count(*) AS a, 100.0 * count(*) FILTER (WHERE n_chars > 500) / count(*) AS b,
    100.0 * count(*) FILTER (WHERE n_chars < 20000) / count(*) AS c FROM documents GROUP BY source)
    SELECT source, CAST(round_even(0.30 * a + 0.45 * b + 0.25 * c, 0) AS INTEGER) AS score,
    CASE WHEN round_even(0.30 * a + 0.45 * b + 0.25 * c, 0) >= 80 THEN 'ready' WHEN round_even(0.30 * a + 0.45 * b + 0.25 * c, 0) >= 60 THEN 'nearly' ELSE 'early' END AS band FROM s""")
def a_readiness_dashboard(spark, d):
    share = lambda c: 100.0 * F.count_if(c) / F.count(F.lit(1))
    s = table(spark, d, "documents").groupBy("source").agg(share(F.col("lang") == "en").alias("a"), share(F.col("n_chars") > 500).alias("b"), share(F.col("n_chars") < 20000).alias("c"))
    score = F.bround(0.30 * F.col("a") + 0.45 * F.col("b") + 0.25 * F.col("c"), 0).cast("int")
    return s.select("source", score.alias("score")).withColumn("band", F.when(F.col("score") >= 80, "ready").when(F.col("score") >= 60, "nearly").otherwise("early"))


# snapshots


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, date_trunc('month', ts) AS period FROM events)
    SELECT event_type, round(sum(value), 2) AS value FROM e JOIN (SELECT period, max(day) AS day FROM e GROUP BY period) USING (period, day) GROUP BY event_type""")
def snap_latest_per_month(spark, d):
    rows = latest_per_period(table(spark, d, "events"), F.to_date("ts"), F.date_trunc("month", "ts"))
    return rows.groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("value"))


@query("""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, datediff('day', DATE '2024-01-03', CAST(ts AS DATE)) // 7 AS period FROM events WHERE ts >= TIMESTAMP '2024-01-03')
    SELECT CAST(period AS INTEGER) AS period, round(sum(value), 2) AS value FROM e JOIN (SELECT period, max(day) AS day FROM e GROUP BY period) USING (period, day) GROUP BY period""")
def snap_latest_per_week_fromstart(spark, d):
    week = F.floor(F.datediff(F.to_date("ts"), F.lit(date(2024, 1, 3))) / 7).cast("int")
    rows = table(spark, d, "events").filter(F.col("ts") >= F.lit(date(2024, 1, 3)).cast("timestamp_ntz"))
    return latest_per_period(rows, F.to_date("ts"), week).groupBy(week.alias("period")).agg(F.round(F.sum("value"), 2).alias("value"))


@query("""WITH e AS (SELECT *, date_trunc('month', l_shipdate) AS period FROM lineitem)
    SELECT l_returnflag, CAST(period AS TIMESTAMP) AS period, round(sum(l_quantity), 2) AS quantity FROM e JOIN (SELECT period, max(l_shipdate) AS l_shipdate FROM e GROUP BY period) USING (period, l_shipdate) GROUP BY ALL""")
def snap_sum_by_dim(spark, d):
    month = dates.time_grain("l_shipdate", "month")
    return latest_per_period(table(spark, d, "lineitem"), F.col("l_shipdate"), month).groupBy("l_returnflag", month.alias("period")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


# order and top-k


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
def o_top_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS LAST, o_orderkey LIMIT 10")
def o_bottom_n(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.asc_nulls_last("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def o_count_rank(spark, d):
    return report(spark, d, Report(["orders"], [Measure("n", "count")], {"o_custkey": F.col("o_custkey")}, order=[F.desc("n"), F.col("o_custkey")], limit=10))


@query("SELECT c_custkey, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY top DESC NULLS LAST, c_custkey LIMIT 50")
def o_nulls_last(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.max("o_totalprice").alias("top")).orderBy(F.desc_nulls_last("top"), "c_custkey").limit(50)


@query("SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 24")
def o_timeseries_order(spark, d):
    period = dates.time_grain("o_orderdate", "month")
    return report(spark, d, Report(["orders"], [Measure("n", "count")], {"period": period}, order=[F.asc_nulls_last("period")], limit=24))


_SECTIONS = "SELECT concat(CAST(p_size AS VARCHAR), '.', CAST(p_partkey % 13 AS VARCHAR)) AS section, p_partkey FROM part"


@query(f"SELECT section, p_partkey FROM ({_SECTIONS}) ORDER BY CAST(split_part(section, '.', 1) AS INTEGER), CAST(split_part(section, '.', 2) AS INTEGER), p_partkey LIMIT 100")
def o_natural_section_sort(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string")).alias("section"), "p_partkey")
    key = F.transform(F.split("section", "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(999999)))
    return rows.orderBy(key, "p_partkey").limit(100)


# the same orders over every row, with the place in the order as a column


@query("""SELECT c_nationkey, c_custkey, top, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY top DESC NULLS LAST, c_custkey) AS INTEGER) AS place
    FROM (SELECT c_nationkey, c_custkey, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)""")
def o_nulls_last_all(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_nationkey", "c_custkey").agg(F.max("o_totalprice").alias("top"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc_nulls_last("top"), "c_custkey")))


@query("""SELECT period, n, CAST(row_number() OVER (ORDER BY period) AS INTEGER) AS place
    FROM (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS period, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1)""")
def o_timeseries_order_all(spark, d):
    rows = report(spark, d, Report(["orders"], [Measure("n", "count")], {"period": dates.time_grain("o_orderdate", "month")}))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("period"))))


@query(f"""SELECT p_brand, section, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CAST(split_part(section, '.', 1) AS INTEGER), CAST(split_part(section, '.', 2) AS INTEGER), p_partkey) AS INTEGER) AS place
    FROM ({_SECTIONS}) JOIN (SELECT p_partkey, p_brand FROM part) USING (p_partkey)""")
def o_natural_section_sort_all(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string")).alias("section"), "p_partkey")
    key = F.transform(F.split("section", "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(999999)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(key, "p_partkey")))


# sets


@query("SELECT s_name AS name FROM supplier UNION ALL SELECT c_name FROM customer")
def s_union_all(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("name")).unionByName(table(spark, d, "customer").select(F.col("c_name").alias("name")))


@query("""SELECT CAST(count(*) FILTER (WHERE s.k IS NULL) AS BIGINT) AS new, CAST(count(*) FILTER (WHERE c.k IS NULL) AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE s.k = c.k) AS BIGINT) AS kept
    FROM (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey < 20) s FULL JOIN (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey > 3) c ON s.k = c.k""")
def s_catalog_diff(spark, d):
    s = table(spark, d, "supplier").filter("s_nationkey < 20").select(F.col("s_nationkey").alias("s")).distinct()
    c = table(spark, d, "customer").filter("c_nationkey > 3").select(F.col("c_nationkey").alias("c")).distinct()
    both = s.join(c, s.s == c.c, "full")
    return both.agg(F.count_if(F.col("s").isNull()).alias("new"), F.count_if(F.col("c").isNull()).alias("removed"), F.count_if(F.col("s") == F.col("c")).alias("kept"))


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
    FROM customer JOIN orders ON c_custkey = o_custkey) WHERE rn <= 3""")
def o_latest_per_customer(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    w = Window.partitionBy("c_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey).withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_type), 'an') AND p_name LIKE '%a%'")
def f_contains_some(spark, d):
    """Contains, with a value that occurs."""
    return table(spark, d, "part").filter(F.lower("p_type").contains("an") & F.col("p_name").contains("a")).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NULL")
def f_is_null_some(spark, d):
    """Is null, over a column that has nulls."""
    return table(spark, d, "customer").filter(F.nullif("c_mktsegment", F.lit("BUILDING")).isNull()).select("c_custkey")
