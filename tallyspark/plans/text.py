"""Text functions over documents, conversations and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.functions import text as T
from tallyspark.sources import table

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[_\\-]+', ' ', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce({{c}}, '')), '[a-z0-9]+'), lambda w: len(w) > 2 AND NOT list_contains({_STOP}, w))"


def _alone(c, p):
    return f"regexp_matches(lower({c}), '(^|[^a-z0-9]){p}($|[^a-z0-9])')"


@query(f"SELECT p_partkey, {_NORM.format(c='p_type')} AS v FROM part")
def t_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.normalized(F.col("p_type")).alias("v"))


@query(f"SELECT item_id, array_to_string({_TOKENS.format(c='text')}, ' ') AS v FROM benchmark")
def t_tokenize(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.tokens(F.col("text")), " ").alias("v"))


_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark"


@query(f"""SELECT w, CASE WHEN regexp_matches(w, 'ies$') AND len(w) > 3 THEN concat(w[:-4], 'y') WHEN regexp_matches(w, '(ch|sh|x|z|s)es$') THEN w[:-3]
    WHEN regexp_matches(w, '[^s]s$') THEN w[:-2] ELSE w END AS v FROM ({_WORDS})""")
def t_singularize(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).distinct()
    return w.select("w", T.singular(F.col("w")).alias("v"))


@query(f"SELECT doc_id FROM documents WHERE {_alone('text', 'the')}")
def t_phrase_match(spark, d):
    return table(spark, d, "documents").filter(T.has_phrase(F.col("text"), "the")).select("doc_id")


@query(f"SELECT item_id, CAST(len(list_distinct({_TOKENS.format(c='text')})) AS INTEGER) AS n FROM benchmark")
def t_keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n"))


#: Requests as a table: (id, text), made from the order statuses and priorities.
_REQUESTS = """SELECT o_orderkey AS id, concat(CASE o_orderkey % 6 WHEN 0 THEN 'count ' WHEN 1 THEN 'show top 10 ' WHEN 2 THEN 'monthly trend of ' WHEN 3 THEN 'compare ' WHEN 4 THEN 'delete ' ELSE 'list ' END,
    CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'pending' END, ' orders ', CASE o_orderkey % 4 WHEN 0 THEN 'this month' WHEN 1 THEN 'last year' WHEN 2 THEN 'today' ELSE 'ever' END) AS text FROM orders"""


def _requests(spark, d):
    k = F.col("o_orderkey")
    verb = F.when(k % 6 == 0, "count ").when(k % 6 == 1, "show top 10 ").when(k % 6 == 2, "monthly trend of ").when(k % 6 == 3, "compare ").when(k % 6 == 4, "delete ").otherwise("list ")
    state = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("pending")
    when = F.when(k % 4 == 0, "this month").when(k % 4 == 1, "last year").when(k % 4 == 2, "today").otherwise("ever")
    return table(spark, d, "orders").select(k.alias("id"), F.concat(verb, state, F.lit(" orders "), when).alias("text"))


def _found(phrases):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_alone('text', p)} THEN '{p}' END" for p in phrases) + "], lambda x: x IS NOT NULL), ',')"


@query(f"SELECT id, {_found(T.TIME_PHRASES)} AS v FROM ({_REQUESTS})")
def t_time_expr(spark, d):
    return _requests(spark, d).select("id", F.array_join(T.matching(F.col("text"), T.TIME_PHRASES), ",").alias("v"))


@query(f"SELECT id, {_found(T.STATUS_TERMS)} AS v FROM ({_REQUESTS})")
def t_status_terms(spark, d):
    return _requests(spark, d).select("id", F.array_join(T.matching(F.col("text"), T.STATUS_TERMS), ",").alias("v"))


def _any(*words):
    return " OR ".join(_alone("text", w) for w in words)


_INTENT = f"""CASE WHEN {_any('delete', 'drop', 'update', 'insert', 'truncate')} THEN 'blocked' WHEN {_any('count', 'how many')} THEN 'count' WHEN {_any('top', 'highest', 'lowest')} THEN 'ranking'
    WHEN {_any('trend', 'monthly')} THEN 'trend' WHEN {_any('compare', 'versus')} THEN 'comparison' WHEN {_any('expired', 'expiring')} THEN 'expiry' WHEN {_any('total', 'average', 'sum')} THEN 'aggregation'
    WHEN {_any('show', 'list')} THEN 'select' ELSE 'unknown' END"""


@query(f"SELECT id, {_INTENT} AS v FROM ({_REQUESTS})")
def t_intent(spark, d):
    return _requests(spark, d).select("id", T.intent(F.col("text")).alias("v"))


@query(f"SELECT {_INTENT} AS v, CAST(count(*) AS BIGINT) AS n FROM ({_REQUESTS}) GROUP BY 1")
def t_route(spark, d):
    return _requests(spark, d).groupBy(T.intent(F.col("text")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('custAcctBal', 'customer account balance'), ('order_qty', 'order quantity'), ('SUPP_NO', 'supplier number')) t(c, v)")
def t_identifier_words(spark, d):
    names = table(spark, d, "region").select(F.explode(F.array(F.lit("custAcctBal"), F.lit("order_qty"), F.lit("SUPP_NO"))).alias("c")).distinct()
    return names.select("c", T.identifier_words(F.col("c")).alias("v"))


@query("SELECT column_name AS c, regexp_matches(lower(column_name), '" + "|".join(T.SENSITIVE) + "') AS v FROM (SELECT unnest(['c_name', 'c_acctbal', 'customer_email', 'PHONE_NO', 'routing']) AS column_name)")
def t_sensitive(spark, d):
    names = table(spark, d, "region").select(F.explode(F.array(*[F.lit(x) for x in ("c_name", "c_acctbal", "customer_email", "PHONE_NO", "routing")])).alias("c")).distinct()
    return names.select("c", F.lower("c").rlike("|".join(T.SENSITIVE)).alias("v"))


_SPELLED = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ABBREVIATIONS.items()) + " ELSE w END"


@query(rf"""SELECT c, array_to_string(list_transform(string_split(trim(regexp_replace(lower(regexp_replace(c, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: {_SPELLED}), ' ') AS v
    FROM (SELECT c_name AS c FROM customer UNION SELECT event_type FROM events)""")
def t_identifier_words_rows(spark, d):
    names = table(spark, d, "customer").select(F.col("c_name").alias("c")).unionByName(table(spark, d, "events").select(F.col("event_type").alias("c"))).distinct()
    return names.select("c", T.identifier_words(F.col("c")).alias("v"))


@query("SELECT DISTINCT text AS c, regexp_matches(lower(text), '" + "|".join(T.SENSITIVE) + "') AS v FROM conversations")
def t_sensitive_rows(spark, d):
    return table(spark, d, "conversations").select(F.col("text").alias("c")).distinct().select("c", F.lower("c").rlike("|".join(T.SENSITIVE)).alias("v"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\d+\.\d+\.\d+'))), ',') AS v FROM documents")
def t_clause_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+\.\d+\.\d+"), F.lit(0)))), ",").alias("v"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y/%m') AS p, CAST(regexp_extract(strftime(o_orderdate, '%Y/%m'), '((19|20)[0-9]{2})', 1) AS INTEGER) AS year FROM orders")
def t_year_parse(spark, d):
    p = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy/MM").alias("p")).distinct()
    return p.select("p", F.regexp_extract("p", "((19|20)[0-9]{2})", 1).cast("int").alias("year"))


@query("SELECT c_custkey, CAST(round_even(c_acctbal, 0) AS BIGINT) AS v FROM customer")
def t_fin_number(spark, d):
    shown = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("c_acctbal", 2))
    return table(spark, d, "customer").select("c_custkey", T.financial_number(shown).alias("v"))


@query("SELECT l_orderkey, l_linenumber, abs(l_extendedprice - abs(l_discount) - l_tax) <= greatest(5, l_extendedprice * 1e-5) AS v FROM lineitem")
def t_accounting_check(spark, d):
    off = F.abs(F.col("l_extendedprice") - F.abs("l_discount") - F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (off <= F.greatest(F.lit(5.0), F.col("l_extendedprice") * 1e-5)).alias("v"))


@query("""SELECT item_id, substr(trim(regexp_replace(substr(text, greatest(1, p - 80), p + 160 - greatest(1, p - 80)), '\\s+', ' ', 'g')), 1, 240) AS v
    FROM (SELECT *, instr(text, 'the') AS p FROM benchmark) WHERE p > 0""")
def t_snippet_window(spark, d):
    at = F.instr("text", "the")
    return table(spark, d, "benchmark").filter(at > 0).select("item_id", T.snippet(F.col("text"), at).alias("v"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN concat(format('{:,.2f}', o_totalprice / 1e6), 'M') WHEN o_totalprice >= 1e3 THEN concat(format('{:,.2f}', o_totalprice / 1e3), 'K')
    ELSE format('{:,.2f}', o_totalprice) END AS v FROM orders""")
def t_compact_number(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.compact(F.col("o_totalprice")).alias("v"))


@query("""SELECT n_name, array_to_string([n_name, 'x'], '|') AS v FROM nation""")
def t_json_or_csv_list(spark, d):
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.array("n_name", F.lit("x"), F.lit(" ")))).otherwise(F.concat(F.col("n_name"), F.lit("; x,x,")))
    return table(spark, d, "nation").select("n_name", F.array_join(T.listed(raw), "|").alias("v"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def t_props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT doc_id, sha256(text) AS v FROM documents")
def t_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("v"))


@query(f"""WITH t AS (SELECT item_id, list_distinct({_TOKENS.format(c='text')}) AS w FROM benchmark), q AS (SELECT w FROM t WHERE item_id = 0)
    SELECT item_id, CAST(len(list_filter(t.w, lambda x: list_contains(q.w, x))) AS INTEGER) AS common, CAST(len(list_filter(t.w, lambda x: NOT list_contains(q.w, x))) AS INTEGER) AS missing FROM t, q""")
def s_token_intersection_difference(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    q = t.filter("item_id = 0").select(F.col("w").alias("q"))
    return t.join(F.broadcast(q)).select("item_id", F.size(F.array_intersect("w", "q")).alias("common"), F.size(F.array_except("w", "q")).alias("missing"))
