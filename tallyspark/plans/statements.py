"""Paths between hosts over what their pages link to, checked figures of statements, mixed evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.operators import paths as P
from tallyspark.operators import statements as S
from tallyspark.plans.web import HREF
from tallyspark.sources import table

_EDGES = """p AS (SELECT lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, list_distinct(list_transform(regexp_extract_all(html, 'href=["'']([^"''#]+)', 1), lambda x: lower(x))) AS links FROM pages),
    h AS (SELECT host, count(*) AS n FROM p WHERE host <> '' GROUP BY 1),
    e AS (SELECT host AS src, dst, CAST(round(100.0 * count(*) / any_value(n)) AS INTEGER) AS c FROM (SELECT host, unnest(links) AS dst FROM p) JOIN h USING (host) GROUP BY 1, 2),
    g AS (SELECT * FROM e UNION ALL SELECT dst, src, c FROM e), w AS (SELECT src, dst, max(c) AS c FROM g WHERE src <> dst GROUP BY 1, 2),
    q AS (SELECT host AS s, lead(host) OVER (ORDER BY host) AS t FROM h QUALIFY t IS NOT NULL)"""


def _levels(most):
    out = ["r0 AS (SELECT DISTINCT s, s AS node, {'n': 0, 'path': [s], 'sure': CAST([] AS INTEGER[])} AS b FROM q)"]
    for k in range(most):
        out.append(f"""r{k + 1} AS (SELECT s, node, min(b) AS b FROM (SELECT * FROM r{k} UNION ALL SELECT s, dst, {{'n': b.n + 1, 'path': list_append(b.path, dst), 'sure': list_append(b.sure, c)}} FROM r{k} JOIN w ON node = src WHERE b.n = {k}) GROUP BY 1, 2)""")
    return ", ".join(out)


@query(f"""WITH {_EDGES}, {_levels(P.MOST_STEPS)}
    SELECT s AS start, t AS "end", b.n AS steps, CAST(round_even(list_sum(b.sure) / len(b.sure), 0) AS INTEGER) AS confidence, array_to_string(b.path, ' ') AS path FROM r{P.MOST_STEPS} JOIN q USING (s) WHERE node = t""")
def n_paths(spark, d):
    """From each host to the next in order, the shortest path over what pages of both link to."""
    pages = table(spark, d, "pages").select(F.lower(F.regexp_extract("url", "^https?://([^/?#:]*)", 1)).alias("host"), "html").filter("host <> ''")
    links = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: F.lower(x)))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    edges = pages.select("host", F.explode(links).alias("dst")).groupBy("host", "dst").agg(F.count(F.lit(1)).alias("k")).join(sizes, "host")
    edges = edges.select(F.col("host").alias("src"), "dst", F.round(100.0 * F.col("k") / F.col("n")).cast("int").alias("confidence"))
    # the host after each in order, found by ranks that no single task makes for all rows
    pairs = sizes.select("host").sort("host").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("host")
    inside = pairs.select("part", "host", F.lead("host").over(within).alias("end"))
    # only the last host of a part looks for the first of the next part: one row a part
    heads = pairs.groupBy("part").agg(F.min("host").alias("host")).select(F.lead("host").over(Window.orderBy("part")).alias("next"), "part")
    pairs = inside.join(heads, "part").select(F.col("host").alias("start"), F.coalesce("end", "next").alias("end"))
    found = P.shortest(edges, pairs)
    return found.select("start", "end", "steps", "confidence", F.array_join("path", " ").alias("path"))


REVENUE = S.Checked(
    heading="Revenue from orders",
    gross=[r"\bGross amount\b", r"\bTotal amount\b"],
    allowance=[r"\bDiscount allowance\b"],
    net=[r"\bNet amount\b"],
    prefix="revenue",
)
_YEARS = (1996, 1995)
#: Two figures of a supplier and year: its price and its discounts, in whole units.
_GROSS, _ALLOWANCE = "CAST(floor(l_extendedprice) AS BIGINT)", "CAST(floor(l_extendedprice * l_discount) AS BIGINT)"


def statements(spark, d):
    """(doc_id, text): a statement of each supplier's lines, as text; some with a net figure that can't be right."""
    lines = table(spark, d, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), F.expr(_GROSS).alias("gross"), F.expr(_ALLOWANCE).alias("allowance")).filter(F.col("y").isin(*_YEARS))
    sums = lines.groupBy("l_suppkey").agg(*[F.coalesce(F.sum(F.when(F.col("y") == y, F.col(c))), F.lit(0)).alias(f"{c}{y}") for y in _YEARS for c in ("gross", "allowance")])
    shown = lambda c: F.format_number(c, 0)
    both = lambda f: F.concat_ws("   ", *[f(y) for y in _YEARS])
    # every seventh supplier's net of the later year is misread by a thousand and its gross
    net = lambda y: F.col(f"gross{y}") - F.col(f"allowance{y}") + (F.when(F.col("l_suppkey") % 7 == 0, F.col(f"gross{y}") + 1000).otherwise(0) if y == _YEARS[0] else 0)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Statement of supplier "), F.col("l_suppkey").cast("string")),
        F.lit(f"31 December {_YEARS[0]}   31 December {_YEARS[1]}"),
        F.lit("14. Other income\nGross amount   1,111   2,222"),
        F.lit("15. Revenue from orders"),
        F.concat(F.when(F.col("l_suppkey") % 2 == 0, "Gross amount   ").otherwise("Total amount   "), both(lambda y: shown(F.col(f"gross{y}")))),
        F.concat(F.lit("Less: Discount allowance   "), both(lambda y: F.concat(F.lit("("), shown(F.col(f"allowance{y}")), F.lit(")")))),
        F.concat(F.lit("Net amount   "), both(lambda y: shown(net(y)))),
        F.lit("16. Borrowings\nNet amount   3   4"),
    )
    return sums.select(F.col("l_suppkey").alias("doc_id"), text.alias("text"))


@query(f"""WITH s AS (SELECT l_suppkey AS doc_id, year(l_shipdate) AS year, sum({_GROSS}) AS gross, sum({_ALLOWANCE}) AS allowance FROM lineitem WHERE year(l_shipdate) IN {_YEARS} GROUP BY 1, 2),
    k AS (SELECT * FROM s WHERE gross > 0 AND NOT (doc_id % 7 = 0 AND year = {_YEARS[0]}))
    SELECT doc_id, unnest(['revenue_gross', 'revenue_allowance', 'revenue_net']) AS fact, CAST(year AS INTEGER) AS year, CAST(unnest([gross, allowance, gross - allowance]) AS BIGINT) AS value FROM k""")
def d_statement_facts(spark, d):
    """Figures read from statements, those alone whose three figures agree; the SQL has them from the rows themselves."""
    return S.facts(statements(spark, d), [REVENUE])


_PIECE = 400
MIX = S.Mix(groups=[["the ", " and "], [" der ", " die "], [" les ", " une "]], terms=["ring", "que", "est", "ung", "tion", "ment", "elle", "sch"], excluded=["thisis"], dated=["en", "er"], units=["qu"], narrative=8, most=6_000, mandatory_chars=2_000)


def _sql_hits(words):
    return "(" + " + ".join(f"CAST(contains(low, '{w}') AS INTEGER)" for w in words) + ")"


_EXTRA = f"CASE WHEN {_sql_hits(MIX.dated)} = {len(MIX.dated)} THEN 2 ELSE 0 END + CASE WHEN {_sql_hits(MIX.units)} > 0 THEN 1 ELSE 0 END"
_BEST = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS g, arg_min(chunk, {{'s': -(10 * {_sql_hits(w)} + {_EXTRA}), 'c': chunk}}) AS chunk FROM c WHERE {_sql_hits(w)} > 0 GROUP BY 1" for i, w in enumerate(MIX.groups)
)


@query(f"""WITH a AS (SELECT doc_id, k AS chunk, substr(text, k * {_PIECE} + 1, {_PIECE}) AS content FROM (SELECT doc_id, text, unnest(range((length(text) + {_PIECE - 1}) // {_PIECE})) AS k FROM documents WHERE text IS NOT NULL)),
    c AS (SELECT *, lower(content) AS low FROM a WHERE trim(content) <> '' AND NOT ({" OR ".join(f"contains(lower(content), '{w}')" for w in MIX.excluded)})),
    b AS ({_BEST}), m AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY min(g)) - 1 AS place FROM b GROUP BY 1, 2),
    n AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY doc_id ORDER BY {_sql_hits(MIX.terms)} DESC, chunk) - 1 AS place FROM c ANTI JOIN m USING (doc_id, chunk) WHERE {_sql_hits(MIX.terms)} > 0 QUALIFY place < {MIX.narrative}),
    u AS (SELECT *, 'mandatory' AS part, greatest(800, {MIX.mandatory_chars} // count(*) OVER (PARTITION BY doc_id)) AS room FROM m UNION ALL SELECT *, 'narrative', greatest(250, {MIX.most - MIX.mandatory_chars} // count(*) OVER (PARTITION BY doc_id)) FROM n),
    t AS (SELECT doc_id, part, place, CASE part WHEN 'mandatory' THEN 'VERIFIED' ELSE 'NARRATIVE' END || ' EVIDENCE ' || (place + 1) || chr(10) || 'CONTENT:' || chr(10) || substr(trim(content), 1, room) AS block FROM u JOIN c USING (doc_id, chunk))
    SELECT doc_id, md5(substr(string_agg(block, chr(10) || chr(10) ORDER BY part, place), 1, {MIX.most})) AS evidence FROM t GROUP BY 1""")
def d_mixed_evidence(spark, d):
    """The evidence of every document: its best chunk for each group, then the chunks with most terms, in two budgets."""
    docs = table(spark, d, "documents").filter("text is not null and text <> ''")
    last = F.floor((F.length("text") - 1) / _PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring("text", k * _PIECE + 1, F.lit(_PIECE)))
    chunks = docs.select("doc_id", F.posexplode(pieces).alias("chunk", "content"))
    return S.evidence_text(S.mixed(chunks, MIX), MIX.most).select("doc_id", F.md5(F.col("evidence").cast("binary")).alias("evidence"))
