"""Grounded answers, snippets of pages and the state of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.functions.text import bound
from tallyspark.operators import conversation as C
from tallyspark.operators import grounding as G
from tallyspark.operators.discovery import exactly_one
from tallyspark.plans.web import _sql_text, page_text
from tallyspark.sources import table

_CHUNK = 3500
_W = "string_split(regexp_replace(trim(text), '\\s+', ' ', 'g'), ' ')"
#: The metadata lines that a text gets, after some of its words, and what an answer proposes: both from the text's own words.
_FIELDS = ["document_id", "version", "effective_date", "review_cycle", "target_audience", "enforcement_level", "governance_owner"]


def _described(spark, d):
    """(doc_id, text, answer): each text with the labels of its metadata among its words, and a proposal in JSON."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", w.alias("w"))
    word = lambda i: F.get("w", i.cast("int"))
    at = [((F.col("doc_id") * 13 + 29 * i) % F.size("w")) for i in range(7)]
    label = [F.get(F.array(*[F.lit(x) for x in G.LABELS[f]]), (F.col("doc_id") % len(G.LABELS[f])).cast("int")) for f in _FIELDS]
    # before the word at each place stands a label; the answer's value is a word some way on
    labels = F.array(*[F.struct(a.alias("at"), F.concat(F.initcap(n), F.lit(": ")).alias("label")) for a, n in zip(at, label, strict=True)])
    put = lambda own, x, i: F.when(F.exists(own, lambda s: s["at"] == i), F.concat(F.array_join(F.transform(F.filter(own, lambda s: s["at"] == i), lambda s: s["label"]), ""), x)).otherwise(x)
    marked = bound(labels, lambda own: F.transform("w", lambda x, i: put(own, x, i)))
    value = [word((a + (F.col("doc_id") % 40)) % F.size("w")) for a in at]
    answer = F.to_json(F.struct(F.array_join(F.slice("w", 1, 4), " ").alias("title"), *[v.alias(f) for f, v in zip(_FIELDS, value, strict=True)]))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(F.col("doc_id") % 17 == 1, F.substring(answer, 2, 40)).otherwise(answer)
    return docs.select("doc_id", F.array_join(marked, " ").alias("text"), fenced.alias("answer"))


def _sql_described():
    at = [f"((doc_id * 13 + {29 * i}) % len(w))" for i in range(7)]
    label = [f"[{', '.join(repr(x.title()) for x in G.LABELS[f])}][doc_id % {len(G.LABELS[f])} + 1]" for f in _FIELDS]
    marks = ", ".join(f"CASE WHEN {a} = i - 1 THEN {n} || ': ' ELSE '' END" for a, n in zip(at, label, strict=True))
    values = [("title", "array_to_string(w[1:4], ' ')")] + [(f, f"w[({a} + doc_id % 40) % len(w) + 1]") for f, a in zip(_FIELDS, at, strict=True)]
    return marks, values


_MARKS, _VALUES = _sql_described()
_DESCRIBED = f"""(SELECT doc_id, w, array_to_string(list_transform(w, lambda x, i: concat({_MARKS}, x)), ' ') AS text FROM (SELECT doc_id, {_W} AS w FROM documents WHERE text IS NOT NULL))"""
_NEAR = " OR ".join(
    f"(field = '{f}' AND ({' OR '.join(f'''(strpos(t, '{x}') > 0 AND abs(strpos(t, '{x}') - strpos(t, v)) <= {G.NEAR})''' for x in labels)}))" for f, labels in G.LABELS.items() if labels
)


@query(f"""WITH m AS (SELECT doc_id, w, text FROM {_DESCRIBED}),
    p AS (SELECT doc_id, unnest([{", ".join(f"{{'field': '{f}', 'value': CASE WHEN doc_id % 3 <> 0 AND doc_id % 17 = 1 THEN NULL ELSE trim({v}) END}}" for f, v in _VALUES)}], recursive := true) FROM m),
    c AS (SELECT doc_id, lower(trim(regexp_replace(substr(text, k * {_CHUNK} + 1, {_CHUNK}), '\\s+', ' ', 'g'))) AS t, k FROM (SELECT doc_id, text, unnest(range((length(text) + {_CHUNK - 1}) // {_CHUNK})) AS k FROM m)),
    a AS (SELECT doc_id, string_agg(t, ' ' ORDER BY k) AS t FROM c GROUP BY 1),
    g AS (SELECT DISTINCT doc_id, field FROM (SELECT doc_id, field, lower(value) AS v FROM p WHERE value <> '') JOIN c USING (doc_id) WHERE strpos(t, v) > 0 AND ({_NEAR})
        UNION SELECT p.doc_id, field FROM p JOIN a USING (doc_id) WHERE field = 'title' AND value <> '' AND strpos(t, lower(value)) > 0)
    SELECT p.doc_id, p.field, CASE WHEN g.field IS NULL THEN '{G.FALLBACK}' ELSE value END AS value, g.field IS NOT NULL AS grounded FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.field = g.field""")
def d_metadata_grounding(spark, d):
    """The proposed metadata of every document, each field grounded in a chunk or the fallback."""
    rows = _described(spark, d)
    starts = lambda t: F.sequence(F.lit(0), F.greatest(F.floor((F.length(t) - 1) / _CHUNK), F.lit(0)).cast("int"))
    pieces = bound(F.col("text"), lambda t: F.transform(starts(t), lambda k: F.substring(t, k * _CHUNK + 1, F.lit(_CHUNK))))
    chunks = rows.select("doc_id", F.posexplode(pieces).alias("chunk", "content"))
    return G.grounded(rows.select("doc_id", "answer"), chunks)


_TERMS = ["and", "reier", "thing", "der", "les", "ring", "que", "ung", "the", "est"]
_TERM_LIST = "[" + ", ".join(f"'{t}'" for t in _TERMS) + "]"


@query(f"""WITH l AS (SELECT page_id, string_split({_sql_text('html')}, chr(10)) AS lines FROM pages),
    m AS (SELECT page_id, lines, list_filter(list_transform(lines, lambda x, i: {{'s': len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(x), '[a-z0-9]+'), lambda w: len(w) > 2)), {_TERM_LIST})), 'i': i}}), lambda r: r.s > 0) AS marked FROM l),
    r AS (SELECT page_id, lines, list_transform(list_sort(list_transform(marked, lambda r: {{'s': -r.s, 'i': r.i}})), lambda r: [r.i]) AS ranked FROM m),
    t AS (SELECT page_id, lines, list_reduce(list_concat([list_filter([0], lambda x: x > 0)], ranked), lambda a, x: CASE WHEN len(a) >= 8 OR len(list_filter(a, lambda t: abs(t - x[1]) <= 4)) > 0 THEN a ELSE list_concat(a, x) END) AS taken FROM r),
    k AS (SELECT page_id, unnest(taken) AS i, generate_subscripts(taken, 1) AS k, lines FROM t)
    SELECT page_id, CAST(k - 1 AS INTEGER) AS k, array_to_string(lines[greatest(i - 2, 1):i + 2], chr(10)) AS snippet FROM k""")
def w_snippets(spark, d):
    """The best snippets of every page for some terms, in the order they are taken."""
    lines = F.split(page_text(F.col("html")), "\n", -1)
    rows = table(spark, d, "pages").select("page_id", lines.alias("lines"))
    return rows.select("page_id", F.posexplode(G.snippets(F.col("lines"), _TERMS)).alias("k", "snippet"))


_WORDS = "string_split(text, ' ')"


def _prompts(spark, d):
    """(conv_id, turn, prompt): user turns as requests; the names in them are words of the turn."""
    rows = table(spark, d, "conversations").filter("role = 'user' and text is not null")
    w = F.split("text", " ")
    name = F.concat(F.get(w, F.lit(0)), F.lit(" "), F.coalesce(F.get(w, F.lit(1)), F.lit("Main")))
    code = F.get(F.array(*[F.lit(c) for c in C.CURRENCIES]), (F.length("text") % len(C.CURRENCIES)).cast("int"))
    forms = [
        F.lit("Show active account balance report by branch"),
        F.concat(F.lit("top "), F.size(w).cast("string"), F.lit(" only")),
        F.concat(F.lit("now in "), name, F.lit(" district")),
        F.concat(F.lit("only "), name, F.lit(" branch")),
        F.lit("inactive instead"),
        F.concat(F.lit("same in "), code, F.lit(" this month")),
        F.lit("lowest to highest"),
        F.col("text"),
        F.lit("List number of customers per district today, first 20, smallest to largest"),
    ]
    k = (F.col("conv_id") * 5 + F.col("turn") * 7 + F.length("text")) % len(forms)
    return rows.select("conv_id", "turn", F.get(F.array(*forms), k.cast("int")).alias("prompt"))


def _any_sql(words):
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


def _first_sql(cases):
    return "CASE " + " ".join(f"WHEN {test} THEN '{value}'" for test, value in cases) + " END"


_NAME = f"concat({_WORDS}[1], ' ', coalesce({_WORDS}[2], 'Main'))"
_FORMS = [
    "'Show active account balance report by branch'",
    f"concat('top ', len({_WORDS}), ' only')",
    f"concat('now in ', {_NAME}, ' district')",
    f"concat('only ', {_NAME}, ' branch')",
    "'inactive instead'",
    f"concat('same in ', [{', '.join(repr(c) for c in C.CURRENCIES)}][length(text) % {len(C.CURRENCIES)} + 1], ' this month')",
    "'lowest to highest'",
    "text",
    "'List number of customers per district today, first 20, smallest to largest'",
]
_COUNTS = _any_sql(["number", "how many", "count"])
_RANKED = _first_sql([(_any_sql(C.TOP), "top"), (_any_sql(C.BOTTOM), "bottom")])
_LAST = ", ".join(f'last_value("{c}" IGNORE NULLS) OVER (PARTITION BY conv_id, era ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "{c}"' for c in C.SLOTS)


@query(f"""WITH q AS (SELECT conv_id, turn, trim(regexp_replace([{', '.join(_FORMS)}][(conv_id * 5 + turn * 7 + length(text)) % {len(_FORMS)} + 1], '\\s+', ' ', 'g')) AS o FROM conversations WHERE role = 'user' AND text IS NOT NULL),
    t AS (SELECT *, lower(o) AS t FROM q),
    f AS (SELECT *, NOT (contains(t, 'report') AND ({' OR '.join(f"starts_with(t, '{x}')" for x in C.OPENINGS)})) AND len(string_split(t, ' ')) <= {C.SHORT} AND {_any_sql(C.FOLLOW_UP)} AS follow_up,
        {_first_sql([(f"contains(t, 'balance') AND {_COUNTS}", 'count_and_balance'), ("contains(t, 'balance')", 'balance'), (_COUNTS, 'count'), ("contains(t, 'account') AND " + _any_sql(['report', 'active']), 'count')])} AS measure,
        {_first_sql([(f"contains(t, '{x}')", x) for x in C.DIMENSIONS])} AS dimension, {_first_sql([("contains(t, 'inactive')", 'inactive'), ("contains(t, 'active')", 'active')])} AS status, {_RANKED} AS ranking,
        {_first_sql([(_any_sql(C.ASCENDING), 'ascending'), (_any_sql(C.DESCENDING), 'descending')])} AS named_order,
        TRY_CAST(regexp_extract(t, '\\b(?:top|bottom|first|last) (\\d+)\\b', 1) AS BIGINT) AS n,
        nullif(trim(regexp_extract(o, '(?i)\\b(?:only|for|in) (.+?\\bdistrict)\\b', 1)), '') AS district, nullif(trim(regexp_extract(o, '(?i)\\b(?:only|for|in) (.+?\\bbranch)\\b', 1)), '') AS branch,
        {_first_sql([(f"regexp_matches(t, '{chr(92)}b{w}{chr(92)}b')", c) for w, c in C.CURRENCIES.items()])} AS currency, {_first_sql([(f"contains(t, '{p}')", p.replace(' ', '_')) for p in C.PERIODS])} AS period FROM t),
    s AS (SELECT *, CASE ranking WHEN 'top' THEN 'descending' WHEN 'bottom' THEN 'ascending' ELSE named_order END AS sort_direction FROM f),
    e AS (SELECT *, CASE WHEN ranking IS NOT NULL OR sort_direction IS NULL THEN n END AS "limit", count_if(NOT follow_up) OVER (PARTITION BY conv_id ORDER BY turn) AS era FROM s),
    c AS (SELECT conv_id, turn, follow_up, o AS previous_prompt, {_LAST} FROM e)
    SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN {f} IS NOT NULL THEN concat('{f}=', {f}) END" for f in C.FILTERS)}], lambda x: x IS NOT NULL), ';') AS filters FROM c""")
def n_contexts(spark, d):
    """What each conversation asks for after each of its requests."""
    out = C.contexts(_prompts(spark, d))
    return out.withColumn("filters", F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"))


_TITLED = f"(SELECT doc_id, lower(array_to_string({_W}[1:3], ' ')) AS title, lower(concat({_W}[2], '-', source, '.pdf')) AS filename, doc_id % 3 = 0 AS ready FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH d AS {_TITLED}, h AS (SELECT doc_id, list_distinct(regexp_extract_all(concat_ws(' ', title, filename), '[a-z0-9]+')) AS held FROM d),
    q AS (SELECT doc_id AS query_id, trim(lower(CASE doc_id % 3 WHEN 0 THEN array_to_string({_W}[1:3], ' ') WHEN 1 THEN concat({_W}[2], '-', source, '.pdf') ELSE array_to_string({_W}[2:3], ' ') END)) AS name FROM documents WHERE text IS NOT NULL),
    w AS (SELECT *, list_distinct(regexp_extract_all(name, '[a-z0-9]+')) AS words FROM q),
    n AS (SELECT doc_id, ready, unnest(list_distinct([trim(title), trim(filename)])) AS name FROM d),
    b AS (SELECT name, count(*) AS exact, count_if(ready) AS ready, min(doc_id) AS one, min(doc_id) FILTER (WHERE ready) AS one_ready FROM n WHERE name <> '' GROUP BY 1),
    e AS (SELECT w.query_id, words, coalesce(exact, 0) AS exact, ready, one, one_ready FROM w LEFT JOIN b ON w.name = b.name),
    c AS (SELECT query_id, count(*) AS n, min(doc_id) AS only_one FROM (SELECT DISTINCT e.query_id, h.doc_id FROM (SELECT query_id, words, words[1] AS first FROM e WHERE exact = 0 AND len(words) > 0) e JOIN (SELECT doc_id, held, unnest(held) AS x FROM h) h ON h.x = e.first AND list_has_all(h.held, e.words)) GROUP BY 1),
    r AS (SELECT e.*, CASE WHEN exact > 0 THEN exact ELSE coalesce(n, 0) END AS candidates, CASE WHEN exact = 1 THEN one WHEN exact > 1 AND ready = 1 THEN one_ready WHEN exact = 0 AND n = 1 THEN only_one END AS doc_id FROM e LEFT JOIN c ON e.query_id = c.query_id)
    SELECT query_id, CASE WHEN doc_id IS NOT NULL THEN 'resolved' WHEN candidates = 0 THEN 'not_found' ELSE 'ambiguous' END AS status, doc_id, CAST(exact AS BIGINT) AS exact, CAST(candidates AS BIGINT) AS candidates FROM r""")
def d_exactly_one(spark, d):
    """One query a document, by its title, its file name or a part of its title: which document each means, if one."""
    docs = table(spark, d, "documents").filter("text is not null").withColumn("w", F.split(F.regexp_replace(F.trim("text"), r"\s+", " "), " "))
    title, second = F.array_join(F.slice("w", 1, 3), " "), F.coalesce(F.get("w", F.lit(1)), F.lit(""))
    filename = F.concat(second, F.lit("-"), F.coalesce("source", F.lit("")), F.lit(".pdf"))
    part = F.array_join(F.slice("w", 2, 2), " ")
    queries = docs.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 == 0, title).when(F.col("doc_id") % 3 == 1, filename).otherwise(part).alias("query"))
    return exactly_one(queries, docs.select("doc_id", title.alias("title"), filename.alias("filename"), (F.col("doc_id") % 3 == 0).alias("ready")))
