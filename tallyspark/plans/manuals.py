"""Sections, chunks, scores, clauses, steps and evidence over manuals made from the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.operators import documents as M
from tallyspark.operators import sections as P
from tallyspark.sources import table

#: What a manual makes of each six lines of a document: a heading, two steps, a heading below it, and two lines as they are.
_KINDS = ["Scope of ", "Authority and responsibilities of ", "Approval process for ", ""]


def _first(x, k):
    return F.regexp_replace(F.array_join(F.slice(F.split(x, " "), 1, k), " "), r"[.,;:\s]+$", "")


def manuals(spark, d):
    def line(x, i):
        n = (i / 6).cast("int") + 1
        kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), n % 4 + 1)
        return (
            F.when(i % 6 == 0, F.concat(n.cast("string"), F.lit(". "), kind, _first(x, 5), F.lit("\n"), x))
            .when(i % 6 == 1, F.concat(F.lit("1. The "), _first(x, 2), F.lit(" file shall be reviewed by the Branch Manager.\n"), x))
            .when(i % 6 == 2, F.concat(F.lit("2) Credit Team must submit within 5 days; it shall be approved.\n"), x))
            .when(i % 6 == 3, F.concat(n.cast("string"), F.lit(".1 "), _first(x, 4), F.lit("\n"), x))
            .otherwise(x)
        )

    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


def _sql_first(k):
    return f"regexp_replace(array_to_string(list_slice(string_split(x, ' '), 1, {k}), ' '), '[.,;:\\s]+$', '')"


_N = "CAST((i - 1) // 6 + 1 AS INTEGER)"
_MANUALS = f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 6
    WHEN 0 THEN concat({_N}, '. ', [{', '.join(f"'{k}'" for k in _KINDS)}][{_N} % 4 + 1], {_sql_first(5)}, chr(10), x)
    WHEN 1 THEN concat('1. The ', {_sql_first(2)}, ' file shall be reviewed by the Branch Manager.', chr(10), x)
    WHEN 2 THEN concat('2) Credit Team must submit within 5 days; it shall be approved.', chr(10), x)
    WHEN 3 THEN concat({_N}, '.1 ', {_sql_first(4)}, chr(10), x) ELSE x END), chr(10)) AS text FROM documents WHERE text IS NOT NULL"""
_SECTIONS = f"""(WITH m AS ({_MANUALS}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM m),
    h AS (SELECT *, len(line) <= {M.LONGEST_HEADING} AND regexp_matches(line, '{M.HEADING}') AS head FROM l),
    g AS (SELECT *, count_if(head) OVER (PARTITION BY doc_id ORDER BY pos) - CAST(first_value(head) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS k FROM h),
    s AS (SELECT doc_id, CAST(k AS INTEGER) AS k, max(CASE WHEN head THEN regexp_extract(line, '{M.HEADING}', 1) END) AS number, coalesce(max(CASE WHEN head THEN regexp_extract(line, '{M.HEADING}', 2) END), '{M.INTRODUCTION}') AS title,
        coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT head), '') AS content FROM g GROUP BY 1, 2)
    SELECT *, CASE WHEN contains(number, '.') THEN last_value(CASE WHEN NOT contains(number, '.') THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_title FROM s)"""


def _sections(spark, d):
    return M.sections(manuals(spark, d))


@query(f"SELECT doc_id, k, number, title, parent_title, md5(content) AS content FROM {_SECTIONS}")
def d_sections(spark, d):
    return _sections(spark, d).select("doc_id", "k", "number", "title", "parent_title", F.md5(F.col("content").cast("binary")).alias("content"))


@query(f"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS w FROM ({_MANUALS})),
    r AS (SELECT doc_id, w, 1 AS i, 0 AS chunk, len(w[1]) + 1 AS used FROM t WHERE len(w) > 0
        UNION ALL SELECT doc_id, w, i + 1, CASE WHEN used + len(w[i + 1]) + 1 > {M.CHUNK_CHARS} THEN chunk + 1 ELSE chunk END, CASE WHEN used + len(w[i + 1]) + 1 > {M.CHUNK_CHARS} THEN 0 ELSE used END + len(w[i + 1]) + 1 FROM r WHERE i < len(w))
    SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, md5(string_agg(w[i], chr(10) ORDER BY i)) AS content FROM r GROUP BY 1, 2""")
def d_chunks(spark, d):
    """Lines packed in order into chunks of at most 3,500 characters."""
    return M.chunks(manuals(spark, d)).select("doc_id", "chunk", F.md5(F.col("content").cast("binary")).alias("content"))


QUESTION = "What are the responsibilities of the Branch Manager for the approval of and reier der files?"
_ASKED = M._plain_tokens(QUESTION)
_LIST = "[" + ", ".join(f"'{w}'" for w in sorted(set(_ASKED))) + "]"
_STOP = "[" + ", ".join(f"'{w}'" for w in M.STOP_WORDS) + "]"


def _tok(c):
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: len(w) > 2 AND NOT list_contains({_STOP}, w))"


_TF = " + ".join(f"CASE WHEN len(list_filter(w, lambda x: x = '{q}')) > 0 THEN 1.0 + 0.2 * least(5, len(list_filter(w, lambda x: x = '{q}'))) ELSE 0.0 END" for q in sorted(set(_ASKED)))
_SCORES = f"""(SELECT doc_id, k, number, title, parent_title, content, CASE WHEN len(w) = 0 THEN 0.0 ELSE round(CAST({_TF} + 4.0 * len(list_intersect({_tok('title')}, {_LIST})) + 3.0 * len(list_intersect({_tok('parent_title')}, {_LIST}))
    + CASE WHEN regexp_matches(lower(concat_ws(' ', title, parent_title)), 'responsib|authorit') THEN 12.0 ELSE 0.0 END + CASE WHEN contains(array_to_string(w, ' '), '{" ".join(_ASKED)}') THEN 5.0 ELSE 0.0 END AS DOUBLE), 6) END AS score
    FROM (SELECT *, {_tok('content')} AS w FROM {_SECTIONS}))"""


@query(f"SELECT doc_id, k, score FROM {_SCORES}")
def d_section_scores(spark, d):
    """The whole lexical score of every section."""
    return M.scored(_sections(spark, d), QUESTION).select("doc_id", "k", "score")


@query(f"""WITH s AS ({_SCORES[1:-1]}), b AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, doc_id, k LIMIT 6)
    SELECT DISTINCT doc_id, k, title, score FROM (SELECT * FROM b UNION ALL SELECT s.* FROM s SEMI JOIN (SELECT doc_id, parent_title FROM b WHERE regexp_matches(lower(parent_title), 'responsib|authorit')) p USING (doc_id, parent_title))""")
def d_top_sections(spark, d):
    """The six best sections, with all sections beside them under a parent about responsibility."""
    return M.top_sections(manuals(spark, d), QUESTION, 6).select("doc_id", "k", "title", "score")


_WANTED = "approval process"


@query(f"""WITH s AS (SELECT *, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS w FROM {_SECTIONS}), v AS (SELECT *, CASE WHEN lower(title) = '{_WANTED}' THEN 100.0 WHEN contains(lower(title), '{_WANTED}') THEN 50.0 WHEN contains('{_WANTED}', lower(title)) THEN 40.0 ELSE 0.0 END
    + 10.0 * len(list_intersect(w, ['approval', 'process'])) + 20.0 * len(list_intersect(w, ['approval', 'process'])) / 2 AS score FROM s),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS r FROM v) WHERE r = 1 AND score >= 20)
    SELECT s.doc_id, s.k, s.title FROM s JOIN b ON s.doc_id = b.doc_id AND (s.k = b.k OR starts_with(s.number, concat(b.number, '.')))""")
def d_best_section(spark, d):
    """Of each manual the section whose title fits best, with the sections below its number."""
    words, wanted = F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))), F.array(F.lit("approval"), F.lit("process"))
    title = F.lower("title")
    exact = F.when(title == _WANTED, 100.0).when(title.contains(_WANTED), 50.0).when(F.lit(_WANTED).contains(title), 40.0).otherwise(0.0)
    overlap = F.size(F.array_intersect(words, wanted))
    every = _sections(spark, d).select("doc_id", "k", "number", "title", (exact + 10.0 * overlap + 20.0 * overlap / 2).alias("score"))
    best = every.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "k"))).filter("r = 1 and score >= 20")
    best = best.select("doc_id", F.col("k").alias("best"), F.col("number").alias("above"))
    found = every.join(best, "doc_id").filter((F.col("k") == F.col("best")) | F.startswith(F.col("number"), F.concat("above", F.lit("."))))
    return found.select("doc_id", "k", "title")


_TITLE_SCORE = "CASE WHEN len(string_split(title, ' ')) BETWEEN 2 AND 10 THEN 20 ELSE 0 END + CASE WHEN len(title) <= 60 THEN 10 ELSE 0 END - CASE WHEN len(title) > 80 THEN 50 ELSE 0 END - CASE WHEN len(string_split(title, ' ')) > 12 THEN 40 ELSE 0 END"


@query(f"""WITH s AS (SELECT *, CAST(string_split(number, '.')[1] AS INTEGER) AS major, {_TITLE_SCORE} AS v FROM {_SECTIONS})
    SELECT doc_id, major, first(title ORDER BY v DESC, k) AS title, CAST(count(*) AS BIGINT) AS sections, array_to_string(list(coalesce(number, '') ORDER BY k), ' ') AS numbers FROM s GROUP BY doc_id, major""")
def d_major_sections(spark, d):
    """Sections by the first part of their number, each group with its best title; those without a number by themselves."""
    n = F.size(F.split("title", " "))
    size = F.length("title")
    weight = F.when(n.between(2, 10), 20).otherwise(0) + F.when(size <= 60, 10).otherwise(0) - F.when(size > 80, 50).otherwise(0) - F.when(n > 12, 40).otherwise(0)
    rows = _sections(spark, d).withColumn("major", F.substring_index("number", ".", 1).cast("int")).withColumn("v", weight)
    out = rows.groupBy("doc_id", "major").agg(F.max_by("title", F.struct("v", -F.col("k"))).alias("title"), F.count(F.lit(1)).alias("sections"), F.array_sort(F.collect_list(F.struct("k", F.coalesce("number", F.lit("")).alias("x")))).alias("own"))
    return out.select("doc_id", "major", "title", "sections", F.array_join(F.transform("own", lambda s: s["x"]), " ").alias("numbers"))


@query(f"""WITH s AS (SELECT doc_id, k, CASE WHEN number IS NULL THEN 0 WHEN NOT contains(number, '.') THEN 1 WHEN regexp_matches(lower(content), 'shall|must') THEN 2 ELSE 3 END AS tier FROM {_SECTIONS}),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tier ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY doc_id, tier) AS n FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, k) AS place FROM t WHERE tier < 3 OR i % greatest(1, n // 8) = 0) SELECT doc_id, k FROM r WHERE place <= 24""")
def d_sampled_sections(spark, d):
    """At most 24 sections of each manual: the introduction, chapters, sections with rules, then every so many of the rest."""
    tier = F.when(F.col("number").isNull(), 0).when(~F.contains(F.col("number"), F.lit(".")), 1).when(F.lower("content").rlike("shall|must"), 2).otherwise(3)
    own = Window.partitionBy("doc_id", "tier")
    rows = _sections(spark, d).select("doc_id", "k", tier.alias("tier")).withColumn("i", F.row_number().over(own.orderBy("k")) - 1).withColumn("n", F.count(F.lit(1)).over(own))
    rows = rows.filter((F.col("tier") < 3) | (F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 8)) == 0))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("tier", "k"))
    return rows.withColumn("place", place).filter("place <= 24").select("doc_id", "k")


@query(f"""WITH s AS (SELECT doc_id, k, content, count(*) OVER (PARTITION BY doc_id) AS n FROM {_SECTIONS}), e AS (SELECT doc_id, string_agg(substr(content, 1, CAST(8000 // n AS BIGINT)), chr(10) ORDER BY k) AS v FROM s GROUP BY 1) SELECT doc_id, md5(substr(v, 1, 8000)) AS evidence FROM e""")
def d_evidence(spark, d):
    """The same share of 8,000 characters from each section of a manual."""
    rows = _sections(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    rows = rows.select("doc_id", "k", F.substring(F.col("content"), F.lit(1), F.floor(8000 / F.col("n")).cast("int")).alias("x"))
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("own"))
    return out.select("doc_id", F.md5(F.substring(F.array_join(F.transform("own", lambda s: s["x"]), "\n"), 1, 8000).cast("binary")).alias("evidence"))


_OPENS = r"^\s*(\d{1,2})[.)]\s+\S"
_CLAUSES = f"""(WITH l AS (SELECT doc_id, k, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM {_SECTIONS}),
    o AS (SELECT *, try_cast(nullif(regexp_extract(line, '{_OPENS}', 1), '') AS INTEGER) AS c FROM l WHERE trim(line) <> ''), r AS (SELECT *, count(c) OVER (PARTITION BY doc_id, k ORDER BY i) AS opened, count(c) OVER (PARTITION BY doc_id, k) AS found FROM o),
    t AS (SELECT doc_id, k, opened, coalesce(max(c), 0) AS clause, string_agg(trim(line), ' ' ORDER BY i) AS text FROM r WHERE opened > 0 OR found = 0 GROUP BY 1, 2, 3) SELECT doc_id, k, CAST(clause AS INTEGER) AS clause, last(text ORDER BY opened) AS text FROM t GROUP BY 1, 2, 3)"""


@query(f"SELECT doc_id, k, clause, md5(text) AS v FROM {_CLAUSES}")
def d_clauses(spark, d):
    return M.clauses(_sections(spark, d)).select("doc_id", "k", "clause", F.md5(F.col("text").cast("binary")).alias("v"))


@query(f"""SELECT s.number, s.title, CAST(count(*) AS BIGINT) AS clauses, CAST(count(DISTINCT s.doc_id) AS BIGINT) AS manuals FROM {_CLAUSES} c JOIN {_SECTIONS} s USING (doc_id, k) GROUP BY 1, 2""")
def d_clause_groups(spark, d):
    """Clauses by the section that owns them, with the key of its natural order."""
    found = _sections(spark, d)
    owned = M.clauses(found).join(found.select("doc_id", "k", "number", "title"), ["doc_id", "k"])
    return owned.groupBy("number", "title").agg(F.count(F.lit(1)).alias("clauses"), F.countDistinct("doc_id").alias("manuals"))


@query(f"""WITH c AS (SELECT doc_id, list_distinct(list(clause)) AS has FROM {_CLAUSES} GROUP BY 1) SELECT doc_id, array_to_string(list_sort(list_filter([1, 2, 3, 7], lambda x: NOT list_contains(has, x))), ',') AS unsupported FROM c""")
def d_answer_clauses(spark, d):
    """Clauses that an answer cites (1, 2, 3 and 7) and a manual doesn't have."""
    cited = F.array(*[F.lit(x) for x in (1, 2, 3, 7)])
    own = M.clauses(_sections(spark, d)).groupBy("doc_id").agg(F.collect_set("clause").alias("has"))
    return own.select("doc_id", F.array_join(F.array_sort(F.array_except(cited, "has")), ",").alias("unsupported"))


@query(None)
def d_steps(spark, d):
    """Numbered steps of every section; look-arounds have no counterpart in the SQL, so fixtures test them."""
    return M.steps(_sections(spark, d))


#: Sentences that name who acts, made of a line's own words: w1 and w2 are its first two, x is the line.
_ACTING = [
    ("The ", " Officer is responsible for "),
    ("The ", " Unit is entrusted with "),
    ("The form shall be signed by the ", " Manager before "),
    ("In such cases, the ", " Team can advise on "),
    ("The ", " Office, in coordination with the Audit Desk, shall prepare "),
    ("It must be re-appraised by the ", " Board other than "),
    ("The ", " file shall go with "),
    ("", " "),
]


def _actions(spark, d):
    """(doc_id, k, action): every line of each document as the action of somebody its first two words name."""
    lines = table(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("k", "x"))
    name = F.array_join(F.slice(F.split("x", " "), 1, 2), " ")
    forms = F.array(*[F.concat(F.lit(a), name, F.lit(b), F.col("x")) for a, b in _ACTING])
    return lines.select("doc_id", "k", F.get(forms, ((F.col("doc_id") + F.col("k")) % len(_ACTING)).cast("int")).alias("action"))


def _sql_actors():
    found = ", ".join(f"list_transform(regexp_extract_all(a, '(?i){p}', {g}), lambda r: coalesce(r, ''))" for p, g, _ in M.ACTORS)
    bare = "r"
    for pattern in M.TRIMMED:
        bare = f"regexp_replace({bare}, '{pattern}', '', 'g')"
    rejected = ", ".join(f"'{x}'" for x in M.NO_ACTORS)
    keep = f"list_filter(list_transform(flatten([{found}]), lambda r: trim({bare})), lambda r: len(r) >= 4 AND len(string_split(r, ' ')) <= 12 AND NOT list_contains([{rejected}], lower(r)))"
    return f"""(WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
        a AS (SELECT doc_id, k, trim(regexp_replace([{", ".join(f"concat('{b}', array_to_string(string_split(x, ' ')[1:2], ' '), '{e}', x)" for b, e in _ACTING)}][(doc_id + k) % {len(_ACTING)} + 1], '\\s+', ' ', 'g')) AS a FROM l),
        f AS (SELECT doc_id, k, {keep} AS f FROM a), g AS (SELECT doc_id, k, f, list_transform(f, lambda r: lower(r)) AS g FROM f)
        SELECT doc_id, k, list_filter(list_filter(f, lambda r, i: list_position(g, lower(r)) = i), lambda r: len(list_filter(g, lambda s: s <> lower(r) AND contains(lower(r), s))) = 0) AS actors FROM g)"""


@query(f"SELECT doc_id, CAST(k AS INTEGER) AS k, array_to_string(actors, '|') AS actors FROM {_sql_actors()}")
def d_actors(spark, d):
    """Who acts, in every action."""
    return _actions(spark, d).select("doc_id", "k", F.array_join(M.actors(F.col("action")), "|").alias("actors"))


@query(f"SELECT actor, CAST(count(*) AS BIGINT) AS actions, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM (SELECT doc_id, lower(unnest(actors)) AS actor FROM {_sql_actors()}) GROUP BY 1")
def d_actor_counts(spark, d):
    """How many actions and documents name each actor. Actions are counted by document before they meet by actor."""
    named = _actions(spark, d).select("doc_id", F.explode(M.actors(F.col("action"))).alias("actor"))
    by_document = named.groupBy(F.lower("actor").alias("actor"), "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return by_document.groupBy("actor").agg(F.sum("n").alias("actions"), F.count(F.lit(1)).alias("documents"))


_EVIDENCE = f"""(SELECT doc_id, k, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS h, trim(regexp_replace(lower(content), '\\s+', ' ', 'g')) AS t FROM {_SECTIONS})"""


@query(f"""SELECT doc_id, k, CASE WHEN regexp_matches(h, '{M.CONTEXT_TITLES}') THEN regexp_matches(t, '{'|'.join(M.ASSIGNING)}') ELSE regexp_matches(t, '{'|'.join(M.ASSIGNING)}') OR regexp_matches(t, '{'|'.join(M.NORMATIVE)}') END AS direct FROM {_EVIDENCE}""")
def d_role_evidence(spark, d):
    """Direct or supporting evidence."""
    return M.evidence(_sections(spark, d)).select("doc_id", "k", "direct")


_OPS = " + ".join(f"CASE WHEN regexp_matches(t, '\\b{p}\\b') THEN 1 ELSE 0 END" for p in M.OPERATIONS)
_ACTIVE = " + ".join(f"CASE WHEN contains(t, '{a}') THEN 1 ELSE 0 END" for a in M.ACTIVITIES)


@query(f"""SELECT doc_id, k, t <> '' AND NOT (regexp_matches(t, '{'|'.join(M.NO_PROCEDURE)}') OR regexp_matches(h, '{M.NO_PROCEDURE_TITLE}')) AND (regexp_matches(t, '{'|'.join(M.SEQUENCE)}')
    OR (len(regexp_extract_all(t, '{M.NUMBERED}')) >= 2 AND {_OPS} >= 2) OR (regexp_matches(t, '{M.PROCESS}') AND {_ACTIVE} >= 3)) AS procedure FROM {_EVIDENCE}""")
def d_procedural(spark, d):
    return M.evidence(_sections(spark, d)).select("doc_id", "k", "procedure")


@query(f"""WITH s AS (SELECT doc_id, k, title, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS key FROM {_SECTIONS} WHERE len(title) BETWEEN 2 AND 120 AND len(string_split(title, ' ')) <= 12) SELECT doc_id, key, first(title ORDER BY k) AS title, CAST(min(k) AS INTEGER) AS k FROM s GROUP BY 1, 2""")
def d_section_titles(spark, d):
    """Titles that a manual teaches: the first of each key."""
    rows = _sections(spark, d).filter(F.length("title").between(2, 120) & (F.size(F.split("title", " ")) <= 12))
    rows = rows.withColumn("key", F.trim(F.regexp_replace(F.lower("title"), r"\s+", " ")))
    return rows.groupBy("doc_id", "key").agg(F.min_by("title", "k").alias("title"), F.min("k").alias("k"))


@query(f"""SELECT doc_id, k, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(title) ORDER BY k) AS r FROM {_SECTIONS} WHERE regexp_matches(lower(title), '\\b(process|procedure|approval)\\b') AND NOT regexp_matches(lower(title), 'responsibilit')) WHERE r = 1""")
def d_procedure_sections(spark, d):
    """The different titles of a manual that name a procedure, in order."""
    title = F.lower("title")
    rows = _sections(spark, d).filter(title.rlike(r"\b(process|procedure|approval)\b") & ~title.rlike("responsibilit"))
    return rows.groupBy("doc_id", title.alias("key")).agg(F.min("k").alias("k"), F.min_by("title", "k").alias("title")).select("doc_id", "k", "title")


@query(f"SELECT doc_id, k, title FROM {_SECTIONS} WHERE number IN ('1', '2', '1.1') ORDER BY doc_id, k LIMIT 24")
def d_in_list(spark, d):
    """The first 24 sections of a list of numbers, in order."""
    return _sections(spark, d).filter(F.col("number").isin("1", "2", "1.1")).select("doc_id", "k", "title").orderBy("doc_id", "k").limit(24)


@query(f"""WITH w AS (SELECT doc_id, k, unnest(list_distinct({_tok('title')})) AS t FROM {_SECTIONS}), f AS (SELECT t, count(*) AS df FROM w GROUP BY 1), o AS (SELECT doc_id, k, unnest(list_distinct({_tok('substr(content, 1, 900)')})) AS t FROM {_SECTIONS}),
    s AS (SELECT doc_id, k, 12.0 / df AS v FROM w JOIN f USING (t) WHERE list_contains({_LIST}, t) UNION ALL SELECT doc_id, k, 6.0 / df FROM o JOIN f USING (t) WHERE list_contains({_LIST}, t)),
    n AS (SELECT doc_id, k, count(*) AS n FROM w WHERE list_contains({_LIST}, t) GROUP BY 1, 2) SELECT s.doc_id, s.k, round(sum(v) + coalesce(max(CASE WHEN n >= 2 THEN 20.0 END), 0.0), 6) AS score FROM s LEFT JOIN n USING (doc_id, k) GROUP BY 1, 2""")
def d_rerank(spark, d):
    """Rare words of the question in a section's title and opening, by how many titles have them."""
    wanted = F.array(*[F.lit(w) for w in sorted(set(_ASKED))])
    rows = _sections(spark, d).select("doc_id", "k", F.array_intersect(M.tokens(F.col("title")), wanted).alias("in_title"), F.array_intersect(M.tokens(F.substring("content", 1, 900)), wanted).alias("in_opening"))
    of_title = rows.select("doc_id", "k", F.explode("in_title").alias("t"))
    often = of_title.groupBy("t").agg(F.count(F.lit(1)).alias("df"))  # one row a word of the question
    both = of_title.withColumn("by", F.lit(12.0)).unionByName(rows.select("doc_id", "k", F.explode("in_opening").alias("t"), F.lit(6.0).alias("by")))
    two = F.when(F.count_if(F.col("by") == 12.0) >= 2, 20.0).otherwise(0.0)
    out = both.join(often, "t").groupBy("doc_id", "k").agg(F.round(F.sum(F.col("by") / F.col("df")) + two, 6).alias("score"))
    return out.select("doc_id", "k", "score")


#: Fixed texts that mark a kind of document.
KINDS = {"license": ["licensed under", "released under", "license"], "legal": ["all rights reserved", "copyright"], "contact": ["@", "phone", "http"]}
_HITS = {k: " + ".join(f"CASE WHEN contains(lower(text), '{p}') THEN 1 ELSE 0 END" for p in v) for k, v in KINDS.items()}


@query(f"""WITH h AS (SELECT doc_id, unnest([{', '.join(f"{{'kind': '{k}', 'hits': {v}}}" for k, v in _HITS.items())}]) AS x FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, kind, round(least(0.95, 0.6 + 0.08 * hits), 6) AS confidence FROM (SELECT doc_id, x.kind AS kind, x.hits AS hits, row_number() OVER (PARTITION BY doc_id ORDER BY x.hits DESC, x.kind) AS r FROM h WHERE x.hits > 0) WHERE r = 1""")
def d_document_type(spark, d):
    """The kind whose marks a document holds most of, in one pass and without a shuffle."""
    text = F.lower("text")
    hits = [F.struct((-sum((F.when(text.contains(p), 1).otherwise(0) for p in v), F.lit(0))).alias("hits"), F.lit(k).alias("kind")) for k, v in KINDS.items()]
    best = F.array_min(F.filter(F.array(*hits), lambda h: h["hits"] < 0))
    out = table(spark, d, "documents").select("doc_id", best.alias("best")).filter("best is not null")
    return out.select("doc_id", "best.kind", F.round(F.least(F.lit(0.95), 0.6 - 0.08 * F.col("best.hits")), 6).alias("confidence"))


def paged(spark, d):
    """(doc_id, page, text): each eight lines of a document as a page, with chapters, headings, clauses and footers put in."""

    def line(x, i):
        n = (i / 6).cast("int") + 1
        part = lambda *words: F.concat(*[w if not isinstance(w, str) else F.lit(w) for w in words])
        no, at = n.cast("string"), i.cast("string")
        return (
            F.when(i % 6 == 0, part("CHAPTER ", no, "\n", no, ". ", _first(x, 5), "\n", x))
            .when(i % 6 == 1, part(no, ".1 ", _first(x, 4), "\n", x))
            .when(i % 6 == 2, part(no, "1.", at, " ", _first(x, 3), "\n", x))
            .when(i % 6 == 3, part("7. ", _first(x, 3), "\nPage | ", at, "\n", x))
            .when(i % 6 == 4, part(no, ".2 The ", _first(x, 2), " Department shall\n", no, ".2.1 ", x))
            .otherwise(x)
        )

    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", F.transform(F.split("text", "\n", -1), line).alias("lines"))
    count = F.ceil(F.size("lines") / 8).cast("int")
    pages = F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.array_join(F.slice("lines", p * 8 + 1, F.lit(8)), "\n"))
    # every third document begins with a page of contents, a copy of its first page
    pages = F.when(F.col("doc_id") % 3 == 0, F.concat(F.transform(F.slice(pages, 1, 1), lambda x: F.concat(F.lit("Table of Contents\n"), x)), pages)).otherwise(pages)
    return docs.select("doc_id", F.posexplode(pages).alias("page", "text"))


_NO = "((i - 1) // 6 + 1)"
_PAGED = f"""a AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 6
        WHEN 0 THEN concat('CHAPTER ', {_NO}, chr(10), {_NO}, '. ', {_sql_first(5)}, chr(10), x) WHEN 1 THEN concat({_NO}, '.1 ', {_sql_first(4)}, chr(10), x)
        WHEN 2 THEN concat({_NO}, '1.', i - 1, ' ', {_sql_first(3)}, chr(10), x) WHEN 3 THEN concat('7. ', {_sql_first(3)}, chr(10), 'Page | ', i - 1, chr(10), x)
        WHEN 4 THEN concat({_NO}, '.2 The ', {_sql_first(2)}, ' Department shall', chr(10), {_NO}, '.2.1 ', x) ELSE x END) AS ls FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, p + CAST(doc_id % 3 = 0 AS INTEGER) AS page, array_to_string(ls[p * 8 + 1:p * 8 + 8], chr(10)) AS text FROM (SELECT doc_id, ls, unnest(range((len(ls) + 7) // 8)) AS p FROM a))"""
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_CONTENTS = r"""contains(lower(text), 'table of contents') OR regexp_matches(lower(text), '(?m)^\s*contents\s*$') OR (len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '...'))) >= 3
    AND len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '...') AND regexp_matches(x, '^\s*\d+(?:\.\d+){0,4}\.?\s+'))) >= 2)"""


@query(rf"""WITH {_PAGED}, c AS (SELECT doc_id, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM b WHERE NOT ({_CONTENTS})),
    d AS (SELECT doc_id, page, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM c),
    e AS (SELECT *, regexp_matches(line, '{P.CHAPTER}') AS chapter, regexp_replace(line, '^[|,;:\- ]+', '') AS raw FROM d
        WHERE line <> '' AND NOT regexp_matches(line, '{P.FOOTER}') AND NOT (contains(lower(line), 'approved by') AND len(line) < 80) AND NOT (len(line) <= 12 AND len(regexp_replace(line, '[^a-zA-Z0-9]', '', 'g')) <= 2)),
    f AS (SELECT *, CASE WHEN NOT chapter THEN nullif(regexp_extract(raw, '{P.NUMBERED}', 1), '') END AS number, trim(regexp_extract(raw, '{P.NUMBERED}', 2)) AS title, regexp_extract_all(regexp_extract(raw, '{P.NUMBERED}', 2), '[A-Za-z0-9/&''-]+') AS w FROM e),
    g AS (SELECT *, number IS NOT NULL AND len(title) <= 160 AND len(w) BETWEEN 1 AND 18 AND lower(w[1]) NOT IN ({_QUOTED(P.CLAUSE_WORDS)}) AND NOT list_bool_or([contains(concat(' ', lower(title), ' '), x) FOR x IN [{_QUOTED(P.REQUIRES)}]])
        AND NOT (len(w) > 8 AND regexp_matches(title, '[.;,]$')) AS is_title, count(*) FILTER (WHERE chapter) OVER (PARTITION BY doc_id ORDER BY page, i) AS chapters FROM f),
    h AS (SELECT *, is_title AND NOT contains(number, '.') AND TRY_CAST(number AS INTEGER) <= {P.MOST_CHAPTERS} AS may FROM g),
    m AS (SELECT *, coalesce(may, false) AND row_number() OVER (PARTITION BY doc_id, chapters, coalesce(may, false) ORDER BY page, i) = 1 AS major FROM h),
    n AS (SELECT *, last_value(CASE WHEN major THEN {{'number': number, 'title': title}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, i ROWS UNBOUNDED PRECEDING) AS above FROM m),
    o AS (SELECT *, coalesce(NOT major AND regexp_matches(number, '^\d+\.\d+$') AND (above IS NULL OR above.number = string_split(number, '.')[1])
        AND (is_title OR list_bool_or([contains(lower(title), x) FOR x IN [{_QUOTED(P.OFFICES)}, ' shall']])), false) AS minor FROM n),
    r AS (SELECT *, count(*) FILTER (WHERE major OR minor) OVER (PARTITION BY doc_id ORDER BY page, i) AS k FROM o WHERE NOT chapter),
    s AS (SELECT *, max(CASE WHEN minor THEN number END) OVER (PARTITION BY doc_id, k) AS role FROM r),
    t AS (SELECT *, CASE WHEN starts_with(number, concat(role, '.')) THEN number WHEN regexp_matches(number, concat('^', replace(role, '.', ''), '\.\d+$')) THEN concat(role, '.', string_split(number, '.')[2]) END AS clause FROM s)
    SELECT doc_id, CAST(k AS INTEGER) AS k, max(CASE WHEN major OR minor THEN number END) AS number, coalesce(max(CASE WHEN major OR minor THEN title END), '{M.INTRODUCTION}') AS title, max(CASE WHEN minor THEN above.number END) AS parent_number, max(CASE WHEN minor THEN above.title END) AS parent_title,
        CAST(min(page) AS INTEGER) AS start_page, CAST(max(page) AS INTEGER) AS end_page, md5(string_agg(CASE WHEN major THEN concat(number, '. ', title) WHEN minor THEN raw WHEN clause IS NOT NULL THEN concat(clause, '. ', title) ELSE line END, chr(10) ORDER BY page, i)) AS content FROM t GROUP BY 1, 2""")
def d_paged_sections(spark, d):
    """The sections of every document as pages with contents, chapters, footers and misread clause numbers."""
    return P.paged_sections(paged(spark, d)).withColumn("content", F.md5(F.col("content").cast("binary")))
