"""People on pages, evidence of roles, and the report of the year that is asked for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.catalogue import query
from tallyspark.operators import people as P
from tallyspark.operators import roles as R
from tallyspark.operators import yearly as Y
from tallyspark.plans.manuals import _SECTIONS, _first, _sections, _sql_first
from tallyspark.sources import table

_MEMBERS = ["Chairman", "Director", "D/Chairman", "Member", "Vice Chairman"]


def staff_pages(spark, d):
    """(doc_id, text): pages of people, one a document: its lines in groups of five, as a member of a board, a chief, a
    deputy, and two as they are; every third group of a sixth of the pages ends with the secretary."""

    def line(x, i):
        n = (i / 5).cast("int")
        member = F.concat(_first(x, 3), F.lit("\nQualification: "), _first(x, 2), F.lit("\nExperience:  "), x, F.lit("\n"), F.element_at(F.array(*map(F.lit, _MEMBERS)), n % len(_MEMBERS) + 1))
        return (
            F.when(i % 5 == 0, member)
            .when(i % 5 == 1, F.concat(_first(x, 2), F.lit("\nChief Executive Officer")))
            .when(i % 5 == 2, F.concat(F.lit("Deputy CEO\n"), _first(x, 2)))
            .when((i % 15 == 13) & (F.col("doc_id") % 6 == 0), F.concat(F.lit("Company Secretary\n"), x))
            .otherwise(x)
        )

    docs = table(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


_G = "CAST((i - 1) // 5 AS INTEGER)"
_PAGES = f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 5
    WHEN 0 THEN concat({_sql_first(3)}, chr(10), 'Qualification: ', {_sql_first(2)}, chr(10), 'Experience:  ', x, chr(10), [{', '.join(f"'{m}'" for m in _MEMBERS)}][{_G} % {len(_MEMBERS)} + 1])
    WHEN 1 THEN concat({_sql_first(2)}, chr(10), 'Chief Executive Officer') WHEN 2 THEN concat('Deputy CEO', chr(10), {_sql_first(2)})
    ELSE CASE WHEN (i - 1) % 15 = 13 AND doc_id % 6 = 0 THEN concat('Company Secretary', chr(10), x) ELSE x END END), chr(10)) AS text FROM documents WHERE text IS NOT NULL"""
_LINES = f"""p AS ({_PAGES}), a AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM p))"""


@query(f"""WITH {_LINES}, b AS (SELECT *, lead(line, 1) OVER w AS q, lead(line, 2) OVER w AS e, lead(line, 3) OVER w AS r, min(CASE WHEN contains(lower(line), '{P.LAST}') THEN i END) OVER (PARTITION BY doc_id) AS last FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS place, line AS name, r AS role, q AS qualification, e AS experience FROM b
    WHERE starts_with(lower(q), '{P.QUALIFICATION}') AND starts_with(lower(e), '{P.EXPERIENCE}') AND lower(r) IN ({', '.join(f"'{r}'" for r in P.BOARD_ROLES)}) AND (last IS NULL OR i < last)""")
def w_board(spark, d):
    """The members of the board on each page, up to the secretary."""
    return staff_pages(spark, d).select("doc_id", F.posexplode(P.board(F.col("text"))).alias("place", "m")).select("doc_id", "place", "m.*")


_ANY = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
_CARDS = f"""c AS (SELECT a.doc_id, a.i, 'chief' AS kind, string_agg(b.line, chr(10) ORDER BY b.i) AS card FROM a JOIN a b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i - 1 AND a.i + 1
        WHERE {_ANY('lower(a.line)', P.CHIEF)} AND NOT contains(lower(a.line), 'deputy') AND NOT {_ANY('lower(b.line)', P.OF_DEPUTY)} GROUP BY 1, 2
    UNION ALL SELECT a.doc_id, a.i, 'deputy', string_agg(b.line, chr(10) ORDER BY b.i) FROM a JOIN a b ON b.doc_id = a.doc_id AND b.i BETWEEN a.i - 1 AND a.i + 1 WHERE {_ANY('lower(a.line)', P.DEPUTY)} GROUP BY 1, 2),
    f AS (SELECT doc_id, kind, card, min(i) AS i FROM c GROUP BY 1, 2, 3)"""


@query(f"""WITH {_LINES}, {_CARDS} SELECT doc_id, kind, CAST(place - 1 AS INTEGER) AS place, card FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i) AS place FROM f) WHERE place <= {P.MOST_RECORDS}""")
def w_role_records(spark, d):
    """The cards of chiefs and of deputies on each page, each different one once."""
    pages = staff_pages(spark, d)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), P.role_records(F.col("text"), deputy).alias("cards")) for k, deputy in (("chief", False), ("deputy", True))])).alias("k")
    return pages.select("doc_id", kinds).select("doc_id", "k.kind", F.posexplode("k.cards").alias("place", "card"))


_ROLE = "What are the obligations of the Branch Manager under the approval process?"
_ROLE_WORDS = R._plain(_ROLE)
_LIST = "[" + ", ".join(f"'{w}'" for w in _ROLE_WORDS) + "]"


def _sql_words(c):
    bare = f"list_transform(string_split_regex(coalesce({c}, ''), '\\s+'), lambda w: trim(lower(w), '{R.ENDS.replace(chr(39), chr(39) * 2)}'))"
    return f"list_distinct(list_filter(list_transform({bare}, lambda w: CASE WHEN len(w) > 5 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END), lambda w: w <> ''))"


@query(f"""WITH s AS (SELECT doc_id, k, title, {_sql_words('title')} AS t, {_sql_words(f'left(content, {R.OPENING})')} AS o FROM {_SECTIONS}),
    h AS (SELECT *, len(list_intersect({_LIST}, t)) AS th, len(list_intersect({_LIST}, o)) AS oh, len(list_intersect({_LIST}, list_concat(t, o))) AS both_, list_filter(t, lambda w: len(w) >= {R.LEAST_CHARS} AND NOT regexp_full_match(w, '[0-9]+')) AS n FROM s)
    SELECT doc_id, k, title, CAST(th AS INTEGER) AS title_hits, CAST(oh AS INTEGER) AS opening_hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY th DESC, oh DESC, k) AS INTEGER) AS place FROM h
    WHERE both_ >= 2 AND NOT (th > 0 AND len(list_filter(n, lambda w: NOT list_contains({_LIST}, w))) > 0 AND NOT list_has_any(n, [{', '.join(f"'{w}'" for w in R.COLLECTIVE)}]) AND th < {len(_ROLE_WORDS)})
        AND NOT list_has_any(t, [{', '.join(f"'{w}'" for w in R.MODIFIERS if w not in _ROLE_WORDS)}])""")
def d_role_validated(spark, d):
    """Sections that are evidence of the role asked about, the best of each manual first."""
    best = Window.partitionBy("doc_id").orderBy(F.desc("title_hits"), F.desc("opening_hits"), "k")
    rows = R.validated(_sections(spark, d).select("doc_id", "k", "title", "content"), _ROLE)
    return rows.select("doc_id", "k", "title", "title_hits", "opening_hits", F.row_number().over(best).alias("place"))


_REPORTS = """r AS (SELECT owner, y, report_id, CASE report_id % 3 WHEN 0 THEN concat('Annual Report ', y, '/', y + 1) WHEN 1 THEN concat('Report ', y, '-', right(CAST(y + 1 AS VARCHAR), 2)) ELSE 'Accounts' END AS title,
    concat('report-', y, '.pdf') AS filename, concat('http://example.com/', owner, '/') AS url FROM (SELECT o_custkey AS owner, year(o_orderdate) + 10 AS y, min(o_orderkey) AS report_id FROM orders GROUP BY 1, 2)),
    q AS (SELECT o_orderkey AS query_id, o_custkey AS owner, y, CASE o_orderkey % 4 WHEN 0 THEN concat(y, '/', y + 1) WHEN 1 THEN concat(y, '/', y + 1) WHEN 2 THEN CAST(y AS VARCHAR) END AS year FROM (SELECT *, CAST(year(o_orderdate) + 9 + o_orderkey % 3 AS BIGINT) AS y FROM orders)),
    h AS (SELECT query_id, year, report_id, replace(lower(concat(title, ' ', filename, ' ', url)), '-', '/') AS n FROM q LEFT JOIN r USING (owner)),
    s AS (SELECT *, CASE WHEN contains(n, year) THEN 100 ELSE 0 END + CASE WHEN contains(n, left(year, 4)) THEN 40 ELSE 0 END + CASE WHEN len(year) > 4 AND contains(n, right(year, 4)) THEN 40 ELSE 0 END + CASE WHEN len(year) > 4 AND contains(n, right(year, 2)) THEN 20 ELSE 0 END AS points FROM h),
    b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN year IS NULL THEN 0 ELSE -points END, report_id) AS place FROM s)"""


@query(f"""WITH {_REPORTS} SELECT query_id, year, CASE WHEN year IS NULL OR points > 0 THEN report_id END AS report_id, CAST(CASE WHEN year IS NOT NULL AND points > 0 THEN points END AS INTEGER) AS score FROM b WHERE place = 1""")
def d_report_by_year(spark, d):
    """A question for each order, about a year of its customer; the customer has a report for each year with orders."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"), F.year("o_orderdate").alias("of"))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    whole = lambda c: c.cast("string")
    ending = lambda c: F.right(whole(c), F.lit(2))
    y = F.col("of") + 10
    reports = orders.groupBy("owner", "of").agg(F.min("o_orderkey").alias("report_id"))
    title = F.when(F.col("report_id") % 3 == 0, text("Annual Report ", whole(y), "/", whole(y + 1))).when(F.col("report_id") % 3 == 1, text("Report ", whole(y), "-", ending(y + 1))).otherwise("Accounts")
    reports = reports.select("report_id", "owner", title.alias("title"), text("report-", whole(y), ".pdf").alias("filename"), text("http://example.com/", whole(F.col("owner")), "/").alias("url"))
    k, z = F.col("o_orderkey") % 4, F.col("of") + 9 + (F.col("o_orderkey") % 3)
    asked = F.when(k == 0, text(whole(z), "/", whole(z + 1))).when(k == 1, text(whole(z), " - ", ending(z + 1))).when(k == 2, whole(z)).otherwise("the last year")
    return Y.select_reports(orders.select(F.col("o_orderkey").alias("query_id"), "owner", text("What was the profit in ", asked, "?").alias("question")), reports)
