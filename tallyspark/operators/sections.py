"""Sections of paged documents: contents pages and footers left out, chapters and numbers carried along."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.operators.documents import INTRODUCTION

#: Words that a numbered clause begins with, so that no heading does.
CLAUSE_WORDS = [
    "ensure", "ensures", "identify", "identifies", "appoint", "appoints", "approve", "approves", "review", "reviews",
    "monitor", "monitors", "conduct", "conducts", "decide", "decides", "undertake", "undertakes", "provide", "provides",
    "maintain", "maintains", "prepare", "prepares", "submit", "submits", "report", "reports", "enforce", "enforces",
    "take", "takes", "perform", "performs", "verify", "verifies", "establish", "establishes", "develop", "develops",
    "implement", "implements",
]
#: What names an office that has a section of its own.
OFFICES = ["board", "president", "vice president", "v/p", "department", "director", "committee", "division", "office", "unit", "management"]
#: Wording of a requirement.
REQUIRES = [" shall ", " should ", " must ", " will ", " may ", " is required to ", " are required to "]
MOST_CHAPTERS = 50
CHAPTER = r"(?i)^chapter [a-z0-9]+$"
NUMBERED = r"^[ |,;:\-]*(\d+(?:\.\d+){0,4})\.? +(.+)$"
FOOTER = r"(?i)^pa(?:ge|de) ?\|? ?\d+$"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def any_in(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def heading_title(title: Column) -> Column:
    """Whether this can be a title: at most 160 characters and 18 words, no clause, no requirement, and with
    more than eight words no end of a sentence."""
    words = F.regexp_extract_all(title, F.lit("[A-Za-z0-9/&'-]+"), F.lit(0))
    n = F.size(words)
    sentence = (n > 8) & title.rlike("[.;,]$")
    required = any_in(F.concat(F.lit(" "), F.lower(title), F.lit(" ")), REQUIRES)
    return (F.length(title) <= 160) & n.between(1, 18) & ~F.lower(F.get(words, F.lit(0))).isin(CLAUSE_WORDS) & ~required & ~sentence


def contents_page(text: Column) -> Column:
    """Whether a page lists contents: it says so, or three lines have dotted leaders, two of them numbered."""
    low, lines = F.lower(text), F.split(text, BREAKS)
    dotted = F.filter(lines, lambda x: x.rlike(r"\.{3,}"))
    numbered = F.filter(dotted, lambda x: x.rlike(r"^\s*\d+(?:\.\d+){0,4}\.?\s+"))
    return F.contains(low, F.lit("table of contents")) | low.rlike(r"(?m)^\s*contents\s*$") | ((F.size(dotted) >= 3) & (F.size(numbered) >= 2))


def no_content(line: Column) -> Column:
    """Whether a line is a page number, an approval stamp, or hardly more than signs."""
    stamp = F.contains(F.lower(line), F.lit("approved by")) & (F.length(line) < 80)
    signs = (F.length(line) <= 12) & (F.length(F.regexp_replace(line, "[^a-zA-Z0-9]", "")) <= 2)
    return (line == "") | line.rlike(FOOTER) | stamp | signs


def paged_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, k, number, title, parent_number, parent_title, start_page, end_page, content) of pages (doc_id, page, text).

    The first heading with a single number opens a major section, and so does the first one after each
    chapter line; a number of two parts below the major section opens a section under it; a clause whose
    number lost a point (53.1 for 5.3.1) gets it back. All other lines belong to the section that is open,
    before any to the introduction. Pages of contents, footers and noise are left out, and so is a null text.
    Pages of one number are taken in the order of their text.

    What a line is depends on what came before only through counts and last values, so the state is carried by
    running windows in the order of the document, which hold one line at a time; no document is collected.
    """
    rows = pages.filter(F.col("text").isNotNull() & ~contents_page(F.trim("text")))
    lines = rows.select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("own"), F.posexplode(F.split("text", BREAKS)).alias("i", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"(?U)\s+", " "))).filter(~no_content(F.col("line")))
    cleaned = F.regexp_replace("line", r"^[|,;:\- ]+", "")
    lines = lines.withColumns({"raw": cleaned, "chapter": F.col("line").rlike(CHAPTER)})
    head = lambda g: F.regexp_extract("raw", NUMBERED, g)
    number = F.when(~F.col("chapter") & F.col("raw").rlike(NUMBERED), head(1))
    lines = lines.withColumn("number", number).withColumn("title", F.when(F.col("number").isNotNull(), F.trim(head(2))))
    lines = lines.withColumn("is_title", heading_title(F.col("title")))

    order = Window.partitionBy("doc_id").orderBy("page", "own", "i")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    single = F.col("number").rlike(r"^0*\d{1,2}$") & F.col("is_title")
    may_open = F.coalesce(single & (F.col("number").try_cast("int") <= MOST_CHAPTERS), F.lit(False))
    lines = lines.withColumn("may_open", may_open).withColumn("chapters", F.count(F.when(F.col("chapter"), 1)).over(so_far))
    # the state between two chapter lines is whether a heading came since: the last heading's count of chapters tells
    last = F.last(F.when(F.col("may_open"), F.col("chapters")), ignorenulls=True).over(before)
    lines = lines.withColumn("major", F.col("may_open") & (last.isNull() | (last < F.col("chapters"))))
    lines = lines.withColumn("above", F.last(F.when(F.col("major"), F.struct("number", "title")), ignorenulls=True).over(so_far))
    two = F.col("number").rlike(r"^\d+\.\d+$") & (F.col("above").isNull() | (F.substring_index("number", ".", 1) == F.col("above.number")))
    office = any_in(F.lower("title"), OFFICES) | F.contains(F.lower("title"), F.lit(" shall"))
    lines = lines.withColumn("minor", F.coalesce(~F.col("major") & two & (office | F.col("is_title")), F.lit(False)))
    opens = F.col("major") | F.col("minor")
    lines = lines.withColumn("k", F.count(F.when(opens, 1)).over(so_far))
    role = F.last(F.when(opens, F.struct(F.when(F.col("minor"), F.col("number")).alias("number"))), ignorenulls=True).over(so_far)
    lines = lines.withColumn("role", role["number"]).filter(~F.col("chapter"))
    # 5.3.1 as it is, or 53.1 as the same below 5.3
    short = F.concat(F.replace("role", F.lit("."), F.lit("")), F.lit("."))
    tail = F.substring(F.col("number"), F.length(short) + 1, F.length("number"))
    clause = F.when(F.startswith(F.col("number"), F.concat("role", F.lit("."))), F.col("number")).when(F.startswith(F.col("number"), short) & tail.rlike(r"^\d+$"), F.concat("role", F.lit("."), tail))
    shown = F.when(F.col("major"), F.concat_ws(". ", "number", "title")).when(F.col("minor"), F.col("raw")).when(clause.isNotNull(), F.concat_ws(". ", clause, "title")).otherwise(F.col("line"))
    minor = F.col("minor")
    parts = lines.select(
        "doc_id",
        F.col("k").cast("int").alias("k"),
        "page",
        F.struct("page", "own", "i", shown.alias("line")).alias("x"),
        F.when(opens, F.struct("number", "title", F.when(minor, F.col("above.number")).alias("parent_number"), F.when(minor, F.col("above.title")).alias("parent_title"))).alias("head"),
    )
    out = parts.groupBy("doc_id", "k").agg(F.max("head").alias("head"), F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.array_sort(F.collect_list("x")).alias("own"))
    content = F.array_join(F.transform("own", lambda s: s["line"]), "\n")
    return out.select("doc_id", "k", "head.number", F.coalesce("head.title", F.lit(INTRODUCTION)).alias("title"), "head.parent_number", "head.parent_title", "start_page", "end_page", content.alias("content"))
