"""Answers held against their evidence: proposed metadata of a document, and snippets of a text.

Metadata is proposed as a JSON object for each document. A title is grounded where it stands in the
document's evidence; any other field's value where, in one chunk, it begins at most NEAR characters from
a label of that field. What isn't grounded is the fallback. A value that is null, blank, an object or a
list, or no JSON object at all, is not grounded. White space counts as one blank, case doesn't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import bound

FALLBACK = "Information not found in internal documents"
NEAR = 160
#: The fields of a document's metadata and the labels that introduce each.
LABELS = {
    "title": [],
    "document_id": ["document id", "document code", "policy id", "policy code", "reference number", "reference no", "document number"],
    "version": ["version", "revision", "revision number", "version number"],
    "effective_date": ["effective date", "effective from", "effective as of", "date effective"],
    "review_cycle": ["review cycle", "review period", "review frequency", "review interval"],
    "target_audience": ["target audience", "intended audience", "applicable to"],
    "enforcement_level": ["enforcement level", "compliance level"],
    "governance_owner": ["governance owner", "document owner", "policy owner", "owner department", "responsible department"],
}


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def proposals(answers: DataFrame) -> DataFrame:
    """(doc_id, field, value): every field of each answer (doc_id, answer); value is null where nothing usable is proposed."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("answer", F.lit(""))), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    rows = answers.select("doc_id", bare.alias("_json")).withColumn("_variant", F.try_parse_json("_json"))
    # an object's values as written, numbers too; what kind a value is only the parsed form tells
    is_object = F.schema_of_variant("_variant").startswith("OBJECT")
    rows = rows.select("doc_id", "_variant", F.when(is_object, F.from_json("_json", "map<string,string>")).alias("_values"))
    kinds = lambda f: F.schema_of_variant(F.try_variant_get("_variant", f"$.{f}", "variant"))
    each = [F.struct(F.lit(f).alias("field"), F.when(~kinds(f).rlike("^(OBJECT|ARRAY)"), F.try_element_at("_values", F.lit(f))).alias("value")) for f in LABELS]
    rows = rows.select("doc_id", F.explode(F.array(*each)).alias("p")).select("doc_id", "p.field", F.trim("p.value").alias("value"))
    usable = (F.col("value") != "") & (F.lower("value") != FALLBACK.lower())
    return rows.withColumn("value", F.when(usable, F.col("value")))


def _place(text: Column, of: Column) -> Column:
    """Where the first occurrence begins, from 1; 0 without one."""
    return F.call_function("locate", of, text)


def _near_label(text: Column, field: Column, value: Column) -> Column:
    near = lambda place, at: (place > 0) & (F.abs(place - at) <= NEAR)

    def tied(at: Column) -> Column:
        by_label = F.lit(False)
        for name, labels in LABELS.items():
            tests = [bound(_place(text, F.lit(x)), lambda place: near(place, at)) for x in labels]
            by_label = F.when(field == name, reduce(lambda a, b: a | b, tests, F.lit(False))).otherwise(by_label)
        return (at > 0) & by_label

    return bound(_place(text, value), tied)


def grounded(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, field, value, grounded): each field of each answer, its value or the fallback.

    answers has one row a document, chunks is (doc_id, chunk, content). A chunk is looked through where it
    is: what is proposed for its document comes to it as one row of eight fields, and only the names of
    those it grounds leave it, counted before they are shuffled. The end of each chunk is looked at with
    the beginning of the next, as a title may go over both."""
    asked = proposals(answers)
    wanted = asked.filter("value is not null").withColumn("_low", F.lower(_flat(F.col("value"))))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("field", F.col("_low").alias("value"))).alias("_asked"))
    blocks = chunks.select("doc_id", "chunk", F.lower(_flat(F.col("content"))).alias("_text")).filter("_text <> ''")
    rows = blocks.join(wanted, "doc_id")
    holds = lambda x: F.when(x["field"] == "title", _place(F.col("_text"), x["value"]) > 0).otherwise(_near_label(F.col("_text"), x["field"], x["value"]))
    title = F.try_element_at(F.transform(F.filter("_asked", lambda x: x["field"] == "title"), lambda x: x["value"]), F.lit(1))
    rows = rows.select("doc_id", "chunk", "_text", title.alias("_title"), F.transform(F.filter("_asked", holds), lambda x: x["field"]).alias("_held"))
    # as many characters of both ends as a title has
    rows = rows.select("doc_id", "chunk", "_held", "_title", F.expr("right(_text, length(_title))").alias("_end"), F.expr("left(_text, length(_title))").alias("_begin"))
    after = F.lead("_begin").over(Window.partitionBy("doc_id").orderBy("chunk"))
    rows = rows.withColumn("_over", F.concat_ws(" ", "_end", after))
    over = F.when(_place(F.col("_over"), F.col("_title")) > 0, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>"))
    found = rows.select("doc_id", F.explode(F.array_union("_held", over)).alias("field")).distinct().withColumn("grounded", F.lit(True))
    out = asked.join(found, ["doc_id", "field"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))
    return out.select("doc_id", "field", F.when(F.col("grounded"), F.col("value")).otherwise(FALLBACK).alias("value"), "grounded")


def snippets(lines: Column, terms: list[str], around: int = 2, most: int = 8) -> Column:
    """The snippets of an array of lines that hold most of the terms, best first.

    A line scores the different terms it holds; each scoring line has a window of `around` lines before and
    after it. Windows are taken from the best line down, the earlier line first among equals, and one
    that shares a line with a window taken before is left out. Null lines have none."""
    wanted = F.array(*[F.lit(t.lower()) for t in sorted(set(terms)) if len(t) > 2])
    words = lambda x: F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    marked = F.transform(lines, lambda x, i: F.struct((-F.size(F.array_intersect(words(x), wanted))).alias("score"), i.alias("at")))
    ranked = F.array_sort(F.filter(marked, lambda s: s["score"] < 0))
    free = lambda taken, s: F.forall(taken, lambda t: F.abs(t - s["at"]) > 2 * around) & (F.size(taken) < most)
    taken = F.aggregate(ranked, F.array().cast("array<int>"), lambda taken, s: F.when(free(taken, s), F.concat(taken, F.array(s["at"]))).otherwise(taken))
    first = lambda t: F.greatest(t - around, F.lit(0)) + 1
    return F.transform(taken, lambda t: F.array_join(F.slice(lines, first(t), t + around + 2 - first(t)), "\n"))
