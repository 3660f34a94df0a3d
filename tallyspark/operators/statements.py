"""Figures of financial statements, and evidence mixed from statements and narrative."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import financial_number

_NUMBER = r"(?:\(?-?\d{1,3}(?:,\d{3})+(?:\.\d+)?\)?|\(?-?\d+(?:\.\d+)?\)?)"
_DATED = r"\b\d{1,2}\s+[A-Z][a-z]+\s+((?:19|20)\d{2})\b"


def note(text: Column, heading: str) -> Column:
    """The note with this heading (a pattern), up to the next line that opens a note; empty where there is none."""
    return F.regexp_extract(text, rf"(?ims)^[ \t]*(?:note[ \t]+)?\d{{1,2}}[a-z]?\.?[ \t]+(?:{heading})[^\n]*\n(.*?)(?=^[ \t]*(?:note[ \t]+)?\d{{1,2}}[a-z]?\.?[ \t]+[A-Z][a-z]|\z)", 1)


def two_columns(text: Column, labels: Sequence[str]) -> Column:
    """struct(current, comparative): the two numbers after the first label (a pattern) that has two on its line.

    A bracket that is not closed makes a number none; the label then counts for nothing. Null without a label."""

    def value(pattern: str, group: int) -> Column:
        raw = F.regexp_extract(text, pattern, group)
        balanced = F.startswith(raw, F.lit("(")) == F.endswith(raw, F.lit(")"))
        return F.when((raw != "") & balanced, financial_number(raw))

    def pair(label: str) -> Column:
        pattern = rf"(?i)(?:{label})[^\n]{{0,120}}?({_NUMBER})\s+({_NUMBER})"
        current, comparative = value(pattern, 1), value(pattern, 2)
        return F.when(current.isNotNull() & comparative.isNotNull(), F.struct(current.alias("current"), comparative.alias("comparative")))

    return F.coalesce(*[pair(x) for x in labels])


def balances(gross: Column, allowance: Column, net: Column) -> Column:
    """Whether gross less the allowance is net, but for five or a hundred-thousandth of gross; false without all three."""
    off = F.abs(gross - F.abs(allowance) - net)
    return F.coalesce(off <= F.greatest(F.lit(5), F.floor(F.abs(gross) * 0.00001)), F.lit(False))


def period(text: Column) -> Column:
    """struct(current, comparative): the two latest years of the dates in the text, if one follows the other."""
    years = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_DATED), F.lit(1)), lambda y: y.cast("int"))), asc=False)
    now, before = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    return F.when(now == before + 1, F.struct(now.alias("current"), before.alias("comparative")))


@dataclass(frozen=True)
class Checked:
    """Three figures of one note that must agree: gross less allowance is net."""

    heading: str
    gross: Sequence[str]
    allowance: Sequence[str]
    net: Sequence[str]
    prefix: str


def facts(reports: DataFrame, checked: Sequence[Checked]) -> DataFrame:
    """(doc_id, fact, year, value): figures of reports (doc_id, text), for the current and the year before.

    A report without a period, and a year of a note whose three figures don't agree or whose gross is not
    positive, give nothing: no figure is returned that was not checked."""
    rows = reports.filter(F.col("text").isNotNull()).select("doc_id", "text", period(F.col("text")).alias("period")).filter("period is not null")
    names = ["gross", "allowance", "net"]
    notes = rows.select("doc_id", "period", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), note(F.col("text"), c.heading).alias("own")) for i, c in enumerate(checked)])).alias("n"))
    own = F.col("n.own")
    pick = lambda part: reduce(lambda a, x: a.when(F.col("n.i") == x[0], two_columns(own, getattr(x[1], part))), enumerate(checked), F.when(F.lit(False), None))
    found = notes.select("doc_id", "period", "n.i", *[pick(x).alias(x) for x in names])
    years = F.array(*[F.struct(F.col(f"period.{c}").alias("year"), *[F.col(f"{x}.{c}").alias(x) for x in names]) for c in ("current", "comparative")])
    rows = found.select("doc_id", "i", F.explode(years).alias("y")).select("doc_id", "i", "y.*").filter(balances(F.col("gross"), F.col("allowance"), F.col("net")) & (F.col("gross") > 0))
    prefix = F.get(F.array(*[F.lit(c.prefix) for c in checked]), F.col("i"))
    out = F.array(*[F.struct(F.concat(prefix, F.lit(f"_{x}")).alias("fact"), (F.abs(x) if x == "allowance" else F.col(x)).alias("value")) for x in names])
    return rows.select("doc_id", "year", F.explode(out).alias("f")).select("doc_id", "f.fact", "year", "f.value")


@dataclass(frozen=True)
class Mix:
    """What a mix of evidence takes: groups that must be there, terms of narrative, texts to leave out, and sizes."""

    groups: Sequence[Sequence[str]]
    terms: Sequence[str]
    excluded: Sequence[str] = ()
    #: All of the first are worth 2, any of the second 1, beside 10 for each pattern of a group.
    dated: Sequence[str] = ()
    units: Sequence[str] = ()
    narrative: int = 8
    most: int = 12_000
    mandatory_chars: int = 8_000


def _hits(low: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, w: a + F.when(F.contains(low, F.lit(w)), 1).otherwise(0), words, F.lit(0))


def mixed(chunks: DataFrame, mix: Mix) -> DataFrame:
    """(doc_id, part, place, chunk, content): the evidence of every document from its chunks (doc_id, chunk, content).

    First, in the order of the groups, the chunk that fits each best, if any does (the earlier of equals; one
    that fits two groups stands once), then the chunks with most terms of the rest. Each part shares its budget
    among its chunks. Blank chunks and those with an excluded text take no part. Best chunks come from one
    aggregate; of the narrative no more than what could be chosen is kept by document before the shuffle.
    """
    rows = chunks.filter(F.trim(F.coalesce("content", F.lit(""))) != "").withColumn("low", F.lower("content"))
    rows = rows.filter(_hits(F.col("low"), mix.excluded) == 0)
    extra = F.lit(0)
    if mix.dated:
        extra = F.when(_hits(F.col("low"), mix.dated) == len(mix.dated), 2).otherwise(0)
    if mix.units:
        extra = extra + F.when(_hits(F.col("low"), mix.units) > 0, 1).otherwise(0)
    fits = [F.when(_hits(F.col("low"), g) > 0, 10 * _hits(F.col("low"), g) + extra) for g in mix.groups]
    scored = rows.select("doc_id", "chunk", _hits(F.col("low"), mix.terms).alias("terms"), *[f.alias(f"fit{i}") for i, f in enumerate(fits)])
    best = scored.groupBy("doc_id").agg(*[F.max(F.when(F.col(f"fit{i}").isNotNull(), F.struct(f"fit{i}", (-F.col("chunk")).alias("at")))).alias(f"best{i}") for i in range(len(fits))])
    ordered = F.array_distinct(F.array_compact(F.array(*[-F.col(f"best{i}.at") for i in range(len(fits))])))
    first = best.select("doc_id", F.posexplode(ordered).alias("place", "chunk"), F.size(ordered).alias("n"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("terms"), "chunk")
    rest = scored.filter("terms > 0").select("doc_id", "chunk", "terms").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= mix.narrative + len(fits))
    rest = rest.join(first.select("doc_id", "chunk"), ["doc_id", "chunk"], "left_anti").withColumn("r", F.row_number().over(by)).filter(F.col("r") <= mix.narrative)
    rest = rest.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    share = lambda whole, least: F.greatest(F.lit(least), F.floor(F.lit(whole) / F.col("n"))).cast("int")
    picked = first.select("doc_id", "chunk", F.lit("mandatory").alias("part"), "place", share(mix.mandatory_chars, 800).alias("room"))
    picked = picked.unionByName(rest.select("doc_id", "chunk", F.lit("narrative").alias("part"), (F.col("r") - 1).alias("place"), share(mix.most - mix.mandatory_chars, 250).alias("room")))
    found = chunks.select("doc_id", "chunk", "content").join(picked, ["doc_id", "chunk"])
    return found.select("doc_id", "part", "place", "chunk", F.substring(F.trim("content"), F.lit(1), F.col("room")).alias("content"))


def evidence_text(found: DataFrame, most: int = 12_000) -> DataFrame:
    """(doc_id, evidence): the mixed evidence of a document as one text, each piece under its heading, cut at the limit."""
    head = F.when(F.col("part") == "mandatory", "VERIFIED EVIDENCE ").otherwise("NARRATIVE EVIDENCE ")
    block = F.concat(head, (F.col("place") + 1).cast("string"), F.lit("\nCONTENT:\n"), F.col("content"))
    own = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", block.alias("block")))).alias("own"))
    return own.select("doc_id", F.substring(F.array_join(F.transform("own", lambda s: s["block"]), "\n\n"), 1, most).alias("evidence"))
