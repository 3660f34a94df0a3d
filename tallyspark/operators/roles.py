"""Which sections are evidence of a role that is asked about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a question that say nothing of the role.
STOP_WORDS = [
    "what", "which", "whose", "obligation", "obligations", "responsibility", "responsibilities", "requirement",
    "requirements", "rule", "rules", "under", "from", "this", "that", "does", "have", "are", "for", "the",
]
#: Words that make a title another role than one without them.
MODIFIERS = ["chief", "deputy", "director", "manager", "head", "board", "committee", "executive", "president", "vice", "supervisor", "coordinator"]
#: Words of titles that speak of everyone.
COLLECTIVE = ["all", "employee", "staff", "performer", "officer", "worker", "personnel", "member"]
LEAST_CHARS, OPENING = 4, 1200
#: What is cut off both ends of a word.
ENDS = ".,:;!?()[]{}'\"/"


def words(text: Column) -> Column:
    """The different words of a text: lower case, without punctuation at their ends and without a plural s."""
    bare = F.transform(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", -1)), lambda w: F.btrim(w, F.lit(ENDS)))
    plural = lambda w: (F.length(w) > 5) & w.endswith("s") & ~w.endswith("ss")
    single = F.transform(bare, lambda w: F.when(plural(w), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.filter(single, lambda w: w != ""))


def _plain(question: str) -> list[str]:
    out = []
    for w in question.split():
        w = w.lower().strip(ENDS)
        w = w[:-1] if len(w) > 5 and w.endswith("s") and not w.endswith("ss") else w
        if len(w) >= LEAST_CHARS and w not in STOP_WORDS and w not in out:
            out.append(w)
    return out


def validated(found: DataFrame, question: str) -> DataFrame:
    """The sections (title, content, ...) that are evidence of the role in question, with title_hits and opening_hits,
    how many of its words their title and their opening hold.

    At least two of the words must be there, or the one if there is but one. A title that holds some
    of them and others besides is out unless it speaks of everyone or holds all; so is a title with a modifier not
    asked for. A question without words has no evidence. Nulls are empty. Each row is judged by itself."""
    asked = _plain(question)
    if not asked:
        return found.limit(0).select("*", F.lit(0).alias("title_hits"), F.lit(0).alias("opening_hits"))
    wanted = F.array(*[F.lit(w) for w in asked])
    collective, modifiers = (F.array(*[F.lit(w) for w in some] or [F.lit("")]) for some in (COLLECTIVE, [m for m in MODIFIERS if m not in asked]))
    hits = lambda c: F.size(F.array_intersect(wanted, c))

    def judged(p):
        named = F.filter(p["title"], lambda w: (F.length(w) >= LEAST_CHARS) & ~w.rlike("^[0-9]+$"))
        enough = hits(F.array_union(p["title"], p["opening"])) >= min(2, len(asked))
        other = (hits(p["title"]) > 0) & (hits(p["title"]) < len(asked)) & (F.size(F.array_except(named, wanted)) > 0) & ~F.arrays_overlap(named, collective)
        return F.struct(hits(p["title"]).alias("title_hits"), hits(p["opening"]).alias("opening_hits"), (enough & ~other & ~F.arrays_overlap(p["title"], modifiers)).alias("_kept"))

    # one value a row, so that its words are found once and not again in a filter pushed below
    both = F.struct(words(F.col("title")).alias("title"), words(F.substring("content", 1, OPENING)).alias("opening"))
    return found.select("*", F.inline(F.filter(F.transform(F.array(both), judged), lambda j: j["_kept"]))).drop("_kept")
