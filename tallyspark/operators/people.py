"""People on pages: cards of a role, and the listing of a board."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.text import bound

#: How a line names a chief executive, and a deputy.
CHIEF = ["chief executive officer", "chief executive", "ceo"]
DEPUTY = ["deputy chief executive officer", "deputy chief executive", "deputy ceo", "deputy chief"]
#: Neighbours of a chief's line that belong to a deputy.
OF_DEPUTY = ["deputy chief", "deputy ceo"]
MOST_RECORDS = 20
#: How the lines of a board member begin, what a member can be, and what ends the listing.
QUALIFICATION, EXPERIENCE = "qualification:", "experience:"
BOARD_ROLES = ["chairman", "d/chairman", "deputy chairman", "vice chairman", "director"]
LAST = "company secretary"


def lines(text: Column) -> Column:
    """The lines of a text that hold anything, white space collapsed; none for a null."""
    parts = F.split(F.coalesce(text, F.lit("")), "\\R|[\x1c-\x1e]", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def _names(line: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(line, F.lit(w)) for w in words])


def role_records(text: Column, deputy: bool = False, most: int = MOST_RECORDS) -> Column:
    """An array of the cards of a page's chief executive, or of its deputies: the line that names the role
    and its neighbours, each different card once, in order, the first `most`. A chief's card leaves out
    lines of a deputy. An array without entries where the text is null or names nobody."""

    def found(all_lines):
        at = F.transform(all_lines, lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("line")))
        hits = F.filter(at, lambda r: _names(r["line"], DEPUTY) if deputy else _names(r["line"], CHIEF) & ~F.contains(r["line"], F.lit("deputy")))

        def card(r):
            near = F.slice(all_lines, F.greatest(r["i"], F.lit(1)), F.when(r["i"] == 0, 2).otherwise(3))
            return F.array_join(near if deputy else F.filter(near, lambda x: ~_names(F.lower(x), OF_DEPUTY)), "\n")

        return F.slice(F.array_distinct(F.transform(hits, card)), 1, most)

    return bound(lines(text), found)


def board(text: Column) -> Column:
    """An array of (name, role, qualification, experience), the members that a page lists, in order.

    A member is four lines: a name, a qualification, an experience and a role. The listing begins at the
    line before the first qualification and ends at a line with LAST, if that line isn't a member's own
    further line. A role line is no name of the next member. One page's lines are one value."""

    def found(all_lines):
        begins = lambda i, word: F.startswith(F.lower(F.get(all_lines, i)), F.lit(word))
        at = F.transform(
            all_lines,
            lambda x, i: F.struct(
                i.alias("i"),
                F.contains(F.lower(x), F.lit(LAST)).alias("last"),
                F.coalesce(begins(i + 1, QUALIFICATION), F.lit(False)).alias("first"),
                F.coalesce(begins(i + 1, QUALIFICATION) & begins(i + 2, EXPERIENCE) & F.lower(F.get(all_lines, i + 3)).isin(BOARD_ROLES), F.lit(False)).alias("member"),
            ),
        )
        start = F.struct(F.lit(0).alias("free"), F.lit(False).alias("begun"), F.lit(False).alias("ended"), F.array().cast("array<int>").alias("taken"))

        def step(s, r):
            begun = s["begun"] | r["first"]
            looked = begun & ~s["ended"] & (r["i"] >= s["free"])
            member = looked & r["member"] & ~r["last"]
            return F.struct(
                F.when(member, r["i"] + 4).otherwise(s["free"]).alias("free"),
                begun.alias("begun"),
                (s["ended"] | (looked & r["last"])).alias("ended"),
                F.when(member, F.concat(s["taken"], F.array(r["i"]))).otherwise(s["taken"]).alias("taken"),
            )

        taken = F.aggregate(F.filter(at, lambda r: r["first"] | r["last"]), start, step)["taken"]
        line = lambda i, k: F.get(all_lines, i + k)
        return F.transform(taken, lambda i: F.struct(line(i, 0).alias("name"), line(i, 3).alias("role"), line(i, 1).alias("qualification"), line(i, 2).alias("experience")))

    return bound(lines(text), found)
