"""Text functions as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Own choice: words that carry no meaning in a request.
STOP_WORDS = "about all and are can does for from give has have how into list me of please show that the their them this to was were what when where which who will with you your".split()
#: Phrases for a time.
TIME_PHRASES = ["today", "yesterday", "tomorrow", "this week", "last week", "next week", "this month", "last month", "next month", "this year", "last year", "next year"]
STATUS_TERMS = ["active", "approved", "closed", "completed", "expired", "inactive", "open", "pending", "rejected"]
#: Own choice: parts of names that mark a column as sensitive.
SENSITIVE = ["email", "phone", "mobile", "address", "password", "salary", "passport", "tin"]
#: Own choice: abbreviations in identifiers.
ABBREVIATIONS = {"acct": "account", "addr": "address", "amt": "amount", "bal": "balance", "cust": "customer", "dt": "date", "no": "number", "qty": "quantity", "supp": "supplier"}


def bound(c: Column, f) -> Column:
    """f of the value of c, which is worked out once however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def normalized(c: Column) -> Column:
    """Lower case, _ and - as spaces, letters, digits and single spaces only."""
    c = F.regexp_replace(F.lower(c), r"[_\-]+", " ")
    c = F.regexp_replace(c, r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower case, of more than two characters and not stop words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def singular(word: Column) -> Column:
    """The singular of a regular English plural."""
    shorter = lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    return (
        F.when(word.rlike("ies$") & (F.length(word) > 3), F.concat(shorter(3), F.lit("y")))
        .when(word.rlike("(ch|sh|x|z|s)es$"), shorter(2))
        .when(word.rlike("[^s]s$"), shorter(1))
        .otherwise(word)
    )


def has_phrase(c: Column, phrase: str) -> Column:
    """The phrase stands alone, not inside a longer word."""
    return F.lower(c).rlike("(?<![a-z0-9])" + phrase.lower() + "(?![a-z0-9])")


def matching(c: Column, phrases: list[str]) -> Column:
    """The phrases that stand alone in the text, in the order given. One pass finds them all; what follows
    a phrase is only looked at, so phrases may share the character between them."""
    longest = "|".join(sorted((p.lower() for p in phrases), key=len, reverse=True))
    found = F.regexp_extract_all(F.lower(c), F.lit(f"(?<![a-z0-9])({longest})(?![a-z0-9])"), F.lit(1))
    return F.array_intersect(F.array(*[F.lit(p) for p in phrases]), found)


def intent(c: Column) -> Column:
    """What a request asks for; a forbidden verb wins, then the first that fits."""
    any_of = lambda *words: reduce(lambda a, b: a | b, [has_phrase(c, w) for w in words])
    return (
        F.when(any_of("delete", "drop", "update", "insert", "truncate"), "blocked")
        .when(any_of("count", "how many"), "count")
        .when(any_of("top", "highest", "lowest"), "ranking")
        .when(any_of("trend", "monthly"), "trend")
        .when(any_of("compare", "versus"), "comparison")
        .when(any_of("expired", "expiring"), "expiry")
        .when(any_of("total", "average", "sum"), "aggregation")
        .when(any_of("show", "list"), "select")
        .otherwise("unknown")
    )


def snippet(c: Column, at: Column, before: int = 80, after: int = 160, most: int = 240) -> Column:
    """Text around a place (from 1), white space collapsed; null where at is 0."""
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(F.trim(F.regexp_replace(F.substring(c, start, at + after - start), r"\s+", " ")), 1, most))


def compact(c: Column) -> Column:
    """A number in thousands, millions or billions."""
    size = F.abs(c)
    scaled = lambda by, unit: F.concat(F.format_number(c / by, 2), F.lit(unit))
    return F.when(c.isNull(), "-").when(size >= 1e9, scaled(1e9, "B")).when(size >= 1e6, scaled(1e6, "M")).when(size >= 1e3, scaled(1e3, "K")).otherwise(F.format_number(c, 2))


def listed(c: Column) -> Column:
    """A JSON list, or else a list divided by , ; or line breaks: trimmed, without blanks, each once."""
    parts = F.coalesce(F.from_json(c, "array<string>"), F.split(c, r"[,;\n]+"))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def financial_number(c: Column) -> Column:
    """A number with commas, negative in brackets; null where there is none."""
    negative = c.rlike(r"^\s*\(.*\)\s*$") | F.trim(c).startswith("-")
    value = F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")
    return F.bround(F.when(negative, -value).otherwise(value), 0).cast("long")


def identifier_words(c: Column) -> Column:
    """An identifier as words, abbreviations spelled out."""
    names = F.create_map(*[F.lit(x) for p in ABBREVIATIONS.items() for x in p])
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+", " ")), " ")
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(names, w), w)), " ")
