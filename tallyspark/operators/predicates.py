"""The declared filter operators as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {"=": "__eq__", "!=": "__ne__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__"}


def predicate(column: str, op: str, value=None) -> Column:
    c = F.col(column)
    if op in COMPARISONS:
        return getattr(c, COMPARISONS[op])(value)
    if op == "contains":
        return c.contains(value)
    if op == "like":
        return c.like(value)
    if op == "not_like":
        return ~c.like(value)
    if op == "in":
        if not value:
            raise ValueError("in takes at least one value")
        return c.isin(list(value))
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op == "between_or_between":
        ranges = [tuple(part.split(",")) for part in value.split("|")]
        if len(ranges) != 2 or any(len(r) != 2 for r in ranges):
            raise ValueError("between_or_between takes two ranges: a,b|c,d")
        try:
            ranges = [(int(a), int(b)) for a, b in ranges]
        except ValueError:
            pass
        return reduce(lambda x, y: x | y, [c.between(a, b) for a, b in ranges])
    raise ValueError(f"unknown operator: {op}")


def implies(condition: Column, then: Column) -> Column:
    """Rows where the condition holds must satisfy then; unknown counts as SQL counts it."""
    return ~condition | then


def any_contains(columns: list[str], text: str) -> Column:
    """Any of the columns holds the text, in any case."""
    return reduce(lambda x, y: x | y, [F.lower(F.col(c)).contains(text.lower()) for c in columns])


def every(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))
