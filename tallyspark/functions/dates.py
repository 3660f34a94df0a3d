"""Relative date ranges, half open, and time grains. The day of reference is always given."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def months_later(day: date, n: int) -> date:
    """The first of the month n months later."""
    m = day.year * 12 + day.month - 1 + n
    return date(m // 12, m % 12 + 1, 1)


def date_range(op: str, as_of: date, months: int = 1) -> tuple[date, date]:
    """[start, end) of this_/last_/next_ day, week (from Monday), month or year, and of
    rolling_months: so many completed months before the one of as_of."""
    if op == "rolling_months":
        if not 1 <= months <= 120:
            raise ValueError("rolling_months takes 1 to 120 months")
        return months_later(as_of, -months), months_later(as_of, 0)
    which, _, unit = op.partition("_")
    k = {"this": 0, "last": -1, "next": 1}[which]
    if unit == "day":
        return as_of + timedelta(k), as_of + timedelta(k + 1)
    if unit == "week":
        monday = as_of - timedelta(as_of.weekday())
        return monday + timedelta(7 * k), monday + timedelta(7 * k + 7)
    if unit == "month":
        return months_later(as_of, k), months_later(as_of, k + 1)
    if unit == "year":
        return date(as_of.year + k, 1, 1), date(as_of.year + k + 1, 1, 1)
    raise ValueError(f"unknown range: {op}")


def within(column: str, op: str, as_of: date, months: int = 1) -> Column:
    """The range on the bare column, so that it is pushed to the scan."""
    start, end = date_range(op, as_of, months)
    c = F.col(column)
    return (c >= F.lit(start).cast("timestamp_ntz")) & (c < F.lit(end).cast("timestamp_ntz"))


def within_numeric(column: Column, op: str, as_of: date, months: int = 1) -> Column:
    """The range on a YYYYMMDD integer."""
    start, end = (int(d.strftime("%Y%m%d")) for d in date_range(op, as_of, months))
    return (column >= start) & (column < end)


def time_grain(column: str, grain: str) -> Column:
    """Beginning of the day, week, month, quarter or year of a timestamp."""
    return F.date_trunc(grain, F.col(column)).cast("timestamp_ntz")


def numeric_grain(column: Column, grain: str) -> Column:
    """Period of a YYYYMMDD integer: the day itself, the week's Monday, YYYYMM, YYYY-Qn, or YYYY."""
    if grain == "day":
        return column.cast("int")
    if grain == "month":
        return F.floor(column / 100).cast("int")
    if grain == "year":
        return F.floor(column / 10000).cast("int")
    day = F.to_date(column.cast("string"), "yyyyMMdd")
    if grain == "week":
        return F.date_trunc("week", day).cast("date")
    if grain == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    raise ValueError(f"unknown grain: {grain}")
