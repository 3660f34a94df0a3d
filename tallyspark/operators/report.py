"""A declared report: joins by approved mappings, filters, measures by dimensions, order, limit."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"count": lambda _: F.count(F.lit(1)), "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
MOST_GROUPS = 1000


@dataclass(frozen=True)
class Measure:
    name: str
    function: str
    column: str | None = None
    digits: int | None = None

    def expression(self) -> Column:
        e = AGGREGATES[self.function](self.column)
        return (F.round(e, self.digits) if self.digits is not None else e).alias(self.name)


@dataclass(frozen=True)
class Join:
    """An approved equality between two tables."""

    left: str
    left_column: str
    right: str
    right_column: str
    how: str = "inner"


@dataclass
class Report:
    tables: list[str]
    measures: list[Measure] = field(default_factory=list)
    dimensions: dict[str, Column] = field(default_factory=dict)
    filters: list[Column] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)
    limit: int | None = None


def path(joins: list[Join], start: str, goal: str, depth: int = 4) -> list[Join]:
    """The fewest joins from one table to another."""
    queue, seen = deque([(start, [])]), {start}
    while queue:
        at, way = queue.popleft()
        if at == goal:
            return way
        for j in joins if len(way) < depth else []:
            for a, b in ((j.left, j.right), (j.right, j.left)):
                if a == at and b not in seen:
                    seen.add(b)
                    queue.append((b, [*way, j]))
    raise ValueError(f"no approved joins lead from {start} to {goal}")


FLIPPED = {"left": "right", "right": "left"}


def joined(frames: dict[str, DataFrame], joins: list[Join], tables: list[str]) -> DataFrame:
    """The tables joined, with bridges in between; a mapping used from its right side is turned round."""
    out, done = frames[tables[0]], {tables[0]}
    for name in tables[1:]:
        if name in done:
            continue
        ways = [path(joins, t, name) for t in sorted(done) if _reaches(joins, t, name)]
        if not ways:
            raise ValueError(f"no approved joins lead to {name}")
        for j in min(ways, key=len):
            if j.left in done and j.right in done:
                continue
            flip = j.right in done
            new = j.left if flip else j.right
            out = out.join(frames[new], out[j.right_column if flip else j.left_column] == frames[new][j.left_column if flip else j.right_column], FLIPPED.get(j.how, j.how) if flip else j.how)
            done.add(new)
    return out


def _reaches(joins: list[Join], start: str, goal: str) -> bool:
    try:
        path(joins, start, goal)
    except ValueError:
        return False
    return True


def run(report: Report, frames: dict[str, DataFrame], joins: list[Join], scope: Column | None = None) -> DataFrame:
    """The report's rows. The scope is a mandatory filter over the joined rows."""
    rows = joined(frames, joins, report.tables)
    for condition in [*([scope] if scope is not None else []), *report.filters]:
        rows = rows.filter(condition)
    groups = [c.alias(name) for name, c in report.dimensions.items()]
    rows = rows.groupBy(*groups).agg(*[m.expression() for m in report.measures]) if report.measures else rows.select(*groups)
    if report.order:
        rows = rows.orderBy(*report.order)
    return rows.limit(report.limit) if report.limit else rows


def latest_per_period(rows: DataFrame, day: Column, period: Column) -> DataFrame:
    """Only the rows of the last day that each period has: what a snapshot measure adds up."""
    dated = rows.withColumn("_day", day).withColumn("_period", period)
    last = dated.groupBy("_period").agg(F.max("_day").alias("_day"))
    return dated.join(F.broadcast(last), ["_period", "_day"], "left_semi").drop("_day", "_period")
