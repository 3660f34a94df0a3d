"""Years that questions name, and the report of that year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A year, or two in a row in long and short form.
BOTH_YEARS = r"\b(20\d{2})\s*[/\-]\s*(20\d{2})\b"
SHORT_YEARS = r"\b(20\d{2})\s*[/\-]\s*(\d{2})\b"
ONE_YEAR = r"\b(20\d{2})\b"
#: Points for the whole year as it is asked for, its first, its second, and the end of its second.
WHOLE, FIRST, SECOND, ENDING = 100, 40, 40, 20


def requested_year(question: Column) -> Column:
    """The year a question names as 2023, or as 2023/2024 from that, 2023-2024 or 2023/24; two years before one, null without any."""
    part = lambda pattern, k: F.regexp_extract(question, pattern, k)
    return (
        F.when(question.rlike(BOTH_YEARS), F.concat(part(BOTH_YEARS, 1), F.lit("/"), part(BOTH_YEARS, 2)))
        .when(question.rlike(SHORT_YEARS), F.concat(part(SHORT_YEARS, 1), F.lit("/"), F.substring(part(SHORT_YEARS, 1), 1, 2), part(SHORT_YEARS, 2)))
        .when(question.rlike(ONE_YEAR), part(ONE_YEAR, 1))
    )


def score(year: Column, title: Column, filename: Column, url: Column) -> Column:
    """How well a report's names fit a year of requested_year; 0 is not at all."""
    names = F.replace(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, filename, url)])), F.lit("-"), F.lit("/"))
    first, second = F.substring_index(year, "/", 1), F.when(F.contains(year, F.lit("/")), F.substring_index(year, "/", -1))
    points = lambda c, n: F.when(F.contains(names, c), n).otherwise(0)
    return points(year, WHOLE) + points(first, FIRST) + points(second, SECOND) + points(F.right(second, F.lit(2)), ENDING)


def select_reports(questions: DataFrame, reports: DataFrame) -> DataFrame:
    """(query_id, year, report_id, score) of every question (query_id, owner, question): its owner's report of the year.

    reports is (report_id, owner, title, filename, url). The report with the most points is taken, of several the
    one with the smallest id; none with no points. A question without a year gets the owner's first report,
    without a score. Questions meet reports only as the different years asked of an owner, of which there can be no
    more than 10,100, so an owner with very many questions and reports is no product of both, and of the reports of
    one owner and year each task passes on only its best. A null owner or question has no report."""
    asked = questions.select("query_id", "owner", requested_year(F.col("question")).alias("year"), F.col("question").isNotNull().alias("_asks"))
    wanted = asked.filter("_asks and year is not null").select("owner", "year").distinct()
    points = score(F.col("year"), F.col("title"), F.col("filename"), F.col("url"))
    scored = reports.join(wanted, "owner").select("owner", "year", "report_id", points.alias("score")).filter("score > 0")
    best = scored.groupBy("owner", "year").agg(F.max_by(F.struct("report_id", "score"), F.struct("score", -F.col("report_id"))).alias("_best"))
    first = reports.groupBy("owner").agg(F.min("report_id").alias("_first"))
    rows = asked.join(best, ["owner", "year"], "left").join(first, "owner", "left")
    report = F.when(F.col("year").isNotNull(), F.col("_best.report_id")).when(F.col("_asks"), F.col("_first"))
    return rows.select("query_id", "year", report.alias("report_id"), F.col("_best.score").alias("score"))
