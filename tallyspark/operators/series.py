"""Time series: trend facts, shares, least-squares forecasts, and a stored series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_POINTS, MOST_POINTS, MOST_AHEAD = 4, 12, 24


def completed(points: DataFrame, period: str, current: Column) -> DataFrame:
    """Points of periods before the current one."""
    return points.filter(F.col(period) < current)


def last_points(points: DataFrame, keys: list[str], period: str, k: int = MOST_POINTS) -> DataFrame:
    """The last k points of each series with their index from 0, oldest first."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(period))
    oldest = Window.partitionBy(*keys).orderBy(F.asc(period))
    return points.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= k).drop("_r").withColumn("x", F.row_number().over(oldest) - 1)


def trend(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, slope, intercept and r2 of each series over its index x; r2 of a constant is 1, a single point has slope 0."""
    y, x = F.col(value).cast("double"), F.col("x").cast("double")
    one = F.count(F.lit(1)) == 1
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(one, F.lit(0.0)).otherwise(F.regr_slope(y, x)).alias("slope"),
        F.when(one, F.first(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"),
        F.when(one | (F.min(y) == F.max(y)), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regr_r2(y, x)))).alias("r2"),
        F.max("period").alias("last_period"),
    )


def confidence(n: Column, r2: Column) -> Column:
    return F.when((n >= 9) & (r2 >= 0.7), "high").when((n >= 6) & (r2 >= 0.35), "medium").otherwise("low")


def forecast(points: DataFrame, keys: list[str], value: str, ahead: int = 3) -> DataFrame:
    """The next periods of monthly series of at least LEAST_POINTS points, never below 0."""
    ahead = min(max(ahead, 1), MOST_AHEAD)
    fit = trend(last_points(points, keys, "period"), keys, value).filter(F.col("n") >= LEAST_POINTS)
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    out = F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step")))
    return steps.select(*keys, F.add_months(F.to_date("last_period"), F.col("step")).alias("period"), out.alias("forecast"), confidence(F.col("n"), F.col("r2")).alias("confidence"))


def change(first: Column, last: Column) -> Column:
    """Change in per cent of the first value; null where that is 0."""
    return F.try_divide((last - first) * 100, F.abs(first))


def shares(totals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row's share of the sum over its keys, in per cent, and its rank."""
    whole = Window.partitionBy(*keys)
    return totals.withColumn("share", F.try_divide(F.col(value) * 100, F.sum(value).over(whole))).withColumn("rank", F.row_number().over(whole.orderBy(F.desc(value), *[c for c in totals.columns if c not in (*keys, value)])))
