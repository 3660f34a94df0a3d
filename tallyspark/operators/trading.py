"""Trade statistics: equity, drawdown, losing streaks, profit factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equity(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Running pnl, its peak (0 at least) and the drawdown from it; a null pnl counts as 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("equity", F.sum(F.coalesce("pnl", F.lit(0.0))).over(w))
    return out.withColumn("peak", F.greatest(F.lit(0.0), F.max("equity").over(w))).withColumn("drawdown", F.col("equity") - F.col("peak"))


def losing_streak(trades: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The longest run of losses of each key; 0 without losses."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lost = F.coalesce(F.col("pnl"), F.lit(0.0)) < 0
    runs = trades.withColumn("_run", F.sum(F.when(lost, 0).otherwise(1)).over(w)).groupBy(*keys, "_run").agg(F.count_if(lost).alias("_n"))
    return runs.groupBy(*keys).agg(F.max("_n").alias("streak"))


def summary(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Win rate in per cent and profit factor, 0 where there is nothing to divide by."""
    pnl = F.coalesce(F.col("pnl"), F.lit(0.0))
    gain, loss = F.sum(F.when(pnl > 0, pnl).otherwise(0.0)), F.sum(F.when(pnl < 0, -pnl).otherwise(0.0))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.try_divide(100.0 * F.count_if(pnl > 0), F.count(F.lit(1))), F.lit(0.0)), 4).alias("win_rate"),
        F.round(F.coalesce(F.try_divide(gain, loss), F.lit(0.0)), 4).alias("profit_factor"),
    )
