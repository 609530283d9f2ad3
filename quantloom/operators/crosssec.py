"""Ranks across securities at one time.

With `by` the ranks are within groups and spread over tasks.  Without it one task ranks the universe of securities, a
few thousand rows for each as-of date; over many dates pass the date as `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .labels import REGIME


def _over(*by: str):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def percentile_rank(column: str, *by: str) -> Column:
    """Mean rank among equals over the count, in percent: neither percent_rank nor cume_dist."""
    ties = F.count("*").over(Window.partitionBy(*by, column)) - 1
    return (F.rank().over(_over(*by).orderBy(column)) + ties / 2) / F.count("*").over(_over(*by)) * 100


def position_rank(column: str, tie: str, *by: str) -> Column:
    """Ascending position over the count of the group, in percent; ties by another column."""
    return F.row_number().over(_over(*by).orderBy(column, tie)) / F.count("*").over(_over(*by)) * 100


def share_below(column: str, *by: str) -> Column:
    """Share of the group that is strictly smaller."""
    return (F.rank().over(_over(*by).orderBy(column)) - 1) / F.count("*").over(_over(*by))


def market_regime(last: DataFrame, *by: str) -> DataFrame:
    """(by..., breadth, mean_ret, n, regime) over last bars with 60 or more bars; columns c, ma20, ret20, nbar."""
    use = last.where("nbar >= 60")
    out = use.groupBy(*by).agg(F.avg(F.when(F.col("c") > F.col("ma20"), 1.0).otherwise(0.0)).alias("breadth"), F.avg("ret20").alias("mean_ret"), F.count("*").alias("n"))
    return out.withColumn("regime", F.expr(REGIME))


def with_regime(last: DataFrame, *by: str) -> DataFrame:
    """last bars with the regime that market_regime gives for all of them."""
    use = F.col("nbar") >= 60
    breadth = F.avg(F.when(use, F.when(F.col("c") > F.col("ma20"), 1.0).otherwise(0.0))).over(_over(*by))
    mean_ret = F.avg(F.when(use, F.col("ret20"))).over(_over(*by))
    return last.withColumns({"breadth": breadth, "mean_ret": mean_ret}).withColumn("regime", F.expr(REGIME)).drop("breadth", "mean_ret")
