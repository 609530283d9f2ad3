"""Aggregations over bars and records; all have a partial step in each task before the exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def period_label(frame: str) -> Column:
    """The last day of a bar's week (ending Friday or Sunday) or month; a Saturday belongs to the next Friday."""
    if frame == "month":
        return F.last_day("d")
    return F.next_day(F.date_sub("d", 1), {"week_friday": "FRI", "week_sunday": "SUN"}[frame])


def resample(bars: DataFrame, frame: str, label: str = "w") -> DataFrame:
    """(code, label, o, h, l, c, v, n): first open, highest, lowest, last close and summed volume of each period."""
    return bars.groupBy("code", period_label(frame).alias(label)).agg(F.min_by("o", "d").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "d").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n"))


def return_summary(returns: DataFrame, *by: str, column: str = "ret") -> DataFrame:
    """n, winners (> 0), losers (two rules), win rate, mean, extremes and sum of returns by group; nulls are left out."""
    r = F.col(column)
    known = returns.where(r.isNotNull())
    out = known.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(r > 0).alias("winners"), F.count_if(r < 0).alias("losers_strict"), F.avg(r).alias("mean"), F.max(r).alias("best"), F.min(r).alias("worst"), F.sum(r).alias("total"))
    return out.withColumns({"losers": F.col("n") - F.col("winners"), "win_rate": F.col("winners") / F.col("n") * 100})


def special_trades(records: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(code, count, inst_days, net, reason): counts, those whose reason has a word, net sum, first reason's 30 characters."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.col("reason").contains(w)
    return records.groupBy("code").agg(F.count("*").alias("lhb_count"), F.count_if(hit).alias("inst_days"), F.sum("net").alias("net"), F.substring(F.min_by("reason", "pos"), 1, 30).alias("reason"))
