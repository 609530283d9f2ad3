"""Portfolio rules: trade levels, caps by group, position scaling, market-timing limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import rounded


def bias_warning(severe: float = 7.5, mild: float = 5.0) -> Column:
    """Distance of the close from its 5-bar mean in percent: severe unless the means are stacked upwards."""
    bias = (F.col("c") - F.col("ma5")) / F.col("ma5") * 100
    stacked = (F.col("ma5") > F.col("ma10")) & (F.col("ma10") > F.col("ma20"))
    return F.when((bias > severe) & ~stacked, "severe").when(bias > mild, "mild").otherwise("")


def first_per_group(rows: DataFrame, group: str, most: int, *order) -> DataFrame:
    """At most `most` rows of each group, the first ones; Spark limits each task's groups before the exchange."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


#: Limits by the market's score: (least score, recommendations, ballot size, expert size, label), best first.
TIMING = ((70, 15, 25, 15, "strong"), (50, 10, 25, 15, "leaning up"), (30, 6, 20, 10, "sideways"), (15, 3, 15, 8, "weak"), (float("-inf"), 0, 10, 5, "stand aside"))
#: Scores of words where no number is given.
TREND_SCORE = {"up": 70, "sideways": 50, "down": 25}
MOOD_SCORE = {"euphoric": 75, "normal": 50, "cold": 30}
#: Most of the capital in use by market label.
POSITION_CAP = {"strong": 0.8, "leaning up": 0.6, "sideways": 0.4, "weak": 0.2, "stand aside": 0.0}


def timing_limits(markets: DataFrame) -> DataFrame:
    """markets(score, trend, mood) with limits; without a score it is the mean of what the words stand for."""
    word = lambda c, table: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)], F.lit(50))
    score = F.coalesce(F.col("score").cast("double"), (word("trend", TREND_SCORE) + word("mood", MOOD_SCORE)) / 2)
    out = F.lit(None)
    for least, recs, ballot, expert, label in reversed(TIMING):
        row = F.struct(F.lit(recs).alias("recommendations"), F.lit(ballot).alias("ballot"), F.lit(expert).alias("expert"), F.lit(label).alias("label"))
        out = row if least == float("-inf") else F.when(score >= least, row).otherwise(out)
    return markets.withColumn("score", score).withColumn("_l", out).select("*", "_l.*").drop("_l")


def trade_levels(last: DataFrame) -> DataFrame:
    """Entries, stop, targets at 1, 2 and 3 risks, and position by volatility; last: c, ma20, atr14, low20 in price units."""
    x = last.withColumns({"aggressive": rounded("c", 2), "moderate": rounded(F.least(F.col("c"), F.col("ma20") * 1.01), 2), "conservative": rounded(F.greatest(F.col("ma20"), F.col("low20") * 1.02), 2)})
    stop = rounded(F.greatest(F.col("ma20") * 0.98, F.col("c") - 2 * F.col("atr14"), F.col("low20").cast("double")), 2)
    x = x.withColumn("stop", F.when(stop >= F.col("moderate"), rounded(F.col("moderate") * 0.95, 2)).otherwise(stop))
    risk = F.col("moderate") - F.col("stop")
    vol = F.col("atr14") / F.col("c") * 100
    x = x.withColumns({f"t{k}": rounded(F.col("moderate") + risk * k, 2) for k in (1, 2, 3)})
    return x.withColumns({"volatility": vol, "position": F.when(vol < 2, 8.0).when(vol < 3.5, 6.0).when(vol < 5, 4.0).otherwise(2.5)}).where(risk > 0)


def group_cap(picks: DataFrame, group: str, most: int, score: str = "final_score", pos: str = "pos") -> DataFrame:
    """picks with kept: the first `most` of each group by score, no score counting as 0, then by input position."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(F.coalesce(F.col(score), F.lit(0)).desc(), pos))
    return picks.withColumn("kept", n <= most)


def scale_positions(picks: DataFrame, cap: Column | float, position: str = "position") -> DataFrame:
    """picks with scaled: positions shrunk in proportion where their sum is above the cap."""
    total = F.sum(position).over(Window.partitionBy())
    return picks.withColumn("scaled", F.when(total > cap, F.col(position) * cap / total).otherwise(F.col(position)))


def diversify(picks: DataFrame, group: str, most: int, pos: str = "pos") -> DataFrame:
    """Greedy diversity: at most `most` of each group in order; kept rows keep their order in `place`."""
    kept = group_cap(picks.withColumn("_s", F.lit(0)), group, most, "_s", pos).where("kept").drop("_s", "kept")
    return kept.withColumn("place", F.row_number().over(Window.orderBy(pos)).cast("long"))
