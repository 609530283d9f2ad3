"""Statistics of back-tests over several groupings at once: layers, horizons, weekdays, periods and regimes.

The returns are read and shuffled once, into one row for each (group, date) or (group, period); all further groupings
start from these few rows.  Win rates count returns above 0; nulls are returns not known yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import fixed


def _sums(ret: str = "ret") -> list[Column]:
    r = F.col(ret)
    return [F.count("*").alias("picks"), F.count(r).alias("n"), F.count_if(r > 0).alias("wins"), F.sum(r).alias("total"), F.max(r).alias("best"), F.min(r).alias("worst")]


def win_rate(wins: Column | str, n: Column | str) -> Column:
    """Percent, 0 without returns."""
    n = F.col(n) if isinstance(n, str) else n
    return F.coalesce((F.col(wins) if isinstance(wins, str) else wins) / F.nullif(n, F.lit(0)) * 100, F.lit(0.0))


def mean_return(total: Column | str, n: Column | str) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.coalesce((F.col(total) if isinstance(total, str) else total) / F.nullif(n, F.lit(0)), F.lit(0.0))


def layer_stats(returns: DataFrame, first_layer: str = "l1", horizon: int = 5) -> DataFrame:
    """(layer, horizon, weekday, n, win_rate, mean, best, worst, mean_picks) of returns(layer, d, code, horizon, ret).

    weekday (0 is Monday) is null in the rows over all days.  Only dates count on which the first layer has a return at
    `horizon`; mean_picks is the mean number of picks over all dates that have any.
    """
    daily = returns.groupBy("layer", "horizon", "d").agg(*_sums())
    known = (F.col("layer") == first_layer) & (F.col("horizon") == horizon) & (F.col("n") > 0)
    daily = daily.withColumns({"seen": F.max(known).over(Window.partitionBy("d")), "weekday": F.weekday("d")})
    seen = lambda c: F.when(F.col("seen"), F.col(c))
    sums = [F.coalesce(F.sum(seen(c)), F.lit(0)).alias(c) for c in ("n", "wins", "total")]
    sets = daily.groupingSets([["layer", "horizon"], ["layer", "horizon", "weekday"]], "layer", "horizon", "weekday")
    g = sets.agg(*sums, F.max(seen("best")).alias("best"), F.min(seen("worst")).alias("worst"), F.avg("picks").alias("mean_picks"), F.grouping("weekday").alias("all_days"))
    g = g.where("all_days = 1 or n > 0")
    return g.select("layer", "horizon", "weekday", "n", win_rate("wins", "n").alias("win_rate"), mean_return("total", "n").alias("mean"), "best", "worst", "mean_picks")


def layer_deltas(stats: DataFrame, first: str = "l1", second: str = "l2") -> DataFrame:
    """(horizon, win_delta, mean_delta): what the second layer's rates, at 1 and 2 places, have on the first one's."""
    at = lambda layer, c, places: F.max(F.when(F.col("layer") == layer, F.round(c, places)))
    delta = lambda c, places: F.round(at(second, c, places) - at(first, c, places), places)
    return stats.where("weekday is null").groupBy("horizon").agg(delta("win_rate", 1).alias("win_delta"), delta("mean", 2).alias("mean_delta"))


#: Fixed limits of the advice: win rates in percent, picks a day, points.
LOW_RATE, HIGH_RATE, MANY, FEW, WORSE, DAYS_APART = 45, 60, 200, 20, 3, 5


def advice(stats: DataFrame, horizon: int = 5) -> DataFrame:
    """(advice, value): one row for each limit of layer_stats' rows at the horizon that is crossed.

    Whether the second layer helps is always said; the effect of weekdays only if the best is more than DAYS_APART points
    above the worst.
    """
    s = stats.where(F.col("horizon") == horizon)
    whole = lambda layer, c: F.max(F.when((F.col("layer") == layer) & F.col("weekday").isNull(), F.col(c)))
    days = (F.col("layer") == "l1") & F.col("weekday").isNotNull()
    one = s.agg(
        *(F.round(whole(layer, "win_rate"), 1).alias(f"{layer}_rate") for layer in ("l1", "l2")), F.round(whole("l1", "mean_picks"), 1).alias("picks"),
        F.round(F.max(F.when(days, F.round("win_rate", 1))) - F.min(F.when(days, F.round("win_rate", 1))), 1).alias("apart"),
    )
    gain = F.round(F.col("l2_rate") - F.col("l1_rate"), 1)
    rules = [
        ("first layer wins rarely", F.col("l1_rate") < LOW_RATE, F.col("l1_rate")), ("first layer wins often", F.col("l1_rate") > HIGH_RATE, F.col("l1_rate")),
        ("too many picks a day", F.col("picks") > MANY, F.col("picks")), ("too few picks a day", F.col("picks") < FEW, F.col("picks")),
        ("second layer is worse", gain < -WORSE, gain), ("weekdays differ", F.col("apart") > DAYS_APART, F.col("apart")),
        ("second layer helps", gain > 0, gain), ("second layer does not help", gain <= 0, gain),
    ]
    rows = F.array(*[F.when(c, F.struct(F.lit(name).alias("advice"), v.cast("double").alias("value"))) for name, c, v in rules])
    return one.select(F.explode(F.array_compact(rows)).alias("r")).select("r.*")


def compare_strategies(returns: DataFrame, dates: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """(kind, label, horizon, old_n, new_n, rates, means, deltas, winner) of returns(strategy, d, horizon, ret) for each period,
    for periods by regime, and for all.

    dates: d, period, regime; a date without a regime has no part in them.  A period with a bullish or neutral date counts as
    bull, one with a bearish date as bear, and one may be both.  A strategy without returns has rate and mean 0; groups where
    both have none have no row.  The new strategy wins where it is more than 1 point ahead with a higher mean, the old one
    where it is more than 1 point ahead with a higher mean of its own; else they are even.
    """
    cells = returns.join(dates.select("d", "period"), "d").groupBy("period", "strategy", "horizon").agg(*_sums())
    member = dates.groupBy("period").agg(F.bool_or(F.col("regime").isin("bull", "neutral")).alias("bull"), F.bool_or(F.col("regime") == "bear").alias("bear"))
    label = lambda kind, name, when=None: (lambda s: s if when is None else F.when(when, s))(F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("label")))
    groups = F.array_compact(F.array(label("period", F.col("period")), label("all", F.lit("all")), label("regime", F.lit("bull"), F.col("bull")), label("regime", F.lit("bear"), F.col("bear"))))
    member = member.select("period", F.explode(groups).alias("g")).select("period", "g.*")
    side = lambda s, c: F.coalesce(F.sum(F.when(F.col("strategy") == s, F.col(c))), F.lit(0))
    sums = [side(s, c).alias(f"{s_}_{c}") for s, s_ in ((old, "old"), (new, "new")) for c in ("n", "wins", "total")]
    g = cells.join(member, "period").groupBy("kind", "label", "horizon").agg(*sums).where("old_n > 0 or new_n > 0")
    g = g.withColumns({f"{s}_rate": win_rate(f"{s}_wins", f"{s}_n") for s in ("old", "new")} | {f"{s}_mean": mean_return(f"{s}_total", f"{s}_n") for s in ("old", "new")})
    g = g.withColumns({"rate_delta": F.col("new_rate") - F.col("old_rate"), "mean_delta": F.col("new_mean") - F.col("old_mean")})
    winner = F.when((F.col("rate_delta") > 1) & (F.col("mean_delta") > 0), "new").when((F.col("rate_delta") < -1) & (F.col("mean_delta") < 0), "old").otherwise("even")
    return g.drop("old_wins", "new_wins", "old_total", "new_total").withColumn("winner", winner)


def pick_counts(picks: DataFrame, dates: DataFrame) -> DataFrame:
    """(strategy, layer, period, mean_picks) of picks(strategy, layer, d): means over the dates of a period, and over all (null).

    Dates on which a strategy picks nothing count with 0, as long as the layer has any pick at all.
    """
    daily = picks.join(dates.select("d", "period"), "d").groupBy("strategy", "layer", "period").agg(F.count("*").alias("picks"))
    days = dates.groupBy("period").agg(F.count("*").alias("days"))
    # each strategy and layer meets each period once
    grid = daily.select("strategy", "layer").distinct().join(days)
    g = grid.join(daily, ["strategy", "layer", "period"], "left").groupingSets([["strategy", "layer"], ["strategy", "layer", "period"]], "strategy", "layer", "period")
    return g.agg((F.coalesce(F.sum("picks"), F.lit(0)) / F.sum("days")).alias("mean_picks"))


def fixed_columns(df: DataFrame, **places: int) -> DataFrame:
    """df with the named columns as whole numbers of 10^-places."""
    return df.withColumns({c: fixed(c, p) for c, p in places.items()})
