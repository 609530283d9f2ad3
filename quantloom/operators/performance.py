"""Forward returns of recommendations and what is learnt from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import first_bar_from

HORIZONS = (3, 5, 8, 20, 60)


def trading_offset(d: Column | str, n: int) -> Column:
    """A calendar date surely n trading days on: floor(1.4 n) + 2 days."""
    return F.date_add(d, int(1.4 * n) + 2)


def forward_returns(recommended: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """recommended(code, d, price, ...) by horizon with ret in percent (2 places) of the first close from the target on."""
    t = recommended.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    days = F.floor(F.col("horizon") * 1.4).cast("int") + 2
    t = t.withColumn("target", F.date_add("d", days))
    out = first_bar_from(t, bars)
    return out.withColumn("ret", (F.col("eval_c") - F.col("price")) / F.col("price") * 100)


def model_weights(daily: DataFrame, least_records: int = 3) -> DataFrame:
    """Adaptive weights from daily(model, d, total, win_rate, avg_return).

    Days with 5 or more records; 60 % win rate and 40 % clipped return, over the models' mean, within 0.5 and 1.5.
    Models with fewer than least_records days weigh 1.
    """
    use = daily.where("total >= 5")
    m = use.groupBy("model").agg(F.count("*").alias("days"), (F.sum(F.col("win_rate") * F.col("total")) / F.sum("total")).alias("win"), (F.sum(F.col("avg_return") * F.col("total")) / F.sum("total")).alias("avg"))
    raw = F.col("win") / 100 * 0.6 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("avg") + 10) / 20)) * 0.4
    m = m.withColumn("raw", raw)
    ratio = F.col("raw") / F.avg("raw").over(Window.partitionBy())
    clipped = F.round(F.least(F.lit(1.5), F.greatest(F.lit(0.5), ratio)), 3)
    return m.select("model", "days", F.when(F.col("days") >= least_records, clipped).otherwise(1.0).alias("weight"))


def split_effect(rows: DataFrame, score: str, ret: str, *by: str) -> DataFrame:
    """Win rates above (and at) and below each group's upper median score, and their difference."""
    n = F.count("*").over(Window.partitionBy(*by))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(score))
    x = rows.withColumns({"_n": n, "_p": place})
    median = F.max(F.when(F.col("_p") == F.floor(F.col("_n") / 2) + 1, F.col(score))).over(Window.partitionBy(*by))
    x = x.withColumn("_high", F.col(score) >= median)
    rate = lambda side: F.avg(F.when(F.col("_high") == side, F.when(F.col(ret) > 0, 100.0).otherwise(0.0)))
    return x.groupBy(*by).agg(rate(True).alias("high"), rate(False).alias("low")).withColumn("spread", F.col("high") - F.coalesce("low", F.lit(0.0)))


def streaks(history: DataFrame) -> DataFrame:
    """history(d, code): for each code in the last recorded date, how many recorded dates in a row hold it."""
    dates = history.select("d").distinct().withColumn("n", F.row_number().over(Window.orderBy(F.desc("d"))))
    h = history.distinct().join(dates, "d")
    run = h.withColumn("island", F.col("n") - F.row_number().over(Window.partitionBy("code").orderBy("n")))
    return run.where("island = 0").groupBy("code").agg(F.count("*").alias("days"))


def retained(history: DataFrame, dates: int = 14) -> DataFrame:
    """The rows of the newest recorded dates."""
    keep = history.select("d").distinct().orderBy(F.desc("d")).limit(dates)
    return history.join(keep, "d", "left_semi")


def suggestions(stats: DataFrame) -> DataFrame:
    """Rows of advice where a layer's statistics cross the fixed limits."""
    rules = [("win rate low", F.col("win_rate") < 45), ("win rate high", F.col("win_rate") > 60), ("too many picks", F.col("n") > 200), ("mean loss", F.col("mean") < -3)]
    rows = F.array(*[F.when(c, F.lit(name)) for name, c in rules])
    return stats.withColumn("advice", F.explode(F.filter(rows, lambda x: x.isNotNull())))
