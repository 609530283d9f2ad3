"""Point-in-time reads: the last bars before a date, and the first bar from a date on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_bars_before(bars: DataFrame, cutoff: DataFrame, most: int) -> DataFrame:
    """The last `most` bars of each code up to the date in the one-row table cutoff(cutoff)."""
    seen = bars.join(F.broadcast(cutoff), F.col("d") <= F.col("cutoff")).drop("cutoff")  # one row
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d")))
    return seen.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def slices(bars: DataFrame, dates: DataFrame, most: int) -> DataFrame:
    """(as_of, code, bars...): for each date the last `most` bars of each code; the loop over dates is a join.

    A bar is among them from its own date until the date of the `most`-th bar after it, so each bar meets just the dates
    that it is wanted for, and only the code's series is shuffled.  A code has one bar a date; dates are few.
    """
    until = F.lead("d", most).over(Window.partitionBy("code").orderBy("d"))
    wanted = (F.col("d") <= F.col("as_of")) & (F.col("_until").isNull() | (F.col("_until") > F.col("as_of")))
    return bars.withColumn("_until", until).join(dates, wanted).drop("_until")


def first_bar_from(targets: DataFrame, bars: DataFrame, column: str = "target") -> DataFrame:
    """targets(code, <column>, ...) with eval_d, eval_c of the first bar of the code on or after the date; null past the end.

    Linear: targets and bars are merged in one window by code from the last date back, which holds one row at a time.
    """
    keys = targets.select("code", F.col(column).alias("d")).distinct()
    merged = bars.select("code", "d", F.struct("d", "c").alias("bar"), F.lit(0).alias("kind")).unionByName(keys.select("code", "d", F.lit(None).cast("struct<d:date,c:bigint>").alias("bar"), F.lit(1).alias("kind")))
    later = Window.partitionBy("code").orderBy(F.desc("d"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("next", F.last("bar", ignorenulls=True).over(later)).where("kind = 1").select("code", F.col("d").alias(column), F.col("next.d").alias("eval_d"), F.col("next.c").alias("eval_c"))
    return targets.join(found, ["code", column], "left")
