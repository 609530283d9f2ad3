"""Prices adjusted for splits and dividends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("o", "h", "l", "c")


def forward_adjusted(bars: DataFrame, factors: DataFrame, least: int = 5, last: int | None = None) -> DataFrame:
    """bars with prices times the factors of all later events, so that the last bar keeps its own; `factor` is that product.

    factors: code, d, factor; a price before the day d is worth factor times its number, one on d or later is as it is.  Several
    events of a day multiply; null factors are 1.  Codes of fewer than `least` bars with a close go, as do bars without a
    close; of the others the `last` bars stay.  One window by code from the last date back: events of days without a bar
    count for all bars before them.
    """
    f = factors.where("factor is not null").groupBy("code", "d").agg(F.product("factor").alias("_own"))
    x = bars.where("c is not null").select("*", F.lit(None).cast("double").alias("_own"), F.lit(True).alias("_bar"))
    x = x.unionByName(f.withColumn("_bar", F.lit(False)), allowMissingColumns=True)
    back = Window.partitionBy("code").orderBy(F.unix_date("d").desc())
    later, upto = back.rangeBetween(Window.unboundedPreceding, -1), back.rangeBetween(Window.unboundedPreceding, 0)
    bars_upto = F.count_if("_bar").over(upto)
    x = x.withColumns({"factor": F.coalesce(F.product("_own").over(later), F.lit(1.0)), "_n": bars_upto, "_all": F.count_if("_bar").over(Window.partitionBy("code"))})
    x = x.where(F.col("_bar") & (F.col("_all") >= least))
    if last is not None:
        x = x.where(F.col("_n") <= last)
    return x.select(*[(F.col(c) * F.col("factor")).alias(c) if c in PRICES else F.col(c) for c in bars.columns if c != "factor"], "factor")
