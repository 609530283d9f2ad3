"""Ratios of a report to an earlier one, by family: which earlier one is the family's own rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def period_ratios(snapshots: DataFrame, families: dict[str, tuple[int, bool]], least: int = 2) -> DataFrame:
    """(code, family, latest, earlier, change): the newest snapshot against an earlier one, in percent at 1 place.

    snapshots: code, family, d, value, in one long table; families: how many snapshots back, and whether the oldest there is
    stands in where there are not so many.  Codes with fewer than `least` snapshots of a family, without the one that is
    asked for, or whose earlier value is not above 0 have no row; null values are 0.  Only the newest snapshots go on after
    the row number, so a long history costs no memory.
    """
    by = Window.partitionBy("code", "family")
    n = F.row_number().over(by.orderBy(F.desc("d"), F.desc("value")))
    x = snapshots.where(F.col("family").isin(*families)).withColumns({"_n": n, "_all": F.count("*").over(by), "value": F.coalesce("value", F.lit(0.0))})
    table = F.create_map(*[c for k, (back, _) in families.items() for c in (F.lit(k), F.lit(back))])
    clamps = F.create_map(*[c for k, (_, clamp) in families.items() for c in (F.lit(k), F.lit(clamp))])
    back = F.when(clamps[F.col("family")], F.least(table[F.col("family")], F.col("_all") - 1)).otherwise(table[F.col("family")])
    x = x.withColumn("_back", back).where((F.col("_all") >= least) & ((F.col("_n") == 1) | (F.col("_n") == F.col("_back") + 1)))
    at = lambda c: F.max(F.when(c, F.col("value")))
    g = x.groupBy("code", "family").agg(at(F.col("_n") == 1).alias("latest"), at(F.col("_n") == F.col("_back") + 1).alias("earlier"))
    return g.where("earlier > 0").withColumn("change", F.round((F.col("latest") - F.col("earlier")) / F.col("earlier") * 100, 1))


def newest(snapshots: DataFrame, *columns: str) -> DataFrame:
    """(code, columns) of each code's newest snapshot (d; of several then the greatest values)."""
    return snapshots.groupBy("code").agg(F.max_by(F.struct(*columns), F.struct("d", *columns)).alias("s")).select("code", "s.*")


def goodwill_ratio(sheets: DataFrame) -> DataFrame:
    """(code, goodwill_ratio): the newest balance sheet's goodwill against its equity in percent at 1 place.

    Null goodwill is 0; equity that is null, 0 or below 1 is 1.
    """
    equity = F.greatest(F.coalesce(F.nullif("equity", F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    return newest(sheets, "goodwill", "equity").select("code", F.round(F.coalesce("goodwill", F.lit(0.0)) / equity * 100, 1).alias("goodwill_ratio"))


def recent_trades(trades: DataFrame, most: int = 30) -> DataFrame:
    """(code, count, mean_discount) over the newest `most` block trades (d, then pos descending); the mean of known ones at 2 places."""
    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("d"), F.desc("pos")))
    x = trades.withColumn("_n", n).where(F.col("_n") <= most)
    return x.groupBy("code").agg(F.count("*").alias("count"), F.round(F.avg("discount"), 2).alias("mean_discount"))
