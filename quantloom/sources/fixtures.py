"""Views that give the engine's table shapes over the TPC-H-like tables, and the same views as SQL text.

bars_walk is whole numbers throughout (cents and units), so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.sources.feeds import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, o, h, l, c, v): one bar for each supplier and ship date."""
    li = table(spark, sf_dir, "lineitem")
    p = F.round(F.col("l_extendedprice") * 100).cast("long")
    r = li.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d"), p.alias("p"), F.col("l_quantity").cast("long").alias("q"))
    r = dealt(r, li.count(), "code")  # one exchange for bars and windows by code
    day = r.groupBy("code", "d").agg(F.sum(F.col("p") % 401 - 200).alias("step"), F.max(F.col("p") % 97).alias("up"), F.max(F.col("p") % 89).alias("dn"), F.sum("q").alias("v"))
    c = (F.lit(20000) + F.sum("step").over(Window.partitionBy("code").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))).alias("c")
    o = F.col("c") - F.col("step")
    return day.select("code", "d", "step", "up", "dn", "v", c).select("code", "d", o.alias("o"), (F.greatest("c", o) + F.col("up")).alias("h"), (F.least("c", o) - F.col("dn")).alias("l"), "c", "v")


BARS = """r as (select l_suppkey code, cast(l_shipdate as date) d, cast(round(l_extendedprice*100) as bigint) p, cast(l_quantity as bigint) q from lineitem),
day as (select code, d, cast(sum(p % 401 - 200) as bigint) step, max(p % 97) up, max(p % 89) dn, cast(sum(q) as bigint) vol from r group by code, d),
walk as (select code, d, 20000 + cast(sum(step) over (partition by code order by d rows unbounded preceding) as bigint) c, step, up, dn, vol from day),
bars as (select code, d, c-step o, greatest(c,c-step)+up h, least(c,c-step)-dn l, c, vol v from walk)"""


def bars_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, o, h, l, c, v): event types as codes, days as bars, values in cents."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.to_date("ts").alias("d"), "ts", F.round(F.col("value") * 100).cast("long").alias("x"))
    return e.groupBy("code", "d").agg(F.min_by("x", "ts").alias("o"), F.max("x").alias("h"), F.min("x").alias("l"), F.max_by("x", "ts").alias("c"), F.sum("x").alias("v"))


TICKS = """tick as (select event_type code, cast(ts as date) d, ts, cast(round(value*100) as bigint) x from events),
bars_tick as (select code, d, arg_min(x, ts) o, max(x) h, min(x) l, arg_max(x, ts) c, cast(sum(x) as bigint) v from tick group by code, d)"""


def basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, pe, mktcap): a dimension with some missing pe."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("code"), F.col("s_name").alias("name"), F.when(k % 11 != 0, 5 + k % 70).alias("pe"), (20 + (k * 37) % 2000).alias("mktcap"))


BASICS = "basics as (select s_suppkey code, s_name as name, case when s_suppkey % 11 <> 0 then 5 + s_suppkey % 70 end pe, 20 + (s_suppkey*37) % 2000 mktcap from supplier)"


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, sector, category)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("sector"), F.col("r_name").alias("category"))


SECTORS = "sector_map as (select s_suppkey code, n_name sector, r_name category from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"


def model_picks(spark: SparkSession, sf_dir: str, most: int = 200) -> DataFrame:
    """(model, rank, code, sector, score): ballots of five models."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    rank = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")
    rows = o.select(F.col("o_orderpriority").alias("model"), rank.alias("rank"), F.col("o_custkey").alias("code"), (50 + F.col("o_orderkey") % 50).alias("score"))
    return rows.where(F.col("rank") <= most)


PICKS = """model_picks as (select * from (select o_orderpriority model, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) rank,
o_custkey code, 50 + o_orderkey % 50 score from orders where o_orderstatus <> 'P') where rank <= 200)"""


def panel_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(voter, item, score, pos): votes of seven voters."""
    return table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("voter"), F.col("event_type").alias("item"), F.round(F.col("value") * 100).cast("long").alias("score"), F.col("event_id").alias("pos"))


VOTES = "panel_votes as (select user_id % 7 voter, event_type item, cast(round(value*100) as bigint) score, event_id pos from events)"


def lhb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, d, net, reason, pos): special-trade records."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    return li.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d"), (F.round(F.col("l_extendedprice") * 100).cast("long") * sign).alias("net"), F.concat(F.col("l_linestatus"), F.lit("-"), F.col("l_partkey").cast("string")).alias("reason"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("pos"))


LHB = """lhb as (select l_suppkey code, cast(l_shipdate as date) d, cast(round(l_extendedprice*100) as bigint) * case when l_linestatus = 'O' then 1 else -1 end net,
l_linestatus || '-' || l_partkey reason, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) pos from lineitem where l_returnflag = 'R')"""


def as_of(spark: SparkSession, sf_dir: str, dates: int = 12, step: int = 30) -> DataFrame:
    """(as_of): every 30th distinct bar date from the last one back."""
    d = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("as_of")).distinct()
    n = F.row_number().over(Window.orderBy(F.desc("as_of")))
    return d.withColumn("n", n).where(((F.col("n") - 1) % step == 0) & (F.col("n") <= dates * step)).select("as_of")


AS_OF = """as_of as (select d as as_of from (select d, row_number() over (order by d desc) n from (select distinct cast(l_shipdate as date) d from lineitem)) where (n - 1) % 30 = 0 and n <= 360)"""
