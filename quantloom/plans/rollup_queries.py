"""Queries of back-test statistics over several groupings, with SQL of their own in GROUPING SETS."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import fixed
from quantloom.operators import performance, rollups
from quantloom.plans.indicator_queries import B, fix
from quantloom.sources import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _picks(spark: SparkSession, sf: str) -> DataFrame:
    """(strategy, layer, d, code, price, rank): at each as-of date the 40 (l1) and 12 (l2) best by 20-bar (new) and 5-bar (old) return."""
    b, dates = fx.bars_walk(spark, sf), fx.as_of(spark, sf)
    x = b.join(dates, (F.col("d") <= F.col("as_of")) & (F.col("d") > F.date_sub("as_of", 150)))
    w = Window.partitionBy("as_of", "code").orderBy("d")
    x = x.withColumns({"c20": F.lag("c", 19).over(w), "c5": F.lag("c", 4).over(w), "n": F.row_number().over(Window.partitionBy("as_of", "code").orderBy(F.desc("d")))}).where("n = 1")
    place = lambda c: F.row_number().over(Window.partitionBy("as_of").orderBy(((F.col("c") - F.col(c)) / F.col(c)).desc_nulls_last(), "code")).cast("long")
    x = x.withColumns({"new": place("c20"), "old": place("c5")})
    sides = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(s).alias("rank")) for s in ("new", "old")])
    x = x.withColumn("side", F.explode(sides)).select(F.col("as_of").alias("d"), "code", F.col("c").alias("price"), "side.*").where("rank <= 40")
    layers = F.array_compact(F.array(F.lit("l1"), F.when(F.col("rank") <= 12, F.lit("l2"))))
    return x.withColumn("layer", F.explode(layers))


def _dates(spark: SparkSession, sf: str) -> DataFrame:
    """(d, period, regime): quarters, and a regime by the share of codes that rose over 20 bars."""
    b, dates = fx.bars_walk(spark, sf), fx.as_of(spark, sf)
    x = b.join(dates, (F.col("d") <= F.col("as_of")) & (F.col("d") > F.date_sub("as_of", 150)))
    w = Window.partitionBy("as_of", "code").orderBy("d")
    x = x.withColumns({"c20": F.lag("c", 19).over(w), "n": F.row_number().over(Window.partitionBy("as_of", "code").orderBy(F.desc("d")))}).where("n = 1")
    share = F.count_if(F.col("c") > F.col("c20")) / F.count("*")
    x = x.groupBy(F.col("as_of").alias("d")).agg(share.alias("share"))
    return x.select("d", F.concat(F.year("d"), F.lit("Q"), F.quarter("d")).alias("period"), F.when(F.col("share") > 0.5, "bull").when(F.col("share") < 0.48, "bear").otherwise("neutral").alias("regime"))


PICKS = f"""{B}, {fx.AS_OF}, s0 as (select as_of, code, d, c, lag(c, 19) over (partition by as_of, code order by d) c20, lag(c, 4) over (partition by as_of, code order by d) c5 from as_of join bars on d <= as_of and d > as_of - 150),
s1 as (select as_of d, code, c, c20, c5 from s0 qualify row_number() over (partition by as_of, code order by d desc) = 1),
s2 as (select d, code, c price, 'new' strategy, row_number() over (partition by d order by (c - c20) / cast(c20 as double) desc nulls last, code) rank from s1 union all select d, code, c, 'old', row_number() over (partition by d order by (c - c5) / cast(c5 as double) desc nulls last, code) from s1),
picks as (select *, 'l1' layer from s2 where rank <= 40 union all select *, 'l2' from s2 where rank <= 12),
dates as (select d, year(d) || 'Q' || quarter(d) period, case when s > 0.5 then 'bull' when s < 0.48 then 'bear' else 'neutral' end regime from (select d, count(*) filter (where c > c20) / cast(count(*) as double) s from s1 group by d))"""
RETURNS = f"""{PICKS}, tg as (select *, d + cast(floor(h * 1.4) as int) + 2 as target from picks, (values (3), (5), (8), (20), (60)) hz(h)),
rets as (select tg.d, tg.code, strategy, layer, tg.h horizon, (b.c - price) / cast(price as double) * 100 ret from tg asof left join bars b on tg.code = b.code and tg.target <= b.d)"""
STATS = f"""{RETURNS}, seen as (select distinct d from rets where strategy = 'new' and layer = 'l1' and horizon = 5 and ret is not null),
daily as (select layer, horizon, d, count(*) k from rets where strategy = 'new' group by all),
st as (select layer, horizon, isodow(d) - 1 weekday, grouping(isodow(d)) g, count(ret) n, coalesce(count(*) filter (where ret > 0) / cast(nullif(count(ret), 0) as double) * 100, 0) w, coalesce(avg(ret), 0) m, max(ret) best, min(ret) worst
  from rets where strategy = 'new' and d in (from seen) group by grouping sets ((layer, horizon), (layer, horizon, isodow(d)))),
pk as (select layer, horizon, case when grouping(isodow(d)) = 0 then isodow(d) - 1 end weekday, avg(k) mk from daily group by grouping sets ((layer, horizon), (layer, horizon, isodow(d)))),
stats as (select st.layer, st.horizon, case when g = 0 then st.weekday end weekday, n, w, m, best, worst, mk from st join pk on pk.layer = st.layer and pk.horizon = st.horizon and pk.weekday is not distinct from case when g = 0 then st.weekday end where g = 1 or n > 0)"""


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return performance.forward_returns(_picks(spark, sf), fx.bars_walk(spark, sf))


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return rollups.layer_stats(_returns(spark, sf).where("strategy = 'new'"))


@query("d10_layer_stats", f"{STATS} select layer, horizon, weekday, n, {fix('w', 1)} as win_rate, {fix('m', 2)} as mean, {fix('best', 2)} as best, {fix('worst', 2)} as worst, {fix('mk', 1)} as mean_picks from stats")
def layer_stats(spark, sf):
    return rollups.fixed_columns(_stats(spark, sf), win_rate=1, mean=2, best=2, worst=2, mean_picks=1)


@query("d10_layer_deltas", f"""{STATS}, whole as (select layer, horizon, round(w, 1) w, round(m, 2) m from stats where weekday is null)
select a.horizon, {fix("b.w - a.w", 1)} as win_delta, {fix("b.m - a.m", 2)} as mean_delta from whole a join whole b using (horizon) where a.layer = 'l1' and b.layer = 'l2'""")
def layer_deltas(spark, sf):
    return rollups.fixed_columns(rollups.layer_deltas(_stats(spark, sf)), win_delta=1, mean_delta=2)


@query("d11_advice", f"""{STATS}, s5 as (select * from stats where horizon = 5), one as (select max(round(w, 1)) filter (where layer = 'l1' and weekday is null) a, max(round(w, 1)) filter (where layer = 'l2' and weekday is null) b,
  max(round(mk, 1)) filter (where layer = 'l1' and weekday is null) k, max(round(w, 1)) filter (where layer = 'l1' and weekday is not null) - min(round(w, 1)) filter (where layer = 'l1' and weekday is not null) ap from s5),
said as (select 'first layer wins rarely' advice, a v from one where a < 45 union all select 'first layer wins often', a from one where a > 60 union all select 'too many picks a day', k from one where k > 200 union all select 'too few picks a day', k from one where k < 20
  union all select 'second layer is worse', b - a from one where b - a < -3 union all select 'weekdays differ', ap from one where ap > 5 union all select case when round(b - a, 1) > 0 then 'second layer helps' else 'second layer does not help' end, b - a from one)
select advice, {fix("v", 1)} as value from said""")
def advice(spark, sf):
    return rollups.fixed_columns(rollups.advice(_stats(spark, sf)), value=1)


@query("d12_c16_strategies", f"""{RETURNS}, pr as (select period, bool_or(regime in ('bull', 'neutral')) bull, bool_or(regime = 'bear') bear from dates group by period),
r2 as (select r.*, dates.period, bull, bear from rets r join dates using (d) join pr using (period) where layer = 'l2'),
gr as (select 'period' kind, period label, * exclude (period) from r2 union all select 'all', 'all', * exclude (period) from r2 union all select 'regime', 'bull', * exclude (period) from r2 where bull union all select 'regime', 'bear', * exclude (period) from r2 where bear),
s as (select kind, label, horizon, count(ret) filter (where strategy = 'old') old_n, count(ret) filter (where strategy = 'new') new_n,
  coalesce(count(*) filter (where strategy = 'old' and ret > 0) / cast(nullif(count(ret) filter (where strategy = 'old'), 0) as double) * 100, 0) ow, coalesce(count(*) filter (where strategy = 'new' and ret > 0) / cast(nullif(count(ret) filter (where strategy = 'new'), 0) as double) * 100, 0) nw,
  coalesce(avg(ret) filter (where strategy = 'old'), 0) om, coalesce(avg(ret) filter (where strategy = 'new'), 0) nm from gr group by kind, label, horizon)
select kind, label, horizon, old_n, new_n, {fix("ow", 1)} as old_rate, {fix("nw", 1)} as new_rate, {fix("om", 2)} as old_mean, {fix("nm", 2)} as new_mean, {fix("nw - ow", 1)} as rate_delta, {fix("nm - om", 2)} as mean_delta,
  case when nw - ow > 1 and nm - om > 0 then 'new' when nw - ow < -1 and nm - om < 0 then 'old' else 'even' end as winner from s where old_n > 0 or new_n > 0""")
def strategies(spark, sf):
    c = rollups.compare_strategies(_returns(spark, sf).where("layer = 'l2'"), _dates(spark, sf))
    return rollups.fixed_columns(c, old_rate=1, new_rate=1, rate_delta=1, old_mean=2, new_mean=2, mean_delta=2)


@query("c16_pick_counts", f"""{PICKS}, pd as (select strategy, layer, d, count(*) k from picks group by all), grid as (select strategy, layer, dates.d, period, coalesce(k, 0) k from dates cross join (select distinct strategy, layer from pd) left join pd using (strategy, layer, d))
select strategy, layer, period, {fix("avg(k)", 2)} as mean_picks from grid group by grouping sets ((strategy, layer), (strategy, layer, period))""")
def pick_counts(spark, sf):
    return rollups.fixed_columns(rollups.pick_counts(_picks(spark, sf), _dates(spark, sf)), mean_picks=2)


@query("z13_overall_performance", f"""{RETURNS}, r5 as (select * from rets where horizon = 5 and ret is not null and layer = 'l2'), dm as (select strategy model, d, count(*) k, count(*) filter (where ret > 0) wins, round(avg(ret), 2) m from r5 group by all)
select 'all' as model, count(*) as n, {fix("count(*) filter (where ret > 0) / cast(count(*) as double) * 100", 1)} as win_rate, {fix("avg(ret)", 2)} as mean, {fix("max(ret)", 2)} as best, {fix("min(ret)", 2)} as worst from r5
union all select model, cast(sum(k) as bigint), {fix("sum(wins) / cast(sum(k) as double) * 100", 1)}, {fix("sum(m * k) / sum(k)", 2)}, null, null from dm group by model""")
def overall_performance(spark, sf):
    """All recommendations' 5-day returns, and each model's by its daily figures: rates from counts, means weighted by them."""
    r = _returns(spark, sf).where("horizon = 5 and ret is not null and layer = 'l2'")
    rate = lambda w, n: fixed(F.sum(w) / F.sum(n) * 100, 1).alias("win_rate")
    daily = r.groupBy("strategy", "d").agg(F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("wins"), F.round(F.avg("ret"), 2).alias("mean"))
    whole = r.agg(F.lit("all").alias("model"), F.count("*").alias("n"), fixed(F.count_if(F.col("ret") > 0) / F.count("*") * 100, 1).alias("win_rate"), fixed(F.avg("ret"), 2).alias("mean"), fixed(F.max("ret"), 2).alias("best"), fixed(F.min("ret"), 2).alias("worst"))
    each = daily.groupBy(F.col("strategy").alias("model")).agg(F.sum("n").alias("n"), rate("wins", "n"), fixed(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 2).alias("mean"))
    return whole.unionByName(each, allowMissingColumns=True)
