"""Queries over bar series: moving averages, oscillators, ranges, ranks and labels, each with its SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import fixed, series, trailing
from quantloom.operators import indicators as ind
from quantloom.operators import labels
from quantloom.operators.crosssec import percentile_rank, position_rank, share_below
from quantloom.operators.pivots import with_pivots
from quantloom.plans import rule_sql
from quantloom.sources import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def fix(x: str, places: int = 4) -> str:
    """SQL twin of functions.expr.fixed."""
    return f"cast(floor(({x})*1e{places}+0.5) as bigint)"


B = f"with recursive {fx.BARS}"
W = "(partition by code order by d)"
LASTBARS = "last as (select * from f qualify row_number() over (partition by code order by d desc) = 1)"


def rows(n: int) -> str:
    return f"over (partition by code order by d rows between {n - 1} preceding and current row)"


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return fx.bars_walk(spark, sf)


@query("a_bars_walk", f"{B} select * from bars")
def bars_walk(spark, sf):
    return _bars(spark, sf)


@query("a2_point_in_time_scan", f"""{B}, {fx.AS_OF}, cut as (select max(as_of) - 200 as x from as_of)
select code, d, c from bars where d <= (select x from cut) qualify row_number() over (partition by code order by d desc) <= 70""")
def point_in_time(spark, sf):
    from quantloom.operators.asof import last_bars_before

    cut = fx.as_of(spark, sf).agg(F.date_sub(F.max("as_of"), 200).alias("cutoff"))
    return last_bars_before(_bars(spark, sf), cut, 70).select("code", "d", "c")


@query("e1_e2_moving_averages", f"""{B} select code, d, {", ".join(f"{fix(f'avg(c) {rows(n)}')} as ma{n}" for n in (5, 10, 20, 60))},
case when row_number() over {W} >= 60 then {fix(f"avg(c) {rows(60)}")} end as strict60 from bars""")
def moving_averages(spark, sf):
    b = _bars(spark, sf)
    return b.select("code", "d", *(fixed(ind.sma(n)).alias(f"ma{n}") for n in (5, 10, 20, 60)), fixed(ind.sma(60, strict=True)).alias("strict60"))


def _mean(state: str, value: str, n: str) -> str:
    return f"{state} * (1 - {n}::double) + {value} * ({n}::double)"


def _wilder(state: str, value: str, n: int) -> str:
    return f"case when {state} is null then {value} else {_mean(state, value, f'1/{n}')} end"


#: MACD, RSI and KDJ of whole series: one row a bar, each step from the states of the one before.
OSC = f"""s as (select code, d, cast(c as double) c, row_number() over {W} n, cast(c - lag(c) over {W} as double) step, (c - min(l) {rows(9)}) / (max(h) {rows(9)} - min(l) {rows(9)} + 1e-9) * 100 rsv from bars),
g as (select code, n, d, c e12, c e26, 0.0::double dif, 0.0::double dea, null::double u6, null::double w6, null::double u14, null::double w14, rsv k from s where n = 1
  union all select code, n, d, e12, e26, round_even(e12 - e26, 4), {_mean("dea0", "round_even(e12 - e26, 4)", "0.2")}, u6, w6, u14, w14, k from (
  select s.code, s.n, s.d, {_mean("g.e12", "s.c", "2/13")} e12, {_mean("g.e26", "s.c", "2/27")} e26, g.dea dea0, {_wilder("g.u6", "greatest(s.step, 0)", 6)} u6, {_wilder("g.w6", "greatest(-s.step, 0)", 6)} w6,
    {_wilder("g.u14", "greatest(s.step, 0)", 14)} u14, {_wilder("g.w14", "greatest(-s.step, 0)", 14)} w14, {_mean("g.k", "s.rsv", "1/3")} k from g join s on s.code = g.code and s.n = g.n + 1)),
osc as (select code, d, n, dif, round_even(dea, 4) dea, round_even(2 * (dif - round_even(dea, 4)), 4) hist, 100 - 100 / (1 + u6 / case when w6 = 0 then 1e-9 else w6 end) rsi6, 100 - 100 / (1 + u14 / case when w14 = 0 then 1e-9 else w14 end) rsi14, k from g)"""


@query("e3_e6_oscillators", f"""{B}, {OSC} select code, d, {fix("dif", 4)} as dif, {fix("dea", 3)} as dea, {fix("rsi6", 2)} as rsi6, {fix("rsi14", 2)} as rsi14, {fix("k", 2)} as k from osc""")
def oscillators(spark, sf):
    o = ind.oscillators(_bars(spark, sf))
    return o.select("code", "d", fixed("dif", 4).alias("dif"), fixed("dea", 3).alias("dea"), fixed("rsi6", 2).alias("rsi6"), fixed("rsi14", 2).alias("rsi14"), fixed("k", 2).alias("k"))


@query("e7_bollinger", f"""{B}, m as (select *, round_even(avg(c) {rows(20)}, 3) mid, coalesce(stddev_samp(c) {rows(20)}, 0) sd from bars),
u as (select *, round_even(mid + 2 * sd, 3) up, round_even(mid - 2 * sd, 3) low from m)
select code, d, {fix("mid", 3)} as mid, {fix("up", 3)} as upper, {fix("low", 3)} as lower, {fix("(up - low) / mid * 100", 3)} as width from u""")
def bollinger(spark, sf):
    b = ind.with_bollinger(_bars(spark, sf))
    return b.select("code", "d", fixed("mid", 3).alias("mid"), fixed("upper", 3).alias("upper"), fixed("lower", 3).alias("lower"), fixed("width", 3).alias("width"))


@query("e8_volume_ratio", f"{B} select code, d, {fix(f'avg(v) {rows(5)}')} as vma5, {fix(f'v / avg(v) {rows(20)}')} as vratio from bars")
def volume_ratio(spark, sf):
    return _bars(spark, sf).select("code", "d", fixed(F.avg("v").over(trailing(5))).alias("vma5"), fixed(F.col("v") / F.avg("v").over(trailing(20))).alias("vratio"))


TR = f"greatest(h - l, abs(h - lag(c) over {W}), abs(l - lag(c) over {W}))"


@query("e9_average_true_ranges", f"""{B}, t as (select *, case when lag(c) over {W} is not null then {TR} end tr, case when lag(c) over {W} is not null then {TR} else h - l end trh,
  greatest(h - l, abs(h - coalesce(lag(c) over {W}, last_value(c) over (partition by code order by d rows between unbounded preceding and unbounded following))), abs(l - coalesce(lag(c) over {W}, last_value(c) over (partition by code order by d rows between unbounded preceding and unbounded following)))) trw from bars)
select code, d, case when count(tr) {rows(15)} = 15 then {fix(f"avg(tr) {rows(15)}")} end as atr15, {fix(f"avg(trh) {rows(5)}")} as atr5, {fix(f"avg(trh) {rows(20)}")} as atr20, {fix(f"avg(tr) {rows(14)}")} as atr14, {fix(f"avg(h - l) {rows(20)}")} as range20, {fix(f"avg(trw) {rows(14)}")} as atr14_wrap from t""")
def average_true_ranges(spark, sf):
    x = ind.with_atr_variants(_bars(spark, sf))
    return x.select("code", "d", *(fixed(n).alias(n) for n in ("atr15", "atr5", "atr20", "atr14", "range20", "atr14_wrap")))


@query("e10_e11_pct_change", f"""{B} select code, d, {fix(f"(c - lag(c, 20) over {W}) / cast(lag(c, 20) over {W} as double) * 100")} as chg20,
{fix(f"(c - coalesce(lag(c, 20) over {W}, first_value(c) over {W})) / cast(greatest(coalesce(lag(c, 20) over {W}, first_value(c) over {W}), 0.01) as double)")} as back20 from bars""")
def pct_changes(spark, sf):
    old = F.greatest(F.coalesce(ind.lagged("c", 20), F.first("c").over(series())).cast("double"), F.lit(0.01))
    return _bars(spark, sf).select("code", "d", fixed(ind.pct_change(20)).alias("chg20"), fixed((F.col("c") - old) / old).alias("back20"))


FEATURES = f"""f0 as (select *, row_number() over {W} nbar, avg(c) {rows(5)} ma5, avg(c) {rows(10)} ma10, avg(c) {rows(20)} ma20, avg(c) {rows(60)} ma60, lag(c) over {W} prev_c, lag(v) over {W} prev_v, lag(c, 2) over {W} c2, lag(c, 3) over {W} c3,
  lag(c, 19) over {W} c20, lag(c, 59) over {W} c60, max(h) {rows(20)} h20, avg(v) {rows(5)} v5, avg(v) {rows(20)} v20, avg(v) {rows(60)} v60, stddev_pop(v) {rows(20)} vsd20, stddev_pop(v) {rows(5)} vsd5, stddev_pop(c) {rows(20)} csd20, avg(c) {rows(20)} cavg20,
  case when lag(c) over {W} is not null then {TR} else h - l end tr_hl, v * c amount, case when c < lag(c) over {W} then 1 else 0 end falls, max(c) {rows(100)} max100, min(l) {rows(20)} low20 from bars),
f1 as (select *, lag(ma20, 5) over {W} ma20_6, avg(tr_hl) {rows(5)} atr5, avg(tr_hl) {rows(20)} atr20, avg(amount) {rows(20)} amount20, sum(falls) {rows(5)} falls5 from f0),
f as (select *, (ma20 - ma20_6) / greatest(ma20_6, 1) slope, (c - c20) / cast(c20 as double) ret20, (c - c60) / cast(c60 as double) ret60, c / cast(h20 as double) near_high, c > o and v > prev_v yang, v / v20 amount_ratio, v5 / v60 v5_60, vsd20 / greatest(v20, 1) vcv, csd20 / greatest(cavg20, 0.01) pcv, atr5 / atr20 atr_ratio from f1)"""
BF = f"{B}, {FEATURES}"


@query("e12_e15_features", f"""{BF} select code, d, {", ".join(f"{fix(x)} as {x}" for x in ("slope", "near_high", "amount_ratio", "v5_60", "vcv", "pcv", "atr_ratio"))}, yang from f""")
def features(spark, sf):
    x = ind.with_features(_bars(spark, sf))
    return x.select("code", "d", *(fixed(n).alias(n) for n in ("slope", "near_high", "amount_ratio", "v5_60", "vcv", "pcv", "atr_ratio")), "yang")


@query("e16_percentile_rank", f"""{BF}, {LASTBARS} select code, {fix("(rank() over (order by ret20) + (count(*) over (partition by ret20) - 1) / 2.0) / cast(count(*) over () as double) * 100")} as rps20 from last""")
def e16(spark, sf):
    return ind.last_features(_bars(spark, sf)).select("code", fixed(percentile_rank("ret20")).alias("rps20"))


@query("e18_sector_rank", f"""{BF}, {fx.SECTORS}, {LASTBARS} select code, sector, {fix("row_number() over (partition by sector order by ret20, code) / cast(count(*) over (partition by sector) as double) * 100")} as pos from last join sector_map using (code)""")
def e18(spark, sf):
    last = ind.last_features(_bars(spark, sf)).join(fx.sector_map(spark, sf), "code")
    return last.select("code", "sector", fixed(position_rank("ret20", "code", "sector")).alias("pos"))


@query("e17_e19_market_rps", f"""{BF}, {LASTBARS} select code, {fix("ret20")} as ret20, {fix("(rank() over (order by ret20) - 1) / cast(count(*) over () as double)")} as below from last""")
def e17(spark, sf):
    return ind.last_features(_bars(spark, sf)).select("code", fixed("ret20").alias("ret20"), fixed(share_below("ret20")).alias("below"))


@query("e20_pivots", f"""{B}, p as (select code, d, h, l, max(h) over (partition by code order by d rows between 5 preceding and 1 preceding) hb, max(h) over (partition by code order by d rows between 1 following and 5 following) ha,
  min(l) over (partition by code order by d rows between 5 preceding and 1 preceding) lb, min(l) over (partition by code order by d rows between 1 following and 5 following) la, count(*) over (partition by code order by d rows between 5 preceding and 5 following) n from bars)
select code, d, n = 11 and h > hb and h > ha as is_high, n = 11 and l < lb and l < la as is_low from p""")
def e20(spark, sf):
    return with_pivots(_bars(spark, sf), 5, 5).select("code", "d", "is_high", "is_low")


@query("e23_ma_alignment", f"{BF}, {LASTBARS} select code, {rule_sql.ALIGNMENT} as alignment, ma5 > ma20 and ma20 > ma60 as bullish, ma5 < ma20 and ma20 < ma60 as bearish from last")
def e23(spark, sf):
    last = ind.last_features(_bars(spark, sf))
    return last.select("code", F.expr(labels.ALIGNMENT).alias("alignment"), F.expr("ma5 > ma20 and ma20 > ma60").alias("bullish"), F.expr("ma5 < ma20 and ma20 < ma60").alias("bearish"))


@query("e24_macd_status", f"""{B}, {OSC}, p as (select *, lag(dif) over {W} p_dif, lag(dea) over {W} p_dea, lag(hist) over {W} p_hist from osc)
select code, {rule_sql.MACD_STATUS} as status, {fix("dif", 2)} as dif from p qualify row_number() over (partition by code order by d desc) = 1""")
def e24(spark, sf):
    return ind.last_oscillators(_bars(spark, sf)).select("code", F.expr(labels.MACD_STATUS).alias("status"), fixed("dif", 2).alias("dif"))


@query("e25_index_trend", f"""{BF}, {LASTBARS} select code, {rule_sql.TREND} as trend,
{fix("(c - prev_c) / cast(prev_c as double) * 100")} as chg1, {fix("v5 / v20")} as v5_20 from last""")
def e25(spark, sf):
    last = ind.last_features(_bars(spark, sf))
    return last.select("code", F.expr(labels.TREND).alias("trend"), fixed((F.col("c") - F.col("prev_c")) / F.col("prev_c") * 100).alias("chg1"), fixed(F.col("v5") / F.col("v20")).alias("v5_20"))


@query("e26_virtual_bar", f"""{B}, today as (select max(d) d from bars), quotes as (select code, (select d from today) d, c o, c + 7 h, c - 5 l, c + code % 3 c, v from (select * from bars qualify row_number() over (partition by code order by d desc) = 1) where code % 4 <> 0)
select code, d, o, h, l, c, v, false as virtual from bars union all
select code, d, o, h, l, c, v, true from quotes q where o > 0 and c > 0 and v > 0 and not exists (select 1 from bars b where b.code = q.code and b.d = q.d)""")
def e26(spark, sf):
    from quantloom.operators.joins import append_virtual_bars

    b = _bars(spark, sf)
    q = ind.last_bars(b).where("code % 4 <> 0").select("code", F.col("c").alias("o"), (F.col("c") + 7).alias("h"), (F.col("c") - 5).alias("l"), (F.col("c") + F.col("code") % 3).alias("c"), "v")
    return append_virtual_bars(b, q.crossJoin(b.agg(F.max("d").alias("d"))))


@query("e27_support_resistance", f"""{BF}, g as (select *, max(h) {rows(60)} h60 from f), last as (select * from g qualify row_number() over (partition by code order by d desc) = 1),
s as (select code, c, list_reverse_sort(list_filter([ma20, ma60, cast(low20 as double)], lambda x: x < c)) lo, list_sort(list_filter([cast(h20 as double), cast(h60 as double)], lambda x: x > c * 1.005)) hi from last)
select code, {fix("coalesce(lo[1], c * 0.97)")} as s1, {fix("coalesce(lo[2], c * 0.95)")} as s2, {fix("coalesce(hi[1], c * 1.03)")} as r1, {fix("coalesce(hi[2], c * 1.05)")} as r2 from s""")
def e27(spark, sf):
    last = ind.last_features(_bars(spark, sf), more={"h60": F.max("h").over(trailing(60))})
    below = F.sort_array(F.filter(F.array(F.col("ma20"), F.col("ma60"), F.col("low20").cast("double")), lambda y: y < F.col("c")), asc=False)
    above = F.sort_array(F.filter(F.array(F.col("h20").cast("double"), F.col("h60").cast("double")), lambda y: y * 1000 > F.col("c") * 1005))
    get = lambda a, k, other: fixed(F.coalesce(F.get(a, F.lit(k)), F.col("c") * other))
    return last.select("code", get(below, 0, 0.97).alias("s1"), get(below, 1, 0.95).alias("s2"), get(above, 0, 1.03).alias("r1"), get(above, 1, 1.05).alias("r2"))


WEEKLY = """weekly as (select code, {label} as w, arg_min(o, d) o, max(h) h, min(l) l, arg_max(c, d) c, cast(sum(v) as bigint) v, count(*) n from bars group by code, {label})"""
FRI = "cast(d - 1 + (7 + 5 - cast(extract('dow' from d - 1) as int) - 1) % 7 + 1 as date)"
SUN = "cast(d - 1 + (7 + 0 - cast(extract('dow' from d - 1) as int) - 1 + 7) % 7 + 1 as date)"


@query("d1_weekly_bars_friday", f"{B}, {WEEKLY.format(label=FRI)} select * from weekly")
def d1(spark, sf):
    from quantloom.operators.aggregates import resample

    return resample(_bars(spark, sf), "week_friday", "w")


@query("d2_weekly_sunday_monthly_bars", f"""{B}, {WEEKLY.format(label=SUN)} select *, 'week' as frame from weekly union all
select code, last_day(d), arg_min(o, d), max(h), min(l), arg_max(c, d), cast(sum(v) as bigint), count(*), 'month' from bars group by code, last_day(d)""")
def d2(spark, sf):
    from quantloom.operators.aggregates import resample

    b = _bars(spark, sf)
    return resample(b, "week_sunday", "w").withColumn("frame", F.lit("week")).unionByName(resample(b, "month", "w").withColumn("frame", F.lit("month")))


@query("e28_monthly_profile", f"""{B}, m as (select code, last_day(d) w, arg_max(c, d) c, cast(sum(v) as bigint) v from bars group by code, last_day(d)),
x as (select *, lag(c, 1) over (partition by code order by w) c1, lag(c, 3) over (partition by code order by w) c3, lag(c, 12) over (partition by code order by w) c12, avg(c) over (partition by code order by w rows between 5 preceding and current row) ma6, avg(v) over (partition by code order by w rows between 2 preceding and current row) / avg(v) over (partition by code) vr from m)
select code, w, {fix("(c - c1) / cast(c1 as double) * 100")} as chg1, {fix("(c - c3) / cast(c3 as double) * 100")} as chg3, {fix("(c - c12) / cast(c12 as double) * 100")} as chg12, {fix("ma6")} as ma6, {fix("vr")} as vr from x""")
def e28(spark, sf):
    from quantloom.operators.aggregates import resample

    m = resample(_bars(spark, sf), "month", "w")
    w = series("w")
    change = lambda k: fixed((F.col("c") - F.lag("c", k).over(w)) / F.lag("c", k).over(w) * 100)
    ratio = F.avg("v").over(w.rowsBetween(-2, 0)) / F.avg("v").over(Window.partitionBy("code"))
    return m.select("code", "w", change(1).alias("chg1"), change(3).alias("chg3"), change(12).alias("chg12"), fixed(F.avg("c").over(w.rowsBetween(-5, 0))).alias("ma6"), fixed(ratio).alias("vr"))


@query("e29_turnover_averages", f"{B} select code, d, {', '.join(f'{fix(f'avg(v) {rows(n)}')} as t{n}' for n in (5, 20, 60))} from bars")
def e29(spark, sf):
    return _bars(spark, sf).select("code", "d", *(fixed(F.avg("v").over(trailing(n))).alias(f"t{n}") for n in (5, 20, 60)))
