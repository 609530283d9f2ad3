"""Queries of the funnel: gates, regime, scores and the layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.expr import fixed, series
from quantloom.operators import indicators as ind
from quantloom.operators import scoring
from quantloom.operators.aggregates import special_trades
from quantloom.operators.crosssec import market_regime
from quantloom.operators.joins import contains_any
from quantloom.plans import funnel, rule_sql
from quantloom.plans.indicator_queries import BF, FEATURES, LASTBARS, OSC, B, W, fix
from quantloom.sources import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: The fixture's prices are a smooth walk: thresholds scaled so that every gate drops something.
SCALED = scoring.Profile(drop=-0.003, limit_gain=0.0005, amount=0.0006)
WORDS = ("O-1", "F-2")


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return fx.bars_walk(spark, sf)


def _lhb(spark: SparkSession, sf: str) -> DataFrame:
    x = special_trades(fx.lhb(spark, sf), WORDS)
    return x.select("code", "lhb_count", "inst_days", (F.col("net") / 1e8).alias("net"))


LHBX = f"{fx.LHB}, lhbx as (select code, count(*) lhb_count, cast(sum(net) as double) / 1e8 net from lhb group by code)"
GATED = " and ".join(f"not ({g})" for g in rule_sql.GATES_SCALED.values())
REGIME = f"breadth as (select avg(case when c > ma20 then 1.0 else 0.0 end) breadth, avg(ret20) mean_ret, count(*) n from last where nbar >= 60), regime as (select *, {rule_sql.REGIME} regime from breadth)"
PRE = f"""{BF}, {LASTBARS}, {fx.BASICS}, {LHBX}, {REGIME}, gated as (select last.*, pe, mktcap from last left join basics using (code) where {GATED}),
pre0 as (select g.*, lhb_count, net, regime, (rank() over (order by ret20) + (count(*) over (partition by ret20) - 1) / 2.0) / cast(count(*) over () as double) * 100 rps20, (rank() over (order by ret60) + (count(*) over (partition by ret60) - 1) / 2.0) / cast(count(*) over () as double) * 100 rps60,
  {rule_sql.CHIP} chip, {rule_sql.LHB_BONUS} lhb_bonus from gated g left join lhbx using (code), regime),
pre as (select *, {fix(f"case when regime = 'bear' then {rule_sql.QUANT_BEAR} else {rule_sql.QUANT_BULL} end", 1)} quant from pre0)"""


@query("b1_b7_gates", f"""{BF}, {LASTBARS}, {fx.BASICS} select code, {", ".join(f"{g} as {n}" for n, g in rule_sql.GATES_SCALED.items())}, {rule_sql.FIVE_FALLS} as five_falls, {rule_sql.CRASH} as crash from last left join basics using (code)""")
def gates(spark, sf):
    x = funnel.latest_features(_bars(spark, sf)).join(fx.basics(spark, sf), "code", "left")
    return x.select("code", *(F.expr(g).alias(n) for n, g in scoring.gates(SCALED).items()), F.expr(scoring.FIVE_FALLS).alias("five_falls"), F.expr(scoring.CRASH).alias("crash"))


@query("d3_c2_special_trades", f"""with {fx.LHB} select code, count(*) as lhb_count, count(*) filter (where contains(reason, 'O-1') or contains(reason, 'F-2')) as inst_days, cast(sum(net) as bigint) as net from lhb group by code""")
def d3(spark, sf):
    return special_trades(fx.lhb(spark, sf), WORDS).drop("reason")


@query("d4_d5_market_regime", f"{BF}, {LASTBARS}, {REGIME} select {fix('breadth')} as breadth, {fix('mean_ret')} as mean_ret, n, regime from regime")
def d4(spark, sf):
    r = market_regime(funnel.latest_features(_bars(spark, sf)))
    return r.select(fixed("breadth").alias("breadth"), fixed("mean_ret").alias("mean_ret"), "n", "regime")


@query("f2_f5_quant_scores", f"{PRE} select code, chip, lhb_bonus, quant, {fix('rps20')} as rps20, regime from pre")
def quant_scores(spark, sf):
    x = funnel.quant_scores(funnel.prefiltered(_bars(spark, sf), fx.basics(spark, sf), _lhb(spark, sf), SCALED))
    return x.select("code", "chip", "lhb_bonus", "quant", fixed("rps20").alias("rps20"), "regime")


TOP = """topn as (select *, row_number() over (order by quant desc, code) rank from pre qualify rank <= greatest(20, least(200, floor(count(*) over () * case when regime = 'bear' then 0.05 else 0.10 end))))"""


@query("f3_f6_quant_funnel", f"{PRE}, {TOP} select rank, code, quant, regime from topn")
def quant_funnel(spark, sf):
    return funnel.quant_funnel(_bars(spark, sf), fx.basics(spark, sf), _lhb(spark, sf), SCALED).select("rank", "code", "quant", "regime")


def _pattern_table(spark, sf) -> DataFrame:
    """A pattern table that SQL can follow: points for every third code, every seventh excluded."""
    k = F.col("code")
    return fx.basics(spark, sf).where("code % 3 = 0 or code % 7 = 0").select("code", F.when(k % 3 == 0, k % 50 + 10).otherwise(0).alias("bull"), (k % 7 == 0).alias("excluded"))


def _tracks(spark, sf) -> DataFrame:
    scored = funnel.quant_scores(funnel.prefiltered(_bars(spark, sf), fx.basics(spark, sf), _lhb(spark, sf), SCALED))
    return funnel.merged_tracks(scored, _pattern_table(spark, sf))


TRACKS = f"""{PRE}, {TOP}, pat as (select code, case when code % 3 = 0 then code % 50 + 10 else 0 end bull, code % 7 = 0 excluded from basics where code % 3 = 0 or code % 7 = 0),
both_ as (select code from topn union select code from pat where bull > 0),
tracks as (select pre.code, pre.quant, coalesce(bull, 0) pattern_score, case when t.code is not null and coalesce(bull, 0) > 0 then 'dual' when t.code is not null then 'quant' else 'pattern' end as source, pre.regime, (select count(*) from pre) candidates
  from pre join both_ using (code) left join topn t on t.code = pre.code left join pat on pat.code = pre.code where pre.code not in (select code from pat where excluded))"""


@query("c4_f7_merged_tracks", f"""{TRACKS}, m as (select *, quant / greatest(max(quant) over (), 1e-9) * 100 * 0.6 + least(100.0, pattern_score * 100 / cast(70 as double)) * 0.4 + case when source = 'dual' then 10 else 0 end s from tracks)
select code, source, quant as quant_score, pattern_score, {fix("s", 1)} as score, row_number() over (order by {fix("s", 1)} desc, code) as rank from m qualify rank <= greatest(20, least(200, floor(candidates * case when regime = 'bear' then 0.05 else 0.10 end)))""")
def merged(spark, sf):
    return funnel.first_layer(_tracks(spark, sf)).select("code", "source", "quant_score", "pattern_score", "score", "rank")


L2 = f"""tail as (select code, d, cast(c as double) c, row_number() over (partition by code order by d desc) back from bars qualify back <= 310),
arr as (select code, list(c order by d) cs, count(*) n300 from tail group by code),
macd as (select code, cs, n300, list_reduce(list_transform(cs, lambda x: {{'a': x, 'b': x, 'dea': 0.0::double, 'x': x}}), lambda s, y: {{'a': s.a * (1 - 2/13::double) + y.x * (2/13::double), 'b': s.b * (1 - 2/27::double) + y.x * (2/27::double),
   'dea': s.dea * 0.8::double + ((s.a * (1 - 2/13::double) + y.x * (2/13::double)) - (s.b * (1 - 2/27::double) + y.x * (2/27::double))) * 0.2::double, 'x': 0.0::double}}) m,
  list_reduce(cs, lambda s, y: s * (1 - 2/61::double) + y * (2/61::double)) ema60, list_reduce(cs[1:greatest(n300 - 10, 1)], lambda s, y: s * (1 - 2/61::double) + y * (2/61::double)) ema60_10 from arr),
hl as (select code, n300, m.a - m.b dif, m.dea dea, ema60, ema60_10 from macd)"""


@query("f8_f9_health_and_volume", f"{BF}, {LASTBARS}, {L2} select code, {rule_sql.HEALTH_L2} as health, {fix(rule_sql.VOLUME_L2)} as volume from last join hl using (code)")
def health_volume(spark, sf):
    b = _bars(spark, sf)
    x = funnel.latest_features(b).join(funnel.health(b), "code")
    return x.select("code", F.expr(scoring.HEALTH_L2).alias("health"), fixed(F.expr(scoring.VOLUME_L2)).alias("volume"))


@query("f10_second_layer", f"""{TRACKS}, {L2}, sc as (select last.*, t.quant, t.pattern_score, t.source, t.regime, hl.* exclude (code) from tracks t join last using (code) join hl using (code) where not ({rule_sql.FIVE_FALLS}) and not ({rule_sql.CRASH})),
sd as (select *, {rule_sql.HEALTH_L2} health, {rule_sql.VOLUME_L2} volume from sc),
tot as (select code, regime, {fix("quant / greatest(max(quant) over (), 1e-9) * 100 * 0.4 + case when max(pattern_score) over () > 0 then pattern_score / cast(max(pattern_score) over () as double) * 100 else 0.0 end * 0.3 + health * 0.2 + volume * 0.1 + case when source = 'dual' then 5 else 0 end", 1)} l2 from sd)
select code, l2, row_number() over (order by l2 desc, code) as rank from tot qualify rank <= greatest(5, least(30, floor(count(*) over () * case when regime = 'bear' then 0.05 else 0.15 end)))""")
def second_layer(spark, sf):
    return funnel.second_layer(_tracks(spark, sf).withColumnRenamed("quant_score", "quant"), _bars(spark, sf)).select("code", "l2", "rank")


@query("f11_backtest_profile", f"""{B}, {FEATURES}, {LASTBARS} select code, {fix("(ma20 - ma20_6) / greatest(abs(ma20_6), 0.01)")} as slope, {rule_sql.GATES_BACKTEST} as dropped from last where nbar >= 60""")
def backtest_profile(spark, sf):
    x = funnel.latest_features(_bars(spark, sf), "backtest").where("nbar >= 60")
    return x.select("code", fixed("slope").alias("slope"), F.expr(" or ".join(f"({g})" for g in scoring.gates(scoring.BACKTEST).values())).alias("dropped"))


#: The back-test's profile with thresholds that fit the fixture.
SCALED_BACKTEST = scoring.Profile(drop=SCALED.drop, amount=SCALED.amount, valuation=False, limit_up=False)
GATED_BACKTEST = " and ".join(f"not ({g})" for n, g in rule_sql.GATES_SCALED.items() if n not in ("valuation", "limit_up"))
#: The same funnel over the back-test's features, without valuation and special trades.
BACKTEST_TRACKS = TRACKS.replace(PRE, f"""{B}, {FEATURES}, {LASTBARS}, {fx.BASICS}, {REGIME}, gated as (select * from last where {GATED_BACKTEST}),
pre0 as (select g.*, regime, (rank() over (order by ret20) + (count(*) over (partition by ret20) - 1) / 2.0) / cast(count(*) over () as double) * 100 rps20, (rank() over (order by ret60) + (count(*) over (partition by ret60) - 1) / 2.0) / cast(count(*) over () as double) * 100 rps60, {rule_sql.CHIP} chip, 0 lhb_bonus from gated g, regime),
pre as (select *, {fix(f"case when regime = 'bear' then {rule_sql.QUANT_BEAR} else {rule_sql.QUANT_BULL} end", 1)} quant from pre0)""")


def _backtest_tracks(spark, sf) -> DataFrame:
    scored = funnel.quant_scores(funnel.prefiltered(_bars(spark, sf), None, None, SCALED_BACKTEST))
    return funnel.merged_tracks(scored, _pattern_table(spark, sf))


@query("f11_backtest_first_layer", f"""{BACKTEST_TRACKS}, m as (select *, quant / greatest(max(quant) over (), 1e-9) * 100 * 0.6 + least(100.0, pattern_score * 100 / cast(70 as double)) * 0.4 + case when source = 'dual' then 10 else 0 end s from tracks)
select code, source, quant as quant_score, pattern_score, {fix("s", 1)} as score, row_number() over (order by {fix("s", 1)} desc, code) as rank from m qualify rank <= greatest(20, least(200, floor(candidates * case when regime = 'bear' then 0.05 else 0.10 end)))""")
def backtest_first(spark, sf):
    return funnel.first_layer(_backtest_tracks(spark, sf)).select("code", "source", "quant_score", "pattern_score", "score", "rank")


@query("f11_backtest_second_layer", f"""{BACKTEST_TRACKS}, {L2.replace("310", "300")}, sc as (select last.*, t.quant, t.pattern_score, t.source, t.regime, hl.* exclude (code) from tracks t join last using (code) join hl using (code) where n300 >= 60 and not ({rule_sql.FIVE_FALLS}) and not ({rule_sql.CRASH})),
sd as (select *, {rule_sql.HEALTH_L2} health, {rule_sql.VOLUME_L2} volume from sc),
tot as (select code, regime, {fix("quant / greatest(max(quant) over (), 1e-9) * 100 * 0.4 + case when max(pattern_score) over () > 0 then pattern_score / cast(max(pattern_score) over () as double) * 100 else 0.0 end * 0.3 + health * 0.2 + volume * 0.1 + case when source = 'dual' then 5 else 0 end", 1)} l2 from sd)
select code, l2, row_number() over (order by l2 desc, code) as rank from tot qualify rank <= greatest(5, least(30, floor(count(*) over () * case when regime = 'bear' then 0.05 else 0.15 end)))""")
def backtest_second(spark, sf):
    chosen = _backtest_tracks(spark, sf).withColumnRenamed("quant_score", "quant")
    return funnel.second_layer(chosen, _bars(spark, sf), SCALED_BACKTEST).select("code", "l2", "rank")


OLD_PREV = ", ".join(f"lag({c}, {k}) over {W} p_{c}{k}" for k in (1, 2) for c in ("c", "o", "v"))


@query("b12_old_gates", f"""{BF}, g as (select *, {OLD_PREV} from f), last as (select * from g qualify row_number() over (partition by code order by d desc) = 1) select code, {rule_sql.OLD_GATES} as dropped from last""")
def old_gates(spark, sf):
    before = {f"p_{c}{k}": F.lag(c, k).over(series()) for k in (1, 2) for c in ("c", "o", "v")}
    return ind.last_features(_bars(spark, sf), more=before).select("code", F.expr(scoring.OLD_GATES).alias("dropped"))


@query("f7_dual_track")
def dual_track(spark, sf):
    """The quant track and the track of real chart patterns, merged."""
    t = funnel.first_layer(funnel.dual_tracks(spark, _bars(spark, sf), fx.basics(spark, sf), _lhb(spark, sf), SCALED))
    return t.select("rank", "code", "source", "quant_score", "pattern_score", "score")


@query("f10_dual_track")
def dual_track_second(spark, sf):
    first = funnel.first_layer(funnel.dual_tracks(spark, _bars(spark, sf), fx.basics(spark, sf), _lhb(spark, sf), SCALED))
    return funnel.second_layer(first.withColumnRenamed("quant_score", "quant"), _bars(spark, sf)).select("code", "l2", "rank")


OLD_FIRST = f"""{B}, {FEATURES}, g as (select *, {OLD_PREV} from f), last as (select * from g qualify row_number() over (partition by code order by d desc) = 1),
passed as (select * from last where nbar >= 20 and not {rule_sql.OLD_GATES} and not coalesce(amount20 < 600, false)),
points as (select *, (rank() over (order by ret20) + (count(*) over (partition by ret20) - 1) / 2.0) / cast(count(*) over () as double) * 100 * 0.25 + if(slope > 0, 20, 0) + if(atr5 < atr20, 15, 0) + if(near_high > 0.8, 15, 0) + if(yang, 15, 0) + if(amount_ratio > 1.2, 10, 0) p from passed),
old1 as (select *, {fix("p", 1)} score, row_number() over (order by {fix("p", 1)} desc, code) rank from points qualify rank <= 150)"""


@query("f12_old_first_layer", f"{OLD_FIRST} select code, score, rank from old1")
def old_first(spark, sf):
    return funnel.old_first_layer(_bars(spark, sf), 0.0006).select("code", "score", "rank")


@query("f12_old_second_layer", f"""{OLD_FIRST}, {L2.replace("310", "300")}, w as (select code, c, lag(c, 4) over (partition by code order by d) c5, row_number() over (partition by code order by d desc) n from bars),
x as (select old1.*, hl.* exclude (code), c5, (rank() over (order by ret20) - 1) / cast(count(*) over () as double) below from old1 join hl using (code) join (select code, c5 from w where n = 1) using (code) where n300 >= 60),
y as (select code, least(100, if(ma5 > ma10, if(ma10 > ma20, 30, 15), 0) + least(30, greatest(0, (1 - atr5 / greatest(atr20, 0.001)) * 60)) + if(c > ma20, 15, 0) + if(c > ma60, 15, 0) + if(dif > dea, 10, 0)) * 0.4 + {rule_sql.VOLUME_L2} * 0.3 + (below * 50 + least(50, greatest(0, (c - c5) / cast(c5 as double) * 500))) * 0.3 t from x where not {rule_sql.FIVE_FALLS} and not {rule_sql.CRASH})
select code, {fix("t", 1)} as score, row_number() over (order by {fix("t", 1)} desc, code) as rank from y qualify rank <= 30""")
def old_second(spark, sf):
    b = _bars(spark, sf)
    return funnel.old_second_layer(funnel.old_first_layer(b, 0.0006), b).select("code", "score", "rank")


PARTS = {"trend": scoring.SIGNAL_TREND, "bias_score": scoring.SIGNAL_BIAS, "volume": scoring.SIGNAL_VOLUME, "support": scoring.SIGNAL_SUPPORT, "macd": scoring.SIGNAL_MACD, "rsi": scoring.SIGNAL_RSI}


@query("f1_signal_score", f"""{BF}, {OSC}, o as (select code, d, dif, dea, hist, rsi6, lag(hist) over {W} p_hist from osc), x as (select f.*, o.* exclude (code, d), (f.c - ma5) / ma5 * 100 bias, f.v / greatest(v5, 1e-9) vr from f join o on o.code = f.code and o.d = f.d),
last as (select * from x qualify row_number() over (partition by code order by d desc) = 1), y as (select *, {", ".join(f"{v} {k}" for k, v in rule_sql.SIGNAL.items())} from last), z as (select *, {" + ".join(PARTS)} total from y)
select code, {", ".join(PARTS)}, total, {rule_sql.SIGNAL_LABEL} as signal from z""")
def signal_score(spark, sf):
    b = _bars(spark, sf)
    x = ind.last_features(b).join(ind.last_oscillators(b).select("code", "dif", "dea", "hist", "p_hist", "rsi6"), "code")
    last = x.withColumns({"bias": (F.col("c") - F.col("ma5")) / F.col("ma5") * 100, "vr": F.col("v") / F.greatest(F.col("v5"), F.lit(1e-9))})
    last = last.withColumns({k: F.expr(v) for k, v in PARTS.items()}).withColumn("total", sum((F.col(k) for k in PARTS), F.lit(0)))
    enough = F.col("nbar") >= 5
    return last.select("code", *PARTS, F.when(enough, F.col("total")).otherwise(0).alias("total"), F.when(enough, F.expr(scoring.SIGNAL_LABEL)).otherwise("SELL").alias("signal"))


@query("b8_b9_keyword_filters", """with n as (select s_suppkey code, s_name name from supplier) select code, contains(name, '1') or contains(name, '77') or contains(cast(code as varchar), '5') as excluded, upper(name) like '%ST%' as st from n""")
def keyword_filters(spark, sf):
    n = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    return n.select("code", (contains_any(F.col("name"), ("1", "77")) | contains_any(F.col("code").cast("string"), ("5",))).alias("excluded"), F.upper("name").like("%ST%").alias("st"))


@query("b10_bias_warning", f"""{BF}, {LASTBARS} select code, case when (c - ma5) / ma5 * 100 > 0.5 and not (ma5 > ma10 and ma10 > ma20) then 'severe' when (c - ma5) / ma5 * 100 > 0.2 then 'mild' else '' end as warning from last""")
def bias_warning(spark, sf):
    from quantloom.operators.portfolio import bias_warning as warn

    return funnel.latest_features(_bars(spark, sf)).select("code", warn(0.5, 0.2).alias("warning"))


@query("b11_change_filter", f"{BF}, {LASTBARS} select code, {fix('(c - prev_c) / cast(prev_c as double) * 100')} as pct from last where (c - prev_c) / cast(prev_c as double) * 100 > 0.3")
def change_filter(spark, sf):
    pct = (F.col("c") - F.col("prev_c")) / F.col("prev_c") * 100
    return funnel.latest_features(_bars(spark, sf)).where(pct > 0.3).select("code", fixed(pct).alias("pct"))


@query("b13_b14_calendar", """select event_id, isodow(ts) <= 5 and hour(ts) * 100 + minute(ts) between 915 and 1505 as session, isodow(ts) in (1, 3, 5) and cast(ts as date) < date '2024-01-20' as picked from events""")
def calendar(spark, sf):
    e = fx.table(spark, sf, "events")
    hhmm = F.hour("ts") * 100 + F.minute("ts")
    return e.select("event_id", (F.weekday("ts").between(0, 4) & hhmm.between(915, 1505)).alias("session"), (F.weekday("ts").isin(0, 2, 4) & (F.to_date("ts") < F.lit("2024-01-20").cast("date"))).alias("picked"))


@query("b15_h17_sampling_cap", f"""with {fx.SECTORS} select code, sector from sector_map qualify row_number() over (partition by sector order by code) <= 3""")
def sampling_cap(spark, sf):
    from quantloom.operators.portfolio import first_per_group

    return first_per_group(fx.sector_map(spark, sf), "sector", 3, "code").select("code", "sector")


@query("b16_safe_number", """select event_id, coalesce(try_cast(regexp_extract(props, '"k": *([^}]*)', 1) as double), 0.0) as k, coalesce(try_cast(event_type as double), -1.0) as t from events""")
def safe_number(spark, sf):
    from quantloom.functions.expr import safe_number as num

    return fx.table(spark, sf, "events").select("event_id", num(F.regexp_extract("props", r'"k": *([^}]*)', 1)).alias("k"), num("event_type", -1.0).alias("t"))


@query("b17_c8_field_backfill", f"""with {fx.PICKS}, {fx.SECTORS} select model, rank, p.code, coalesce(nullif(case when p.code % 2 = 0 then '' else 'own' end, ''), s.sector, 'unknown') as sector from model_picks p left join sector_map s on s.code = p.code""")
def field_backfill(spark, sf):
    p = fx.model_picks(spark, sf).withColumn("own", F.when(F.col("code") % 2 == 0, "").otherwise("own"))
    s = fx.sector_map(spark, sf).select("code", F.col("sector"))
    return p.join(s, "code", "left").select("model", "rank", "code", F.coalesce(F.nullif("own", F.lit("")), "sector", F.lit("unknown")).alias("sector"))
