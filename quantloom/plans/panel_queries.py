"""Queries of what a panel of models says: the radar's consensus, sector votes, typed picks; and ratios of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import fixed, rounded
from quantloom.operators import fusion, opinions, picks, profiles, radar, ratios
from quantloom.operators.aggregates import resample
from quantloom.plans.indicator_queries import B, fix
from quantloom.sources import fixtures as fx
from quantloom.sources.feeds import stored

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer for each event: its words by numbers, some empty or null."""
    k, u = F.col("event_id"), F.col("user_id")
    words = lambda x, *w: F.get(F.array(*[F.lit(v) for v in w]), (x % len(w)).cast("int"))
    text = lambda name, n: F.when(k % n != 0, F.concat(F.lit(name), (k % 13).cast("string"))).otherwise("")
    return fx.table(spark, sf, "events").select(
        F.concat(F.lit("m"), (u % 7).cast("string")).alias("model"), k.alias("pos"), words(k, "up", "", "down", "up", None).alias("trend"), words(k * 3 + u, "hot", "cold", "").alias("temperature"), words(u, "", None, "start").alias("phase"),
        F.when(k % 4 != 0, k % 100).alias("score"), text("why ", 3).alias("reasoning"), text("sign ", 5).alias("signals"), text("sum ", 2).alias("summary"), text("hint ", 7).alias("hint"), text("do ", 11).alias("advice"),
    )


def _said(name: str, n: int, most: int, model: bool) -> str:
    text = f"'{name} ' || event_id % 13"
    text = f"'[m' || user_id % 7 || '] ' || {text}" if model else text
    return f"coalesce((select string_agg(x, '; ' order by event_id) from (select event_id, {text} x from events where event_id % {n} <> 0 order by event_id limit {most})), '')"


def _mode(value: str, default: str) -> str:
    return f"coalesce((select v from (select {value} v, event_id from events) where v <> '' group by v order by count(*) desc, min(event_id) limit 1), '{default}')"


@query("h9_market_consensus", f"""select {_mode("['up', '', 'down', 'up', null][event_id % 5 + 1]", "sideways")} as trend, {_mode("['hot', 'cold', ''][(event_id * 3 + user_id) % 3 + 1]", "normal")} as temperature, {_mode("['', null, 'start'][user_id % 3 + 1]", "")} as phase,
  (select cast(round_even(avg(event_id % 100), 0) as bigint) from events where event_id % 4 <> 0) as score, {_said("why", 3, 3, True)} as reasoning, {_said("sign", 5, 3, True)} as signals, {_said("sum", 2, 1, False)} as summary, {_said("hint", 7, 1, False)} as hint, {_said("do", 11, 3, True)} as advice""")
def market_consensus(spark, sf):
    return radar.market_consensus(_answers(spark, sf))


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    s = lambda x: x.cast("string")
    etf = lambda x: F.struct(F.when(x % 5 != 0, F.concat(F.lit("E"), s(x % 5))).otherwise("").alias("code"), F.concat(F.lit("fund "), s(x)).alias("name"))
    return fx.table(spark, sf, "events").select(
        F.concat(F.lit("m"), s(u % 7)).alias("model"), k.alias("pos"), F.lit(0).alias("at"), F.when(k % 17 != 0, F.concat(F.lit(" "), "event_type", F.lit("-"), s((k * k + u) % 9), F.lit(" "))).alias("concept"), F.when(k % 5 != 0, (k % 60).cast("double")).alias("confidence"),
        F.get(F.array(F.lit("early"), F.lit(""), F.lit("peak"), F.lit("late")), ((k + u) % 4).cast("int")).alias("stage"), F.when(k % 2 == 0, F.concat(F.lit("g"), s(k % 6))).alias("signals"), F.when(k % 3 == 0, F.concat(F.lit("sp"), s(k % 5))).alias("space"),
        F.concat(F.lit("r"), s(k % 8)).alias("reasoning"), F.when(k % 4 == 0, F.concat(F.lit("x"), s(k % 7))).otherwise("").alias("risk"), F.array(s(k % 6), s(u % 8), s(k % 3)).alias("leaders"), F.array(etf(k), etf(u)).alias("etfs"),
    )


CONCEPTS = """p as (select event_id k, user_id u, trim(' ' || event_type || '-' || (event_id * event_id + user_id) % 9 || ' ') concept, case when event_id % 5 <> 0 then event_id % 60 else 70 end conf, ['early', '', 'peak', 'late'][(event_id + user_id) % 4 + 1] stage from events where event_id % 17 <> 0),
g as (select concept, count(*) votes, round(avg(conf), 1) confidence, min(k) f from p group by concept), top as (select *, row_number() over (order by votes desc, confidence desc, f) rank from g qualify rank <= 8),
st as (select concept, stage from p where stage <> '' group by concept, stage qualify row_number() over (partition by concept order by count(*) desc, min(k)) = 1),
lead0 as (select concept, k, unnest([k % 6, u % 8, k % 3]) c, unnest([0, 1, 2]) i from p), lead1 as (select concept, c, min(k * 3 + i) o from lead0 group by concept, c qualify row_number() over (partition by concept order by o) <= 5), leads as (select concept, string_agg(c, ',' order by o) leaders from lead1 group by concept),
etf0 as (select concept, k, unnest([k, u]) c, unnest([0, 1]) i from p), etf1 as (select concept, c % 5 c5, arg_min(c, k * 2 + i) c, min(k * 2 + i) o from etf0 where c % 5 <> 0 group by 1, 2 qualify row_number() over (partition by concept order by min(k * 2 + i)) <= 3),
etfs as (select concept, string_agg('E' || c5 || ' fund ' || c, ',' order by o) etfs from etf1 group by concept),
sg as (select concept, string_agg('g' || k % 6, '; ' order by k) x from (select * from p where k % 2 = 0 qualify row_number() over (partition by concept order by k) <= 3) group by concept),
rs as (select concept, string_agg('[m' || u % 7 || '] r' || k % 8, '; ' order by k) x from (select * from p qualify row_number() over (partition by concept order by k) <= 2) group by concept),
sp as (select concept, arg_min('sp' || k % 5, k) x from p where k % 3 = 0 group by concept), rk as (select concept, arg_min('x' || k % 7, k) x from p where k % 4 = 0 group by concept)"""


@query("h9_concept_consensus", f"""with {CONCEPTS} select rank, concept, votes, {fix("confidence", 1)} as confidence, coalesce(stage, 'unknown') as stage, coalesce(sg.x, '') as signals, coalesce(sp.x, '') as space, coalesce(rs.x, '') as reasoning, leaders, etfs, coalesce(rk.x, '') as risk
from top left join st using (concept) left join leads using (concept) left join etfs using (concept) left join sg using (concept) left join rs using (concept) left join sp using (concept) left join rk using (concept)""")
def concept_consensus(spark, sf):
    c = radar.concept_consensus(_predictions(spark, sf))
    etfs = F.array_join(F.transform("etfs", lambda e: F.concat_ws(" ", e["code"], e["name"])), ",")
    return c.withColumns({"confidence": fixed("confidence", 1), "leaders": F.array_join("leaders", ","), "etfs": etfs})


def _panel(spark: SparkSession, sf: str, step: int) -> DataFrame:
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").where(k % step == 0).select(F.concat(F.lit(" S"), (k % 11 % 7).cast("string")).alias("sector"), F.when(k % 3 != 0, k % 5 + 1).alias("rank"), F.when(k % 4 != 0, 50 + k % 50).alias("score"), k.alias("pos"))


PANEL = """sp as (select 'S' || o_orderkey % 11 % 7 sector, count(*) votes, round(avg(case when o_orderkey % 3 <> 0 then o_orderkey % 5 + 1 else 5 end), 2) r, round(avg(case when o_orderkey % 4 <> 0 then 50 + o_orderkey % 50 else 70 end), 1) s, min(o_orderkey) f from orders group by 1),
panel as (select *, row_number() over (order by votes desc, r, f) place from sp qualify place <= 5)"""


@query("h6_sector_panel", f"with {PANEL} select place, sector, votes, {fix('r', 2)} as mean_rank, {fix('s', 1)} as mean_score from panel")
def sector_panel(spark, sf):
    return radar.sector_votes(_panel(spark, sf, 1)).select("place", "sector", "votes", fixed("mean_rank", 2).alias("mean_rank"), fixed("mean_score", 1).alias("mean_score"))


def _switched(limit: int) -> str:
    """The panel cut to sectors below a number, and the screen of every second order."""
    return f"""with p0 as (select * from orders where o_orderkey % 11 % 7 < {limit}), sp as (select 'S' || o_orderkey % 11 % 7 sector, count(*) votes, round(avg(case when o_orderkey % 3 <> 0 then o_orderkey % 5 + 1 else 5 end), 2) r, min(o_orderkey) f from p0 group by 1),
panel as (select sector, row_number() over (order by votes desc, r, f) place from sp qualify place <= 5),
s0 as (select 'S' || o_orderkey % 11 % 7 sector, count(*) votes, avg(case when o_orderkey % 4 <> 0 then 50 + o_orderkey % 50 else 70 end) s, min(o_orderkey) f from orders where o_orderkey % 2 = 0 group by 1), screen as (select sector, row_number() over (order by votes desc, s desc, f) place from s0 qualify place <= 5),
b as (select sector, place, 'panel' as source from panel union all select sector, place, 'screen' from screen where sector not in (select sector from panel) and (select count(*) from panel) < 3)
select row_number() over (order by source, place) as place, sector, source from b qualify row_number() over (order by source, place) <= 5"""


@query("h6_h7_switched_over", _switched(2))
def switched_over(spark, sf):
    """A panel that names two sectors only, so the screen's follow."""
    return radar.chosen_sectors(_panel(spark, sf, 1).where("pos % 11 % 7 < 2"), _panel(spark, sf, 2))


@query("h6_h7_not_switched", _switched(7))
def not_switched(spark, sf):
    """The whole panel: the screen has no part in the result."""
    return radar.chosen_sectors(_panel(spark, sf, 1), _panel(spark, sf, 2))


def _pick_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer of five picks for each turn: ranks and scores as numbers, texts and nonsense, targets whole, partial and of other types."""
    c, t = F.col("conv_id"), F.col("turn")
    q = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))

    def one(i: int):
        n = c * 7 + t * 3 + i
        rank = F.when(n % 4 == 0, q(n % 30)).when(n % 4 == 1, F.lit('"first"')).when(n % 4 == 2, (n % 25).cast("string")).otherwise("null")
        score = F.when(n % 3 == 0, q(n % 90 + 0.5)).when(n % 3 == 1, (n % 80).cast("string")).otherwise('"high"')
        targets = F.when(n % 5 == 0, F.lit('"none"')).when(n % 5 == 1, F.concat(F.lit('{"baseline":'), (n % 40).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"conservative":"'), (n % 11).cast("string"), F.lit('","baseline":1.5,"optimistic":"x"}')))
        code = F.when(n % 9 == 0, F.lit(" ")).otherwise(F.lpad((n % 1000).cast("string"), 6, "0"))
        return F.concat(F.lit('{"code":"'), code, F.lit('","rank":'), rank, F.lit(',"score":'), score, F.lit(',"reasoning":"'), F.repeat(F.lit("ab"), (n % 200).cast("int")), F.lit('","target_prices":'), targets, F.lit("}"))

    body = F.concat(F.lit('{"picks":['), F.concat_ws(",", *[one(i) for i in range(5)]), F.lit("]}"))
    answer = F.when(c % 3 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(c % 3 == 1, F.concat(F.lit("well "), body)).otherwise(F.when(t % 5 == 0, F.lit("no picks at all")).otherwise(body))
    return fx.table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("answer"))


@query("i2_whole_picks", f"""with n as (select conv_id, turn, i, conv_id * 7 + turn * 3 + i n from conversations, range(5) r(i) where not (conv_id % 3 = 2 and turn % 5 = 0)),
p as (select *, case n % 4 when 0 then n % 30 when 2 then n % 25 else 99 end rank, case n % 3 when 0 then n % 90 + 0.5 when 1 then n % 80 else 70 end score from n where n % 9 <> 0)
select conv_id, turn, row_number() over (partition by conv_id, turn order by rank, i) as place, rank, lpad(cast(n % 1000 as varchar), 6, '0') as code, {fix("score", 1)} as score, least(300, n % 200 * 2) as chars,
  case n % 5 when 0 then null when 1 then 0 else n % 11 * 10 end as conservative, case n % 5 when 0 then null when 1 then n % 40 * 10 else 15 end as baseline, case n % 5 when 0 then null else 0 end as optimistic from p""")
def whole_picks(spark, sf):
    p = picks.typed_picks(stored(_pick_answers(spark, sf)), 20)  # the answers are made here; a feed has them in a column
    target = lambda k: fixed(F.try_element_at("targets", F.lit(k)), 1)
    return p.select("conv_id", "turn", "place", F.col("rank").cast("long").alias("rank"), "code", fixed("score", 1).alias("score"), F.length("reasoning").cast("long").alias("chars"), *(target(k).alias(k) for k in picks.TARGETS))


# -- ratios of reports


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """A long table of two families: a customer's orders as holder counts, a supplier's shipments as margin balances."""
    o = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.lit("holders").alias("family"), F.col("o_orderkey").alias("d"), F.when(F.col("o_orderkey") % 13 != 0, F.round("o_totalprice").cast("double")).alias("value"))
    li = fx.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("code"), F.lit("margin").alias("family"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("d"), F.when(F.col("l_orderkey") % 17 != 0, F.round("l_extendedprice").cast("double")).alias("value"))
    return o.unionByName(li)


@query("d19_period_ratios", f"""with s as (select o_custkey code, 'holders' as family, o_orderkey d, coalesce(case when o_orderkey % 13 <> 0 then round(o_totalprice) end, 0) v from orders union all select l_suppkey, 'margin', l_orderkey * 10 + l_linenumber, coalesce(case when l_orderkey % 17 <> 0 then round(l_extendedprice) end, 0) from lineitem),
n as (select *, row_number() over (partition by code, family order by d desc, v desc) n, count(*) over (partition by code, family) k from s), r as (select code, family, max(v) filter (where n = 1) a, max(v) filter (where n = 1 + case family when 'holders' then 1 else least(4, k - 1) end) b from n where k >= 2 group by all)
select code, family, cast(a as double) as latest, cast(b as double) as earlier, {fix("round((a - b) / b * 100, 1)", 1)} as change from r where b > 0""")
def period_ratios(spark, sf):
    r = ratios.period_ratios(_snapshots(spark, sf), {"holders": (1, False), "margin": (4, True)})
    return r.select("code", "family", "latest", "earlier", fixed("change", 1).alias("change"))


@query("d19_sheets_and_trades", f"""with sheets as (select o_custkey code, o_orderkey d, case when o_orderkey % 5 <> 0 then o_totalprice end g, case o_orderkey % 7 when 0 then 0 when 1 then null else o_totalprice * 3 + 1 end e from orders),
gw as (select code, round(coalesce(arg_max(coalesce(g, 0), d), 0) / greatest(coalesce(nullif(arg_max(coalesce(e, 0), d), 0), 1), 1) * 100, 1) x from sheets group by code),
bt as (select l_suppkey code, l_orderkey * 10 + l_linenumber pos, cast(l_shipdate as date) d, case when l_linenumber <> 3 then l_discount * 100 - 5 end disc from lineitem qualify row_number() over (partition by l_suppkey order by cast(l_shipdate as date) desc, l_orderkey * 10 + l_linenumber desc) <= 30),
tr as (select code, count(*) n, round(avg(disc), 2) m from bt group by code)
select coalesce(gw.code, tr.code) as code, {fix("gw.x", 1)} as goodwill_ratio, n as trades, {fix("m", 2)} as mean_discount from gw full join tr on gw.code = tr.code""")
def sheets_and_trades(spark, sf):
    k = F.col("o_orderkey")
    sheets = fx.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), k.alias("d"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("goodwill"), F.when(k % 7 == 0, 0.0).when(k % 7 != 1, F.col("o_totalprice") * 3 + 1).alias("equity"))
    li = fx.table(spark, sf, "lineitem")
    trades = li.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 100 - 5).alias("discount"))
    j = ratios.goodwill_ratio(sheets).join(ratios.recent_trades(trades), "code", "full")
    return j.select("code", fixed("goodwill_ratio", 1).alias("goodwill_ratio"), F.col("count").alias("trades"), fixed("mean_discount", 2).alias("mean_discount"))


# -- single securities


def _said_picks(spark: SparkSession, sf: str) -> DataFrame:
    """Ballots with texts: names, sectors and reasonings that are sometimes missing."""
    c, r, m = F.col("code"), F.col("rank"), F.substring("model", 1, 1)
    return fx.model_picks(spark, sf).select(
        "model", "rank", "code", "score", (r * 10 + m.cast("long")).alias("pos"), F.when((c + r) % 3 != 0, F.concat(F.lit("n"), c)).otherwise("").alias("name"), F.when((c % 4 != 0) | (r % 2 != 0), F.concat(F.lit("s"), c % 7, F.lit("-"), m)).alias("sector"),
        F.when(r % 5 != 0, F.concat(F.lit("because "), r)).otherwise("").alias("reasoning"), F.when(r % 4 != 0, r % 5 + 1).alias("stars"),
    )


SAID = f"""{fx.PICKS}, said as (select model, rank, code, score, rank * 10 + cast(substr(model, 1, 1) as bigint) pos, case when (code + rank) % 3 <> 0 then 'n' || code else '' end as name, case when code % 4 <> 0 or rank % 2 <> 0 then 's' || code % 7 || '-' || substr(model, 1, 1) end as sector,
  case when rank % 5 <> 0 then 'because ' || rank else '' end as reasoning, case when rank % 4 <> 0 then rank % 5 + 1 end as stars from model_picks),
known as (select code, coalesce(arg_min(name, pos) filter (where name <> ''), '') as name, coalesce(arg_min(sector, pos) filter (where sector <> ''), '') as sector from said group by code),
reasons as (select code, string_agg('[' || model || '] ' || reasoning, ';' order by pos) as reasonings from (select * from said where reasoning <> '' qualify row_number() over (partition by code order by pos) <= 3) group by code)"""


@query("h1_borda_rows", f"""with {SAID}, bd as (select code, sum(greatest(0, 21 - rank)) borda, round(avg(cast(score as double)), 1) mean_score, count(*) ballots, round(sum(greatest(0, 21 - rank)) / cast((select count(distinct model) from said) as double), 2) borda_mean from said group by code),
bo as (select *, row_number() over (order by borda_mean desc, ballots desc, mean_score desc, code desc) place from bd)
select place, code, {fix("borda_mean", 2)} as borda_mean, ballots, {fix("mean_score", 1)} as mean_score, name, sector, coalesce(reasonings, '') as reasonings from bo join known using (code) left join reasons using (code) where place <= 30""")
def borda_rows(spark, sf):
    b = fusion.borda(_said_picks(spark, sf), most=30)
    return b.select("place", "code", fixed("borda_mean", 2).alias("borda_mean"), "ballots", fixed("mean_score", 1).alias("mean_score"), "name", "sector", F.array_join("reasonings", ";").alias("reasonings"))


@query("h4_panel_picks", f"""with {SAID} select cast(code as varchar) as code, name, sector, votes, {fix("mean_score", 1)} as mean_score, {fix("mean_stars", 1)} as mean_stars, {fix("mean_score + 5 * (votes - 1)", 1)} as consensus
from (select code, count(*) votes, round(avg(cast(score as double)), 1) mean_score, round(avg(cast(coalesce(stars, 3) as double)), 1) mean_stars from said group by code) join known using (code)""")
def panel_picks(spark, sf):
    p = opinions.panel_picks(_said_picks(spark, sf).withColumn("code", F.concat(F.lit(" "), F.col("code").cast("string"))))
    return p.withColumns({"mean_score": fixed("mean_score", 1), "mean_stars": fixed("mean_stars", 1), "consensus": fixed("consensus", 1)})


@query("h12_breakout_votes", f"""with {SAID}, b as (select code, count(*) votes, max(score) score, arg_max(name, score * 100000 - pos) as name, arg_max(reasoning, score * 100000 - pos) reasoning, min(pos) f from said group by code)
select row_number() over (order by votes desc, score desc, f) as place, cast(code as varchar) as code, votes, cast(score as double) as score, name, reasoning from b qualify row_number() over (order by votes desc, score desc, f) <= 15""")
def breakout_votes(spark, sf):
    return opinions.breakout_votes(_said_picks(spark, sf).withColumn("code", F.col("code").cast("string")))


@query("z2_expert_rows", f"""with {SAID} select 'E' || code % 7 as expert, cast(code as varchar) as code, name, 3.0::double as stars, cast(case when rank % 6 = 0 then 70 else score end as double) as score, model as voter from said""")
def expert_rows(spark, sf):
    """Models' logs by expert, nested as they answer, regrouped."""
    p = _said_picks(spark, sf).withColumns({"expert": F.concat(F.lit("E"), F.col("code") % 7), "score": F.when(F.col("rank") % 6 != 0, F.col("score"))})
    logs = p.groupBy("model", "expert").agg(F.collect_list(F.struct(F.col("code").cast("string").alias("code"), "name", "score")).alias("picks")).groupBy("model").agg(F.collect_list(F.struct("expert", "picks")).alias("logs"))
    return opinions.by_expert(logs.withColumn("pos", F.lit(0))).select("expert", "code", "name", "stars", "score", "voter")


def _debates(spark: SparkSession, sf: str) -> DataFrame:
    """Opinions of the models on a security, with turns to its risks in some texts."""
    c, r = F.col("code"), F.col("rank")
    pick = lambda x, *w: F.get(F.array(*[F.lit(v) for v in w]), (x % len(w)).cast("int"))
    text = F.concat(pick(r, "但开头就不好了。", "看好", "", "虽强"), pick(c + r, "但估值已经偏高；其余尚可", "，不过短。", "，需注意量能流出明显", "。", "风险在于业绩承压。完"), pick(c * 3 + r, "警惕获利了结压力", "", "但估值已经偏高。"))
    experts = F.when(r % 3 == 0, F.array(F.lit("E1"), F.concat(F.lit("E"), c % 9))).when(r % 3 == 1, F.array().cast("array<string>"))
    return fx.model_picks(spark, sf).select("code", "model", F.substring("model", 1, 1).cast("long").alias("pos"), F.when(r % 7 != 0, F.col("score") % 10).alias("score"), text.alias("reasoning"), experts.alias("experts"), F.when(r % 4 == 0, c % 90).alias("baseline"), F.when(r % 4 == 1, c % 80 + 0.5).alias("conservative"), (r % 3 * 4).alias("stop_loss_pct"), "rank")


def _sql_fragments(turns: tuple[str, ...], least: int) -> str:
    each = [f"case when instr(t, '{m}') > {least} and length(trim(regexp_extract(substr(t, instr(t, '{m}')), '^[^。；]*'))) >= 5 then trim(regexp_extract(substr(t, instr(t, '{m}')), '^[^。；]*')) end" for m in turns]
    return f"list_filter([{', '.join(each)}], lambda x: x is not null)"


DEBATES = f"""{fx.PICKS}, dd as (select code, model, cast(substr(model, 1, 1) as bigint) pos, rank, coalesce(case when rank % 7 <> 0 then score % 10 end, 0) sc, ['但开头就不好了。', '看好', '', '虽强'][rank % 4 + 1] || ['但估值已经偏高；其余尚可', '，不过短。', '，需注意量能流出明显', '。', '风险在于业绩承压。完'][(code + rank) % 5 + 1] || ['警惕获利了结压力', '', '但估值已经偏高。'][(code * 3 + rank) % 3 + 1] t,
  case when rank % 3 = 0 then 'E1+E' || code % 9 || '推荐' end ex, case when rank % 4 = 0 then nullif(code % 90, 0) when rank % 4 = 1 then code % 80 + 0.5 end target, rank % 3 * 4 sl from one_each),
fr as (select *, {_sql_fragments(opinions.OWN_TURNS, 1)} own, {_sql_fragments(opinions.OTHER_TURNS, 0)} oth, row_number() over (partition by code order by sc desc, pos) b from dd),
bst as (select * from fr where b = 1), rest as (select fr.code, list(fr.oth order by fr.pos) os from fr join bst on bst.code = fr.code and bst.model <> fr.model group by fr.code)""".replace("from one_each", "from (select * from model_picks qualify row_number() over (partition by code, model order by rank) = 1)")
# the own clauses, each once in their order, then of each other model's the first that is new
RISK = """list_reduce(list_concat([list_filter(own, lambda x, i: list_position(own, x) = i)], coalesce(os, [])), lambda s, c: case when len(list_filter(c, lambda x: not list_contains(s, x))) > 0 then list_append(s, list_filter(c, lambda x: not list_contains(s, x))[1]) else s end)"""


@query("z5_z6_debated", f"""with {DEBATES} select code, model, cast(sc as double) as score, t || case when ex is not null or target is not null then ' (' || concat_ws(', ', ex, case when target is not null then '目标' || cast(round_even(target, 0) as bigint) end) || ')' else '' end as reason,
  array_to_string(list_concat({RISK}, case when sl <> 0 then ['止损' || sl || '%'] else [] end)[1:3], '；') as risk from bst left join rest using (code)""")
def debated(spark, sf):
    d = _debates(spark, sf)
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy("code", "model").orderBy("rank"))).where("_n = 1")
    return opinions.debated(d).select("code", "model", "score", "reason", "risk")


@query("z10_debate_context", f"""with {SAID}, l as (select model, string_agg('  • ' || code || case when name <> '' then ' ' || name else '' end || '（' || coalesce(cast(stars as varchar), '?') || '星/' || score || '分）: ' || substr(repeat(reasoning || ' ', 12), 1, 80), chr(10) order by rank) x from said where rank <= 3 and model like '1%' group by model)
select model, '【' || model || '】的选择：' || chr(10) || x as line from l union all select distinct model, '【' || model || '】未给出有效选择' from said where model like '2%' union all select distinct model, '【' || model || '】: ' || replace(substr(repeat('line' || chr(10), 100), 1, 300), chr(10), ' ') || '...' from said where model > '3'""")
def debate_context(spark, sf):
    p = _said_picks(spark, sf)
    one = F.struct("rank", F.col("code").cast("string").alias("code"), "name", "score", "stars", F.repeat(F.concat("reasoning", F.lit(" ")), 12).alias("reasoning"))
    g = p.groupBy("model").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= 3, one))).alias("picks"))
    head = F.substring("model", 1, 1)
    empty = F.slice("picks", 1, 0)
    a = g.select("model", F.lit(0).alias("pos"), F.lit("line\n" * 100).alias("text"), F.when(head == "1", F.col("picks")).when(head == "2", empty).alias("picks"))
    return opinions.debate_context(a).select("model", "line")


# -- universes and fields


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of sectors that share codes: each nation's suppliers, and those whose number ends like the nation's."""
    n, s = fx.table(spark, sf, "nation"), fx.table(spark, sf, "supplier")
    hit = (F.col("s_nationkey") == F.col("n_nationkey")) | (F.col("s_suppkey") % 25 == F.col("n_nationkey"))
    m = s.join(F.broadcast(n), hit)  # twenty-five rows
    return m.select(F.col("n_name").alias("sector"), F.col("n_nationkey").alias("sector_pos"), ((F.col("s_suppkey") * 7) % 100003).alias("pos"), F.when(F.col("s_suppkey") % 19 != 0, F.concat(F.lit(" "), F.col("s_suppkey").cast("string"))).otherwise(" ").alias("code"))


MEMBERS = "m0 as (select n_name sector, n_nationkey sp, s_suppkey * 7 % 100003 pos, s_suppkey code from supplier join nation on s_nationkey = n_nationkey or s_suppkey % 25 = n_nationkey where s_suppkey % 19 <> 0), home as (select code, arg_min(sector, sp * 1000000 + pos) sector from m0 group by code)"


def _sampled(most: int) -> str:
    return f"""with {MEMBERS}, k as (select *, row_number() over (partition by sp order by pos) n from m0), few as (select code, min(sp * 1000000 + pos) o from k where (select count(*) from home) <= 25 * {most} or n <= {most} group by code)
select cast(few.code as varchar) as code, sector, row_number() over (order by o) as place from few join home using (code)"""


@query("b15_sampled_members", _sampled(1))
def sampled_members(spark, sf):
    return opinions.sampled_members(_members(spark, sf), 25, 1)


@query("b15_all_members", _sampled(1000))
def all_members(spark, sf):
    """The same lists under a limit that they don't reach: nothing is left out."""
    return opinions.sampled_members(_members(spark, sf), 25, 1000)


@query("b17_filled_fields", f"""with {fx.PICKS}, {fx.SECTORS}, lk as (select code, max(score) as bs, count(*) as mc, case when code % 4 = 0 then 'own' when code % 4 = 1 then '' end cl, case when code % 3 = 0 then 'l' || code end se from model_picks where rank <= 150 group by code),
r as (select c_custkey code, case c_custkey % 4 when 0 then 1.5 when 1 then 0 end bs, case c_custkey % 5 when 0 then 4 when 1 then 0 end mc, case c_custkey % 6 when 0 then 'kept' when 1 then '' end cl, case c_custkey % 7 when 0 then 'mine' when 1 then '' end se from customer),
f as (select r.code, coalesce(nullif(r.bs, 0), lk.bs, 0) bs, coalesce(nullif(r.mc, 0), lk.mc, 0) mc, r.cl, lk.cl lcl, coalesce(nullif(r.se, ''), nullif(lk.se, ''), s.sector, '') se from r left join lk using (code) left join sector_map s on s.code = r.code)
select code, cast(bs as double) as borda_score, mc as model_count, coalesce(nullif(cl, ''), nullif(lcl, ''), case when mc >= 3 then 'strong' when mc >= 2 then 'medium' else 'single' end) as consensus_level, se as sector from f""")
def filled_fields(spark, sf):
    k, c = F.col("c_custkey"), F.col("code")
    rows = fx.table(spark, sf, "customer").select(k.alias("code"), F.when(k % 4 == 0, 1.5).when(k % 4 == 1, 0.0).alias("borda_score"), F.when(k % 5 == 0, 4).when(k % 5 == 1, 0).alias("model_count"), F.when(k % 6 == 0, "kept").when(k % 6 == 1, "").alias("consensus_level"), F.when(k % 7 == 0, "mine").when(k % 7 == 1, "").alias("sector"))
    lookup = fx.model_picks(spark, sf).where("rank <= 150").groupBy("code").agg(F.max("score").alias("borda_score"), F.count("*").alias("model_count"))
    lookup = lookup.withColumns({"consensus_level": F.when(c % 4 == 0, "own").when(c % 4 == 1, ""), "sector": F.when(c % 3 == 0, F.concat(F.lit("l"), c))})
    return opinions.filled_fields(rows, lookup, fx.sector_map(spark, sf).select("code", F.col("sector").alias("industry")))


def _funds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k = F.col("p_partkey")
    quote = fx.table(spark, sf, "part").select(F.concat(F.lit(" "), k.cast("string")).alias("code"), F.col("p_name").alias("name"), ((k * 37) % 900 / 100 - 4).alias("change"), F.when(k % 23 != 0, (k * 7919) % 1300 * 1e6).alias("amount"))
    gainers = quote.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("change"), F.trim("code").cast("long"))).cast("long")).where("pos <= 20")
    listed = quote.withColumn("pos", F.row_number().over(Window.orderBy(F.desc_nulls_last("amount"), F.trim("code").cast("long"))).cast("long")).where("pos <= 50")
    funds = fx.table(spark, sf, "part").where("p_partkey % 3 > 0").select(k.cast("string").alias("code"), F.concat("p_brand", F.lit("/"), (k % 4).cast("string")).alias("sector"))
    return gainers, listed, funds


@query("f19_fund_signals", f"""with qt as (select p_partkey k, p_name as name, p_brand || '/' || p_partkey % 4 sector, p_partkey % 3 > 0 mapped, p_partkey * 37 % 900 / 100.0::double - 4 chg, case when p_partkey % 23 <> 0 then p_partkey * 7919 % 1300 * 1e6 end amt from part),
g0 as (select *, row_number() over (order by chg desc, k) pos from qt qualify pos <= 20), l0 as (select *, row_number() over (order by amt desc nulls last, k) pos, coalesce(amt, 0) / 1e8 u from qt qualify pos <= 50),
g as (select sector, arg_max(k, chg * 1e6 - pos) k, min(pos) f from g0 where mapped group by sector), l as (select *, min(pos) filter (where u > 10) over (partition by sector) busy from l0 where mapped),
o as (select sector, any_value(l.k) filter (where g.k is null and pos = busy) k, min(busy) f, count(*) filter (where u > 5 and (g.k is not null or pos > busy)) marks, arg_max(u, pos) filter (where u > 5 and (g.k is not null or pos > busy)) mu from l left join g using (sector) group by sector),
j as (select coalesce(g.sector, o.sector) sector, g.k gk, coalesce(g.k, o.k) k, coalesce(marks, 0) marks, mu, coalesce(g.f, o.f) f from g full join o on o.sector = g.sector where g.k is not null or o.k is not null)
select row_number() over (order by round(chg, 2) desc, gk is null, f) as place, j.sector, cast(j.k as varchar) as fund, name, {fix("round(chg, 2)", 2)} as change, {fix("round(coalesce(mu, coalesce(amt, 0) / 1e8), 2)", 2)} as amount, case when gk is not null then 'gainer' else 'volume' end || repeat('+active', marks) as signal from j join qt on qt.k = j.k""")
def fund_signals(spark, sf):
    a = opinions.active_sectors(*_funds(spark, sf))
    return a.withColumns({"change": fixed("change", 2), "amount": fixed("amount", 2)})


# -- profiles


def _changes(unit: str, lags: tuple[int, ...], means: tuple[int, ...], recent: int) -> tuple[str, str]:
    w = "over (partition by code order by w)"
    inner = [f"lag(c, {k}) {w} l{k}" for k in lags] + [f"avg(c) over (partition by code order by w rows between {m - 1} preceding and current row) m{m}" for m in means]
    inner += ["count(*) over (partition by code) n", "row_number() over (partition by code order by w desc) back", f"avg(v) over (partition by code order by w rows between {recent - 1} preceding and current row) / greatest(avg(v) over (partition by code), 1) vr"]
    longest = max(means)
    outer = [f"{fix(f'round((c - l{k}) / cast(l{k} as double) * 100, 2)', 2)} as {unit}{k}" for k in lags] + [fix(f"m{m}", 2) + f" as {unit}_ma{m}" if m < longest else f"case when n >= {m} then {fix(f'm{m}', 2)} end as {unit}_ma{m}" for m in means]
    return ", ".join(inner), ", ".join([*outer, f"{fix('vr', 2)} as {unit}_volume"])


_MONTH, _WEEK = _changes("m", (1, 3, 6, 12), (6, 12, 24), 3), _changes("w", (4, 8, 13), (5, 10, 20), 4)


@query("e28_profile", f"""{B}, mo as (select code, last_day(d) w, arg_max(c, d) c, sum(v) v from bars group by 1, 2), we as (select code, cast(date_trunc('week', d) as date) + 6 w, arg_max(c, d) c, sum(v) v from bars group by 1, 2),
m1 as (select code, c, {_MONTH[0]} from mo), w1 as (select code, c, {_WEEK[0]} from we), m2 as (select code, {_MONTH[1]} from m1 where back = 1 and n >= 3), w2 as (select code, {_WEEK[1]} from w1 where back = 1 and n >= 5)
select * from m2 full join w2 using (code)""")
def profile(spark, sf):
    b = fx.bars_walk(spark, sf)
    return profiles.period_profile(resample(b, "month"), "m", (1, 3, 6, 12), (6, 12, 24), 3, 3).join(profiles.period_profile(resample(b, "week_sunday"), "w", (4, 8, 13), (5, 10, 20), 4, 5), "code", "full")


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each supplier's security, with gaps."""
    k = F.col("code")
    some = lambda n, v: F.when(k % n != 0, v)
    x = fx.basics(spark, sf).join(fx.sector_map(spark, sf).select("code", "sector"), "code").join(profiles.recent_change(fx.bars_walk(spark, sf)), "code", "left")
    return x.select(
        "code", "name", some(6, F.col("sector")).alias("sector"), "pe", some(5, k % 9).alias("pb"), F.col("mktcap").alias("cap"), some(4, k * 3).alias("price"), some(9, rounded("change", 3)).alias("change"), "days", F.when(k % 3 == 0, F.when(k % 2 == 0, "up").otherwise("")).alias("forecast"), F.lit("10-20").alias("forecast_range"),
        some(2, k % 7 - 3).alias("holder_change"), some(3, k % 100).alias("rps"), some(4, k % 30).alias("goodwill_ratio"), some(3, k % 50 + 0.25).alias("pledge_ratio"), (k % 4).alias("trades"), some(2, k % 3).alias("discount"), some(5, k % 11 - 5).alias("margin_change"), (k % 90).alias("score"), F.lit("HOLD").alias("signal"),
        (k % 13 - 6).alias("bias"), some(2, k % 77).alias("avg_cost"), some(3, k % 8 / 8).alias("profit_ratio"), some(4, k % 16 / 16).alias("concentration"), some(5, k * 2 - 90).alias("inflow"), (k % 8 == 0).alias("virtual"),
    )


@query("i7_slim_profile", f"""{B}, {fx.BASICS}, {fx.SECTORS}, bk as (select code, c, first_value(c) over (partition by code order by d rows between 20 preceding and current row) b, row_number() over (partition by code order by d desc) r, count(*) over (partition by code) n from bars),
ch as (select code, round((c - b) / greatest(cast(b as double), 0.01) * 100, 3) chg, least(20, n - 1) dys from bk where r = 1 and n >= 2), z as (select basics.*, sector, chg, dys, code % 7 - 3 h, code % 11 - 5 m from basics join sector_map using (code) left join ch using (code)),
parts as (select *, concat_ws(' ', case when code % 4 <> 0 then '商誉率=' || code % 30 || '%' end, case when code % 3 <> 0 then '质押率=' || printf('%.1f', round_even(code % 50 + 0.25, 1)) || '%' end) gp,
  concat_ws(' ', case when code % 2 <> 0 then '均成本=' || code % 77 end, case when code % 3 <> 0 then '获利比=' || printf('%.0f', round_even(code % 8 / 8.0::double * 100, 0)) || '%' end, case when code % 4 <> 0 then '集中度=' || printf('%.3f', round_even(code % 16 / 16.0::double, 3)) end, case when code % 5 <> 0 then '5日主力净流入=' || (code * 2 - 90) || '万' end) cp from z)
select code, concat_ws(' | ', code || ' ' || name, '板块:' || case when code % 6 <> 0 then sector else '未知' end, 'PE=' || coalesce(cast(pe as varchar), 'N/A') || ' PB=' || case when code % 5 <> 0 then cast(code % 9 as varchar) else 'N/A' end || ' 市值=' || mktcap || ' 现价=' || case when code % 4 <> 0 then cast(code * 3 as varchar) else 'N/A' end || ' 近20日=' || case when code % 9 <> 0 and chg is not null then printf('%+.1f', round_even(chg, 1)) || '%(' || dys || '日)' else 'N/A' end,
  case when code % 6 = 0 then '业绩预告:up10-20' end, case when code % 2 <> 0 then '股东户数:' || case when h < 0 then '减少' else '增加' end || printf('%.1f', abs(h)::double) || '%' end, case when code % 3 <> 0 then '板块RPS=' || code % 100 end, nullif(gp, ''),
  case when code % 4 > 0 then '大宗交易:' || code % 4 || '笔' || case when code % 2 <> 0 and code % 3 <> 0 then '折价' || code % 3 || '%' else '' end end, case when code % 5 <> 0 then '融资余额5日:' || case when m > 0 then '增' else '减' end || printf('%.1f', abs(m)::double) || '%' end, '筹码: ' || nullif(cp, ''),
  case when code % 90 > 0 then '量化评分=' || code % 90 || '分(HOLD) 乖离率(MA5)=' || printf('%+.1f', (code % 13 - 6)::double) || '%' end) || case when code % 8 = 0 then ' [盘中实时]' else '' end as profile from parts""")
def slim_profile(spark, sf):
    return profiles.slim_profile(_facts(spark, sf))


@query("z9_profile_fields", f"""{B}, {fx.BASICS}, bk as (select code, c, first_value(c) over (partition by code order by d rows between 20 preceding and current row) b, row_number() over (partition by code order by d desc) r, count(*) over (partition by code) n from bars),
ch as (select code, round((c - b) / greatest(cast(b as double), 0.01) * 100, 3) chg from bk where r = 1 and n >= 2)
select code, case when code % 9 <> 0 and chg is not null then '20日' || printf('%+.1f', round_even(chg, 1)) || '%' else '' end as position, coalesce(cast(pe as varchar), '') as pe from basics left join ch using (code)""")
def profile_fields(spark, sf):
    p = profiles.slim_profile(_facts(spark, sf))
    change = profiles.profile_field("profile", "近20日", r"[+\-]?[\d.]+%")
    return p.select("code", F.when(change != "", F.concat(F.lit("20日"), change)).otherwise("").alias("position"), profiles.profile_field("profile", "PE", r"[\d.]+").alias("pe"))


@query("h18_report_order", """with r as (select o_orderkey pos, o_orderkey % 3 = 0 b, case when o_orderkey % 5 <> 0 then o_orderkey % 4 = 0 end w, case o_orderkey % 7 when 0 then 'x1p' when 1 then 'p1' end bd, case when o_orderkey % 6 = 0 then '量价齐升!' else '' end wd from orders),
p as (select pos, case when b and coalesce(w, false) then 0 when coalesce(contains(bd, '1p'), false) then 1 when contains(wd, '量价齐升') then 2 when b then 3 else 4 end as priority from r) select pos, priority, row_number() over (order by priority, pos) as place from p""")
def report_order(spark, sf):
    k = F.col("o_orderkey")
    rows = fx.table(spark, sf, "orders").select(k.alias("pos"), (k % 3 == 0).alias("chan_buy"), F.when(k % 5 != 0, k % 4 == 0).alias("wave_bull"), F.when(k % 7 == 0, "x1p").when(k % 7 == 1, "p1").alias("chan_buy_detail"), F.when(k % 6 == 0, "量价齐升!").otherwise("").alias("wave_bull_detail"))
    return opinions.report_order(rows).select("pos", "priority", "place")


@query("h20_panel_members", """with p as (select n_name provider, min(n_nationkey) pos from nation group by 1) select row_number() over (order by case provider when 'NATION_7' then 0 when 'NATION_2' then 1 when 'NATION_11' then 3 else 4 end, pos) as place, provider from p qualify place <= 6""")
def panel_members(spark, sf):
    providers = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("provider"))
    return opinions.panel_members(providers, ("NATION_7", "NATION_2", "none", "NATION_11"), 6)
