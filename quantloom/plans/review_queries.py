"""Queries of the review of fused picks; their SQL states the rules on its own, without the plans' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import text as tx
from quantloom.functions.expr import fixed
from quantloom.operators import fusion, review
from quantloom.operators.indicators import last_bars
from quantloom.plans.fusion_queries import BORDA, RET, WTS, P, _returns, _weights
from quantloom.plans.indicator_queries import B, fix
from quantloom.sources import feeds
from quantloom.sources import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _fused(spark: SparkSession, sf: str, most: int = 60) -> DataFrame:
    p = fx.model_picks(spark, sf)
    return fusion.borda(p, _weights(p), most)


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    l1 = fx.basics(spark, sf).select("code", (F.col("code") % 2 == 0).alias("dual"))
    return review.cross_validated(_fused(spark, sf).drop("place"), l1)


CV = """cv as (select bo.code, bo.place pos, borda_mean + case when s_suppkey is null then 0.0 when s_suppkey % 2 = 0 then 15.0 else 8.0 end final_score, s_suppkey is not null in_l1 from bo left join supplier on s_suppkey = bo.code where bo.place <= 60)"""


@query("c3_unmatched_warnings", f"{P}, {WTS}, {BORDA}, {CV} select code, in_l1, {fix('final_score', 2)} as final_score, case when in_l1 then 0 else 1 end as warnings, row_number() over (order by final_score desc, code) as place from cv")
def c3(spark, sf):
    x = _validated(spark, sf)
    return x.select("code", "in_l1", fixed("final_score", 2).alias("final_score"), F.size("warnings").cast("long").alias("warnings"), "place")


REAL = f"""{B}, {fx.BASICS}, closes as (select code, c / 100.0::double price, (c - lag(c, 20) over w) / cast(lag(c, 20) over w as double) * 100 ret20, (c - lag(c, 60) over w) / cast(lag(c, 60) over w as double) * 100 ret60, row_number() over (partition by code order by d desc) n from bars window w as (partition by code order by d)),
known as (select b.code, cast(pe as double) pe, cast(mktcap as double) cap, price, ret20, ret60 from basics b left join closes c on c.code = b.code and n = 1),
said as (select *, code % 60 + 1 s_pe, mktcap + code % 1000 s_cap, code % 7 - 3 s_20, code % 11 - 5 s_60, 150 + code % 100 s_price from known join (select s_suppkey k, 20 + (s_suppkey*37) % 2000 mktcap from supplier) on k = code)"""
DOUBTS = "concat_ws(',', case when abs(s_pe - pe) > 0.3 * pe then 'pe' end, case when abs(s_cap - cap) > 0.3 * cap then 'cap' end, case when ret20 <> 0 and abs(s_20 - ret20) / abs(ret20) > 0.5 then 'ret20' end, case when ret60 <> 0 and abs(s_60 - ret60) / abs(ret60) > 0.5 then 'ret60' end, case when abs(s_price - price) / price > 0.15 then 'price' end)"


def _real(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("code").orderBy("d")
    gain = lambda n: (F.col("c") - F.lag("c", n).over(w)) / F.lag("c", n).over(w) * 100
    last = last_bars(fx.bars_walk(spark, sf).withColumns({"ret20": gain(20), "ret60": gain(60)})).select("code", (F.col("c") / 100).alias("price"), "ret20", "ret60")
    return fx.basics(spark, sf).select("code", "pe", F.col("mktcap").alias("cap")).join(last, "code", "left")


def _reasoned(spark: SparkSession, sf: str) -> DataFrame:
    """A text for each code that states five numbers, after one that can't be meant and a target price."""
    k = F.col("code")
    say = F.format_string("PE0, PE约%d倍，市值约%d亿；近20日涨幅约%+d%%，60天上涨%+d%%。目标价999元，股价：%d元", k % 60 + 1, F.col("mktcap") + k % 1000, k % 7 - 3, k % 11 - 5, 150 + k % 100)
    return fx.basics(spark, sf).select("code", say.alias("text"))


@query("i4_claim_verification", f"{REAL} select code, {DOUBTS} as doubts from said")
def i4(spark, sf):
    x = review.verified(_reasoned(spark, sf), _real(spark, sf))
    return x.select("code", F.array_join(F.transform("doubts", lambda d: d["kind"]), ",").alias("doubts"))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    v = _validated(spark, sf).withColumn("position", 5.0 + F.col("code") % 4).withColumnRenamed("place", "pos")
    s = fx.sector_map(spark, sf).select("code", F.when(F.col("code") % 5 != 0, F.col("sector")).alias("sector"))
    return review.risk_checked(v.join(s, "code", "left"), "leaning up")


CHECKED = f"""{P}, {WTS}, {BORDA}, {CV}, {fx.SECTORS}, placed as (select cv.code, row_number() over (order by final_score desc, cv.code) pos, final_score, 5.0 + cv.code % 4 as position, case when sector is null or cv.code % 5 = 0 then 'unknown' else sector end sector from cv left join sector_map m on m.code = cv.code),
marked as (select *, row_number() over (partition by sector order by final_score desc, pos) > 2 dropped from placed),
sums as (select cast(coalesce(sum(position), 0) as double) total from marked where not dropped), checked as (select marked.*, total, case when dropped then null when total > 60 then position * 60.0 / total else position end scaled from marked, sums)"""


@query("f15_f16_risk_check", f"{CHECKED} select code, sector, dropped, {fix('scaled')} as scaled, case when dropped then 1 when total > 60 then 1 else 0 end as flags from checked")
def f15(spark, sf):
    x = _checked(spark, sf)
    return x.select("code", "sector", (F.col("state") == "sector").alias("dropped"), fixed("scaled").alias("scaled"), F.size("flags").cast("long").alias("flags"))


@query("d20_portfolio_check", f"""{CHECKED.replace("with recursive", B + ",", 1)}, tail as (select code, h, l, c, row_number() over (partition by code order by d desc) n from bars), vol as (select code, avg(h - l) / max(c) filter (where n = 1) * 100 v from tail where n <= 20 group by code having count(*) = 20),
s as (select count(*) n, least(max(total), 60.0) used, count(distinct sector) sectors, coalesce(avg(v), 0) volatility from checked left join vol using (code) where not dropped)
select n, {fix('used', 1)} as used, sectors, {fix('volatility', 2)} as volatility, {fix('sectors / cast(greatest(n, 1) as double)', 2)} as diversity, concat_ws(',', case when volatility > 6 then 'volatility' end, case when n >= 4 and sectors < n / 2.0 then 'diversity' end) as warnings from s""")
def d20(spark, sf):
    s = review.portfolio_summary(_checked(spark, sf), fx.bars_walk(spark, sf))
    return s.select("n", fixed("used", 1).alias("used"), "sectors", fixed("volatility", 2).alias("volatility"), fixed("diversity", 2).alias("diversity"), "warnings")


@query("f17_timing_cut", f"{CHECKED} select code, case when dropped then 'sector' when row_number() over (partition by dropped order by final_score desc, pos) > 10 then 'timing' else 'approved' end as state from checked")
def f17(spark, sf):
    return review.timing_cut(_checked(spark, sf), 10, "leaning up").select("code", "state")


@query("p1_review_chain", f"""{CHECKED.replace("with recursive", REAL + ",", 1)}, d as (select code, {DOUBTS} doubts from said) select c.code, case when dropped then 'sector' when row_number() over (partition by dropped order by final_score desc, pos) > 10 then 'timing' else 'approved' end as state, {fix('scaled')} as scaled, coalesce(doubts, '') as doubts from checked c left join d using (code)""")
def chain(spark, sf):
    """Cross-validation, claims, risk check and timing cut, one after the other."""
    doubts = review.verified(_reasoned(spark, sf), _real(spark, sf)).select("code", F.array_join(F.transform("doubts", lambda d: d["kind"]), ",").alias("doubts"))
    x = review.timing_cut(_checked(spark, sf), 10, "leaning up").join(doubts, "code", "left")
    return x.select("code", "state", fixed("scaled").alias("scaled"), F.coalesce("doubts", F.lit("")).alias("doubts"))


@query("z1_arbitration_rows", f"{P}, {WTS}, {BORDA} select code, {fix('borda_mean', 2)} as final_score, ballots as experts, case when ballots >= 3 then 'strong' when ballots = 2 then 'medium' else 'single' end as consensus, true as pass_l1, 0 as bonus from bo where place <= 30")
def z1(spark, sf):
    return review.arbitration_rows(_fused(spark, sf, 30)).select("code", fixed("final_score", 2).alias("final_score"), "experts", "consensus", "pass_l1", "bonus")


def _logs(spark: SparkSession, sf: str) -> DataFrame:
    """A debate log for each supplier; every third is no JSON."""
    k = F.col("s_suppkey")
    log = F.format_string('{"bear_warnings":[{"code":"%d","verdict":"%s","risk_points":["r%d-1","r%d-2","r%d-3"]}],"bull_picks":[{"code":"%d","buy_reasons":["a%d","b","c"]}],"picks":[{"code":"%d","score":%d,"recommended_by_experts":["E1","E%d"]},{"code":""}]}', k % 50, F.when(k % 2 == 0, "降级").otherwise("保留"), k, k, k, k % 40, k % 40, k % 20, k, k % 7)
    s = fx.table(spark, sf, "supplier")
    return s.select(F.concat(F.lit("m"), (k % 4).cast("string")).alias("model"), k.alias("pos"), F.when(k % 3 == 0, "no json {").otherwise(log).alias("debate_log"))


@query("z3_debate_merge", """with w as (select s_suppkey % 50 code, string_agg('r' || s_suppkey || '-1|r' || s_suppkey || '-2', '|' order by s_suppkey) more from supplier where s_suppkey % 3 <> 0 and s_suppkey % 2 = 0 group by 1), b as (select distinct s_suppkey % 40 code from supplier where s_suppkey % 3 <> 0)
select s_suppkey as code, concat_ws('|', 'w', more) as warnings, case when b.code is null then '' else 'a' || b.code || ' | b' end as reason, case when b.code is not null and b.code % 2 = 0 then 2 else 1 end as reasonings from supplier left join w on w.code = s_suppkey left join b on b.code = s_suppkey""")
def z3(spark, sf):
    k = F.col("s_suppkey")
    own = F.when(k % 2 == 0, F.array(F.lit("own"))).otherwise(F.array(F.concat(F.lit("a"), k.cast("string"), F.lit(" | b"))))
    picks = fx.table(spark, sf, "supplier").select(k.alias("code"), F.array(F.lit("w")).alias("warnings"), own.alias("reasonings"))
    x = review.debate_merged(picks, _logs(spark, sf))
    return x.select("code", F.array_join("warnings", "|").alias("warnings"), F.col("expert_reasoning").alias("reason"), F.size("reasonings").cast("long").alias("reasonings"))


@query("z4_debate_index", "select cast(s_suppkey % 20 as varchar) as code, 'm' || s_suppkey % 4 as model, cast(s_suppkey as double) as score, 'E1,E' || s_suppkey % 7 as experts from supplier where s_suppkey % 3 <> 0")
def z4(spark, sf):
    return review.debate_index(_logs(spark, sf)).select("code", "model", "score", F.array_join("experts", ",").alias("experts"))


@query("d7_recommended_by", f"""{RET}, {fx.PICKS}, m as (select distinct model, code from model_picks) select model, count(*) as n, count(*) filter (where ret > 0) as winners, {fix("avg(ret)")} as mean from ret join m using (code) where horizon = 5 and ret is not null group by model""")
def d7(spark, sf):
    """Each recommendation counts for every model in its recommended_by."""
    by = fx.model_picks(spark, sf).groupBy("code").agg(F.collect_set("model").alias("recommended_by"))
    x = _returns(spark, sf).where("horizon = 5 and ret is not null").join(by, "code").withColumn("model", F.explode("recommended_by"))
    return x.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("ret") > 0).alias("winners"), fixed(F.avg("ret")).alias("mean"))


@query("f18_diversity_refill", f"""with {fx.SECTORS}, r as (select code as item, category, row_number() over (order by code * 7919 % 10007, code) pos from sector_map), top as (select * from r where pos <= 12), k as (select item, category, pos, row_number() over (partition by category order by pos) n from r)
select item, category, row_number() over (order by pos) as place from (select *, row_number() over (order by pos) p from k where n <= 2) where pos <= 12 or p <= 12""")
def f18(spark, sf):
    r = fx.sector_map(spark, sf).select(F.col("code").alias("item"), "category").withColumn("pos", F.row_number().over(Window.orderBy(F.col("item") * 7919 % 10007, "item")))
    return review.refilled(r.where("pos <= 12"), r, "category", 2).select("item", "category", "place")


@query("a14_strip_prefix", "select s_suppkey as k, lpad(cast(s_suppkey * 9973 % 1000000 as varchar), 6, '0') as code from supplier")
def a14(spark, sf):
    s = fx.table(spark, sf, "supplier")
    symbol = tx.market_prefix(F.lpad((F.col("s_suppkey") * 9973 % 1000000).cast("string"), 6, "0"))
    return s.select(F.col("s_suppkey").alias("k"), tx.without_prefix(symbol).alias("code"))


@query("a20_retention", "select event_id, cast(ts as date) as day from events where cast(ts as date) >= date '2024-01-30' - 7")
def a20(spark, sf):
    """Dated partitions older than seven days are dropped from the store; what is read back is what is left."""
    path = feeds.shared_path(spark, "retention")
    e = fx.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    feeds.write_snapshot(e, path, by="day")
    feeds.drop_partitions(spark, path, "day", "2024-01-23")
    return spark.read.schema("event_id long, day date").parquet(path)
