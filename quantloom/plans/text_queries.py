"""Queries of feeds, text functions, patterns and the streaming extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions import text as tx
from quantloom.functions.expr import fixed, printed, trailing
from quantloom.operators import events, patterns, sequences
from quantloom.operators.asof import last_bars_before
from quantloom.operators.indicators import last_bars
from quantloom.plans.indicator_queries import B, fix, rows
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


@query("a8_normalize_bars", "select l_suppkey as code, cast(l_shipdate as date) as d, l_quantity as o, l_extendedprice as c from lineitem where l_discount > 0.05")
def a8(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    raw = li.select(F.col("l_suppkey").alias("code"), F.date_format("l_shipdate", "yyyyMMdd").alias("Trade_Date"), F.col("l_quantity").cast("string").alias("open"), F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice").cast("string")).otherwise("n/a").alias("Close"))
    return feeds.normalize_bars(raw).select("code", "d", "o", "c")


@query("a9_a10_delimited_quotes", "select cast(o_orderkey as varchar) as code, o_totalprice as price, o_orderpriority as name from orders where o_orderstatus <> 'P'")
def a9(spark, sf):
    o = fx.table(spark, sf, "orders")
    line = F.concat_ws("~", F.col("o_orderkey").cast("string"), "o_orderpriority", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("string")))
    q = feeds.split_quotes(o.select(line.alias("value")), "~", 3, {"code": 0, "name": 1, "price": 2})
    return q.select("code", F.col("price").try_cast("double").alias("price"), "name")


@query("a11_quoted_records", "select cast(s_suppkey as varchar) as code, case when s_suppkey % 11 <> 0 then 5.0::double + s_suppkey % 70 end as pe from supplier")
def a11(spark, sf):
    b = fx.basics(spark, sf)
    line = F.concat(F.lit("v_"), F.col("code").cast("string"), F.lit('="'), F.concat_ws("~", "name", F.coalesce(F.col("pe").cast("string"), F.lit("-"))), F.lit('";'))
    r = feeds.quoted_records(b.select(line.alias("value")))
    return r.select(F.col("name").alias("code"), feeds.blank_to_null(F.element_at(F.split("body", "~"), 2)).try_cast("double").alias("pe"))


@query("a12_array_bars", f"with {fx.TICKS} select code, d, o / 100.0::double as o, h / 100.0::double as h, c / 100.0::double as c from bars_tick")
def a12(spark, sf):
    t = fx.bars_tick(spark, sf)
    row = F.array(*[F.col("d").cast("string"), *((F.col(k) / 100).cast("string") for k in ("o", "c", "h", "l", "v"))])
    j = t.groupBy("code").agg(F.to_json(F.collect_list(row)).alias("value"))
    parsed = j.select("code", F.explode(F.from_json("value", "array<array<string>>")).alias("a"))
    at = lambda k: F.get("a", F.lit(k)).try_cast("double")
    return parsed.select("code", F.get("a", F.lit(0)).try_cast("date").alias("d"), at(1).alias("o"), at(3).alias("h"), at(2).alias("c"))


@query("a14_a15_market_prefix", "select s_suppkey as k, case when substr(c, 1, 1) in ('6', '5') then 'sh' when substr(c, 1, 1) in ('4', '8') then 'bj' else 'sz' end || c as code from (select s_suppkey, lpad(cast(s_suppkey * 9973 % 1000000 as varchar), 6, '0') c from supplier)")
def a15(spark, sf):
    s = fx.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), tx.market_prefix(F.lpad((F.col("s_suppkey") * 9973 % 1000000).cast("string"), 6, "0")).alias("code"))


@query("a16_a18_snapshot_round_trip", "select n_nationkey, n_name, n_regionkey from nation")
def a16(spark, sf):
    """A dated snapshot written to the shared folder and read back; Spark's committer makes it all or nothing."""
    path = feeds.shared_path(spark, "snapshot")
    n = fx.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    feeds.write_snapshot(n, path, kind="json")
    return spark.read.schema(n.schema).json(path)


@query("a17_age_bounded_read", "select event_id from events where ts >= timestamp '2024-01-30 00:00:00' - interval 24 hours")
def a17(spark, sf):
    return feeds.fresh(fx.table(spark, sf, "events"), F.lit("2024-01-30 00:00:00").cast("timestamp"), 24, "ts").select("event_id")


@query("a19_event_pairs", "select event_id, epoch(ts) - epoch(lag(ts) over (partition by user_id, event_type order by ts)) as elapsed from events".replace("epoch(ts) - epoch(lag(ts) over (partition by user_id, event_type order by ts))", "cast(floor(epoch(ts)) as bigint) - cast(floor(epoch(lag(ts) over (partition by user_id, event_type order by ts))) as bigint)"))
def a19(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts")
    sec = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000000)
    return fx.table(spark, sf, "events").select("event_id", (sec(F.col("ts")) - sec(F.lag("ts").over(w))).cast("long").alias("elapsed"))


@query("a22_health_order", "select n_nationkey, row_number() over (order by case n_name when 'NATION_3' then 0 when 'NATION_1' then 1 else 99 end, n_name) as place from nation")
def a22(spark, sf):
    prio = F.coalesce(F.create_map(F.lit("NATION_3"), F.lit(0), F.lit("NATION_1"), F.lit(1))[F.col("n_name")], F.lit(99))
    return fx.table(spark, sf, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(prio, "n_name")).cast("long").alias("place"))


@query("a23_export", f"{B}, t as (select code, d, c, row_number() over (partition by code order by d desc) n, count(*) over (partition by code) k from bars) select code, count(*) as n, cast(sum(c) as bigint) as total from t where n <= 300 and k >= 50 group by code")
def a23(spark, sf):
    x = feeds.last_n_per_code(fx.bars_walk(spark, sf), 300, 50)
    return x.select("code", F.size("bars").cast("long").alias("n"), F.aggregate("bars", F.lit(0).cast("long"), lambda s, b: s + b["c"]).alias("total"))


@query("i1_json_cascade", """select conv_id, turn, case when role = 'user' then '{"k":' || turn || '}' end as j from conversations""")
def i1(spark, sf):
    c = fx.table(spark, sf, "conversations")
    body = F.concat(F.lit('{"k":'), F.col("turn").cast("string"), F.lit("}"))
    kind = F.col("conv_id") % 4
    answer = F.when(F.col("role") != "user", "no {json here").when(kind == 0, F.concat(F.lit("so:\n```json\n"), body, F.lit("\n```\nend"))).when(kind == 1, body).when(kind == 2, F.concat(F.lit("well "), body, F.lit(" ok"))).otherwise(F.concat(F.lit("```\n"), body, F.lit("\n```")))
    return c.select("conv_id", "turn", tx.json_text(answer).alias("j"))


@query("i2_typed_picks", """select conv_id, turn, conv_id % 30 as rank, case when turn % 2 = 0 then 70.0 else turn * 1.0 end::double as score from conversations""")
def i2(spark, sf):
    c = fx.table(spark, sf, "conversations")
    j = F.concat(F.lit('{"picks":[{"rank":"'), (F.col("conv_id") % 30).cast("string"), F.lit('","score":"'), F.when(F.col("turn") % 2 == 0, "high").otherwise(F.col("turn").cast("string")), F.lit('"}]}'))
    p = c.select("conv_id", "turn", F.explode(F.from_json(j, "picks array<struct<rank:string,score:string>>").picks).alias("p"))
    return p.select("conv_id", "turn", F.coalesce(F.col("p.rank").try_cast("long"), F.lit(99)).alias("rank"), F.coalesce(F.col("p.score").try_cast("double"), F.lit(70.0)).alias("score"))


@query("i3_compaction", "select doc_id, case when length(text) <= 600 then length(text) when length(text) > 1200 then 800 + 9 else length(text) end as n from documents")
def i3(spark, sf):
    """All texts; the SQL knows none with JSON in it, as the tables have none: that case is in the tests."""
    return fx.table(spark, sf, "documents").select("doc_id", F.length(tx.compacted(F.col("text"))).cast("long").alias("n"))


@query("i4_claim_check", f"with {fx.BASICS} select code, coalesce(pe <> 0 and abs(code % 60 - pe) / cast(pe as double) > 0.3, false) as doubtful from basics")
def i4(spark, sf):
    b = fx.basics(spark, sf)
    said = F.concat(F.lit("cheap, PE= "), (F.col("code") % 60).cast("string"), F.lit(" and rising"))
    return b.select("code", tx.deviates(tx.first_number(said, "PE|pe"), F.col("pe"), 0.3).alias("doubtful"))


@query("i5_i6_parsers", "select s_suppkey as code, case when s_suppkey % 3 = 0 then (s_suppkey % 7 + s_suppkey % 7 + 2) / 2.0 when s_suppkey % 3 = 1 then s_suppkey % 7 else 5 end::double as position, case when s_suppkey % 3 = 0 then s_suppkey * 1000.0 when s_suppkey % 3 = 1 then s_suppkey / 10000.0 else (s_suppkey * 1e7) / 1e8 end::double as cap from supplier where s_suppkey > 0")
def i5(spark, sf):
    s = fx.table(spark, sf, "supplier").where("s_suppkey > 0")
    k = F.col("s_suppkey")
    t = (k % 7).cast("string")
    p = F.when(k % 3 == 0, F.concat(t, F.lit("-"), (k % 7 + 2).cast("string"), F.lit("%"))).when(k % 3 == 1, F.concat(t, F.lit("%"))).otherwise("some")
    c = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(",000亿"))).when(k % 3 == 1, F.concat(k.cast("string"), F.lit("万"))).otherwise((k * 10000000).cast("string"))
    return s.select(k.alias("code"), tx.position_percent(p).alias("position"), tx.market_cap(c).alias("cap"))


@query("i7_i9_joined_profile", f"with {fx.BASICS} select code, 'name:' || name || coalesce(' | pe:' || pe, '') || ' | cap:' || mktcap as line from basics")
def i7(spark, sf):
    return fx.basics(spark, sf).select("code", tx.joined_known(" | ", name=F.col("name"), pe=F.col("pe"), cap=F.col("mktcap")).alias("line"))


@query("i8_full_profile")
def i8(spark, sf):
    b = fx.basics(spark, sf).join(fx.sector_map(spark, sf), "code")
    return b.select("code", F.concat_ws("\n", F.concat(F.lit("== "), "name"), tx.joined_known(", ", sector=F.col("sector"), category=F.col("category")), tx.joined_known(", ", pe=F.col("pe"), cap=F.col("mktcap"))).alias("profile"))


@query("i10_lessons", "select o_custkey as code, case when avg(o_totalprice) < 100000 then 'lesson' when avg(case when o_orderstatus = 'F' then 100.0 else 0 end) > 70 then 'success' else '' end as note from orders group by 1")
def i10(spark, sf):
    win = F.avg(F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0))
    return fx.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("code")).agg(F.when(F.avg("o_totalprice") < 100000, "lesson").when(win > 70, "success").otherwise("").alias("note"))


@query("i12_date_formats", "select o_orderkey, strftime(o_orderdate, '%Y%m%d') as ymd, dayname(o_orderdate) as day from orders")
def i12(spark, sf):
    return fx.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("ymd"), F.date_format("o_orderdate", "EEEE").alias("day"))


@query("i13_i14_names_and_width", "select n_nationkey, replace(replace(n_name || '(申万)Ⅱ', '(申万)', ''), 'Ⅱ', '') as name, length(n_name) + 2 * 2 as width from nation")
def i13(spark, sf):
    n = fx.table(spark, sf, "nation")
    return n.select("n_nationkey", tx.industry_name(F.concat("n_name", F.lit("(申万)Ⅱ"))).alias("name"), tx.display_width(F.concat("n_name", F.lit("中文"))).cast("long").alias("width"))


@query("i15_z10_array_helpers", "select conv_id, string_agg(role || ':' || turn, ' > ' order by turn) as path, list(turn order by turn)[1] as first from conversations group by conv_id")
def i15(spark, sf):
    a = F.array_sort(F.collect_list(F.struct("turn", "role")))
    g = fx.table(spark, sf, "conversations").groupBy("conv_id").agg(a.alias("a"))
    return g.select("conv_id", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["role"], x["turn"].cast("string"))), " > ").alias("path"), F.element_at("a", 1)["turn"].alias("first"))


@query("i17_trend_line", f"with {fx.TICKS}, p as (select code, c, row_number() over (partition by code order by d) - 1 n from bars_tick), k as (select code, max(c) filter (where n = 2) a, max(c) filter (where n = 9) b from p group by code) select code, {fix('(b - a) / 7.0::double')} as slope, {fix('a - (b - a) / 7.0::double * 2')} as intercept from k")
def i17(spark, sf):
    p = fx.bars_tick(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("d")) - 1)
    at = lambda k: F.max(F.when(F.col("n") == k, F.col("c")))
    g = p.groupBy("code").agg(at(2).alias("a"), at(9).alias("b")).withColumn("slope", (F.col("b") - F.col("a")) / 7)
    return g.select("code", fixed("slope").alias("slope"), fixed(F.col("a") - F.col("slope") * 2).alias("intercept"))


@query("z2_opinions_by_code", f"with {fx.PICKS} select code, count(*) as n, string_agg(model || '#' || rank, ',' order by model, rank) as models from model_picks group by code")
def z2(spark, sf):
    x = fx.model_picks(spark, sf)
    line = F.array_sort(F.collect_list(F.struct("model", "rank")))
    return x.groupBy("code").agg(F.count("*").alias("n"), F.array_join(F.transform(line, lambda s: F.concat_ws("#", s["model"], s["rank"].cast("string"))), ",").alias("models"))


@query("z1_z5_best_opinion", f"with {fx.PICKS} select code, arg_max(model, score * 1000 - rank) as model, max(score) as score from model_picks group by code")
def z5(spark, sf):
    return fx.model_picks(spark, sf).groupBy("code").agg(F.max_by("model", F.struct("score", -F.col("rank"))).alias("model"), F.max("score").alias("score"))


@query("z6_z9_fragments", "select doc_id, trim(regexp_extract(text, 'the [^.;]*')) as f from documents where length(trim(regexp_extract(text, 'the [^.;]*'))) >= 5")
def z6(spark, sf):
    x = fx.table(spark, sf, "documents").select("doc_id", tx.risk_fragment(F.col("text"), ("the ",)).alias("f")).where(F.size("f") > 0)
    return x.select("doc_id", F.element_at("f", 1).alias("f"))


@query("z11_message_statistics", "select conv_id, count(*) as n, cast(sum(length(text)) as bigint) as chars, arg_max(right(text, 200), turn) filter (where role = 'user') as tail from conversations group by conv_id")
def z11(spark, sf):
    tail = F.max_by(F.when(F.col("role") == "user", F.right("text", F.lit(200))), F.when(F.col("role") == "user", F.col("turn")))
    return fx.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), tail.alias("tail"))


@query("z14_refill_missing", f"with {fx.BASICS} select code, coalesce(pe, code % 40) as pe from basics")
def z14(spark, sf):
    b = fx.basics(spark, sf)
    again = b.where("pe is null").select("code", (F.col("code") % 40).alias("again"))
    return b.join(again, "code", "left").select("code", F.coalesce("pe", "again").alias("pe"))


@query("z15_candidate_risk_text", f"""{B}, x as (select code, c, first_value(c) over (partition by code order by d rows between 59 preceding and current row) c60, avg(c) {rows(5)} ma5, row_number() over (partition by code order by d desc) n from bars)
select code, printf('60-bar %+.1f%%, bias %+.2f%%', (c - c60) / cast(c60 as double) * 100, (c - ma5) / ma5 * 100) as line from x where n = 1""")
def z15(spark, sf):
    b = fx.bars_walk(spark, sf)
    x = b.withColumns({"c60": F.first("c").over(trailing(60)), "ma5": F.avg("c").over(trailing(5))})
    gain, bias = (F.col("c") - F.col("c60")) / F.col("c60") * 100, (F.col("c") - F.col("ma5")) / F.col("ma5") * 100
    return last_bars(x).select("code", F.concat(F.lit("60-bar "), printed(gain, 1), F.lit("%, bias "), printed(bias, 2), F.lit("%")).alias("line"))


@query("i18_report_order", f"with {fx.PICKS} select code, src, row_number() over (order by score desc, code, src) as place from (select code, 'approved' as src, max(score) score from model_picks where rank <= 20 group by code union all select code, 'soft', max(score) from model_picks where rank between 21 and 40 group by code)")
def i18(spark, sf):
    p = fx.model_picks(spark, sf)
    part = lambda c, n: p.where(c).groupBy("code").agg(F.max("score").alias("score")).withColumn("src", F.lit(n))
    both = part("rank <= 20", "approved").unionByName(part("rank between 21 and 40", "soft"))
    return both.select("code", "src", F.row_number().over(Window.orderBy(F.desc("score"), "code", "src")).cast("long").alias("place"))


@query("z16_formats", "select event_id, repeat('*', cast(greatest(0, least(5, round(value / 40))) as int)) as stars, printf('%+.1f%%', cast(event_id % 200 - 100 as double) / 7) as pct from events")
def z16(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", tx.stars(F.col("value") / 40).alias("stars"), tx.signed_percent((F.col("event_id") % 200 - 100) / 7).alias("pct"))


@query("z17_code_universe", """with u as (select lpad(cast(i as varchar), 6, '0') code from (select unnest(range(1, 1000)) i union all select unnest(range(600000, 600500)))) select u.code, s_suppkey is not null as listed from u left join supplier on lpad(cast(s_suppkey as varchar), 6, '0') = u.code""")
def z17(spark, sf):
    """The codes of fixed ranges, and which of them are listed."""
    listed = fx.table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.lit(True).alias("listed"))
    return feeds.code_universe(spark, ((1, 999), (600000, 600499))).join(listed, "code", "left").select("code", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("g1_g11_chart_patterns")
def g1(spark, sf):
    return patterns.chart_patterns(fx.bars_walk(spark, sf))


def _pivot(column: str, edge: str, sign: str, k: int) -> str:
    span = "over (partition by code, timeframe order by d rows between {} and {})"
    before, after = span.format(f"{k} preceding", "1 preceding"), span.format("1 following", f"{k} following")
    return f"(pos >= {k} and pos < n - {k} and {column} {sign} {edge}({column}) {before} and {column} {sign} {edge}({column}) {after})"


def _dif(bar: str) -> str:
    return f"""(select m.a - m.b from (select list_reduce(list_transform(cs[1:{bar} + 1], lambda x: {{'a': x, 'b': x}}), lambda s, y: {{'a': s.a + (y.a - s.a) * (2 / 13::double), 'b': s.b + (y.b - s.b) * (2 / 27::double)}}) m))"""


SEQUENCES = f"""{B}, days as (select code, d, h, l, c, v, count(*) over (partition by code) k from bars qualify row_number() over (partition by code order by d desc) <= 500),
cut as (select *, count(*) over (partition by code) kk from days),
fr as (select code, 'daily' timeframe, d, cast(h as double) h, cast(l as double) l, cast(c as double) c, cast(v as double) v from cut
  union all select code, 'weekly', cast(d + cast((12 - isodow(d)) % 7 as int) as date) w, max(h), min(l), arg_max(c, d), sum(v) from cut where kk >= 100 group by code, w),
p0 as (select *, row_number() over (partition by code, timeframe order by d) - 1 pos, count(*) over (partition by code, timeframe) n from fr),
p1 as (select *, n - 1 - pos back, coalesce(case when timeframe = 'daily' then {_pivot("h", "max", ">", 5)} else {_pivot("h", "max", ">", 2)} end, false) hi, coalesce(case when timeframe = 'daily' then {_pivot("l", "min", "<", 5)} else {_pivot("l", "min", "<", 2)} end, false) lo from p0),
q as (select code, timeframe, max(n) n, count(*) filter (where hi) + count(*) filter (where lo) pivots, quantile_cont(h, 0.7) qh, quantile_cont(l, 0.3) ql, median(v) vm, max(pos) filter (where hi or lo) lastp,
  arg_min(pos, pos - h * 1e6) filter (where back < 7) top, arg_min(pos, pos + l * 1e6) filter (where back < 7) bot, avg(c) filter (where back < 5) m5, avg(c) filter (where back < 20) m20, avg(c) filter (where back < 50) m50, avg(c) filter (where back < 60) m60,
  max(h) filter (where back < 30) mh, max(h) filter (where back < 90) qhh, min(l) filter (where back < 30) ml, min(l) filter (where back < 90) qll, avg(v) filter (where back < 20) av, list(c order by pos) cs from p1 group by code, timeframe having max(n) >= 30 and pivots >= 3),
pv as (select code, timeframe, pos, 0 side, h p, v from p1 where hi union all select code, timeframe, pos, 1, l, v from p1 where lo),
strong as (select pv.*, row_number() over (partition by code, timeframe order by pos desc, side desc) r from pv join q using (code, timeframe) where p >= qh),
sup as (select code, timeframe, arg_max(pos, pos * 2 + side) pos, arg_max(p, pos * 2 + side) p from pv join q using (code, timeframe) where p <= ql and pv.v > vm group by all),
x as (select q.*, (select max(p) from pv where pv.code = q.code and pv.timeframe = q.timeframe and pv.pos = lastp) pmax, (select min(p) from pv where pv.code = q.code and pv.timeframe = q.timeframe and pv.pos = lastp) pmin,
  (select h from p1 where p1.code = q.code and p1.timeframe = q.timeframe and p1.pos = top) th, (select l from p1 where p1.code = q.code and p1.timeframe = q.timeframe and p1.pos = bot) bl,
  (select min(l) from p1 where p1.code = q.code and p1.timeframe = q.timeframe and p1.pos >= top) sl, (select max(h) from p1 where p1.code = q.code and p1.timeframe = q.timeframe and p1.pos >= bot) sh from q),
mo as (select q.code, q.timeframe, b.p bp, a.p ap, {_dif("b.pos")} bd, {_dif("a.pos")} ad from q join strong a on a.code = q.code and a.timeframe = q.timeframe and a.r = 1 join strong b on b.code = q.code and b.timeframe = q.timeframe and b.r = 2 where q.n >= 60)
select code, timeframe, 'FLAGU' as pattern, lastp as a_bar, top as b_bar from x where n >= 50 and top < n - 1 and th >= mh and th >= case when n >= 90 then qhh else mh end and m20 >= m50 * 1.08 and sl >= (pmax + th) / 2
union all select code, timeframe, 'FLAGD', lastp, bot from x where n >= 50 and bot < n - 1 and bl <= ml and bl <= case when n >= 90 then qll else ml end and m20 <= m50 * 0.92 and sh <= (pmin + bl) / 2
union all select code, timeframe, 'MACD_DIV', null, null from mo where ap >= bp * 0.97 and ad < bd and ad < 0
union all select distinct q.code, q.timeframe, 'BREAK_SUPPORT', null, null from q join sup using (code, timeframe) join p1 on p1.code = q.code and p1.timeframe = q.timeframe where back < 5 and p1.pos > sup.pos and p1.c < sup.p and p1.v > av
union all select code, timeframe, case when m5 > m20 then 'MA_BULL' else 'MA_BEAR' end, null, null from q where n >= 60 and (m5 > m20 and m20 > m60 or m5 < m20 and m20 < m60)"""


@query("g7_g10_sequences", SEQUENCES)
def g7(spark, sf):
    bars = fx.bars_walk(spark, sf)
    found = sequences.sequence_patterns(sequences.frames(last_bars_before(bars, bars.agg(F.max("d").alias("cutoff")), 500)))
    bar = lambda k: F.try_element_at("points", F.lit(k))["bar"]
    return found.select("code", "timeframe", "pattern", bar("A").alias("a_bar"), bar("B").alias("b_bar"))


@query("g12_pattern_scores")
def g12(spark, sf):
    return patterns.pattern_scores(spark, patterns.chart_patterns(fx.bars_walk(spark, sf)))


REPORTS = """ev as (select source kind, doc_id pos, substr(text, 1, 40) title, substr(coalesce(text, ''), 1, 20) t, doc_id % 100 certainty, 'm' || (doc_id % 4) model from documents)"""
#: One title after the other, with the list of clusters so far: the rule as it is told.
ONE_BY_ONE = rf"""{REPORTS}, tt as (select kind, t, p0, row_number() over (partition by kind order by p0) k, list_filter(list_distinct(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')[1:3]), lambda w: length(w) > 1) w from (select kind, t, min(pos) p0 from ev group by all)),
walk as (select kind, k, t, p0, p0 place, [{{'place': p0, 'w': w}}] cs from tt where k = 1
  union all select kind, k, t, p0, coalesce(hit, p0), case when hit is null then list_append(cs, {{'place': p0, 'w': w}}) else cs end from (
    select x.kind, x.k, x.t, x.p0, x.w, y.cs, list_filter(y.cs, lambda c: len(list_filter(c.w, lambda v: contains(x.t, v))) > 0)[1].place hit from walk y join tt x on x.kind is not distinct from y.kind and x.k = y.k + 1))"""


def _reports(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    gains = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct(((k + i * 5) % 11).cast("string").alias("code"), ((k * (i + 1)) % 50).cast("double").alias("score"), F.concat(F.lit("l"), k % 9).alias("logic")))
    return fx.table(spark, sf, "documents").select(F.col("source").alias("kind"), k.alias("pos"), F.substring("text", 1, 40).alias("title"), (k % 100).alias("certainty"), F.concat(F.lit("m"), k % 4).alias("model"), gains.alias("beneficiaries"))


@query("h10_event_merge", f"with recursive {ONE_BY_ONE} select kind, t, p0 as first_at, place from walk")
def h10(spark, sf):
    return events.event_clusters(_reports(spark, sf)).select("kind", "t", F.col("at").alias("first_at"), "place")


@query("h10_top_events", rf"""with recursive {ONE_BY_ONE}, x as (select ev.*, place, len(list_filter(string_split_regex(ev.t, '\s+'), lambda w: length(w) > 1)[1:3]) as words, max(pos) over (partition by ev.kind, ev.t) last from ev join walk on walk.kind is not distinct from ev.kind and walk.t = ev.t),
y as (select * from x where len(list_filter(list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')[1:3], lambda w: length(w) > 1)) > 0 or pos = last),
c as (select kind, place, count(*) model_votes, max(certainty) certainty, arg_min(title, (99 - certainty) * 10000000 + pos) event from y group by all), top as (select *, row_number() over (partition by kind order by model_votes desc, certainty desc, place) rank from c qualify rank <= 5),
g as (select kind, place, pos, i, (pos + i * 5) % 11 code, cast((pos * (i + 1)) % 50 as double) score, pos % 9 logic from (select *, unnest(range(0, pos % 3 + 1)) i from y)),
h as (select kind, place, code, count(*) votes, max(score) score, arg_min(logic, (50 - score) * 1e9 + pos * 10 + i) logic, min(pos * 10 + i) seen from g group by all),
r as (select *, row_number() over (partition by kind, place order by votes desc, score desc, seen) n from h qualify n <= 10)
select top.kind, rank, model_votes, certainty, event, (select string_agg(code || ':' || votes || ':' || cast(score as bigint) || ':l' || logic, ',' order by n) from r where r.kind is not distinct from top.kind and r.place = top.place) as beneficiaries from top""")
def h10_merged(spark, sf):
    e = events.merged_events(_reports(spark, sf))
    line = F.array_join(F.transform("beneficiaries", lambda b: F.concat_ws(":", b["code"], b["votes"].cast("string"), b["score"].cast("long").cast("string"), b["logic"])), ",")
    return e.select("kind", "rank", "model_votes", "certainty", "event", line.alias("beneficiaries"))


@query("j1_streaming_bars", f"with {fx.TICKS} select code, d, o, h, l, c, v from bars_tick")
def j1(spark, sf):
    """The streaming extension over the events file: a run to the end of what is there."""
    from quantloom.streaming.bars import run_available

    t = run_available(spark, sf, "events.parquet", feeds.shared_path(spark, "stream"))
    return t.select("code", F.to_date("start").alias("d"), "o", "h", "l", "c", "v")


@query("j4_incremental_dates", f"{B}, {fx.AS_OF} select as_of from as_of where as_of not in (select as_of from as_of order by as_of limit 7)")
def j4(spark, sf):
    a = fx.as_of(spark, sf)
    return a.join(a.orderBy("as_of").limit(7), "as_of", "left_anti")
