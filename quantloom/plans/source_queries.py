"""Queries of names, feeds and stored results: staged lookups, positional quotes with rejects, cascades of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import adjust, cascade, naming, performance
from quantloom.operators.aggregates import resample
from quantloom.plans.fusion_queries import RET, recommended
from quantloom.plans.indicator_queries import B, fix
from quantloom.sources import feeds, quotes, results
from quantloom.sources import fixtures as fx

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# -- names


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Sector names as a feed writes them: equal to a key, with or without its suffix, longer, shorter, or none."""
    k, nation = F.col("c_custkey"), lambda n: F.concat(F.lit("NATION_"), (F.col("c_custkey") % n).cast("string"))
    name = F.when(k % 6 == 0, nation(25)).when(k % 6 == 1, F.concat(nation(30), F.lit("II"))).when(k % 6 == 2, F.concat(nation(40), F.lit(" mining"))).when(k % 6 == 3, F.substring(nation(60), 3, 20)).when(k % 6 == 4, F.col("c_mktsegment"))
    return fx.table(spark, sf, "customer").select(k.alias("code"), name.alias("name"))


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return fx.table(spark, sf, "nation").select(F.concat("n_name", F.when(k % 3 == 0, "II").when(k % 3 == 1, "(sw)").otherwise("")).alias("key"), k.alias("value"), k.alias("ord"))


#: Aliases of names that no index has: (alias, keyword).
ALIASES = [("HOUSE", "ring"), ("HOUSE", "lamp"), ("MACHINE", "widget"), ("AUTO", "gear"), ("AUTO", "red w"), ("MACHINERY TOOLS", "bolt")]
FORMS = (lambda c: c, naming.suffixed("II"), naming.stripped("II"), naming.suffixed("(sw)"))
NAMES = f"""raw as (select c_custkey code, case c_custkey % 6 when 0 then 'NATION_' || c_custkey % 25 when 1 then 'NATION_' || c_custkey % 30 || 'II' when 2 then 'NATION_' || c_custkey % 40 || ' mining' when 3 then substr('NATION_' || c_custkey % 60, 3, 20) when 4 then c_mktsegment end as name from customer),
names as (select distinct name from raw where name is not null),
ks as (select n_name || case n_nationkey % 3 when 0 then 'II' when 1 then '(sw)' else '' end as key, n_nationkey as value from nation),
forms as (select name, unnest([name, name || 'II', rtrim(name, 'I'), name || '(sw)']) f, unnest([0, 1, 2, 3]) o from names),
exact as (select name, arg_min(key, o) as key, arg_min(value, o) as value, 'exact' as stage from forms join ks on f = key group by name),
near as (select name, arg_min(key, value) as key, min(value) as value, 'contained' as stage from names join ks on contains(name, key) or contains(key, name) where name not in (select name from exact) group by name),
resolved as (select name, key, value, stage from names left join (select * from exact union all select * from near) using (name)),
al(alias, keyword) as (values {", ".join(f"('{a}', '{k}')" for a, k in ALIASES)})"""


@query("c11_resolved_names", f"with {NAMES} select * from resolved")
def resolved_names(spark, sf):
    return naming.resolve(_names(spark, sf), _keys(spark, sf), FORMS)


@query("c11_sector_members", f"""with {NAMES}, listed as (select s_nationkey as value, s_suppkey code from supplier where s_nationkey % 5 <> 0), own as (select name, code, stage from resolved join listed using (value)),
rest as (select name from names where name not in (select name from own)), kw0 as (select distinct name, keyword from rest join al on contains(name, alias) or contains(alias, name)),
kw as (select * from kw0 union all select name, trim(replace(name, 'II', '')) from rest where name not in (select name from kw0)),
more as (select distinct name, p_partkey code, 'keyword' stage from kw join part on contains(p_name, keyword))
select name, stage, count(*) as n, min(code) as first, cast(sum(code) as bigint) as total from (select * from own union all select * from more) group by name, stage""")
def sector_members(spark, sf):
    listed = fx.table(spark, sf, "supplier").where("s_nationkey % 5 <> 0").select(F.col("s_nationkey").alias("value"), F.col("s_suppkey").alias("code"))
    catalogue = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), F.col("p_name").alias("industry"))
    m = naming.members(_names(spark, sf), _keys(spark, sf), listed, catalogue, spark.createDataFrame(ALIASES, "alias string, keyword string"), FORMS, ("II",))
    return m.groupBy("name", "stage").agg(F.count("*").alias("n"), F.min("code").alias("first"), F.sum("code").alias("total"))


@query("z8_sector_labels", f"""with {NAMES}, plain as (select name, arg_min(key, n_nationkey) key, arg_min(n_regionkey, n_nationkey) stage, min(n_nationkey) etf from (select name, key, n_regionkey, n_nationkey from names join (select n_name key, n_regionkey, n_nationkey from nation) on name = key) group by name),
near2 as (select name, arg_min(key, n_nationkey) key, arg_min(n_regionkey, n_nationkey) stage, min(n_nationkey) etf from names join (select n_name key, n_regionkey, n_nationkey from nation) on contains(name, key) or contains(key, name) where name not in (select name from plain) group by name),
b as (select * from plain union all select * from near2)
select code, case when raw.name is not null then raw.name || coalesce('|stage ' || stage || '|' || 'ETF ' || etf, '') end as label from raw left join b on b.name = raw.name""")
def sector_labels(spark, sf):
    """A security's sector with the stage and the fund of the concept of that name, or of the first that contains it or is in it."""
    n = fx.table(spark, sf, "nation")
    keys = n.select(F.col("n_name").alias("key"), F.struct("n_regionkey", "n_nationkey").alias("value"), F.col("n_nationkey").alias("ord"))
    names = _names(spark, sf)
    found = naming.resolve(names, keys).select("name", F.concat(F.lit("|stage "), F.col("value.n_regionkey"), F.lit("|ETF "), F.col("value.n_nationkey")).alias("more"))
    return names.join(found, "name", "left").select("code", F.concat("name", F.coalesce("more", F.lit(""))).alias("label"))


@query("z19_board_members", f"""with {NAMES}, ex as (select name, min(n_nationkey) v from names join nation on name = n_name group by name), co as (select name, min(n_nationkey) v from names join nation on contains(n_name, name) where name not in (select name from ex) group by name),
m as (select name, repeat('0', cast(5 - s_suppkey % 3 as int)) || s_suppkey as code from (select * from ex union all select * from co) join supplier on s_nationkey = v) select name, code from m where length(code) = 6""")
def board_members(spark, sf):
    """The board of a name, or the first whose name contains it, and its constituents with codes of six characters."""
    n = fx.table(spark, sf, "nation")
    keys = n.select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("value"), F.col("n_nationkey").alias("ord"))
    names = _names(spark, sf)
    found = naming.resolve(names, keys, contained=False)
    hit = naming.containing(keys, found.where("value is null and name <> ''"), "key", "name").toDF("key", "name").join(keys, "key").groupBy("name").agg(F.min("value").alias("value"))
    found = found.where("value is not null").select("name", "value").unionByName(hit)
    s = fx.table(spark, sf, "supplier")
    code = F.concat(F.repeat(F.lit("0"), (5 - F.col("s_suppkey") % 3).cast("int")), F.col("s_suppkey").cast("string"))
    return found.join(s, F.col("value") == F.col("s_nationkey")).select("name", code.alias("code")).where(F.length("code") == 6)


# -- quote feeds


def _tilde_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A line for each supplier: a full quote, or one of the faults by its number; blank statements between."""
    k, text = F.col("s_suppkey"), lambda c: c.cast("string")
    code = F.lpad(text(k), 6, "0")
    at = {1: F.col("s_name"), 2: code, 3: text(F.col("s_acctbal")), 4: text(k % 50), 5: F.when(k % 4 == 0, "n/a").otherwise(text(k + 0.5)), 33: text(k + 2), 34: text(k - 2), 36: text(k * 10), 37: text(k * 11), 38: text(k % 9 / 4), 39: F.when(k % 11 == 0, "-").otherwise(text(k % 4000)),
          41: F.when(k % 2 == 0, "").otherwise(text(k + 3)), 42: F.when(k % 3 == 0, "").otherwise(text(k - 3)), 43: text(k % 7), 44: text(k * 0.5), 45: text(k * 1.0), 46: F.lit("1.5")}
    fields = F.concat_ws("~", *[at.get(i, F.lit("")) for i in range(49)])
    body = F.when(k % 7 == 1, "").when(k % 7 == 2, F.concat_ws("~", F.lit("1"), F.col("s_name"), code)).otherwise(fields)
    line = F.when(k % 7 == 0, F.concat(F.lit("pv_none_match "), code)).otherwise(F.concat(F.lit(" v_sz"), code, F.lit('="'), body, F.lit('"; ;')))
    return fx.table(spark, sf, "supplier").select(k.alias("k"), line.alias("value"))


def _comma_lines(spark: SparkSession, sf: str) -> DataFrame:
    k, text = F.col("s_suppkey"), lambda c: c.cast("string")
    body = F.concat_ws(",", F.col("s_name"), text(k + 0.25), text(k % 40), text(F.col("s_acctbal")), text(k + 1), text(k - 1), F.lit(""), F.lit(""), text(k * 9), F.when(k % 5 != 3, text(k * 8)))
    line = F.concat(F.lit("var hq_str_sh"), F.lpad(text(k), 6, "0"), F.lit('="'), F.when(k % 5 == 4, "").otherwise(body), F.lit('";'))
    return fx.table(spark, sf, "supplier").select(k.alias("k"), line.alias("value"))


TILDE = """tq as (select s_suppkey k, lpad(cast(s_suppkey as varchar), 6, '0') code, s_name as name, s_acctbal as last, s_suppkey % 50 as previous, case when s_suppkey % 4 = 0 then 0 else s_suppkey + 0.5 end as open, case when s_suppkey % 2 = 0 then s_suppkey + 2 else s_suppkey + 3 end as high,
  case when s_suppkey % 3 = 0 then s_suppkey - 2 else s_suppkey - 3 end as low, s_suppkey * 10 as volume, case when s_suppkey % 11 = 0 then 0 else s_suppkey % 4000 end as pe, 1.5 as pb, s_suppkey * 1e8 as cap from supplier where s_suppkey % 7 > 2)"""
COMMA = """cq as (select s_suppkey k, lpad(cast(s_suppkey as varchar), 6, '0') code, s_name as name, s_acctbal as last, s_suppkey % 40 as previous, s_suppkey + 0.25 as open, s_suppkey + 1 as high, s_suppkey - 1 as low, s_suppkey * 9 as volume from supplier where s_suppkey % 5 < 3)"""
CHANGE = "case when previous > 0 then " + fix("round((last - previous) / cast(previous as double) * 100, 2)", 2) + " end"


@query("a9_a10_quotes", f"""with {TILDE}, {COMMA} select 'tilde' as feed, code, name, cast(last as double) as last, cast(previous as double) as previous, cast(open as double) as open, cast(high as double) as high, cast(low as double) as low, cast(volume as double) as volume, cast(pe as double) as pe, cast(cap as double) as cap, {CHANGE} as change from tq
union all select 'comma', code, name, last, previous, open, high, low, volume, null, null, {CHANGE} from cq""")
def quote_feeds(spark, sf):
    out = None
    for feed, lines, layout in (("tilde", _tilde_lines(spark, sf), quotes.TILDE), ("comma", _comma_lines(spark, sf), quotes.COMMA)):
        good, _ = quotes.split_rejects(quotes.parse_quotes(lines, layout))
        more = [F.col(c) if c in good.columns else F.lit(None).cast("double").alias(c) for c in ("pe", "cap")]
        part = good.select(F.lit(feed).alias("feed"), "code", "name", "last", "previous", "open", "high", "low", "volume", *more, F.floor(F.col("change") * 100 + 0.5).alias("change"))
        out = part if out is None else out.unionByName(part)
    return out


@query("a9_a10_rejects", """with t as (select 'tilde' feed, case s_suppkey % 7 when 0 then 'no variable' when 1 then 'no value' when 2 then 'too few fields' end reason from supplier union all select 'comma', case s_suppkey % 5 when 4 then 'no value' when 3 then 'too few fields' end from supplier)
select feed, reason, count(*) as n from t where reason is not null group by feed, reason""")
def quote_rejects(spark, sf):
    t, c = quotes.parse_quotes(_tilde_lines(spark, sf), quotes.TILDE), quotes.parse_quotes(_comma_lines(spark, sf), quotes.COMMA)
    both = quotes.split_rejects(t)[1].withColumn("feed", F.lit("tilde")).unionByName(quotes.split_rejects(c)[1].withColumn("feed", F.lit("comma")))
    return both.groupBy("feed", "reason").agg(F.count("*").alias("n"))


FIELDS = ("last", "pe", "pb", "cap")


def _sources(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    k = F.col("s_suppkey")
    own = fx.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.lpad(k.cast("string"), 6, "0").alias("code"), (F.col("s_acctbal") + 1).alias("last"), F.when(k % 2 == 0, k % 30 / 2).alias("pe"), F.lit(2.5).alias("pb"), (k * 3e8).alias("cap"))
    parsed = [quotes.split_rejects(quotes.parse_quotes(lines(spark, sf), layout))[0] for lines, layout in ((_tilde_lines, quotes.TILDE), (_comma_lines, quotes.COMMA))]
    return [("own", own), ("tilde", parsed[0]), ("comma", parsed[1])]


SOURCES = f"""{TILDE}, {COMMA}, own as (select lpad(cast(s_suppkey as varchar), 6, '0') code, s_acctbal + 1 as last, case when s_suppkey % 2 = 0 then s_suppkey % 30 / 2.0::double end as pe, 2.5::double as pb, s_suppkey * 3e8 as cap from supplier where s_suppkey % 3 = 0),
three as (select 'own' as source, code, last, pe, pb, cap from own union all select 'tilde', code, last, pe, pb, cap from tq where code not in (select code from own)
  union all select 'comma', code, last, null, null, null from cq where code not in (select code from own) and code not in (select code from tq)),
au as (select lpad(cast(s_suppkey as varchar), 6, '0') code, nullif(s_suppkey % 70, 3) + 0.125::double as ape, case when s_suppkey % 6 = 0 then 0 else 1.75::double end as apb, s_suppkey * 2.0::double as acap from supplier where s_suppkey % 4 > 0)"""


@query("a6_quote_cascade", f"""with {SOURCES}, j as (select three.*, round(ape, 2) ape, apb, acap * 1e4 acap, coalesce(pe, 0) = 0 or pe > 2000 as wrong from three left join au using (code))
select code, cast(last as double) as last, cast(case when wrong and ape <> 0 then ape else pe end as double) as pe, cast(case when wrong and apb <> 0 then apb else pb end as double) as pb, cast(case when wrong and acap <> 0 then acap else cap end as double) as cap, source,
  concat_ws(',', case when wrong and ape <> 0 then 'pe' end, case when wrong and apb <> 0 then 'pb' end, case when wrong and acap <> 0 then 'cap' end) as patched from j""")
def quote_cascade(spark, sf):
    k = F.col("s_suppkey")
    authority = fx.table(spark, sf, "supplier").where("s_suppkey % 4 > 0").select(F.lpad(k.cast("string"), 6, "0").alias("code"), (F.nullif(k % 70, F.lit(3)) + 0.125).alias("pe"), F.when(k % 6 == 0, 0.0).otherwise(1.75).alias("pb"), (k * 2.0).alias("cap"))
    return cascade.quote_cascade(_sources(spark, sf), authority, FIELDS).withColumn("patched", F.array_join("patched", ","))


@query("a6_first_fields", f"""with {SOURCES}, f as (select coalesce(own.code, tq.code, cq.code) code, own.last a, tq.last b, cq.last c, own.pe ap, tq.pe bp, own.pb ab, tq.pb bb from own full join tq on tq.code = own.code full join cq on cq.code = coalesce(own.code, tq.code))
select code, coalesce(a, b, c) as last, case when a is not null then 'own' when b is not null then 'tilde' when c is not null then 'comma' end as last_source, cast(coalesce(ap, bp) as double) as pe, case when ap is not null then 'own' when bp is not null then 'tilde' end as pe_source from f""")
def first_fields(spark, sf):
    return cascade.first_fields(_sources(spark, sf), ("last", "pe")).select("code", "last", "last_source", "pe", "pe_source")


# -- adjusted bars

EVENTS = "ev as (select code, d, case when code % 2 = 0 then 0.5::double else 0.75::double end as factor from bars where day(d) = 15 and code % 3 <> 1 union all select code, d + 1, 0.5 from bars where day(d) = 27 and code % 3 = 0)"
ADJUSTED = f"{B}, {EVENTS}, ad as (select b.code, b.d, b.c * coalesce(product(factor), 1) as c, b.h * coalesce(product(factor), 1) as h, b.v from bars b left join ev on ev.code = b.code and ev.d > b.d group by b.code, b.d, b.c, b.h, b.v)"


def _adjusted(spark, sf, last: int | None = None) -> DataFrame:
    b = fx.bars_walk(spark, sf)
    k = F.col("code")
    days = b.where((F.day("d") == 15) & (k % 3 != 1)).select("code", "d", F.when(k % 2 == 0, 0.5).otherwise(0.75).alias("factor"))
    days = days.unionByName(b.where((F.day("d") == 27) & (k % 3 == 0)).select("code", F.date_add("d", 1).alias("d"), F.lit(0.5).alias("factor")))
    return adjust.forward_adjusted(b, days, last=last)


@query("a1_adjusted_bars", f"{ADJUSTED} select code, d, {fix('c', 3)} as c, {fix('h', 3)} as h, v from ad qualify row_number() over (partition by code order by d desc) <= 120 and count(*) over (partition by code) >= 5")
def adjusted_bars(spark, sf):
    return _adjusted(spark, sf, 120).select("code", "d", F.floor(F.col("c") * 1000 + 0.5).alias("c"), F.floor(F.col("h") * 1000 + 0.5).alias("h"), "v")


@query("a1_adjusted_weeks", f"{ADJUSTED}, w as (select code, cast(date_trunc('week', d) as date) + 6 as w, max(h) h, arg_max(c, d) c, cast(sum(v) as bigint) v from ad group by all) select code, w, {fix('h', 3)} as h, {fix('c', 3)} as c, v from w qualify row_number() over (partition by code order by w desc) <= 30")
def adjusted_weeks(spark, sf):
    """Weeks that end on Sunday, of adjusted bars: the last thirty of each code."""
    w = resample(_adjusted(spark, sf), "week_sunday")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("w")))
    return w.withColumn("n", n).where("n <= 30").select("code", "w", F.floor(F.col("h") * 1000 + 0.5).alias("h"), F.floor(F.col("c") * 1000 + 0.5).alias("c"), "v")


# -- results that grow


@query("j3_j4_incremental_results", f"{RET} select d, code, horizon, {fix('ret')} as ret from ret where horizon in (3, 5, 8)")
def incremental_results(spark, sf):
    """A back-test in three runs: some dates at two horizons, all dates at three, and one that finds nothing to do."""
    path = feeds.shared_path(spark, "results")
    picks, bars = feeds.stored(recommended(spark, sf)), fx.bars_walk(spark, sf)
    dates = picks.select("d").distinct()

    def evaluate(open_: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
        return performance.forward_returns(picks.join(open_, "d", "left_semi"), bars, horizons).select("d", "code", "horizon", "ret")

    results.update_results(spark, path, dates.orderBy("d").limit(7), (3, 5), evaluate)
    for _ in range(2):
        results.update_results(spark, path, dates, (3, 5, 8), evaluate)
    return spark.read.parquet(path).select("d", "code", "horizon", F.floor(F.col("ret") * 10000 + 0.5).alias("ret"))
