"""Hand-made cases: rounding, ranks, regimes, weeks, as-of reads, ballots, streaks, parsers, patterns."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import text as tx
from quantloom.functions.expr import fixed, safe_number
from quantloom.operators import fusion, indicators, joins, patterns, performance, portfolio
from quantloom.operators.aggregates import period_label
from quantloom.operators.asof import first_bar_from
from quantloom.operators.crosssec import market_regime, percentile_rank
from quantloom.operators.labels import REGIME
from quantloom.operators.pivots import with_pivots
from quantloom.sources import feeds


def one(df):
    return [tuple(r) for r in df.collect()]


def bars(spark, closes, code=1, start=dt.date(2024, 1, 1)):
    rows = [(code, start + dt.timedelta(days=i), int(c), int(c) + 1, int(c) - 1, int(c), 10) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "code long, d date, o long, h long, l long, c long, v long")


def test_percentile_rank_with_ties(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 3, 5)], "x int")
    assert sorted(r[0] for r in df.select(percentile_rank("x")).collect()) == [20, 50, 50, 80, 100]


@pytest.mark.parametrize(("breadth", "ret", "want"), [(0.55, 0.5, "neutral"), (0.56, 0.01, "neutral"), (0.56, 0.011, "bull"), (0.40, 0, "neutral"), (0.39, 0, "bear"), (0.5, -0.02, "neutral"), (0.5, -0.021, "bear")])
def test_regime_edges(spark, breadth, ret, want):
    df = spark.createDataFrame([(breadth, float(ret))], "breadth double, mean_ret double")
    assert df.select(F.expr(REGIME)).first()[0] == want


def test_regime_counts_codes_with_enough_bars(spark):
    rows = [(60, 2.0, 1.0, 0.5), (60, 0.5, 1.0, 0.25), (59, 2.0, 1.0, 9.0)]
    r = market_regime(spark.createDataFrame(rows, "nbar int, c double, ma20 double, ret20 double")).first()
    assert (r["breadth"], r["mean_ret"], r["n"], r["regime"]) == (0.5, 0.375, 2, "neutral")


def test_week_labels(spark):
    days = [(dt.date(2024, 1, d),) for d in (4, 5, 6, 7)]  # Thursday to Sunday
    df = spark.createDataFrame(days, "d date").select(period_label("week_friday"), period_label("week_sunday"))
    assert one(df) == [(dt.date(2024, 1, 5), dt.date(2024, 1, 7)), (dt.date(2024, 1, 5), dt.date(2024, 1, 7)), (dt.date(2024, 1, 12), dt.date(2024, 1, 7)), (dt.date(2024, 1, 12), dt.date(2024, 1, 7))]


def test_forward_as_of_past_the_end(spark):
    b = bars(spark, [10, 11, 12])
    t = spark.createDataFrame([(1, dt.date(2023, 12, 1)), (1, dt.date(2024, 1, 2)), (1, dt.date(2024, 2, 1)), (9, dt.date(2024, 1, 1))], "code long, target date")
    got = {(r.code, r.target): r.eval_c for r in first_bar_from(t, b).collect()}
    assert got == {(1, dt.date(2023, 12, 1)): 10, (1, dt.date(2024, 1, 2)): 11, (1, dt.date(2024, 2, 1)): None, (9, dt.date(2024, 1, 1)): None}


def test_trading_offsets(spark):
    d = spark.createDataFrame([(dt.date(2024, 1, 1),)], "d date")
    got = d.select(*(F.datediff(performance.trading_offset("d", n), "d") for n in (3, 5, 8, 20, 60))).first()
    assert tuple(got) == (6, 9, 13, 30, 86)


def test_borda_ties_missing_rank_and_weights(spark):
    rows = [("a", 1, "1", 80), ("a", 2, "2", 80), ("b", 2, "1", 80), ("b", 1, "2", 80), ("b", None, "3", None), ("b", 3, "3", 60), ("c", 1, " ", 50)]
    p = spark.createDataFrame(rows, "model string, rank int, code string, score int")
    got = fusion.borda(p).select("place", "code", "borda", "ballots", "mean_score").collect()
    assert [tuple(r) for r in got] == [(1, "2", 39.0, 2, 80.0), (2, "1", 39.0, 2, 80.0), (3, "3", 18.0, 2, 65.0)]
    w = spark.createDataFrame([("a", 0.5), ("b", 1.5)], "model string, weight double")
    assert fusion.borda(p, w).first()["code"] == "2"


def test_streak_with_a_gap(spark):
    days = [dt.date(2024, 1, d) for d in (1, 3, 8, 9)]
    h = spark.createDataFrame([(d, "x") for d in days] + [(days[0], "y"), (days[1], "y"), (days[3], "y"), (days[2], "z")], "d date, code string")
    assert {tuple(r) for r in performance.streaks(h).collect()} == {("x", 4), ("y", 1)}
    assert performance.retained(h, 2).select("d").distinct().count() == 2


def test_ewm_matches_pandas(spark):
    values = np.random.default_rng(1).normal(100, 5, 60).tolist()
    got = spark.createDataFrame([(values,)], "a array<double>").select(indicators.ewm_last(F.col("a"), 2 / 13)).first()[0]
    assert got == pytest.approx(pd.Series(values).ewm(span=12, adjust=False).mean().iloc[-1], rel=1e-12)


def test_fixed_and_safe_number(spark):
    df = spark.createDataFrame([(0.12345, "7.5"), (-0.00004, "x"), (2.5, None)], "x double, s string")
    assert one(df.select(fixed("x"), safe_number("s", -1))) == [(1235, 7.5), (0, -1.0), (25000, -1.0)]


ANSWERS = {'```json\n{"a":1}\n```': '{"a":1}', '{"a":2}': '{"a":2}', 'well {"a":3} ok': '{"a":3}', "broken {": None, "": None, "```\n[1]\n```": "[1]", "7": None}


def test_json_cascade(spark):
    df = spark.createDataFrame([(k,) for k in ANSWERS], "t string")
    assert {r.t: r.j for r in df.select("t", tx.json_text(F.col("t")).alias("j")).collect()} == ANSWERS


def test_parsers(spark):
    df = spark.createDataFrame([("3-5%", "1,234万"), ("8%", "200亿"), ("none", "50000000"), (None, "x")], "p string, m string")
    got = one(df.select(tx.position_percent(F.col("p")), tx.market_cap(F.col("m"))))
    assert got == [(4.0, 0.1234), (8.0, 200.0), (5.0, 0.5), (5.0, 0.0)]
    claim = spark.createDataFrame([("PE=50", 5.5), ("PE 5.6", 5.5), ("no claim", 5.5), ("PE 3", None)], "t string, pe double")
    assert [r[0] for r in claim.select(tx.deviates(tx.first_number(F.col("t"), "PE|pe"), F.col("pe"), 0.3)).collect()] == [True, False, False, False]


def test_group_cap_keeps_the_best_two(spark):
    p = spark.createDataFrame([(1, "s", 3.0), (2, "s", None), (3, "s", 9.0), (4, "t", 1.0)], "pos int, sector string, final_score double")
    assert {r.pos for r in portfolio.group_cap(p, "sector", 2).where("kept").collect()} == {1, 3, 4}


def test_timing_limits(spark):
    m = spark.createDataFrame([(70.0, None, None), (69.9, None, None), (14.0, None, None), (None, "up", "euphoric"), (None, None, None)], "score double, trend string, mood string")
    assert [r.recommendations for r in portfolio.timing_limits(m).collect()] == [15, 10, 0, 15, 10]


def test_sources_and_fills(spark):
    a = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "code int, x int")
    b = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "code int, x int")
    got = {tuple(r) for r in joins.first_source([(a, 2), (b, 1)]).select("code", "x").collect()}
    assert got == {(1, 5), (1, 6), (2, 2), (3, 3)}
    assert joins.fill_missing(a, b).count() == 4


def test_reordered(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "code string, pos int")
    wanted = spark.createDataFrame([("c", 1), ("zz", 2), ("c", 3), ("b", 4)], "code string, at int")
    assert [r.code for r in joins.reordered(items, wanted).orderBy("place").collect()] == ["c", "b", "a"]


def test_pivots_need_a_unique_extreme(spark):
    got = with_pivots(bars(spark, [1, 5, 2, 9, 9, 1, 2, 3]), 1, 1).orderBy("d").collect()
    assert [r.is_high for r in got] == [False, True, False, False, False, False, False, False]
    assert [r.pos for r in got if r.is_low] == [2, 5]


def make(points):
    """A series of straight legs between (bar, price) points; volume falls."""
    x, y = zip(*points, strict=True)
    c = np.interp(np.arange(x[-1] + 1), x, y)
    return patterns.Series.of(c + 0.5, c - 0.5, c, np.linspace(200, 100, len(c)), 5, 5)


def test_double_bottom_and_its_mirror():
    s = make([(0, 110), (20, 100), (30, 104), (40, 100.5), (47, 102)])
    s.h, s.l = s.c + 2, s.c - 2  # ranges wide enough for the rise between the lows
    found = patterns.double_bottom(s)
    assert found and [found[k][0] for k in "ABCD"] == [20, 30, 40, 47]
    top = make([(0, 90), (20, 100), (30, 96), (40, 99.5), (47, 98)])
    top.h, top.l = top.c + 2, top.c - 2
    assert patterns.double_bottom(top.mirror()) is not None
    # near miss: the second low is more than 4 % away
    assert patterns.double_bottom(make([(0, 110), (20, 100), (30, 108), (40, 93), (47, 100)])) is None


def test_doubled_pivot_skips_one_more():
    s = patterns.Series(np.zeros(9), np.zeros(9), np.zeros(9), np.ones(9), np.array([2, 4, 4, 6, 8]), np.arange(5.0), np.ones(5))
    assert (s.after(2), s.after(4), s.after(6)) == (1, 4, 4)


def test_pattern_scores(spark):
    rows = [(1, "daily", "DBOT", "bullish"), (1, "weekly", "TRNG_Descending", "bullish"), (2, "weekly", "DTOP", "bearish"), (2, "daily", "MA_BULL", "bullish"), (3, "daily", "HNSD", "bearish"), (3, "daily", "DBOT", "bullish"), (3, "daily", "MA_BULL", "bullish")]
    got = {r.code: (r.bull, r.bear, r.excluded) for r in patterns.pattern_scores(spark, spark.createDataFrame(rows, "code int, timeframe string, pattern string, direction string")).collect()}
    assert got == {1: (15, 0, False), 2: (10, 25, True), 3: (25, 20, True)}


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "x int, day string")
    feeds.write_snapshot(df, str(tmp_path / "s"), by="day")
    feeds.write_snapshot(df.where("x = 2").withColumn("x", F.lit(5)), str(tmp_path / "s"), by="day")
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [1, 5]


def test_normalize_bars_aliases(spark):
    raw = spark.createDataFrame([("1", "20240105", "2.5", "x"), ("1", "2024-01-06", None, "3")], "code string, Date string, OPEN string, close string")
    assert [(str(r.d), r.o, r.c) for r in feeds.normalize_bars(raw).collect()] == [("2024-01-06", None, 3.0)]


def test_event_matches_either_way(spark):
    texts = ["breaking: rates cut again", "rates cut again today", "so: rates cut a third time", "oil", "crude oil up", None, "é😀é is one of them all", "well, é😀é is one of none", "nothing of that", "x" * 70 + "nothing of it", "oil", "line one\nline two"]
    ids = [7, 3, 9, 12, 2, 1, 15, 14, 40, 41, 13, 50]

    def brute(rows):
        hit = lambda a, b: a is not None and b is not None and (a[:10] in b or b[:10] in a)
        return {i: min((j for j, u in rows if hit(t, u)), default=None) for i, t in rows}

    for more in ([], [(60, "")]):
        rows = [*zip(ids, texts, strict=True), *more]
        got = {r.eid: r.doc_id for r in joins.event_matches(spark.createDataFrame(rows, "doc_id long, title string")).collect()}
        assert got == brute(rows)


def test_event_matches_shuffle_only_windows_that_are_beginnings(spark):
    from .conftest import SMALL

    t = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("unhex(sha2(text, 256)) as h", "doc_id as id", "text as t").where("t is not null")
    first = t.selectExpr("substring(t, 1, 10) as k").distinct()
    held = joins.held_windows(t, first)
    beginnings = {r.k for r in first.collect()}
    texts = [r.t for r in t.collect()]
    want = sum(len({x[i : i + m] for m in {len(k) for k in beginnings} for i in range(len(x) - m + 1)} & beginnings) for x in texts)
    assert want <= held.count() <= want * 1.1 and held.where(F.col("k").isin(*beginnings)).count() == want


def test_event_matches_reads_all_texts(spark):
    from quantloom.plans import QUERIES

    from .conftest import SMALL

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    want = {i: min(j for j, u in rows if t[:10] in u or u[:10] in t) for i, t in rows}
    assert {r.eid: r.doc_id for r in QUERIES["c12_event_match"](spark, SMALL).collect()} == want and len(want) == 200


def test_fragments_of_later_lines_and_json_in_prose(spark, tmp_path):
    from quantloom.plans import QUERIES

    prose, inner = "word " * 200, '{"a": [1, 2]}'
    rows = [(1, "first\nthe second line\ngoes on. end", "de"), (2, "no such word", "en"), (3, f"{prose}{inner} {prose}", "en"), (4, f"{prose}```json\n{inner}\n``` {prose}", "fr"), (5, f"{prose}{{broken {prose}", "en"), (6, inner, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.f for r in QUERIES["z6_z9_fragments"](spark, str(tmp_path)).collect()} == {1: "the second line\ngoes on"}
    want = {i: len(t) for i, t, _ in rows} | {3: len(inner), 4: len(inner), 5: 800 + 9}
    assert {r.doc_id: r.n for r in QUERIES["i3_compaction"](spark, str(tmp_path)).collect()} == want


# -- clusters, reads as of a date, review


def test_as_of_reads_have_no_wide_frames(spark):
    from pyspark.sql import functions as F

    from quantloom.operators.asof import first_bar_from, slices

    bars = spark.range(400).select((F.col("id") % 4).alias("code"), F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 4 * 3).cast("int")).alias("d"), F.col("id").alias("c"))
    targets = spark.range(4).select(F.col("id").alias("code")).crossJoin(spark.range(320).select(F.date_add(F.lit("2023-12-20").cast("date"), F.col("id").cast("int")).alias("target")))
    targets = spark.createDataFrame(targets.collect(), targets.schema)
    found = first_bar_from(targets, bars)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "unboundedfollowing" not in plan.lower()
    by = {}
    for r in bars.collect():
        by.setdefault(r.code, []).append((r.d, r.c))
    for r in found.collect():
        want = min((x for x in by[r.code] if x[0] >= r.target), default=(None, None))
        assert (r.eval_d, r.eval_c) == want
    dates = targets.select(F.col("target").alias("as_of")).distinct().limit(40)
    got = {}
    for r in slices(bars, dates, 3).collect():
        got.setdefault((r.as_of, r.code), []).append(r.d)
    for a in (r.as_of for r in dates.collect()):
        for code, xs in by.items():
            assert sorted(got.get((a, code), [])) == sorted(d for d, _ in xs if d <= a)[-3:]


def test_claims_read_from_text(spark):
    from quantloom.operators.review import verified

    rows = [(1, "PE0 then pe: 12, 目标价500元 股价20元"), (2, "市盈率为30，市值800亿 近20日涨幅约+18%"), (3, "收盘 99999 元"), (4, "")]
    real = [(1, 10.0, None, None, None, 19.0), (2, 20.0, 1000.0, 10.0, None, None), (3, None, None, None, None, 50.0), (4, 1.0, 1.0, 1.0, 1.0, 1.0)]
    x = verified(spark.createDataFrame(rows, "code long, text string"), spark.createDataFrame(real, "code long, pe double, cap double, ret20 double, ret60 double, price double"))
    assert {r.code: [d.kind for d in r.doubts] for r in x.collect()} == {1: [], 2: ["pe", "ret20"], 3: [], 4: []}


def test_timing_cut_and_risk_flags(spark):
    from quantloom.operators.review import risk_checked, timing_cut

    rows = [(k, "tech" if k < 4 else " " if k < 6 else "oil", None if k == 5 else 10.0 - k, 30.0, k) for k in range(8)]
    x = risk_checked(spark.createDataFrame(rows, "code long, sector string, final_score double, position double, pos long"), "weak")
    got = {r.code: r for r in timing_cut(x, 3, "weak").collect()}
    assert [got[k].state for k in range(8)] == ["approved", "approved", "sector", "sector", "approved", "timing", "timing", "timing"]
    assert got[4].sector == "unknown" and got[0].scaled == 20 * 30 / 180 and got[2].scaled is None and len(got[5].flags) == 2
