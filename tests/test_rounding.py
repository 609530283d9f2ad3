"""Rounding as SQL and printf do it, deviations of whole numbers, and features of the last bars alone."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from quantloom.functions.expr import printed, rounded, rounded_even, trailing
from quantloom.operators import indicators as ind
from quantloom.operators import scoring

HALVES = [(3987.97 - 40) / 40.0 * 100, 1.005, 2.675, 0.125, -0.04, -0.125, 0.35, 0.25, 12.5, -2.5, 0.0, -0.0, 99.95, 9.995, 1234.45]


def _walk(n: int, code: int, seed: int = 3):
    rng = random.Random(seed + code)
    c, out = 20000, []
    for i in range(n):
        c += rng.randrange(-200, 201)
        out.append((code, dt.date(2020, 1, 1) + dt.timedelta(i), c, c + rng.randrange(90), c - rng.randrange(90), c, rng.randrange(1, 51)))
    return out


BARS = "code long, d date, o long, h long, l long, c long, v long"


def test_halves_go_as_in_sql_and_printf(spark, duck):
    x = spark.createDataFrame([(v,) for v in HALVES], "x double")
    got = x.select("x", *(rounded("x", k).alias(f"r{k}") for k in (1, 2)), *(rounded_even("x", k).alias(f"e{k}") for k in (1, 2)), *(printed("x", k).alias(f"p{k}") for k in (1, 2))).collect()
    duck.execute("create or replace temp table halves as select unnest(?::double[]) x", [HALVES])
    want = duck.sql("select x, round(x, 1), round(x, 2), round_even(x, 1), round_even(x, 2), printf('%+.1f', x), printf('%+.2f', x) from halves").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_printed_agrees_with_c_on_many_values(spark):
    rng = random.Random(5)
    values = [rng.choice((-1, 1)) * rng.randrange(20000) / rng.choice((8, 16, 20, 200, 2000, 7)) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", printed("x", 1).alias("a"), printed("x", 2).alias("b")).collect()
    assert all((r.a, r.b) == (f"{r.x:+.1f}", f"{r.x:+.2f}") for r in got)


def test_share_of_deviation_is_exact(spark):
    v = [29, 2, 41, 1, 10, 29, 18, 6, 30, 30, 42, 44, 30, 39, 9, 38, 15, 49, 42, 8]  # 15.2 / 25.6
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(i), 5, 6, 5, 5, x) for i, x in enumerate(reversed(v))]
    x = ind.with_features(spark.createDataFrame(rows, BARS))
    assert x.orderBy(F.desc("d")).first().vcv == 0.59375


def test_last_features_are_those_of_whole_series(spark):
    bars = spark.createDataFrame([r for code, n in ((1, 300), (2, 104), (3, 106), (4, 7), (5, 1)) for r in _walk(n, code)], BARS)
    for profile in ("live", "backtest"):
        more = {"h60": F.max("h").over(trailing(60))}
        want = ind.last_bars(ind.with_features(bars, profile).withColumns(more))
        got = ind.last_features(bars, profile, more)
        assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() == 5


def test_last_oscillators_are_the_last_rows(spark):
    bars = spark.createDataFrame([r for code, n in ((1, 60), (2, 2), (3, 1)) for r in _walk(n, code)], BARS)
    rows = sorted(ind.oscillators(bars).collect(), key=lambda r: (r.code, r.d))
    got = {r.code: r for r in ind.last_oscillators(bars).collect()}
    for code in (1, 2, 3):
        own = [r for r in rows if r.code == code]
        assert tuple(got[code])[: len(own[0])] == tuple(own[-1])
        assert (got[code].p_dif, got[code].p_dea, got[code].p_hist) == ((own[-2].dif, own[-2].dea, own[-2].hist) if len(own) > 1 else (None, None, None))


def test_strength_near_a_threshold_is_not_rounded(spark):
    """RSI of 29.996 is under 30."""
    up, w = 29.996, 70.004
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(i), 0, int(c), int(c), int(c), 1) for i, c in enumerate((0, up * 1000, up * 1000))]
    rows += [(2, r[1], 0, 0, 0, x, 1) for r, x in zip(rows, (1_000_000, 1_000_000 + 29996, 1_000_000 + 29996 - 84005), strict=True)]
    rsi = {(r.code, r.d): r.rsi6 for r in ind.oscillators(spark.createDataFrame(rows, BARS)).collect()}
    a, b = 29996 * (1 - 1 / 6), 84005 * (1 / 6)
    assert rsi[2, rows[2][1]] == 100 - 100 / (1 + a / (b if b else w)) and rsi[2, rows[2][1]] != round(rsi[2, rows[2][1]], 2)


def test_volume_at_four_fifths_is_no_dry_up(spark):
    x = spark.createDataFrame([(1.2, 1.5, 0.0, 1, 1, 9)], "v5 double, v20 double, vsd5 double, c long, o long, v long")
    assert 1.2 * 10 == 1.5 * 8 and x.select(F.expr(scoring.VOLUME_L2)).first()[0] == 20 + 30


def test_resistance_at_the_slack_itself_does_not_count(spark, monkeypatch):
    """20100 is 1.005 times 20000, which as doubles is less."""
    from quantloom.plans import indicator_queries as iq

    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(i), 20000, h, 19000, 20000, 1) for i, h in enumerate((20050, 20100, 20010))]
    monkeypatch.setattr(iq, "_bars", lambda *_: spark.createDataFrame(rows, BARS))
    r = iq.QUERIES["e27_support_resistance"](spark, "").first()
    assert (r.r1, r.r2) == (206000000, 210000000)
