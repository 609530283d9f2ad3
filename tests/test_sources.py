"""Quote lines with faults, cascades, adjusted prices and results that grow."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

from pyspark.sql import functions as F

from quantloom.operators import adjust, cascade
from quantloom.sources import feeds, quotes, results


def tilde(**at):
    fields = [""] * 47
    for k, v in at.items():
        fields[int(k[1:])] = v
    return "~".join(fields)


def test_tilde_lines(spark):
    good = tilde(f1="n ame", f2="000001", f3="11", f4="10", f33="12", f41="", f34="9", f42="8", f39="-", f45="2")
    lines = [f'v_sz000001="{good}"; v_sh000002=""', "pv_none", f'v_sz3="{good}~48th"', 'v_x="1~2"; ;', None, "", "=", 'a="b=c"']
    rows = quotes.parse_quotes(spark.createDataFrame([(x,) for x in lines], "value string"), quotes.TILDE).collect()
    assert [r.reason for r in rows] == [None, "no value", "no variable", None, "too few fields", "no value", "too few fields"]
    q = rows[0]
    assert (q.code, q.name, q.last, q.previous, q.high, q.low, q.pe, q.cap, q.change, q.open) == ("000001", "n ame", 11.0, 10.0, 12.0, 8.0, 0.0, 2e8, 10.0, 0.0)
    assert rows[1].code is None and rows[1].raw == 'v_sh000002=""'
    good_, bad = quotes.split_rejects(quotes.parse_quotes(spark.createDataFrame([(x,) for x in lines], "value string"), quotes.TILDE))
    assert good_.count() == 1 and bad.count() == 5  # both quotes are of one code


def test_comma_lines(spark):
    body = "name,1.5,0,3,4,2,,,100,200"
    lines = [f'var hq_str_sh600519="{body}";', f'var hq_str_bj1="{body},more"', 'var hq_str_sh600000="a,b";']
    rows = quotes.parse_quotes(spark.createDataFrame([(x,) for x in lines], "value string"), quotes.COMMA).collect()
    assert [(r.code, r.name, r.open, r.last, r.volume, r.change, r.reason) for r in rows] == [("600519", "name", 1.5, 3.0, 100.0, None, None), ("1", "name", 1.5, 3.0, 100.0, None, None), (None, None, None, None, None, None, "too few fields")]
    assert quotes.parse_quotes(spark.createDataFrame([], "value string"), quotes.COMMA).count() == 0


def test_written_lines_read_back(spark):
    df = spark.createDataFrame([("000001", "x", 2.0, 1.0, 5e9), ("000002", "y", None, 4.0, None)], "code string, name string, last double, previous double, cap double")
    missing = {n: F.lit(None).cast("double") for n, _, _ in quotes.TILDE.numbers if n not in df.columns}
    line = quotes.quote_lines(df.withColumns(missing), quotes.TILDE, F.concat(F.lit("v_sz"), "code"))
    back = {r.code: r for r in quotes.parse_quotes(df.withColumns(missing).select(line.alias("value")), quotes.TILDE).collect()}
    assert (back["000001"].last, back["000001"].cap, back["000001"].change) == (2.0, 5e9, 100.0)
    assert (back["000002"].last, back["000002"].cap, back["000002"].change) == (0.0, 0.0, -100.0)


def test_cascades(spark):
    one = lambda rows: spark.createDataFrame(rows, "code string, pe double, pb double, cap double")
    a, b = one([("x", None, 1.0, 5.0), (None, 1.0, 1.0, 1.0)]), one([("x", 9.0, 9.0, 9.0), ("y", 3000.0, None, 7.0), ("y", 4000.0, 2.0, 8.0), ("z", 5.0, 1.0, 1.0)])
    fields = ("pe", "pb", "cap")
    rows = {r.code: r for r in cascade.first_rows([("a", a), ("b", b)], fields).collect()}
    assert (rows["x"].pe, rows["x"].source) == (None, "a") and (rows["y"].pe, rows["y"].source) == (3000.0, "b") and rows[None].source == "a"
    each = {r.code: r for r in cascade.first_fields([("a", a), ("b", b)], fields).collect()}
    assert (each["x"].pe, each["x"].pe_source, each["x"].pb_source) == (9.0, "b", "a") and each["y"].pb == 2.0
    got = {r.code: r for r in cascade.quote_cascade([("a", a), ("b", b)], one([("x", 7.123, 0.0, 2.0), ("y", None, 6.0, None), ("z", 8.0, 8.0, 8.0), ("only", 1.0, 1.0, 1.0)]), fields).collect()}
    assert set(got) == {"x", "y", "z", None}
    assert (got["x"].pe, got["x"].pb, got["x"].cap, got["x"].patched) == (7.12, 1.0, 2e4, ["pe", "cap"])
    assert (got["y"].pe, got["y"].pb, got["y"].cap, got["y"].patched) == (3000.0, 6.0, 7.0, ["pb"])
    assert (got["z"].pe, got["z"].patched) == (5.0, [])
    plan = cascade.quote_cascade([("a", a), ("b", b)], b, fields)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_adjusted_prices(spark):
    r = random.Random(1)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    bars = [(c, day(n), r.randint(1, 99), float(r.randint(100, 200)) if r.random() < 0.95 else None) for c in range(4) for n in sorted(r.sample(range(90), 40 if c < 3 else 4))]
    events = [(c, day(r.randrange(95)), r.choice((0.5, 0.8, None))) for c in range(4) for _ in range(12)]
    got = {(x.code, x.d): x for x in adjust.forward_adjusted(spark.createDataFrame(bars, "code long, d date, v long, c double"), spark.createDataFrame(events, "code long, d date, factor double"), last=25).collect()}
    want = {}
    for c in range(3):
        own = [b for b in bars if b[0] == c and b[3] is not None]
        for _, d, v, price in own[-25:]:
            f = math.prod(x for k, e, x in events if k == c and e > d and x is not None)
            want[c, d] = (v, price * f, f)
    assert got.keys() == want.keys()
    for k, (v, price, f) in want.items():
        assert got[k].v == v and math.isclose(got[k].c, price) and math.isclose(got[k].factor, f)
    none = adjust.forward_adjusted(spark.createDataFrame(bars, "code long, d date, v long, c double"), spark.createDataFrame([], "code long, d date, factor double"))
    assert none.where("factor <> 1").count() == 0 and none.count() == len([b for b in bars if b[0] < 3 and b[3] is not None])


def files(path):
    return {os.path.join(f, x): os.stat(os.path.join(f, x)).st_mtime_ns for f, _, names in os.walk(path) for x in names if x.startswith("part-")}


def test_results_grow_and_keep_their_files(spark):
    path = feeds.shared_path(spark, "test-results")
    dates = spark.range(6).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    seen = []

    def evaluate(open_, horizons):
        seen.append((sorted(r.d.day for r in open_.collect()), horizons))
        rows = open_.where("day(d) <> 6").crossJoin(spark.createDataFrame([(h,) for h in horizons], "horizon int"))
        return rows.select("d", "horizon", (F.day("d") * F.col("horizon")).cast("double").alias("ret"))

    assert results.update_results(spark, path, dates.limit(3), (3, 5), evaluate) == 3
    before = files(path)
    assert results.update_results(spark, path, dates, (3, 5), evaluate) == 3  # the others
    assert before.items() <= files(path).items()
    assert results.update_results(spark, path, dates, (3, 5), evaluate) == 1  # nothing comes of the sixth
    before = files(path)
    assert results.update_results(spark, path, dates.limit(2), (3, 5, 8), evaluate) == 2
    after = files(path)
    kept = {k for k in before if "d=2024-01-01" not in k and "d=2024-01-02" not in k}
    assert {k: before[k] for k in kept} == {k: after[k] for k in kept} and not (before.keys() - kept) & after.keys()
    results.update_results(spark, path, dates, (3, 5, 8), evaluate)
    assert seen == [([1, 2, 3], (3, 5)), ([4, 5, 6], (3, 5)), ([6], (3, 5)), ([1, 2], (3, 5, 8)), ([3, 4, 5, 6], (3, 5, 8))]
    assert sorted((r.d.day, r.horizon, r.ret) for r in spark.read.parquet(path).collect()) == sorted((d, h, float(d * h)) for d in range(1, 6) for h in (3, 5, 8))


def test_a_day_is_computed_once(spark):
    path, calls = feeds.shared_path(spark, "test-days"), []

    def compute(x):
        def run():
            calls.append(x)
            return spark.createDataFrame([(x,)], "x int")

        return run

    read = lambda day, x, **k: [r.x for r in results.day_result(spark, path, day, compute(x), **k).collect()]
    assert read("2024-01-01", 1) == [1] and read("2024-01-02", 2) == [2]
    before = files(path)
    assert read("2024-01-01", 9) == [1] and read("2024-01-02", 3, again=True) == [3] and calls == [1, 2, 3]
    assert [k for k in before if "2024-01-01" in k] == [k for k in files(path) if "2024-01-01" in k] and read("2024-01-02", 9) == [3]
