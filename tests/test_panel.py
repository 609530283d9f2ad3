"""Consensus of a panel, typed picks and ratios: ties, defaults and empty input."""

from __future__ import annotations

import json

from quantloom.operators import picks, radar, ratios

ANSWER = "model string, pos long, trend string, temperature string, phase string, score long, reasoning string, signals string, summary string, hint string, advice string"
PREDICTION = "model string, pos long, at int, concept string, confidence double, stage string, signals string, space string, reasoning string, risk string, leaders array<string>, etfs array<struct<code:string,name:string>>"


def test_market_consensus(spark):
    rows = [("a", 1, "up", None, "", 50, "", "s1", "", "h", None), ("b", 2, "down", "hot", "x", 51, "why", None, "sum", "", "buy"), ("c", 3, "down", "cold", "y", None, "r", "s3", "more", "k", "sell"), ("d", 4, "up", "cold", "y", None, "q", "s4", None, None, ""), ("e", 5, "", "hot", None, None, "z", "s5", None, None, "x")]
    got = radar.market_consensus(spark.createDataFrame(rows, ANSWER)).collect()
    assert len(got) == 1
    g = got[0]
    assert (g.trend, g.temperature, g.phase, g.score) == ("up", "hot", "y", 50)  # ties: the first seen; 50.5 to even
    assert (g.reasoning, g.signals, g.summary, g.hint, g.advice) == ("[b] why; [c] r; [d] q", "[a] s1; [c] s3; [d] s4", "sum", "h", "[b] buy; [c] sell; [e] x")
    none = radar.market_consensus(spark.createDataFrame([], ANSWER)).collect()
    assert [tuple(x) for x in none] == [("sideways", "normal", "", 50, "", "", "", "", "")]


def test_concept_consensus(spark):
    e = lambda *codes: [(c, f"n{c}") for c in codes]
    rows = [
        ("a", 1, 0, " gold ", 80.0, "peak", "s1", "", "r1", "k", ["1", "2", "1"], e("E1", "")), ("a", 1, 1, "oil", None, "", "", "sp", "", "", None, None), ("b", 2, 0, "gold", None, "early", None, "wide", "r2", "", ["2", "", None, "3", "4", "5", "6"], e("E1", "E2", "E3", "E4")),
        ("b", 2, 1, "oil", 70.0, None, "x", "", "", "z", [], e(None)), ("c", 3, 0, "", 99.0, "peak", "", "", "", "", None, None), ("c", 3, 1, None, 99.0, "peak", "", "", "", "", None, None), ("c", 3, 2, "tin", 99.0, "late", "t", "", "w", "", None, None),
    ]
    got = {x.concept: x for x in radar.concept_consensus(spark.createDataFrame(rows, PREDICTION)).collect()}
    assert [(x.concept, x.votes, x.confidence) for x in sorted(got.values(), key=lambda x: x.rank)] == [("gold", 2, 75.0), ("oil", 2, 70.0), ("tin", 1, 99.0)]
    g = got["gold"]
    assert (g.stage, g.signals, g.space, g.reasoning, g.risk, list(g.leaders), [x.code for x in g.etfs]) == ("peak", "s1", "wide", "[a] r1; [b] r2", "k", ["1", "2", "3", "4", "5"], ["E1", "E2", "E3"])
    assert (got["oil"].stage, got["oil"].space, got["oil"].leaders, got["oil"].etfs, got["oil"].risk) == ("unknown", "sp", None, None, "z")
    assert radar.concept_consensus(spark.createDataFrame([], PREDICTION)).count() == 0
    many = [("a", i, 0, f"c{i % 12}", 1.0, "", "", "", "", "", None, None) for i in range(40)]
    assert [x.concept for x in radar.concept_consensus(spark.createDataFrame(many, PREDICTION)).orderBy("rank").collect()] == ["c0", "c1", "c2", "c3", "c4", "c5", "c6", "c7"]


def test_sectors_switch_over(spark):
    panel = lambda rows: spark.createDataFrame(rows, "sector string, rank int, score int, pos long")
    screen = spark.createDataFrame([(s, n, k) for k, (s, n) in enumerate([("b", 60), ("a", 90), ("d", 90), ("d", 10), ("e", 90), ("f", 1), (" ", 99), (None, 99)])], "sector string, score int, pos long")
    names = lambda rows: [(x.sector, x.source) for x in radar.chosen_sectors(panel(rows), screen).orderBy("place").collect()]
    two = [(" a", 1, None, 1), ("x", None, 5, 2), ("x ", 1, 5, 3), ("", 1, 1, 4)]
    assert names(two) == [("x", "panel"), ("a", "panel"), ("d", "screen"), ("e", "screen"), ("b", "screen")]
    assert names([*two, ("y", 2, 2, 5)]) == [("x", "panel"), ("a", "panel"), ("y", "panel")]
    assert names([]) == [("d", "screen"), ("a", "screen"), ("e", "screen"), ("b", "screen"), ("f", "screen")]
    by = {x.sector: x for x in radar.sector_votes(panel(two)).collect()}
    assert (by["x"].mean_rank, by["x"].votes, by["a"].mean_score) == (3.0, 2, 70.0)


def plain_picks(answer):
    def number(x, kind, default):
        try:
            return kind(x)
        except (TypeError, ValueError):
            return default

    try:
        found = json.loads(answer)["picks"]
    except (TypeError, ValueError, KeyError):
        return []
    out = []
    for p in found if isinstance(found, list) else ():
        if isinstance(p, dict) and str(p.get("code", "")).strip():
            prices = p.get("target_prices")
            targets = {k: number(prices.get(k, 0), float, 0.0) for k in picks.TARGETS} if isinstance(prices, dict) else {}
            out.append((number(p.get("rank", 99), int, 99), str(p["code"]).strip(), number(p.get("score", 70), float, 70.0), str(p.get("reasoning", ""))[:300], targets, number(p.get("stop_loss_pct", 0), float, 0.0)))
    return sorted(out, key=lambda x: x[0])[:20]


def test_typed_picks(spark):
    odd = [
        {"code": "1", "rank": 3, "score": "88.5", "target_prices": {"conservative": "7", "baseline": None, "optimistic": 9}}, {"code": " 2 ", "rank": "1", "stop_loss_pct": "5.5"}, {"code": "3", "rank": "1.5", "score": None}, {"code": "", "rank": 0},
        {"rank": 0}, "text", 7, None, [], {"code": 600519, "rank": 2.9, "score": [], "reasoning": "x" * 400, "target_prices": []}, {"code": "5", "rank": {}, "score": "high", "target_prices": {}, "stop_loss_pct": {}}, {"code": "6", "rank": 3, "recommended_by_experts": ["a", "b"], "reasoning": "é"},
    ]
    answers = [json.dumps({"picks": odd}), json.dumps({"picks": [{"code": str(i), "rank": 50 - i % 40} for i in range(60)]}), json.dumps({"picks": "none"}), json.dumps({"other": 1}), "no json", "", None, json.dumps({"picks": []})]
    df = spark.createDataFrame(list(enumerate(answers)), "id int, answer string")
    got = {}
    for r in picks.typed_picks(df).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.rank, r.code, r.score, r.reasoning, dict(r.targets), r.stop_loss_pct))
        assert r.place == len(got[r.id]) and (list(r.experts) if r.experts else None) == (["a", "b"] if r.id == 0 and r.code == "6" else None)
    want = {i: p for i, a in enumerate(answers) if (p := plain_picks(a))}
    assert got == want and len(want[1]) == 20 and len(want[0]) == 6


def test_ratios(spark):
    rows = [("a", "h", d, v) for d, v in ((1, 100.0), (2, 80.0), (3, 90.0))] + [("b", "h", 1, 5.0)] + [("c", "h", 1, 0.0), ("c", "h", 2, 9.0)] + [("a", "m", d, float(d)) for d in range(1, 9)] + [("b", "m", 1, 4.0), ("b", "m", 2, None), ("c", "x", 1, 1.0), ("c", "x", 2, 1.0)]
    df = spark.createDataFrame(rows, "code string, family string, d int, value double")
    got = {(r.code, r.family): (r.latest, r.earlier, r.change) for r in ratios.period_ratios(df, {"h": (1, False), "m": (4, True)}).collect()}
    assert got == {("a", "h"): (90.0, 80.0, 12.5), ("a", "m"): (8.0, 4.0, 100.0), ("b", "m"): (0.0, 4.0, -100.0)}
    assert ratios.period_ratios(df, {"h": (2, False)}).select("code", "earlier").collect() == [("a", 100.0)]
    sheets = spark.createDataFrame([("a", 1, 9.0, 9.0), ("a", 2, None, 10.0), ("b", 1, 5.0, None), ("c", 1, 5.0, 0.5), ("d", 1, 1.0, 3.0)], "code string, d int, goodwill double, equity double")
    assert {r.code: r.goodwill_ratio for r in ratios.goodwill_ratio(sheets).collect()} == {"a": 0.0, "b": 500.0, "c": 500.0, "d": 33.3}
    trades = spark.createDataFrame([("a", i % 40, i, None if i % 2 else float(i)) for i in range(45)] + [("b", 1, 1, None)], "code string, d int, pos int, discount double")
    last = sorted(((i % 40, i) for i in range(45)), reverse=True)[:30]
    known = [i for _, i in last if i % 2 == 0]
    assert {r.code: (r["count"], r.mean_discount) for r in ratios.recent_trades(trades).collect()} == {"a": (30, round(sum(known) / len(known), 2)), "b": (1, None)}
