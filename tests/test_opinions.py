"""Opinions, samples and fund signals against their rules in plain Python, with missing and equal values."""

from __future__ import annotations

import random

from quantloom.operators import fusion, opinions


def fragment(text, turn, least):
    at = text.find(turn)
    if at < least:
        return None
    clause = text[at:]
    for stop in "。；":
        clause = clause.split(stop)[0]
    clause = clause.strip(" ")
    return clause if len(clause) > 4 else None


def plain_risk(rows):
    best = max(rows, key=lambda x: (x[3] or 0, -x[2]))
    parts = []
    for turn in opinions.OWN_TURNS:
        f = fragment(best[4] or "", turn, 1)
        if f and f not in parts:
            parts.append(f)
    for row in sorted(rows, key=lambda x: x[2]):
        if row[1] != best[1]:
            for turn in opinions.OTHER_TURNS:
                f = fragment(row[4] or "", turn, 0)
                if f and f not in parts:
                    parts.append(f)
                    break
    if best[8]:
        parts.append(f"止损{best[8]}%")
    target = best[6] or best[7]
    suffix = (["+".join(best[5]) + "推荐"] if best[5] else []) + ([f"目标{target:.0f}"] if target else [])
    return best[1], (best[4] or "") + (f" ({', '.join(suffix)})" if suffix else ""), "；".join(parts[:3])


def test_debated(spark):
    r = random.Random(3)
    bits = ["但估值偏高了", "虽然增长放缓", "不过短", "需注意量能萎缩", "风险在业绩承压", "警惕获利了结", "空方占优势中", "看好", "。", "；", " ", "好"]
    rows = []
    for code in range(150):
        for pos, model in enumerate(r.sample("abcdef", r.randint(1, 5))):
            text = r.choice([None, "", "".join(r.choice(bits) for _ in range(r.randint(1, 9)))])
            rows.append((code, model, pos, r.choice([None, 0, 5, 9]), text, r.choice([None, [], ["E1"], ["E1", "E2"]]), r.choice([None, 0.0, 12.5, 13.5]), r.choice([None, 0.0, 7.4]), r.choice([None, 0, 8])))
    df = spark.createDataFrame(rows, "code int, model string, pos int, score int, reasoning string, experts array<string>, baseline double, conservative double, stop_loss_pct int")
    got = {x.code: (x.model, x.reason, x.risk) for x in opinions.debated(df.repartition(3)).collect()}
    assert got == {c: plain_risk([x for x in rows if x[0] == c]) for c in range(150)}
    assert opinions.debated(df.limit(0)).count() == 0


def test_votes_and_borda_rows(spark):
    rows = [("a", 1, " 7 ", "", None, None, None, "first"), ("b", 2, "7", "name", "", 90, 5, ""), ("c", 3, "7", "other", "sec", 60, 1, "third"), ("a", 4, "8", None, None, 80, None, None), ("a", 5, " ", "x", "x", 99, 5, "x"), ("a", 6, None, "x", "x", 99, 5, "x")]
    p = spark.createDataFrame(rows, "model string, pos int, code string, name string, sector string, score int, stars int, reasoning string")
    got = {x.code: tuple(x)[1:] for x in opinions.panel_picks(p).collect()}
    assert got == {"7": ("name", "sec", 3, 73.3, 3.0, 83.3), "8": ("", "", 1, 80.0, 3.0, 80.0)}
    votes = [tuple(x) for x in opinions.breakout_votes(spark.createDataFrame([(1, "x", None, "n1", "r1"), (2, "y", 5, "n2", "r2"), (3, "x", 0, "n3", "r3"), (4, "y", 5, "n4", "r4"), (5, "", 9, "", "")], "pos int, code string, score int, name string, reasoning string")).orderBy("place").collect()]
    assert votes == [(1, "y", 2, 5.0, "n2", "r2"), (2, "x", 2, 0.0, "n1", "r1")]
    b = fusion.borda(p.where("trim(code) <> ''").withColumns({"rank": p["pos"], "code": p["code"].substr(1, 3)}).selectExpr("model", "rank", "trim(code) code", "score", "pos", "name", "sector", "reasoning")).orderBy("place").collect()
    assert [(x.code, x.name, x.sector, list(x.reasonings)) for x in b] == [("7", "name", "sec", ["[a] first", "[c] third"]), ("8", "", "", [])]


def test_experts_and_context(spark):
    logs = [("E1", [("1", None, None), (None, "n", 50.0)]), ("E2", [])]
    df = spark.createDataFrame([(None, 0, logs), ("m", 1, [("E1", [("2", "x", 1.0)])]), ("n", 2, None)], "model string, pos int, logs array<struct<expert:string,picks:array<struct<code:string,name:string,score:double>>>>")
    rows = sorted((x.expert, x.pos, x.code, x.name, x.stars, x.score, x.voter) for x in opinions.by_expert(df).collect())
    assert rows == [("E1", 0, "", "n", 3.0, 50.0, "unknown"), ("E1", 0, "1", "", 3.0, 70.0, "unknown"), ("E1", 1, "2", "x", 3.0, 1.0, "m")]
    pick = "array<struct<code:string,name:string,score:int,stars:int,reasoning:string>>"
    answers = spark.createDataFrame([("a", 0, "t", [("1", "n", 70, 4, "r" * 99), (None, "", None, None, None)]), ("b", 1, "t", []), ("c", 2, "x\ny", None), ("d", 3, None, None)], f"model string, pos int, text string, picks {pick}")
    assert [x.line for x in opinions.debate_context(answers).orderBy("pos").collect()] == ["【a】的选择：\n  • 1 n（4星/70分）: " + "r" * 80 + "\n  • ?（?星/?分）: ", "【b】未给出有效选择", "【c】: x y...", "【d】: ..."]


def test_samples_and_fields(spark):
    r = random.Random(9)
    lists = {f"s{k}": [str(r.randrange(40)) for _ in range(r.randint(0, 25))] + [""] for k in range(6)}
    lists = {s: list(dict.fromkeys(codes)) for s, codes in lists.items()}
    members = spark.createDataFrame([(s, k, i, c) for k, (s, codes) in enumerate(lists.items()) for i, c in enumerate(codes)], "sector string, sector_pos int, pos int, code string").repartition(3)
    home = {}
    for s, codes in lists.items():
        for c in codes:
            if c:
                home.setdefault(c, s)
    for most in (1, 3, 5, 30):
        kept = list(dict.fromkeys(c for codes in lists.values() for c in [x for x in codes if x][:most])) if len(home) > 6 * most else list(home)
        got = [(x.code, x.sector) for x in opinions.sampled_members(members, 6, most).orderBy("place").collect()]
        assert got == [(c, home[c]) for c in kept]
    rows = spark.createDataFrame([("a", None, 0, "", None), ("b", 2.0, 5, "x", "own"), ("c", 0.0, None, None, "")], "code string, borda_score double, model_count int, consensus_level string, sector string")
    lookup = spark.createDataFrame([("a", 7.5, 3, "", "up"), ("b", 1.0, 1, "y", "z")], "code string, borda_score double, model_count int, consensus_level string, sector string")
    industries = spark.createDataFrame([("a", "i"), ("c", "ind")], "code string, industry string")
    assert {tuple(x) for x in opinions.filled_fields(rows, lookup, industries).collect()} == {("a", 7.5, 3, "strong", "up"), ("b", 2.0, 5, "x", "own"), ("c", 0.0, 0, "single", "ind")}


def test_fund_signals(spark):
    r = random.Random(4)
    sector = {str(c): f"s{c % 9}" for c in range(40) if c % 5}
    quote = lambda pos: (pos, f" {r.randrange(40)}", f"n{pos}", r.choice([None, -1.0, 2.25, 3.5, 4.0]), r.choice([None, 1e8, 5e8, 6e8, 11e8, 12e8]))
    for _ in range(6):
        gainers, listed = [quote(i) for i in range(6)], [quote(i) for i in range(30)]
        seen = {}
        for _, code, name, change, amount in gainers:
            s = sector.get(code.strip())
            if s and (s not in seen or (change or 0) > seen[s][2]):
                seen[s] = [code.strip(), name, change or 0.0, (amount or 0) / 1e8, "gainer"]
        for _, code, name, change, amount in listed:
            s, units = sector.get(code.strip()), (amount or 0) / 1e8
            if s in seen:
                if units > 5:
                    seen[s][4] += "+active"
                    seen[s][3] = units
            elif s and units > 10:
                seen[s] = [code.strip(), name, change or 0.0, units, "volume"]
        want = sorted(((s, *v) for s, v in seen.items()), key=lambda x: -x[3])
        q = "pos int, code string, name string, change double, amount double"
        got = opinions.active_sectors(spark.createDataFrame(gainers, q), spark.createDataFrame(listed, q), spark.createDataFrame(list(sector.items()), "code string, sector string"))
        assert [tuple(x)[1:] for x in got.orderBy("place").collect()] == want


def test_slim_profile(spark):
    from quantloom.operators import profiles

    names = "sector pe pb cap price change days forecast forecast_range holder_change rps goodwill_ratio pledge_ratio trades discount margin_change score signal bias avg_cost profit_ratio concentration inflow virtual".split()
    kinds = dict.fromkeys(names, "double") | dict.fromkeys(("sector", "forecast", "forecast_range", "signal"), "string") | dict.fromkeys(("days", "trades", "score", "rps"), "int") | {"virtual": "boolean"}
    full = dict(sector="s", pe=10.5, pb=1.0, cap=20.0, price=3.0, change=-2.25, days=7, forecast="up", forecast_range="1-2", holder_change=-3.0, rps=80, goodwill_ratio=1.5, pledge_ratio=2.25, trades=2, discount=0.0, margin_change=0.0, score=70, signal="BUY", bias=1.0, avg_cost=9.5, profit_ratio=0.625, concentration=0.0625, inflow=-10.5, virtual=True)
    rows = [("1", "n", *[full[k] for k in names]), ("2", None, *[None] * len(names)), ("3", "", *[0 if kinds[k] == "int" else None for k in names])]
    df = spark.createDataFrame(rows, "code string, name string, " + ", ".join(f"{k} {kinds[k]}" for k in names))
    got = {x.code: x.profile for x in profiles.slim_profile(df).collect()}
    assert got["1"] == "1 n | 板块:s | PE=10.5 PB=1.0 市值=20.0 现价=3.0 近20日=-2.2%(7日) | 业绩预告:up1-2 | 股东户数:减少3.0% | 板块RPS=80 | 商誉率=1.5% 质押率=2.2% | 大宗交易:2笔 | 融资余额5日:减0.0% | 筹码: 均成本=9.5 获利比=62% 集中度=0.062 5日主力净流入=-10万 | 量化评分=70分(BUY) 乖离率(MA5)=+1.0% [盘中实时]"
    assert got["2"] == "2  | 板块:未知 | PE=N/A PB=N/A 市值=N/A 现价=N/A 近20日=N/A" and got["3"].endswith("近20日=N/A | 板块RPS=0")
    fields = {x.code: (x.a, x.b) for x in profiles.slim_profile(df).select("code", profiles.profile_field("profile", "近20日", r"[+\-]?[\d.]+%").alias("a"), profiles.profile_field("profile", "PE", r"[\d.]+").alias("b")).collect()}
    assert fields == {"1": ("-2.2%", "10.5"), "2": ("", ""), "3": ("", "")}


def test_orders_by_priority(spark):
    p = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b"), (4, "c")], "pos int, provider string")
    names = lambda df: [x.provider for x in df.orderBy("place").collect()]
    assert names(opinions.panel_members(p, ("c", "x"), 2)) == ["c", "a"] and names(opinions.panel_members(p, (), 9)) == ["a", "b", "c"]
    assert names(opinions.panel_members(p, ("c",), 2, chosen=("z", "b", "a"))) == ["z", "b"]
    rows = [(1, True, True, None, None), (2, False, None, "a1p", None), (3, None, False, "", "量价齐升"), (4, True, False, "p", None), (5, None, None, None, None), (6, True, True, "1p", "")]
    df = spark.createDataFrame(rows, "pos int, chan_buy boolean, wave_bull boolean, chan_buy_detail string, wave_bull_detail string")
    assert [(x.pos, x.priority) for x in opinions.report_order(df).orderBy("place").collect()] == [(1, 0), (6, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
