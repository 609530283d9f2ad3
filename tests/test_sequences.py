"""Windowed patterns against loops over each series."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd

from quantloom.operators import sequences


def expected(f, k):
    """The patterns of one series of bars (pandas, by date), with pivots of k bars to either side."""
    h, low, c, v, n = *(f[x].to_numpy(float) for x in ("h", "l", "c", "v")), len(f)
    pivots = []  # (bar, price, volume), a bar's high before its low
    for i in range(k, n - k):
        others = [*range(i - k, i), *range(i + 1, i + k + 1)]
        pivots += [(i, h[i], v[i])] * all(h[i] > h[j] for j in others) + [(i, low[i], v[i])] * all(low[i] < low[j] for j in others)
    out = {}
    if n < 30 or len(pivots) < 3:
        return out
    mean = lambda m: c[-m:].mean()
    last = [p for b, p, _ in pivots if b == pivots[-1][0]]
    if n >= 50:
        top = max(range(n - 7, n), key=lambda i: (h[i], -i))
        if top < n - 1 and h[top] == max(h[-90:] if n >= 90 else h[-30:]) and mean(20) >= 1.08 * mean(50) and min(low[top:]) >= (max(last) + h[top]) / 2:
            out["FLAGU"] = {"A": (pivots[-1][0], max(last)), "B": (top, h[top])}
        bottom = min(range(n - 7, n), key=lambda i: (low[i], i))
        if bottom < n - 1 and low[bottom] == min(low[-90:] if n >= 90 else low[-30:]) and mean(20) <= 0.92 * mean(50) and max(h[bottom:]) <= (min(last) + low[bottom]) / 2:
            out["FLAGD"] = {"A": (pivots[-1][0], min(last)), "B": (bottom, low[bottom])}
    strong = [x for x in pivots if x[1] >= np.quantile(h, 0.7)][-2:]
    if n >= 60 and len(strong) == 2:
        dif = (pd.Series(c).ewm(span=12, adjust=False).mean() - pd.Series(c).ewm(span=26, adjust=False).mean()).to_numpy()
        before, now = (dif[x[0]] for x in strong)
        if strong[1][1] >= 0.97 * strong[0][1] and now < before and min(before, now) < 0:
            out["MACD_DIV"] = {}
    held = [x for x in pivots if x[1] <= np.quantile(low, 0.3) and x[2] > np.median(v)]
    if held and any(c[i] < held[-1][1] and v[i] > v[-20:].mean() for i in range(n - 5, n) if i > held[-1][0]):
        out["BREAK_SUPPORT"] = {}
    if n >= 60:
        out |= {"MA_BULL": {}} if mean(5) > mean(20) > mean(60) else {"MA_BEAR": {}} if mean(5) < mean(20) < mean(60) else {}
    return out


def test_sequences_equal_loops(spark):
    r, rows = random.Random(11), []
    for code in range(260):
        n, c, drift, kick = r.choice([20, 35, 49, 59, 60, 89, 90, 99, 100, 180, 260]), 1000.0, r.choice([-9, -4, 0, 4, 9]), r.choice([-3, -1, 1])
        for i in range(n):
            c = max(60, c + r.randint(-12, 12) + (drift if i > n - 60 else 0) * (1 if i < n - 5 else kick))
            rows.append((code, dt.date(2023, 1, 2) + dt.timedelta(days=i * 7 // 5), int(c), int(c) + r.randint(0, 10), int(c) - r.randint(0, 10), int(c), r.randint(1, 100)))
    bars = spark.createDataFrame(rows, "code long, d date, o long, h long, l long, c long, v long")
    got = {}
    for x in sequences.sequence_patterns(sequences.frames(bars)).collect():
        got.setdefault((x.code, x.timeframe), {})[x.pattern] = {k: (p.bar, p.price) for k, p in x.points.items()}
        assert x.direction == ("bullish" if x.pattern in ("FLAGU", "MA_BULL") else "bearish")
    want, table = {}, pd.DataFrame(rows, columns=["code", "d", "o", "h", "l", "c", "v"])
    for code, f in table.groupby("code"):
        found = {"daily": expected(f, 5)}
        if len(f) >= 100:
            w = f.set_index(pd.to_datetime(f["d"])).resample("W-FRI").agg({"h": "max", "l": "min", "c": "last", "v": "sum"}).dropna()
            found["weekly"] = expected(w, 2)
        want |= {(code, frame): x for frame, x in found.items() if x}
    assert got == want
    assert {p for x in want.values() for p in x} == {"FLAGU", "FLAGD", "MACD_DIV", "BREAK_SUPPORT", "MA_BULL", "MA_BEAR"}


def test_one_exchange_and_no_bars(spark):
    bars = spark.createDataFrame([], "code long, d date, o long, h long, l long, c long, v long")
    series = sequences.frames(bars).select("code", "timeframe", "d", "h", "l", "c", "v").where("timeframe = 'daily'")
    found = sequences.sequence_patterns(series)
    assert found.count() == 0
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
