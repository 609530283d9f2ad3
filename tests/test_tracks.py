"""The merge of both tracks against its rules, step by step in plain Python."""

from __future__ import annotations

import random

import pytest

from quantloom.plans import funnel


@pytest.mark.parametrize("regime", ["bull", "bear"])
def test_merged_tracks_and_first_layer(spark, regime):
    r = random.Random(regime)
    scored = [(c, r.randrange(200, 900), regime) for c in range(300)]
    pattern = [(c, r.choice((0, 0, 10, 35, 70, 90)), r.random() < 0.2) for c in range(0, 300, 2)] + [(999, 50, False)]
    got = funnel.merged_tracks(spark.createDataFrame(scored, "code long, quant long, regime string"), spark.createDataFrame(pattern, "code long, bull int, excluded boolean"))
    share = 0.05 if regime == "bear" else 0.10
    n = max(20, min(200, int(len(scored) * share)))
    quant = {c: q for c, q, _ in sorted(scored, key=lambda x: (-x[1], x[0]))[:n]}
    bulls = {c: b for c, b, out in pattern if b > 0 and not out}
    scores, gone = {c: q for c, q, _ in scored}, {c for c, _, out in pattern if out}
    want = {}
    for c in (quant | bulls).keys() & scores.keys() - gone:
        source = "dual" if c in quant and c in bulls else "quant" if c in quant else "pattern"
        want[c] = (scores[c], bulls.get(c, 0), source)
    assert {x.code: (x.quant_score, x.pattern_score, x.source) for x in got.collect()} == want
    assert gone & quant.keys() and any(s == "pattern" and q > 0 for q, _, s in want.values())  # vetoed quant codes, scored pattern codes

    top = max(q for q, _, _ in want.values())
    score = lambda q, p, s: q / top * 100 * 0.6 + min(100, p * 100 / 70) * 0.4 + 10 * (s == "dual")
    rows = funnel.first_layer(got).orderBy("rank").collect()
    order = sorted(want, key=lambda c: (-int(score(*want[c]) * 10 + 0.5), c))[:n]
    assert [x.code for x in rows] == order


def test_tracks_without_patterns_or_codes(spark):
    scored = spark.createDataFrame([(1, 10, "bull"), (2, 20, "bull")], "code long, quant long, regime string")
    none = spark.createDataFrame([], "code long, bull int, excluded boolean")
    assert {(x.code, x.source, x.pattern_score) for x in funnel.merged_tracks(scored, none).collect()} == {(1, "quant", 0), (2, "quant", 0)}
    assert funnel.merged_tracks(scored.limit(0), none).count() == 0
