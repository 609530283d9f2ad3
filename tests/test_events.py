"""Event clusters and votes against the rule carried out one event after the other."""

from __future__ import annotations

import random

from quantloom.operators import events

SCHEMA = "kind string, pos long, title string, certainty long, model string, beneficiaries array<struct<code:string,score:double,logic:string>>"


def one_by_one(rows):
    """{kind: [(cluster title, [events])]} in the order of beginnings; a wordless title starts its list anew."""
    kinds = {}
    for row in sorted(rows, key=lambda x: x[1]):
        clusters = kinds.setdefault(row[0], {})
        t = (row[2] or "")[:20]
        home = next((name for name in clusters if any(len(w) > 1 and w in t for w in name.split()[:3])), None)
        if home is None:
            clusters[t] = [row]
        else:
            clusters[home].append(row)
    return kinds


def votes(rows):
    seen = {}
    for _, _, _, _, model, gains in rows:
        for code, score, logic in gains or ():
            if code:
                b = seen.setdefault(code, {"votes": 0, "score": score or 0.0, "logic": logic or "", "models": []})
                b["votes"] += 1
                b["models"].append(model)
                if (score or 0.0) > b["score"]:
                    b["score"], b["logic"] = score, logic or ""
    return [(c, b["votes"], b["score"], b["logic"], b["models"]) for c, b in sorted(seen.items(), key=lambda x: (-x[1]["votes"], -x[1]["score"]))][:10]


def table(seed):
    r = random.Random(seed)
    words = ["rate", "cut", "oil", "a", "bank", "ban", "of", "x", "gas", "banking", "é", "利率", "下调"]
    rows = []
    for i in range(r.randint(1, 160)):
        gains = [(r.choice(["1", "2", "3", "", None]), r.choice([None, 1.0, 5.0, 9.0]), r.choice(["p", "q", None])) for _ in range(r.randint(0, 3))]
        title = None if r.random() < 0.03 else " ".join(r.choice(words) for _ in range(r.randint(0, 5)))
        rows.append((r.choice(["k", "k", "k", "other", None]), i * 3, title, r.choice([None, 10, 50, 90]), f"m{i % 4}", r.choice([gains, gains, None])))
    r.shuffle(rows)
    return rows


def test_twenty_tables_equal_one_by_one(spark):
    rows = [(f"{seed} {kind}", *rest) for seed in range(20) for kind, *rest in table(seed)] + [(None, *rest) for kind, *rest in table(20) if kind is None]
    want = one_by_one(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = events.event_clusters(df).collect()
    assert len(got) == len({(k, (t or "")[:20]) for k, _, t, *_ in rows})
    for x in got:
        assert x.cluster == next(name for name, own in want[x.kind].items() if any((e[2] or "")[:20] == x.t for e in own))
    found = {}
    for x in events.merged_events(df).orderBy("kind", "rank").collect():
        found.setdefault(x.kind, []).append((x.cluster, x.model_votes, x.certainty, x.event, [(b.code, b.votes, b.score, b.logic, list(b.models)) for b in x.beneficiaries or ()]))
    assert found.keys() == want.keys() and None in want
    for kind, clusters in want.items():
        base = {name: max(own, key=lambda e: (e[3] or 0, -e[1])) for name, own in clusters.items()}
        best = sorted(clusters, key=lambda name: (-len(clusters[name]), -(base[name][3] or 0)))[:5]
        assert found[kind] == [(n, len(clusters[n]), base[n][3] or 0, base[n][2], votes(clusters[n])) for n in best]


def test_chains_wait_for_each_other(spark):
    # each title holds a word of the one before: every second one begins a cluster
    rows = [("k", i, f"w{i:03} w{i + 1:03}", 1, "m", None) for i in range(30)]
    got = {x.at: x.place for x in events.event_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i - i % 2 for i in range(30)}


def test_no_events(spark):
    assert events.merged_events(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rounds_read_what_is_open(spark, monkeypatch):
    """Each title waits for the one before it: the rows of a round are those of open titles, not all."""
    made, plain = [], events.stored

    def counted(df):
        out = plain(df)
        if "word" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(events, "stored", counted)
    rows = [("k", k, f"w{k} w{k + 1}", 1, "m", []) for k in range(8)]
    got = {(r.t, r.place) for r in events.event_clusters(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(x[2], group[0][1]) for group in one_by_one(rows)["k"].values() for x in group}
    assert got == want
    assert len(made) > 4 and made[-1] == 0 and made[2] < made[0] and made[3] < made[1]
