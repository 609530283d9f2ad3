"""Staged lookups against the loops that they stand for."""

from __future__ import annotations

import random

from quantloom.operators import naming


def looked_up(name, keys, forms):
    for f in forms:
        hit = next((k for k in keys if k[0] == f(name)), None)
        if hit:
            return (*hit[:2], "exact")
    hit = next((k for k in keys if name in k[0] or k[0] in name), None)
    return (*hit[:2], "contained") if hit else (None, None, None)


def test_resolve_and_members_equal_loops(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abII") for _ in range(n))
    keys = list({k: (k, f"v{i}", i) for i, k in enumerate(word(r.randint(2, 6)) for _ in range(60))}.values())
    keys = sorted(keys, key=lambda k: k[2])
    names = [word(r.randint(1, 9)) for _ in range(200)] + ["zz", "c zz II", "II", None, ""] + [keys[0][0]] * 3
    aliases = [("zz", "gold"), ("z", "coal"), ("c zz II more", "tin")]
    listed = [(v, f"c{i}") for i, (_, v, _) in enumerate(keys) if i % 3]
    catalogue = [("p1", "gold mines"), ("p2", "coal"), ("p3", "ab goods"), ("p4", None), ("p5", "old gold coal")]
    one = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    n, k = one([(x,) for x in names], "name string"), one(keys, "key string, value string, ord int")
    forms = (lambda c: c, naming.suffixed("II"), naming.stripped("I"))
    plain = (lambda x: x, lambda x: x + "II", lambda x: x.rstrip("I"))
    want = {x: looked_up(x, keys, plain) for x in names if x}
    got = {x.name: (x.key, x.value, x.stage) for x in naming.resolve(n, k, forms).collect()}
    assert got == want | {"": (None, None, None)}
    assert {"exact", "contained", None} <= {s for _, _, s in want.values()}

    found = {}
    for name, (_, value, stage) in want.items():
        own = {(c, stage) for v, c in listed if v == value}
        if not own:
            words = [w for a, w in aliases if a in name or name in a] or [name.replace("II", "").strip()]
            own = {(c, "keyword") for c, industry in catalogue if industry and any(w and w in industry for w in words)}
        if own:
            found[name] = own
    m = naming.members(n, k, one(listed, "value string, code string"), one(catalogue, "code string, industry string"), one(aliases, "alias string, keyword string"), forms, ("II",))
    got = {}
    for x in m.collect():
        got.setdefault(x.name, set()).add((x.code, x.stage))
    assert got == found and {s for own in found.values() for _, s in own} == {"exact", "contained", "keyword"}


def test_no_stage_compares_all_with_all(spark):
    names, keys = spark.range(50).selectExpr("cast(id as string) as name"), spark.range(40).selectExpr("cast(id * 3 as string) as key", "id as value", "id as ord")
    plan = naming.either_way(names, keys)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and plan.count("BroadcastNestedLoopJoin") == 2  # one row of lengths each
    assert naming.resolve(names.limit(0), keys).count() == 0
    assert {x.stage for x in naming.resolve(names, keys.limit(0)).collect()} == {None}
