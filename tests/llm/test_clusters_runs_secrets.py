"""Centroid clustering, periodic runs and secrets against their definitions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantloom.llm import hadamard_clusters, periodic_runs, secret_models
from quantloom.llm.oracles import ORACLES
from quantloom.llm.queries import QUERIES
from tests.conftest import SMALL


# -- centroid clustering
def plain_clusters(vectors, k, rounds, seed="2:"):
    first = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for i, v in vectors)[:k]
    centroids = [list(v) for _, v in first]

    def near(v):
        d, c = min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(centroids))
        return c, d

    for _ in range(rounds):
        at = [near(v)[0] for _, v in vectors]
        for c in set(at):
            own = [v for (_, v), a in zip(vectors, at, strict=True) if a == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [near(v) for _, v in vectors], centroids


def test_op11_equals_sql(same):
    same(QUERIES["op11_centroid_clustering"], ORACLES["op11_centroid_clustering"])


def test_transform_keeps_distances_and_orders_by_sign_changes():
    x = np.random.default_rng(0).integers(-(1 << 24), 1 << 24, (50, 64))
    y = hadamard_clusters.walsh_hadamard(x)
    assert (((y[:25] - y[25:]) ** 2).sum(axis=1) == 64 * ((x[:25] - x[25:]) ** 2).sum(axis=1)).all()
    h = hadamard_clusters.walsh_hadamard(np.eye(64, dtype=np.int64))[hadamard_clusters.sequency_order(64)]
    assert np.count_nonzero(np.diff(h, axis=1), axis=1).tolist() == list(range(64))
    assert (h @ h.T == 64 * np.eye(64)).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from((1, 3, 200, 1 << 24)))
def test_search_equals_full_scan_with_ties(seed, k, spread):
    r = np.random.default_rng(seed)
    x, c = r.integers(-spread, spread + 1, (70, 64)), r.integers(-spread, spread + 1, (k, 64))
    c[k // 2 :] = c[: k - k // 2]  # equal centroids: the smaller number wins
    x[:10] = c[r.integers(0, k, 10)]
    to, distance, compared = hadamard_clusters.Search(c).nearest(x)
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (to == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert compared <= 70 * (k * 64 + 4 * k + 64)


def test_search_gives_up_centroids_early():
    r = np.random.default_rng(1)
    c = r.integers(-500, 500, (40, 1)) + r.integers(-20, 20, (40, 64))
    x = np.repeat(c, 10, axis=0) + r.integers(-20, 20, (400, 64))
    assert hadamard_clusters.Search(c).nearest(x)[2] < 0.5 * 400 * 40 * 64


def test_clusters_equal_plain_integers(spark):
    r = random.Random(3)
    rows = [(i, [r.choice((-0.5, 0.0, 0.25, 0.7501)) if d < 3 else float(r.randint(-1, 1)) for d in range(8)]) for i in range(60)]
    rows += [(60, rows[0][1]), (61, rows[0][1]), (61, rows[0][1]), (None, rows[1][1])]
    odd = [(70, None), (71, [1.0] * 7), (72, [1.0] * 9), (73, [None] + [1.0] * 7), (74, [float("nan")] * 8), (75, [float("inf")] + [0.0] * 7), (76, [1e30] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("Cluster", F.lit("x")).repartition(5)
    got = hadamard_clusters.cluster_vectors(df, k=7, rounds=3, width=8).collect()
    ints = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    seeds = [x for x in ints if x[0] is not None]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in seeds)[:7]
    assert len(first) == 7
    want, centroids = plain_clusters_with(ints, [v for _, v in first], 3)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in got) == Counter((i, c, d) for (i, _), (c, d) in zip(ints, want, strict=True))
    for r in got:
        assert list(r.centroid) == centroids[r.cluster] and r.inertia == sum(d for _, d in want)
        assert r.cluster_inertia == sum(d for c, d in want if c == r.cluster) and r.n_cluster == sum(c == r.cluster for c, _ in want)


def plain_clusters_with(vectors, first, rounds):
    hashes = {i: v for i, v in enumerate(first)}
    centroids = [list(hashes[i]) for i in range(len(first))]

    def near(v):
        d, c = min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(centroids))
        return c, d

    for _ in range(rounds):
        at = [near(v)[0] for _, v in vectors]
        for c in set(at):
            own = [v for (_, v), a in zip(vectors, at, strict=True) if a == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [near(v) for _, v in vectors], centroids


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert hadamard_clusters.cluster_vectors(spark.createDataFrame([], schema)).collect() == []
    assert hadamard_clusters.cluster_vectors(spark.createDataFrame([(1, None), (2, [0.5])], schema)).collect() == []
    two = hadamard_clusters.cluster_vectors(spark.createDataFrame([(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.5] * 64)], schema)).collect()
    assert {(r.vec_id, r.distance) for r in two} == {(1, 0), (2, 0), (3, 0)} and len({r.cluster for r in two}) == 2


# -- periodic runs
def plain_runs(w, least=12):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j + q - i >= least:
                root = list(w[i : i + q])
                if not any(q % p == 0 and root == root[:p] * (q // p) for p in range(1, q)):
                    out.add((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def words(r, kind):
    n = r.randint(0, 260)
    if kind == 0:
        return [r.randint(0, 1) for _ in range(n)]
    if kind == 1:  # Fibonacci's words are full of runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 2:
        return [0] * n
    if kind == 3:  # powers with errors
        root = [r.randint(0, 1) for _ in range(r.randint(1, 70))]
        w = (root * 300)[:n]
        for _ in range(r.randint(0, 4)):
            if w:
                w[r.randrange(len(w))] = 2
        return w
    if kind == 4:  # stretches of short periods inside of long ones
        part = lambda: [[0], [0, 1], [0, 0, 1], [2]][r.randrange(4)] * r.randint(1, 30)
        root = sum((part() for _ in range(r.randint(1, 4))), [])
        return sum((root * r.randint(1, 3) + part() for _ in range(r.randint(1, 4))), [])
    x = [r.randint(0, 50) for _ in range(n)]
    return x + x[: r.randint(0, n)] + x


@pytest.mark.parametrize("short", [4, 8, 32])
@pytest.mark.parametrize("kind", range(6))
def test_runs_equal_scans_of_all_lags(kind, short):
    r = random.Random(kind)
    for _ in range(120):
        w = words(r, kind)
        assert periodic_runs.runs(np.array(w, np.int64), 12, short) == plain_runs(w), w
    if short < 12:
        w = words(r, kind)
        assert periodic_runs.runs(np.array(w, np.int64), short // 2, short) == plain_runs(w, short // 2), w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 3))
def test_runs_of_any_words(w, times):
    w = w * times
    assert periodic_runs.runs(np.array(w, np.int64), 12, 4) == plain_runs(w)


def test_one_word_repeated_and_long_periods_take_little():
    n = 60_000
    assert periodic_runs.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    r = np.random.default_rng(0)
    root = r.integers(0, 10**6, 9_000)
    assert (0, 45_000, 9_000) in periodic_runs.runs(np.tile(root, 5))
    w = np.concatenate((np.zeros(9_000, np.int64), np.ones(1, np.int64)) * 3)
    found = periodic_runs.runs(w)
    assert (0, 27_003, 9_001) in found and len(found) == 4


def test_find_runs(spark):
    text = "x " + "a b c " * 5 + "z\n" + "q\t" * 20 + "é"
    rows = [(1, text), (2, None), (3, ""), (4, " \n "), (5, "one two"), (1, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Runs", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = periodic_runs.find_runs(df).withColumn("longest", periodic_runs.longest_run()).withColumn("digest", periodic_runs.runs_digest()).collect()
    assert len(got) == 6 and set(got[0].asDict()) == {"doc_id", "text", "n_words", "runs", "collapsed", "longest", "digest"}
    for g in got:
        w = (g.text or "").split()
        want = plain_runs(w)
        assert [tuple(x) for x in g.runs] == want and g.n_words == len(w)
        drop = {i for s, n, q in want for i in range(s + q, s + n)}
        assert g.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
        assert g.digest == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert (g.longest is None) == (not want)
    one = next(g for g in got if g.doc_id == 1)
    assert tuple(one.longest) == (17, 20, 1) and one.collapsed == "x a b c z q é"
    assert periodic_runs.find_runs(df.limit(0)).count() == 0


def test_longest_run_breaks_ties(spark):
    df = spark.createDataFrame([([(9, 14, 1), (3, 14, 7), (3, 14, 2), (0, 13, 1)],), ([],), (None,)], "runs array<struct<start:long,length:long,period:long>>")
    assert [r[0] and tuple(r[0]) for r in df.select(periodic_runs.longest_run()).collect()] == [(3, 14, 2), None, None]


def test_op12_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 6000 or n_chars is null")
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "a b " * 9), (10**9, None), (10**9 + 7, "")], "doc_id long, text string"))
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    seen = 0
    for doc_id, text in docs.select("doc_id", "text").collect():
        if doc_id not in got:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want, r = plain_runs(w), got[doc_id]
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None, None, None)
        drop = {i for s, n, q in want for i in range(s + q, s + n)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()
        seen += bool(want)
    assert seen > 5


# -- secrets
def plain_base(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], secret_models.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["token", "PassWord", "passwd", "api_key", "APIKEY", "secret", "ſecret", "toKen", "=", ":", " ", "  ", '"', "'", "\n", "AKIA", "AKI", "AB12CD34EF56", "0a1b2c3d", "deadbeef", "é", "xyz.=-", "9"]), max_size=25))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert secret_models.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def model():
    from pydoc_data.topics import topics  # English prose with identifiers

    offers = secret_models.offered(iter(topics.values()), 4000)
    return secret_models.train([(t, label) for t, label, _ in offers])


def test_held_out_samples(model):
    assert model.held_out[0] > 0.97 and model.held_out[1] <= 0.001


def test_unseen_random_and_ordinary_tokens(model):
    r = random.Random(77)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(r.choices(base64, k=r.randint(20, 48))) for _ in range(500)]
    assert sum(model.score(k) > model.least for k in keys) >= 495
    names = ["getUserAccountNameById", "default_timeout_seconds", "customer-order-2023-11-05", "MAX_BUFFER_SIZE_BYTES", "ImageUploadController2", "payments/invoice/list", "backgroundcolorpicker", "session_manager_v12_test", "AbstractSingletonFactoryMethod", "internationalization"]
    assert [n for n in names if model.score(n) > model.least] == []


def test_find_secrets(spark, model):
    key = "q7RtVz0XkLp4Wm9sYbNc3HjD5fGe"
    rows = [
        (1, f"é key {key} end"), (2, f"see https://example.com/{key} there"), (3, "id 123e4567-e89b-12d3-a456-426614174000 and 12345678901234567890"), (4, None), (5, ""), (6, f'token = "{key}"'),
        (7, f"-{key}==, {key}"), (8, f"ü{key}"), (1, f"é key {key} end"), (9, "plain words only, default_timeout_seconds too"), (10, "a " * 200_000 + key),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Added", F.lit(1))
    got = secret_models.find_secrets(df, model).withColumn("clean", secret_models.redacted()).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "base", "added", "clean"}
    by = {r.doc_id: r for r in got}
    spans = {i: [r.text[s.start : s.end] for s in r.added] for i, r in by.items() if r.text}
    assert {i for i, s in spans.items() if s} == {1, 7, 10} and spans[1] == [key] and spans[7] == [key + "==", key] and spans[10] == [key]
    assert [tuple(s) for s in by[6].base] == [("assign", 0, 9 + len(key))] and by[6].added == []
    assert by[1].clean == "é key [secret] end" and by[7].clean == "-[secret], [secret]" and by[4].clean is None
    assert secret_models.find_secrets(df.limit(0), model).count() == 0


def test_samples_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text")
    one, many = (sorted(map(tuple, secret_models.label_samples(docs.repartition(n), sample=50).collect())) for n in (1, 7))
    assert one == many and 50 <= len(one) <= 100
    assert secret_models.label_samples(docs.limit(0)).count() == 0
    assert secret_models.train([]).held_out[0] > 0.9 and secret_models.train([(None, True), ("abcdefgh", None)]).least >= 12


def check_op13(spark, folder):
    rows = QUERIES["op13_secrets"](spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        want = plain_base(texts[r.doc_id])
        joined = [f"{k}:{s}:{e}" for k, s, e in want]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == joined
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex"))
    return {r.doc_id: r.spans for r in rows}


def test_op13_base_and_clean_texts(spark):
    assert not any("random" in s for s in check_op13(spark, SMALL).values())


def test_op13_planted_secrets(spark, tmp_path):
    from pydoc_data.topics import topics

    r, key = random.Random(5), lambda n: "".join(random.Random(n).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32))
    rows = [(i, t) for i, t in enumerate(topics.values())]
    for n in range(40):
        i, t = rows[n]
        at = t.index(" ", r.randrange(len(t) // 2))
        secret = (f"é {key(n)}", f'password: "{key(n)}"', f"AKIA{key(n).upper()[:16]}", f"{zlib.crc32(key(n).encode()):08x}" * 5)[n % 4]
        rows[n] = (i, f"{t[:at]} {secret} {t[at:]}")
    spark.createDataFrame([*rows, (10**6, None), (10**6 + 1, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spans = check_op13(spark, str(tmp_path))
    kinds = [{x.split(":")[0] for x in spans[n].split(",") if x} for n in range(40)]
    assert [n for n in range(40) if ("random", "assign", "access", "hex")[n % 4] not in kinds[n]] == []
    assert all("random" in kinds[n] for n in range(0, 40, 4))
    assert sum("random" in s for i, s in spans.items() if i >= 40) <= 1
