"""The training-data operators against brute force, held-out accuracy and awkward tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import cotraining, decontam, html_blocks, html_diff, language_id, line_dedup, mixing, ngram_join, pii_weak, quality_rules, shingles, url_filters
from quantloom.llm.components import connected
from quantloom.llm.oracles import ORACLES
from quantloom.llm.queries import QUERIES, URL_RULES

from ..conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(QUERIES)))
def test_matches_sql(name, same):
    same(QUERIES[name], ORACLES[name])


# -- line dedup


def brute_lines(rows, least):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for k, (_, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")} - {""}:
            held.setdefault(x, set()).add(k)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or len(held[key(x)]) < least]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


ROWS = [(1, None), (2, ""), (3, "a\n B \nc"), (4, "b\nB\t"), (5, "b\r\nx\n\n"), (5, "b\r\nx\n\n"), (None, "x\nÉ\né"), (7, "long " * 20_000 + "\nb")]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_line_dedup_brute_force(spark, limit):
    got = line_dedup.dedup_lines(documents(spark, ROWS).withColumn("N_LINES", F.lit("clash")), min_docs=2, filter_bits=1 << 12, broadcast_keys=limit)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(ROWS, 2)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_line_dedup_first_stays(spark, limit):
    got = line_dedup.dedup_lines(documents(spark, [(3, "x\ny"), (1, "q\nX\nx"), (2, "x")]), min_docs=2, keep="first", filter_bits=1 << 12, broadcast_keys=limit)
    assert {r.doc_id: r.text for r in got.collect()} == {1: "q\nX", 2: "", 3: "y"}


def test_line_dedup_filter_follows_the_lines(spark):
    assert line_dedup.bits_for(documents(spark, [(1, None), (2, "")]), "text") == line_dedup.LEAST_BITS
    many = spark.range(1000).select(F.repeat(F.lit("x\n"), 999).alias("text"))
    assert line_dedup.bits_for(many, "text") == 1 << 24
    assert line_dedup.dedup_lines(documents(spark, [(1, "x")]).where("false")).count() == 0


def test_two_blooms_never_miss():
    blooms = line_dedup.TwoBlooms(1 << 10)
    h = np.random.default_rng(0).integers(0, 2**63, 300).astype(np.uint64)
    blooms.add(h)
    blooms.add(h[:50])
    assert blooms.suspects(h[:50]).all()


# -- language ID


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(SMALL.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = language_id.train(docs, sample_docs=600, per_language=100)
    got = language_id.identify(docs, model).where(language_id.held_out("doc_id") & F.col("lang").isNotNull())
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    assert got.where("rejected").count() <= 3


def test_language_awkward_rows(spark):
    docs = documents(spark, [(1, None, "en"), (2, "", "en"), (3, "123 !?", "fr"), (None, "the cat", None), (5, "der Hund " * 50_000, "de")])
    model = language_id.train(documents(spark, [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de")] * 12)]))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language_id.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", True)
    assert got[5][0] == "de" and got[None][0] == "en"
    empty = language_id.train(docs.where("false"))
    assert {r.lang_pred for r in language_id.identify(docs, empty).collect()} == {"und"}


def test_language_bound_and_repeats(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("der Hund und die Katze", "de"), ("le chat est ici", "fr")] * 8)]
    docs = documents(spark, rows).withColumn("LANG_PRED", F.lit("clash"))
    few = language_id.train(docs, most_languages=2)
    assert "de" in few.languages and len(few.languages) == 2
    model = language_id.train(docs)
    assert model.languages == ["de", "en", "fr"]
    out = language_id.identify(docs, model)
    assert "LANG_PRED" not in out.columns and len({(r.text, r.lang_pred, r.score) for r in out.collect()}) == 3
    assert language_id.identify(docs.where("false"), model).count() == 0


# -- shared tables


def test_no_local_folder_on_a_cluster(spark):
    from quantloom.llm import runtime

    class Elsewhere:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="checkpoint"):
            runtime.shared_folder(Elsewhere)


def test_tables_are_released(spark):
    from quantloom.llm import runtime

    mark = runtime.tables()
    a, b = (runtime.materialize(spark.range(k)) for k in (3, 4))
    runtime.release(spark, mark, keep=1)
    assert b.count() == 4 and runtime.tables() == mark + 1
    with pytest.raises(Exception, match="(?i)not.*exist|not found"):
        a.count()
    runtime.release(spark, mark)


# -- quality classifier


def test_quality_and_toxicity(spark):
    d = SMALL.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    model = cotraining.train(docs, labels)
    got = cotraining.score_documents(docs, model).join(labels, "doc_id")
    x = got.select(F.avg(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("double")), F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.col("kept").cast("double"))), F.avg(F.when(F.col("toxic") == 1, F.col("kept").cast("double")))).first()
    assert x[0] > 0.97 and x[1] > 0.95 and x[2] < 0.25


def test_quality_on_held_out_labels(spark):
    """A third of the labels is never seen; rounds=1 is the supervised baseline."""
    d = SMALL.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    right = {}
    for rounds in (1, 4):
        model = cotraining.train(docs, labels.where(~unseen), rounds=rounds)
        got = cotraining.score_documents(docs, model).join(labels.where(unseen), "doc_id")
        right[rounds] = got.select(F.avg(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right[1] > 0.95 and right[4] >= right[1] - 0.01


def test_quality_of_words_alone(spark):
    """Documents that look alike and differ in their words; the metadata says the same as the words for most."""
    rng = random.Random(3)
    good, bad, common = (["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(40)] for _ in range(3))
    say = lambda own: " ".join(rng.choice(own if rng.random() < 0.3 else common) for _ in range(60))
    rows = [(k, say(good if k % 2 else bad), "en", ("g" if k % 2 else "b") if k % 10 < 8 else "x", 360) for k in range(600)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 300)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows).withColumn("KEPT", F.lit("clash"))
    model = cotraining.train(docs, labels)
    out = cotraining.score_documents(docs, model)
    got = {r.doc_id: r.quality_score for r in out.collect()}
    assert out.columns[-3:] == ["quality_score", "toxic_score", "kept"] and "KEPT" not in out.columns
    assert sum((got[k] >= 0.5) == bool(k % 2) for k in range(300, 600)) >= 290 and max(model.handed_over) > 0
    assert cotraining.score_documents(docs.where("false"), model).count() == 0


def brute_odds(words, labels, bucket):
    n = {c: sum(y == c for y in labels) for c in (0, 1)}
    k = {c: sum(bucket in w for w, y in zip(words, labels, strict=True) if y == c) for c in (0, 1)}
    odds = np.log((k[1] + 1) / (n[1] + 2)) - np.log((k[0] + 1) / (n[0] + 2))
    return max(-3, min(3, odds)) if k[0] + k[1] >= 2 else 0


def test_word_odds_against_brute_force():
    rng = np.random.default_rng(0)
    words = [np.unique(rng.integers(0, 30, 8)) for _ in range(40)]
    labels = rng.integers(0, 2, 40)
    odds = cotraining.word_odds(words, labels)
    assert all(odds[b] == pytest.approx(brute_odds(words, labels, b), abs=1e-5) for b in range(40))


def test_quality_without_labels(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "text " * 30_000, "en", "s", 5)])
    model = cotraining.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {(r.quality_score, r.toxic_score, r.kept) for r in cotraining.score_documents(docs, model).collect()} == {(0.5, 0.0, True)}


# -- URL filters

PAGES = [(1, "http://good.org/a", '<a href="http://friend.net/x">'), (2, "http://friend.net/", '<a href="//pal.net/">'), (3, "http://pal.net/q", None), *((10 + k, f"http://bad.com/de/{k}", "") for k in range(8)), (6, "http://evil.net/p", '<a href="http://bad.com/1"><a class=x href=http://BAD.com/2>'), (7, "http://mixed.net/p", '<a href="http://bad.com/1"><a href="http://good.org/2"><a href="http://pal.net/2">'), (8, None, None), (9, "nourl", "x"), (20, "http://A.Example.ORG:8/en/12?x#y", ""), (21, "x://example.org?q", "")]


def brute_rank(edges, seeds, damping, n):
    rank = {h: (1 - damping) * s for h, s in seeds.items()}
    own = dict(rank)
    for _ in range(n):
        new = dict(own)
        for (a, b), share in edges.items():
            new[b] = new.get(b, 0) + damping * rank.get(a, 0) * share
        rank = new
    return rank


def test_url_verdicts(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("Rule", F.lit(1)), URL_RULES).collect()}
    assert got[1] == ("good.org", "/a", "org/", "allow")
    assert got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("bad.com", "/de/0", "com/de/", "block")
    assert got[6][2:] == (None, "block") and got[7][3] == got[2][3] == got[3][3] == "allow"
    assert got[20] == ("a.example.org:8", "/en/12", None, "allow") and got[21] == ("example.org", "", None, "allow")


def test_rank_settles_early_and_without_edges(spark):
    s = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    none = spark.createDataFrame([], "src string, dst string, share double")
    assert [tuple(r) for r in url_filters.personalised_rank(none, s, 0.85).collect()] == [("a", pytest.approx(0.15))]
    loop = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, share double")
    got = {r.host: r["rank"] for r in url_filters.personalised_rank(loop, s, 0.5).collect()}
    assert got == pytest.approx({"a": 2 / 3, "b": 1 / 3}, abs=1e-6)
    slow = {r.host: r["rank"] for r in url_filters.personalised_rank(loop, s, 0.9).collect()}
    assert sum(slow.values()) == pytest.approx(1, abs=1e-5)  # no end but that it has settled
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.filter_urls(pages, URL_RULES).count() == 0


def brute_verdicts(pages, rules, damping=0.85, iterations=300, ratio=0.6, least=0.3):
    parts, judged, links = {}, {}, {}
    for p, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h) + len(q), h + q, v) for h, q, v in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        parts[p] = (host, max(fits)[2] if fits else None)
        if host:
            judged.setdefault(host, []).append(parts[p][1])
        for other in {x.lower() for x in re.findall(r'href="https?://([^/"]+)', html or "")} - {host}:
            links[host, other] = links.get((host, other), 0) + 1
    out = {}
    for (a, _), n in links.items():
        out[a] = out.get(a, 0) + n
    share = {e: n / out[e[0]] for e, n in links.items()}
    seeds = {v: {h: sum(x == v for x in xs) / (len(xs) + 2) for h, xs in judged.items()} for v in ("allow", "block")}
    trust = brute_rank(share, {h: s for h, s in seeds["allow"].items() if s}, damping, iterations)
    distrust = brute_rank({(b, a): s for (a, b), s in share.items()}, {h: s for h, s in seeds["block"].items() if s}, damping, iterations)
    bad = {h for h, x in distrust.items() if x >= least * (1 - damping) and x >= ratio * (x + trust.get(h, 0))}
    return {p: v or ("block" if h in bad else "allow") for p, (h, v) in parts.items()}


def test_verdicts_against_brute_force(spark):
    """Hosts that link to each other: farms that point at blocked hosts, friends of allowed ones, and both."""
    rng = random.Random(23)
    hosts = [f"good{k}.org" for k in range(4)] + [f"bad{k}.com" for k in range(4)] + [f"site{k}.net" for k in range(30)]
    pages = []
    for k, host in enumerate(hosts):
        liked = rng.choice([hosts[:4], hosts[4:8], hosts[8:], hosts])
        for n in range(rng.randint(1, 6)):
            path = f"/de/{n}" if host.endswith(".com") and n % 4 else f"/p{n}"
            html = "".join(f'<a href="http://{rng.choice(liked)}/x">' for _ in range(rng.randint(0, 4)))
            pages.append((100 * k + n, f"http://{host}{path}", html + '<a href="/inside">' + "text " * (40_000 if k + n == 0 else 3)))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(df.union(df.limit(5)), URL_RULES).collect()}
    want = brute_verdicts(pages, URL_RULES)
    ruled = brute_verdicts([(p, u, "") for p, u, _ in pages], URL_RULES)
    assert got == want and sum(ruled[p] != want[p] for p in want) >= 3  # links change verdicts


def test_rank_against_brute_force(spark):
    edges = {("a", "b"): 0.5, ("a", "c"): 0.5, ("b", "c"): 1.0, ("c", "a"): 1.0}
    e = spark.createDataFrame([(*k, v) for k, v in edges.items()], "src string, dst string, share double")
    s = spark.createDataFrame([("a", 1.0), ("z", 0.5)], "host string, seed double")
    got = {r.host: r["rank"] for r in url_filters.personalised_rank(e, s, 0.85).collect()}
    assert got == pytest.approx(brute_rank(edges, {"a": 1.0, "z": 0.5}, 0.85, 300), rel=1e-5)


# -- decontamination


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_hits(text, items):
    words, out = decontam.words_of(text), set()
    for i, t in items:
        item = decontam.words_of(t)
        n = len(item)
        if not item:
            continue
        if n < 8:
            if words == item:
                out.add(i)
            continue
        windows = [words[s : s + n] for s in range(max(1, len(words) - n + 1))]
        if any(word_edits(item, w) <= n // 5 for w in windows):
            out.add(i)
    return out


def test_decontamination_recall_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(9, 30)))) for k in range(30)] + [(90, "short item here"), (91, None), (92, "")]
    rows = [(1, None), (2, ""), (3, "Short, item HERE!"), (4, "a short item here")]
    for k in range(120):
        words = items[k % 30][1].split()
        for _ in range(rng.randint(0, len(words) // 4)):
            at = rng.randrange(len(words))
            rng.choice([lambda: words.__setitem__(at, "zzz"), lambda: words.pop(at), lambda: words.insert(at, "yyy")])()
        rows.append((10 + k, " ".join([*say(rng.randint(0, 40)), *words, *say(rng.randint(0, 40))])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: brute_hits(t, items) for d, t in rows}
    for block in (1000, 11):
        got = {r.doc_id: (set(r["items"]), r.contaminated) for r in decontam.decontaminate(documents(spark, rows), bench, block_items=block).collect()}
        assert all(got[d][0] <= want[d] for d in want)
        assert sum(len(got[d][0]) for d in want) >= 0.98 * sum(map(len, want.values()))
        assert all(bool(got[d][0]) == got[d][1] for d in want) and got[3][0] == {90}


def least_edits(item, words):
    """Of the item to any part of the words."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def any_length_hits(text, items):
    return {i for i, t in items if least_edits(t.split(), decontam.words_of(text)) <= len(t.split()) // 5}


def test_decontamination_passages_of_any_length(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([9, 15, 24, 37, 37, 57, 57, 59])]
    rows = []
    for k in range(160):
        words = items[k % 8][1].split()
        spots = sorted(rng.sample(range(1, len(words) - 1), len(words) // 5), reverse=True)
        for at in spots:
            (words.insert(at, "yyy") if k // 8 % 3 == 0 else words.pop(at) if k // 8 % 3 == 1 else words.__setitem__(at, "zzz"))
        rows.append((k, " ".join([*say(rng.randint(0, 40)), *words, *(say(rng.randint(0, 40)) if k % 5 else [])])))
    rows += [(500 + k, " ".join(say(60))) for k in range(20)]
    got = {r.doc_id: set(r["items"]) for r in decontam.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), any_length=True).collect()}
    want = {d: any_length_hits(t, items) for d, t in rows}
    assert all(k % 8 in want[k] for k in range(160)) and all(got[d] <= want[d] for d in want)
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values()))


@pytest.mark.parametrize("any_length", [False, True])
def test_decontamination_of_long_items(spark, any_length):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(900)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([100, 140, 200, 300])]
    rows = []
    for k in range(160):
        words = items[k % 4][1].split()
        for at in rng.sample(range(len(words)), len(words) // 5):
            words[at] = "zzz"
        rows.append((k, " ".join([*say(rng.randint(0, 30)), *words, *say(rng.randint(0, 30))])))
    got = {r.doc_id: r["items"] for r in decontam.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), any_length=any_length).collect()}
    assert all(set(got[k]) <= {k % 4} for k in range(160))
    assert sum(len(x) for x in got.values()) >= 0.98 * 160


def test_decontamination_at_low_similarity(spark):
    """Where so many edits are allowed that no q-gram need be left whole."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(12))) for k in range(6)]
    rows = []
    for k in range(60):
        words = items[k % 6][1].split()
        for at in (1, 4, 7, 10)[: 3 + k % 2]:
            words[at] = "zzz"
        rows.append((k, " ".join([*say(k % 9), *words, *say(9)])))
    got = {r.doc_id: r["items"] for r in decontam.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), similarity=0.6).collect()}
    assert all(set(got[k]) <= {k % 6} for k in range(60)) and sum(map(len, got.values())) >= 0.98 * 60


def test_decontamination_of_short_items(spark):
    items = [(1, "what is the answer now"), (2, "yes it is"), (3, "one two three four"), (4, "Is the answer now, yes it")]
    rows = [(1, "so What is THE answer, now?"), (2, "oh yes it is"), (3, "Yes, it is"), (4, "one two four three"), (5, "what is the answer now yes it is one two three four"), (5, "what is the answer now yes it is one two three four"), (6, "x " * 50_000 + "one two three four"), (7, None), (8, "")]
    docs = documents(spark, rows).withColumn("Items", F.lit("clash"))
    out = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "contaminated", "items"]
    got = sorted((r.doc_id, tuple(r["items"])) for r in out.collect())
    assert got == [(1, (1,)), (2, ()), (3, (2,)), (4, ()), (5, (1, 3, 4)), (5, (1, 3, 4)), (6, (3,)), (7, ()), (8, ())]
    assert decontam.decontaminate(docs.where("false"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_empty_benchmark(spark):
    out = decontam.decontaminate(documents(spark, [(1, "x")]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert not out[0].contaminated and out[0]["items"] == []


# -- mixing


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over


def test_mixing_targets_and_rounding(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.choice([1, 3, 20, 200])), "en", rng.choice(["a", "b", "é", "z", None, "tiny"] if k % 50 == 0 else ["a", "b", "b", "é", "z", None])) for k in range(900)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", "only empty"), (None, "x y", "en", "a"), (7, rows[7][1], "en", rows[7][3])]
    got = [r.asDict() for r in mixing.mix_sources(documents(spark, rows)).collect()]
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 25 for s in want)
    again = mixing.mix_sources(documents(spark, rows[::-1])).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in again) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in got)
    assert mixing.mixed(documents(spark, rows)).count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(documents(spark, rows).where("false")).count() == 0


def brute_rates(rows, want, cap=3):
    """The dual by gradient steps on all documents: rates, and mu."""
    size = np.array([len(WORD.findall(r[1] or "")) for r in rows], float)
    names = list(want)
    of = np.array([names.index(r[3]) for r in rows])
    x = np.log(np.maximum(size, 1))
    mean = (size * x).sum() / size.sum()
    sd = ((size * x * x).sum() / size.sum() - mean**2) ** 0.5
    z, total = (x - mean) / sd, size.sum()
    targets = np.array([want[n] for n in names])
    own = np.bincount(of, size, len(names))
    mu, lam = 0.0, np.full(len(names), 0.0)

    def settle(mu):
        for k in range(len(names)):  # each source's lambda by bisection
            low, high = -40.0, 40.0
            for _ in range(90):
                mid = (low + high) / 2
                r = np.minimum(cap, np.exp(mid + mu * z[of == k]))
                low, high = (mid, high) if (r * size[of == k]).sum() < targets[k] else (low, mid)
            lam[k] = low if own[k] else 0.0
        r = np.minimum(cap, np.exp(lam[of] + mu * z))
        return r, (r * size * z).sum() + mixing.RIDGE * total * mu

    low, high = -5.0, 5.0
    for _ in range(60):
        mu = (low + high) / 2
        r, g = settle(mu)
        low, high = (mu, high) if g < 0 else (low, mu)
    return r, mu


def test_mixing_dual_against_brute_force(spark):
    rng = random.Random(15)
    rows = [(k, " ".join(["w"] * max(1, int(rng.lognormvariate({"a": 1, "b": 3, "c": 4}[s], 1)))), "en", s) for k, s in enumerate(rng.choices("abc", (6, 3, 1), k=600))]
    rows += [(1000, "x " * 60_000, "en", "b"), (1001, "", "en", "none")]
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = brute_targets(sizes)
    rates, mu = brute_rates(rows, want)
    got = {r.doc_id: r for r in mixing.mix_sources(documents(spark, rows).withColumn("Copies", F.lit("clash"))).collect()}
    assert abs(mu) > 0.01 and all(got[r[0]].rate == pytest.approx(x, rel=1e-3, abs=1e-6) for r, x in zip(rows, rates, strict=True) if r[3] != "none")
    for s in sizes:
        due = sum(got[r[0]].rate * got[r[0]].size for r in rows if r[3] == s)
        assert due == pytest.approx(want[s], rel=1e-5, abs=1e-6)


# -- quality rules


def brute_base(t):
    t = t or ""
    words = WORD.findall(t)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(3)}
    lines = t.split("\n")
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)), len(hit)


TEXTS = [None, "", " \n\t", "a b c a b c", "x é\nx é\n\n\n|#", "one two three four one two three", "same same same same", "a\u00a0b c\x1cd", "k " * 200]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert quality_rules.base_counts(text.encode() if text else None) == brute_base(text)


def test_frequent_lines_deplete(spark):
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(80))
    menu = "home about contact login " * 15
    rows = [(k, f"{body(k)}\n{menu}", "en", "h") for k in range(30)] + [(100 + k, f"{menu}\nextra{k}", "en", "h") for k in range(3)] + [(200, f"{menu}\nextra", "en", None)] + [(300 + k, body("copy"), "en", "h") for k in range(40)]
    got = {r.doc_id: r for r in quality_rules.judge(documents(spark, rows)).collect()}
    assert all(got[k].n_removed_lines == 1 and not got[k].depleted for k in range(30))
    assert all(got[100 + k].depleted and not got[100 + k].kept for k in range(3))
    assert not got[200].depleted and all(got[300 + k].kept for k in range(40))


def test_frequent_lines_by_documents_or_texts(spark):
    body = " ".join(f"w{j}" for j in range(80))
    rows = [(k, f"{body}\ncopied line", "en", "h") for k in range(30)] + [(100, f"{'x ' * 60}\ncopied line", "en", "h"), (101, None, "en", "h"), (102, "long " * 60_000 + "\ncopied line", "en", None)]
    docs = documents(spark, rows).withColumn("Kept", F.lit("clash")).withColumn("OF", F.lit(1))
    texts = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    each = {r.doc_id: r for r in quality_rules.judge(docs, count="documents").collect()}
    assert all(r.n_removed_lines == 0 for r in texts.values())
    assert each[0].n_removed_lines == 2 and each[0].depleted and each[100].n_removed_lines == 1 and not each[100].depleted and each[102].n_removed_lines == 0
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_frequent_lines_at_any_host_size(spark):
    menu = "home about contact login " * 15
    held = [(k, f"{menu}\nextra{k}", "en", "h") for k in range(21)] + [(50 + k, f"{'x ' * 60}\nonly {'abcdefghijklmnopqrst'[k]}\nrare", "en", "h") for k in range(20)]
    many = spark.range(1000, 45_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"), F.lit("h").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    for docs in (documents(spark, held), documents(spark, held).unionByName(many)):
        got = {r.doc_id: r for r in quality_rules.judge(docs).where("doc_id < 1000").collect()}
        assert all(got[k].n_removed_lines == 1 and got[k].depleted for k in range(21))
        assert all(got[50 + k].n_removed_lines == 0 for k in range(20))


# -- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 10 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[1], pii_weak.KINDS.index(s[0])))


def test_base_spans_against_patterns():
    rng = random.Random(9)
    for _ in range(4000):
        t = "".join(rng.choice(["a", "B", "@", ".", "-", "+", " ", "7", "0", "255", "4539578763621486", "x@y.z", "10.0.0.1", "(", ")", "é", "\n", "+1 (555) 123-4567"]) for _ in range(rng.randint(0, 14)))
        assert pii_weak.base_spans(t) == brute_spans(t), t


def test_long_runs_stay_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a." * 150_000, "@" * 200_000, "+1" + "(" * 200_000, "1.2.3." * 60_000, "a@" * 100_000):
        pii_weak.base_spans(t)


def test_weak_supervision_adds_secrets(spark):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f"plain words here password={key(20)} and more words") for k in range(40)] + [(100 + k, f"see version 2024-01-{k % 28 + 1:02d} of file-{k}00000 now") for k in range(40)] + [(900, None), (901, "")]
    got = {r.doc_id: r for r in pii_weak.find_personal_data(documents(spark, rows)).collect()}
    assert all(len(got[k].added) == 1 and got[k].added[0].kind == "secret" for k in range(40))
    assert not any(got[100 + k].added for k in range(40)) and not got[900].added and not got[901].base
    assert pii_weak.find_personal_data(documents(spark, rows).where("false")).count() == 0


def planted(rng):
    """(text, spans by kind) with personal data, and with what only looks like it."""
    pick = rng.choice
    given, family = ["Anna", "Peter", "Maria", "Carlos", "Sophie", "Zbigniew", "Oluchi"], ["Miller", "Schmidt", "García", "Dubois", "Kowalski", "O'Brien"]
    number = lambda n: "".join(pick("0123456789") for _ in range(n))
    prose = ["the weather was fine", "we met at noon", "nothing of note happened", "prices rose again"]
    name = f"{pick(given)} {pick(family)}"
    kind, lead, body = pick(
        [("name", pick(["my name is ", "please contact Mr. ", "signed by ", "dear ", "a letter from Frau "]), name)] * 2
        + [("address", pick(["she lives at ", "ship to: ", "address: "]), f"{rng.randint(1, 999)} {pick(['Oak', 'Maple Hill', 'Green'])} {pick(['Street', 'Road', 'Avenue'])}"), ("address", "er wohnt in ", f"{pick(['Linden', 'Garten', 'Berg'])}straße {rng.randint(1, 99)}")]
        + [("id", pick(["SSN: ", "social security number ", "ssn is "]), f"{rng.randint(100, 650)}-{rng.randint(10, 99)}-{number(4)}"), ("id", "passport number ", f"{pick('CFG')}{number(8)}")]
        + [("password", pick(["password: ", "password is ", "pwd="]), "".join(pick("abcdefghijkmnop") for _ in range(10))), ("", "the password is ", pick(["required", "expired", "incorrect", "changed"])), ("secret", "token = ", "".join(pick("0123456789abcdef") for _ in range(32)))]
        + [("", "see pages ", f"{number(3)} {number(3)} {number(3)}"), ("", "", "Monday Morning News"), ("", "as shown in 1984 ", "Green Park Road Books"), ("", "file-", f"{number(5)}.000-{number(4)}"), ("", "on May ", "Street East")]
    )
    before, after = f"{pick(prose)}, and ", f" {pick(prose)}."
    at = len(before) + len(lead)
    return before + lead + body + after, [(kind, at, at + len(body))] if kind else []


def test_weak_supervision_recall_and_precision_by_kind(spark):
    rng = random.Random(31)
    cases = [planted(rng) for _ in range(1500)]
    rows = [(k, t) for k, (t, _) in enumerate(cases)] + [(5000, None), (5001, ""), (5002, "plain words " * 40_000)] + [(0, cases[0][0])]
    docs = documents(spark, rows).withColumn("Base", F.lit("clash"))
    out = pii_weak.find_personal_data(docs).collect()
    assert len(out) == len(rows) and all(not r.added for r in out if r.doc_id >= 5000)
    got = {r.doc_id: {(s.kind, s.start, s.end) for s in r.added} for r in out}
    for kind in pii_weak.ADDED:
        want = {(k, *s) for k, (_, spans) in enumerate(cases) for s in spans if s[0] == kind}
        found = {(k, *s) for k in range(len(cases)) for s in got[k] if s[0] == kind}
        right = len(want & found)
        assert right >= 0.9 * len(want) and right >= 0.9 * len(found), (kind, len(want), len(found), right)


def test_reliabilities_against_brute_force():
    """EM on votes of labelers with known error rates finds them."""
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.4
    quality = (0.95, 0.9, 0.85, 0.8, 0.6)
    v = np.stack([np.where(rng.random(len(truth)) < 0.3, 0, np.where(rng.random(len(truth)) < q, truth, ~truth) + 1) for q in quality], axis=1)
    patterns, n = np.unique(v, axis=0, return_counts=True)
    p, table = pii_weak.posteriors(patterns, n.astype(float))
    each = {tuple(x): y for x, y in zip(patterns, p, strict=True)}
    assert np.mean([(each[tuple(x)] > 0.5) == y for x, y in zip(v, truth, strict=True)]) > 0.93
    for k, q in enumerate(quality):
        assert table[1, k, 2] / (table[1, k, 1] + table[1, k, 2]) == pytest.approx(q, abs=0.03)


# -- HTML


def test_blocks_and_zones():
    html = "<title>t</title><nav>menu</nav><p>a&amp;b  <b>c</b>d<br>e</p><!-- x --><article><h1>H</h1><p>one<p>two &lt; <script>var t='</p>';</script><div class='ad box'>buy</div><div id=comments><p>me too</div></article><footer>f</footer><p>tail"
    assert html_blocks.blocks(html) == [("menu", 1), ("a&b cd", 0), ("e", 0), ("H", 2), ("one", 2), ("two <", 2), ("buy", 1), ("me too", 1), ("f", 1), ("tail", 0)]
    assert html_blocks.blocks("<div class=header>x</div><article><div class='post-header'><h1>t</h1></div><p class=ad>buy</p></article>") == [("x", 1), ("t", 2), ("buy", 1)]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("a < b <p") == [("a < b", 0)]
    html_blocks.blocks("<a" * 50_000 + "<!--" * 50_000)


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) - 1, -1, -1), range(len(b) - 1, -1, -1)):
        d[i][j] = d[i + 1][j + 1] + 1 if a[i] == b[j] else max(d[i + 1][j], d[i][j + 1])
    return d[0][0]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        hit = html_diff.common_subsequence(a, b)
        rest = iter(b)
        assert len(hit) == brute_lcs(a, b) and all(a[i] in rest for i in sorted(hit))


def test_main_text(spark):
    frame = "<div>Site name</div><p>{}</p><div>All rights reserved</div>"
    pages = [(1, "http://h.com/a/1", frame.format("first text")), (2, "http://h.com/a/2", frame.format("second text")), (3, "http://h.com/b", "<article><p>shared<p>own</article>"), (4, "http://h.com/c", "<article>shared</article>"), (5, None, None), (6, "x", ""), (7, "http://alone.com/", frame.format("alone"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for n in (1, 3, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = {r.page_id: r.text for r in html_diff.extract_main_text(df).collect()}
        assert got == {1: "first text", 2: "second text", 3: "shared own", 4: "shared", 5: "", 6: "", 7: "Site name alone All rights reserved"}
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_main_text_of_unmarked_copies(spark):
    frame = "<div>Site name</div><p>{}</p><div>All rights reserved</div>"
    first, second = frame.format("first text"), frame.format("second text")
    pages = [(1, "http://h.com/a/1", first), (2, "http://h.com/a/1?x=1", first), (3, "http://h.com/a/2", second), (4, "http://h.com/m/a/1", first), (4, "http://h.com/m/a/1", first), (5, "http://h.com/m/a/2", second)]
    pages += [(6, "http://copies.com/1", first), (7, "http://copies.com/2", first), (8, "http://copies.com/3", first)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    whole = "Site name first text All rights reserved"
    for n in (1, 40):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted((r.page_id, r.text) for r in html_diff.extract_main_text(df).collect())
        assert got == [(1, "first text"), (2, "first text"), (3, "second text"), (4, "first text"), (4, "first text"), (5, "second text"), (6, whole), (7, whole), (8, whole)]
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def page_of(template, body, article):
    head, foot = "".join(f"<div>{x}</div>" for x in template[:4]), "".join(f"<div>{x}</div>" for x in template[4:])
    body = "".join(f"<p>{x}</p>" for x in body)
    return f"<body>{head}<article>{body}</article>{foot}</body>" if article else f"<body>{head}{body}{foot}</body>"


def test_unmarked_pages_by_difference(spark):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    quote, pages, want = say(30), [], {}
    for host in range(3):
        template = [say(4) for _ in range(8)]
        for k in range(60):
            body = [say(rng.randint(20, 60)) for _ in range(rng.randint(2, 8))] + ([quote] if k in (20, 21) else [])
            for marked in (False, True):
                n = len(pages)
                pages.append((n, f"http://h{host}{'m' * marked}.com/{k // 10}/{k}", page_of(template, body, marked)))
                want[n] = " ".join(body)
    # an article's tags around the whole page: the template inside goes by the difference alone
    for k in range(40):
        body = [say(30), say(40)]
        pages.append((1000 + k, f"http://wrap.com/{k}", f"<main><div>Site name here</div><div>Home</div>{''.join(f'<p>{x}</p>' for x in body)}<div>All rights</div></main>"))
        want[1000 + k] = " ".join(body)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_diff.extract_main_text(df.union(df.limit(3))).collect()}
    assert len(got) == len(want) and {k: r.text for k, r in got.items()} == want
    assert all(r.n_deleted for r in got.values() if r.page_id >= 1000)


def test_stripped_tables_keep_their_words(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    stripped = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "</?article[^>]*>", ""), ' class="[^"]*"', ""))
    want = {r.page_id: r.text for r in html_diff.extract_main_text(pages).collect()}
    got = {r.page_id: r.text for r in html_diff.extract_main_text(stripped).collect()}
    assert all(want.values())
    split = lambda x: {k: t.split() for k, t in x.items()}
    want, got = split(want), split(got)
    both = sum(len(html_diff.common_subsequence(w, got[k])) for k, w in want.items())
    assert both >= 0.95 * sum(map(len, want.values())) and both >= 0.95 * sum(map(len, got.values()))


def test_pages_without_rows_and_very_long_ones(spark):
    schema = "page_id long, url string, html string, Text string"
    assert html_diff.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    long = [f"<p>line {k % 90_000} of it</p>" for k in range(100_000)]
    pages = [(1, "http://l.com/1", "".join(long), "x"), (2, "http://l.com/2", "".join([*long[1000:], "<p>own</p>", *long[:1000]]), "x"), (3, "http://l.com/3", None, None)]
    got = {r.page_id: r for r in html_diff.extract_main_text(spark.createDataFrame(pages, schema)).collect()}
    assert got[1].n_shared >= 99_000 and "own" in got[2].text and got[3].text == ""


# -- n-gram join


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(150)}" for _ in range(rng.choice([1, 2, 3, 5, 60, 120]))] for _ in range(12)]
    rows = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (None, "a b"), (None, "lonely text of nobody")]
    for k in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_components_brute_force(spark, seed):
    rows = near_copies(seed, 150)
    got = ngram_join.ngram_components(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)


def test_ngram_components_with_hot_tokens_and_clashing_names(spark, monkeypatch):
    rows = near_copies(3, 150)
    want = brute_components(rows)
    for hot, bits in ((4, 64), (500, 3), (3, 2)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        got = ngram_join.ngram_components(documents(spark, rows), node_bits=bits).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("hot, shingles, sets", [(500, 8_000_000, 2_000), (4, 900, 30)])
def test_ngram_near_misses_make_no_pairs(spark, monkeypatch, hot, shingles, sets):
    """Sixty texts of which each two are just not linked, and one linked with two of them: rows by members, not by pairs."""
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        for i in range(3):
            w[(k * 3 + i) % 60 * 3 + 9] = f"x{k}.{i}"
        rows.append((k, " ".join(w)))
    rows += [(60, rows[0][1].replace("x0.0", "w9")), (61, rows[1][1].replace("x1.0", "y")), (62, " ".join(base))]
    made = []

    def counted(df, plain=ngram_join.materialize):
        out = plain(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialize", counted)
    for name, value in (("HOT", hot), ("BLOCK_SHINGLES", shingles), ("BLOCK_SETS", sets)):
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.ngram_components(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    assert made and max(made) < len(rows) * (1 if hot > len(rows) else 8)


def test_links_within_a_label_are_not_looked_for():
    sets = [(k, np.array(s, np.int64)) for k, s in enumerate([[1, 2, 3, 4], [1, 2, 3, 5], [8, 9], [8, 9, 10]])]
    assert sorted(ngram_join.linked_pairs(sets, ngram_join.Threshold(1, 2))) == [(0, 1), (2, 3)]
    assert ngram_join.linked_pairs(sets, ngram_join.Threshold(1, 2), [7, 7, 2, 9]) == [(2, 3)]


def test_forest_joins_all_that_may_be_linked():
    rng = random.Random(5)
    for t in range(60):
        limit = ngram_join.Threshold(*[(9, 10), (4, 5), (1, 2)][t % 3])
        base = sorted(rng.sample(range(1 << 40), rng.choice([8, 300, 1020, 2045])))
        sets = []
        for _ in range(25):
            s = set(rng.sample(base, rng.randint(len(base) * 3 // 4, len(base)))) | {base[0]}
            sets.append(np.array(sorted(s | {rng.randrange(1 << 40) for _ in range(rng.randrange(9))}), np.int64))
        pos = [int(np.searchsorted(s, base[0])) for s in sets]
        label, part = [rng.randrange(12) for _ in sets], [rng.randrange(2) if t % 2 else 0 for _ in sets]
        sketches = np.array([ngram_join.sketch(s) for s in sets] + [b""], object)[:-1]
        forest = ngram_join._forest(*(np.array(x, np.int64) for x in ([len(s) for s in sets], range(25), pos, label, part)), sketches, limit)
        assert len(forest) < len(sets)
        group = list(range(25))
        for i, j in forest:
            assert label[i] != label[j]
            group = [group[i] if g == group[j] else g for g in group]
        for i, j in itertools.combinations(range(25), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            fits = limit.den * both >= limit.num * (len(sets[i]) + len(sets[j]) - both) and 1 + min(len(sets[i]) - 1 - pos[i], len(sets[j]) - 1 - pos[j]) >= limit.overlap(len(sets[i]), len(sets[j]))
            if fits and label[i] != label[j] and (len(set(part)) == 1 or part[i] != part[j]):
                assert group[i] == group[j]


def test_trie_against_all_pairs():
    rng = random.Random(7)
    for t in range(60):
        limit = ngram_join.Threshold(*[(9, 10), (4, 5), (1, 2)][t % 3])
        base = [sorted(rng.sample(range(300), rng.randint(1, 50))) for _ in range(4)]
        sets = set()
        for _ in range(rng.randint(1, 40)):
            s = set(rng.choice(base))
            for _ in range(rng.randrange(4)):
                s ^= {rng.randrange(300)}
            sets.add(tuple(sorted(s)) or (0,))
        sets = [np.array(s, np.int64) for s in sorted(sets)]
        group = list(range(len(sets)))
        for i, j in itertools.combinations(range(len(sets)), 2):
            both = len(np.intersect1d(sets[i], sets[j]))
            if limit.den * both >= limit.num * (len(sets[i]) + len(sets[j]) - both):
                group = [group[i] if g == group[j] else g for g in group]
        links = ngram_join.linked_pairs(list(enumerate(sets)), limit)
        mine = list(range(len(sets)))
        for i, j in links:
            mine = [mine[i] if g == mine[j] else g for g in mine]
        assert all((group[i] == group[j]) == (mine[i] == mine[j]) for i, j in itertools.combinations(range(len(sets)), 2))
        assert len(links) == len(sets) - len(set(group))


def test_unlinked_sets_end_at_their_first_tokens():
    import time

    rng = np.random.default_rng(0)
    sets = [(k, np.unique(rng.integers(0, 1 << 60, 200))) for k in range(2000)]
    began = time.time()
    assert ngram_join.linked_pairs(sets, ngram_join.Threshold(9, 10)) == []
    assert time.time() - began < 10


def test_groups_in_parts():
    import pyarrow as pa

    token = np.repeat(np.arange(6), [1, 9, 2, 1, 12, 3])
    batches = lambda n: (pa.RecordBatch.from_pydict({"t": token[i : i + n], "x": np.arange(len(token))[i : i + n]}) for i in range(0, len(token), n))
    for n, most in itertools.product((1, 2, 5, 50), (None, 4, 8)):
        parts = list(ngram_join._by_token(batches(n), most))
        assert np.concatenate([c[1] for c, _ in parts]).tolist() == list(range(len(token)))
        whole = [set(c[0]) for c, part in parts if not part]
        assert not any(a & b for a, b in itertools.combinations(whole, 2))
        if most:
            assert all(np.bincount(c[0]).max() <= most for c, part in parts if not part and n <= most) or n > most


def test_ngram_empty_and_lonely(spark):
    assert ngram_join.ngram_components(documents(spark, [(1, "x")]).where("false")).count() == 0
    assert [tuple(r) for r in ngram_join.ngram_components(documents(spark, [(4, None), (5, "one of a kind text")])).orderBy("doc_id").collect()] == [(4, 0, 4), (5, 3, 5)]


def test_word_hashes_in_pieces(monkeypatch):
    text = b"  ab cd\tef\n" * 40 + b"x" * 300 + b" end"
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert (shingles.word_hashes(text) == whole).all() and len(whole) == len(text.split())


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(6)
    en, de = "the of and to in is that was for with".split(), "der die das und ist nicht mit auf ein von".split()
    say = lambda words, n: " ".join(rng.choice(words) + rng.choice("abcdefg") * rng.randrange(2) for _ in range(n))
    item = say(en, 25)
    rows = [(k, say(en if k % 2 else de, 80), "en" if k % 2 else "de", f"s{k % 3}", 1) for k in range(60)]
    rows[5] = (5, rows[3][1], "en", "s1", 1)
    rows[7] = (7, f"{say(en, 20)} {item} {say(en, 20)}", "en", "s1", 1)
    rows[9] = (9, "12345 67890", "en", "s1", 1)
    rows = [(d, t + ("\nFooter line" if k % 2 and k != 9 else ""), *r) for k, (d, t, *r) in enumerate(rows)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert not ids & {5, 7, 9} and not any("Footer" in r.text for r in out)
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "mixing"] and len(out) >= len(ids)


def test_pipeline_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp
    from quantloom.llm import runtime

    en, de = "the of and to in is that was for with", "der die das und ist nicht mit auf ein von"
    say = lambda words, k: " ".join(w + "abcdefghij"[(k + j) % 10] * (j % 3) for j, w in enumerate(words.split() * 6))
    rows = [(k, say(en if k % 2 else de, k), "en" if k % 2 else "de", f"s{k % 3}" if k % 4 else None, 1) for k in range(40)]
    rows += [(100, None, "en", "s1", 1), (101, "", "en", "s1", None), (102, "12 34", None, None, 1), (None, " ".join(say(en, 77).split()[::-1]), "en", "s1", 1), (103, "the of and " * 30_000, "en", "s2", 1)] + [(104, say(de, 91), "de", "s1", 1)] * 2
    docs = documents(spark, rows)
    for name, table in (("some", docs), ("none", docs.where("false"))):
        folder = tmp_path / name
        table.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    mark = runtime.tables()
    got = cp.run(spark, str(tmp_path / "some")).collect()
    ids = [r.doc_id for r in got]
    assert not set(ids) & {100, 101, 102}
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "some"))
    kept = [r.doc_id for r in docs.collect()]
    assert kept.count(104) == 1 and kept.count(None) == 1 and set(ids) <= set(kept)
    assert all(r["copy"] >= 1 for r in got) and len({(r.doc_id, r["copy"]) for r in got}) == len(got)
    assert runtime.tables() - mark < 12
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_join_takes_five_words_at_four_fifths(spark):
    import corpus_pipeline as cp

    words = [f"w{k}" for k in range(104)]
    spoilt = lambda *at: " ".join("zzz" if k in at else w for k, w in enumerate(words))
    # of 100 shingles two scattered words cost ten (90 / 110 shared), three fifteen (85 / 115)
    rows = [(1, " ".join(words), "en", "s", 1), (2, spoilt(20, 60), "en", "s", 1), (3, spoilt(10, 40, 70), "en", "s", 1)]
    assert {r.doc_id for r in cp.join_stage(spark, documents(spark, rows[:2]), "").collect()} == {1}
    assert {r.doc_id for r in cp.join_stage(spark, documents(spark, [rows[0], rows[2]]), "").collect()} == {1, 3}


def test_pipeline_join_keeps_one_row_of_repeats_and_null_ids(spark):
    import corpus_pipeline as cp

    say = lambda c: " ".join(f"{c}{k}" for k in range(50))
    rows = [(1, say("a"), "en", "s", 1)] * 2 + [(None, say("a"), "en", "s", 1), (2, say("a"), "en", "s", 1)]
    rows += [(None, say("b"), "en", "s", 1)] * 2 + [(None, say("b"), "en", "t", 1), (3, say("c"), "en", "s", 1), (None, say("d"), "en", "s", 1)]
    rows += [(4, None, "en", "s", 1), (5, "", "en", "s", 1), (5, "", "en", "s", 1)]
    got = sorted((str(r.doc_id), (r.text or "")[:1]) for r in cp.join_stage(spark, documents(spark, rows), "").collect())
    assert got == [("1", "a"), ("3", "c"), ("4", ""), ("5", ""), ("None", "b"), ("None", "d")]


def test_kept_text_digest_matches(spark):
    df = QUERIES["op1_line_dedup"](spark, SMALL)
    full = line_dedup.dedup_lines(spark.read.parquet(f"{SMALL}/documents.parquet"))
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in full.collect()}
    assert {r.doc_id: r.kept_sha256 for r in df.collect()} == want
