"""URL filtering by rules and by trust that spreads over the link graph of hosts, in DataFrame operations only.

Rules decide where they fit.  Elsewhere two personalised PageRanks over host edges decide: trust flows along links from
hosts whose pages the rules allow, distrust flows against links from hosts whose pages they block.  A host whose
distrust is high in itself and against its trust is blocked.

At scale: edges are host pairs, summed in each task before the shuffle; a rank is one join and one sum for each link
that it has come over, written to the shared folder every CUT links, until more add nothing that counts.  Verdicts reach the pages by a join with the
blocked hosts alone, which Spark broadcasts only when their files are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, release, tables, without

#: (host, path, verdict); the longest that fits wins.
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"
CUT = 5


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; rules are a short parameter list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts, with multiplicity."""
    links = pages.where(F.col(html).isNotNull()).select(F.col(host).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float = 1e-6) -> DataFrame:
    """(host, rank) with rank = (1 - damping) * seed + damping * what comes over edges (src, dst, share).

    A further link adds to a rank and never takes from it, and each costs a factor of damping.  So the ranks' sum grows by
    less and less, and they are done where CUT links more add less than the tolerance's part of it: there is no other end.
    Every CUT links the ranks are written, which cuts their lineage.
    """
    spark, mark = edges.sparkSession, tables()
    start = seeds.select("host", (F.col("seed") * (1 - damping)).alias("own"))
    rank, total = start.select("host", F.col("own").alias("rank")), None
    while True:
        for _ in range(CUT):
            flow = edges.join(rank, edges["src"] == rank["host"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("own"))
            rank = start.unionByName(flow).groupBy("host").agg(F.sum("own").alias("rank"))
        rank = materialize(rank)
        release(spark, mark, keep=1)
        now = rank.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        if total is not None and now - total <= tolerance * (1 - damping) * now:
            return rank
        total = now


def blocked_hosts(pages: DataFrame, edges: DataFrame, damping: float, ratio: float, least: float) -> DataFrame:
    """Hosts that the link graph condemns; pages: (host, verdict of the rules or null, n pages), edges: (src, dst, n)."""
    share = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)) / (F.sum("n") + 2)  # noqa: E731  two pages of doubt: one bad page says little of a small host
    seeds = pages.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    good = seeds.where("good > 0").select("host", F.col("good").alias("seed"))
    bad = seeds.where("bad > 0").select("host", F.col("bad").alias("seed"))
    out_n = edges.groupBy("src").agg(F.sum("n").alias("all"))
    forward = materialize(edges.join(out_n, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")))
    trust = personalised_rank(forward, good, damping)
    # who links to a blocked host is distrusted by the share of links that go there
    distrust = personalised_rank(forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "share"), bad, damping)
    scores = distrust.withColumnRenamed("rank", "distrust").join(trust.withColumnRenamed("rank", "trust"), "host", "left")
    d, t = F.col("distrust"), F.coalesce("trust", F.lit(0.0))
    return scores.where((d >= least * (1 - damping)) & (d >= ratio * (d + t))).select("host")


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", html: str = "html", damping: float = 0.85, ratio: float = 0.6, least: float = 0.3) -> DataFrame:
    """Judge each page's url.

    ratio: share of distrust in distrust + trust that condemns a host.  least: the distrust it needs besides, as a part
    of what a host has whose pages are all blocked; so a few blocked pages don't condemn their host's other pages.

    Result: the columns of pages and host, path, rule, verdict (string), which replace columns of those names.  A null
    url, or one without "://", has an empty host and path, no rule and verdict allow, unless a rule with an empty host
    fits.  Rules of one length: the last by code points wins.  Null html has no links; relative ones name no host and
    count as none; html of any length is read whole.  Repeated rows are judged alike; an empty table gives an empty table.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    named = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    ruled = named.withColumn("\0rule", rule_of(F.col("host"), F.col("path"), rules))
    edges = materialize(host_edges(named, "host", html))
    judged = materialize(ruled.groupBy("host", F.col("\0rule.verdict").alias("verdict")).agg(F.count("*").alias("n")))
    bad = materialize(blocked_hosts(judged, edges, damping, ratio, least)).select(F.col("host").alias("\0bad"))
    joined = ruled.join(bad, F.col("host") == F.col("\0bad"), "left")
    verdict = F.coalesce(F.col("\0rule.verdict"), F.when(F.col("\0bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.withColumns({"rule": F.col("\0rule.rule"), "verdict": verdict}).select(*pages.columns, "host", "path", "rule", "verdict")
