"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all rates up to `cap` that meet every source's word target and keep the mix's mean log size of documents (by words)
at the corpus's own, those nearest to 1 in relative entropy (words as base measure) are exponential tilts:
rate = min(cap, exp(lambda of the source + mu * z)), z being the document's standardised log size.  The second
constraint couples the sources: without it a mix of sources of short texts would be one of short texts beyond need.
It is met softly, by a ridge on mu, since it may be out of reach where targets are near the cap; targets are met exactly.

The dual is convex.  Each Newton step sums, by source, the words taken and their first two moments in z over the table
of (source, size, number of documents), which is what gradient and Hessian consist of; the Hessian is an arrow of one
row a source and one column for mu, so a step is solved by sums over the source rows.

Rates become whole copies by error diffusion: within a source, documents are dealt to buckets of about `bucket_docs` by
hash, and in a bucket each document, the long ones first, takes the copies that bring the words taken nearest to the
words due.  The remaining error of a bucket is about half of its shortest document.

At scale: a source that holds a third of all rows is many buckets; the narrow (doc_id, source, size) rows shuffle, never
the texts; a step reads rows of distinct sizes only, summed in each task before the shuffle; the source table, one row
per source, is joined by broadcast only where its files are small enough.  Sums are of decimals, so their order, and
with it a rerun, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, release, tables

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS = 40
#: Words taken may be off their targets by this part; weight of the ridge on mu against the words of the corpus.
TOLERANCE, RIDGE = 1e-7, 1.0


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, docs, weight, target) from rows (source, size, m): one row per source."""
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("weight", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    # sources reach their caps in the order of cap / weight; the level is set by the first that doesn't
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    capped = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(whole) - capped) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", level)
    water = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(whole)
    per = per.withColumn("target", F.coalesce(F.least(F.col("most"), F.col("weight") * water), F.col("most")))
    return per.select("source", "source_size", "docs", "weight", "target")


def log_size(size: str) -> Column:
    return F.log(F.greatest(F.col(size), F.lit(1)).cast("double"))


def _exact(x: Column) -> Column:
    return F.coalesce(F.sum(F.round(x, 9).cast("decimal(38,9)")), F.lit(0).cast("decimal(38,9)"))


def rate_of(z: Column, mu: float, cap: float) -> Column:
    """The tilt of a document whose source's lambda is in the column of that name."""
    return F.least(F.lit(float(cap)), F.exp(F.col("lambda") + F.lit(mu) * z))


def solve_dual(sizes: DataFrame, targets: DataFrame, cap: float) -> tuple[DataFrame, float, float, float]:
    """((source, lambda), mu, mean, deviation) of rows (source, size, m) and targets(source, source_size, target).

    mean and deviation standardise the log size.  A source with a target of 0 or without words has the rate 0 or 1; one
    whose target is its cap has all rates there.
    """
    counts = materialize(sizes.groupBy("source", "size").agg(F.sum("m").alias("m")))
    words, x = F.col("m") * F.col("size"), log_size("size")
    w, m1, m2 = counts.agg(_exact(words.cast("double")), _exact(words * x), _exact(words * x * x)).first()
    total = float(w)
    mean = float(m1) / total if total else 0.0
    deviation = max(1e-6, float(m2) / total - mean * mean) ** 0.5 if total else 1.0
    z = (x - mean) / deviation
    first = F.when(F.col("source_size") == 0, 0.0).when(F.col("target") >= cap * F.col("source_size"), 50.0).otherwise(F.coalesce(F.ln(F.col("target") / F.col("source_size")), F.lit(-50.0)))
    dual = targets.select(F.col("source").alias("of"), "target", first.alias("lambda"))
    mu, taken = 0.0, words.cast("double") * F.col("r")
    mark = tables()
    for _ in range(NEWTON_STEPS):
        at = counts.join(dual, F.col("source").eqNullSafe(F.col("of"))).withColumns({"z": z, "r": rate_of(z, mu, cap)})
        free = F.when(F.col("r") < cap, taken).otherwise(0.0)
        sums = at.groupBy("of").agg(F.first("target").alias("target"), F.first("lambda").alias("lambda"), _exact(taken).cast("double").alias("t"), _exact(free).cast("double").alias("a"), _exact(free * F.col("z")).cast("double").alias("b"), _exact(free * F.col("z") * F.col("z")).cast("double").alias("c"), _exact(taken * F.col("z")).cast("double").alias("q"))
        # sources that a step can move; the others are at their caps or empty
        sums = materialize(sums.withColumn("a", F.when(F.col("a") > 1e-9 * F.greatest("target", F.lit(1.0)), F.col("a"))))
        gap = F.col("t") - F.col("target")
        one = sums.agg(_exact(F.col("q")), _exact(F.coalesce(F.col("c"), F.lit(0.0))), _exact(F.coalesce(F.col("b") * F.col("b") / F.col("a"), F.lit(0.0))), _exact(F.coalesce(F.col("b") * gap / F.col("a"), F.lit(0.0))), F.max(F.when(F.col("a").isNotNull(), F.abs(gap) / F.greatest("target", F.lit(1.0))))).first()
        release(sums.sparkSession, mark, keep=1)
        q, c, bb, bg, worst = (float(v or 0) for v in one)
        g = q + RIDGE * total * mu
        step = max(-1.0, min(1.0, -(g - bg) / (c - bb + RIDGE * total))) if total else 0.0
        move = F.coalesce((gap + F.col("b") * step) / F.col("a"), F.lit(0.0))
        dual = sums.select("of", "target", (F.col("lambda") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), move))).alias("lambda"))
        mu += step
        if worst < TOLERANCE and abs(step) < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the dual has not settled in {NEWTON_STEPS} steps: a target is off by {worst:.2g} of itself")
    return dual.select("of", "lambda"), mu, mean, deviation


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, bucket_docs: int = 128) -> DataFrame:
    """How many copies of each document the mix takes.

    Sources in code point order, null last, weigh `weights`, repeating.  Targets share the words of all sources by
    weight; none is above cap times its source's words, what is above goes to the others by weight.

    Result: a row per row of docs: doc_id, source, size, source_size, copies, taken (long), target, rate (double), and m,
    the number of rows that share doc_id, source and size, and so their copies: such a group is rounded together, so many
    repeats of a row in a bucket may be off by half of their words.  Texts of any length count whole.  Null texts and texts without words have
    size 0 and take 0 words.  An empty table gives no rows.  Other columns of docs play no part.
    """
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    sizes = materialize(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")))
    targets = materialize(source_targets(sizes, weights, cap))
    t = targets.withColumnRenamed("source", "of")
    dual, mu, mean, deviation = solve_dual(sizes, targets, cap)
    t = t.join(dual.withColumnRenamed("of", "\0of"), F.col("of").eqNullSafe(F.col("\0of"))).drop("\0of")
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")
    rows = rows.withColumn("rate", F.round(rate_of((log_size("size") - mean) / deviation, mu, cap), 9)).drop("lambda")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.ceil(F.col("docs") / bucket_docs)))
    item = F.struct((-F.col("size")).alias("shorter"), "doc_id", "size", "m", "rate")
    buckets = rows.groupBy("source", "bucket").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.array_sort(F.collect_list(item)).alias("items"))
    fold = """aggregate(items, named_struct('gap', 0D, 'out', cast(array() as array<struct<doc_id:bigint,size:bigint,m:bigint,rate:double,copies:bigint>>)),
      (s, x) -> named_struct(
        'gap', s.gap + x.size * x.m * (x.rate - greatest(floor(x.rate), least(ceil(x.rate), floor(x.rate + if(x.size = 0, 0D, s.gap / (x.size * x.m)) + 0.5D)))),
        'out', concat(s.out, array(named_struct('doc_id', cast(x.doc_id as bigint), 'size', x.size, 'm', x.m, 'rate', x.rate,
          'copies', greatest(floor(x.rate), least(ceil(x.rate), floor(x.rate + if(x.size = 0, 0D, s.gap / (x.size * x.m)) + 0.5D))))))),
      s -> s.out)"""
    out = buckets.select("source", "source_size", "target", F.explode(F.expr(fold)).alias("x"))
    each = out.select(F.col("x.doc_id").alias("doc_id"), "source", F.col("x.size").alias("size"), "source_size", "target", F.col("x.rate").alias("rate"), F.col("x.m").alias("m"), F.col("x.copies").alias("copies"))
    return each.withColumn("taken", F.col("copies") * F.col("size")).withColumn("row", F.explode(F.expr("sequence(1, m)"))).drop("row")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with `copy` (1, 2, ...) last."""
    plan = mix_sources(docs, text, source, doc_id, **options).where("copies > 0").select(F.col("doc_id").alias("\0d"), F.col("source").alias("\0s"), F.col("size").alias("\0n"), F.col("copies").alias("\0c")).distinct()
    d = docs.withColumn("\0w", word_count(text))
    joined = d.join(plan, d[doc_id].eqNullSafe(plan["\0d"]) & d[source].eqNullSafe(plan["\0s"]) & (d["\0w"] == plan["\0n"]))
    return joined.withColumn("copy", F.explode(F.expr("sequence(1, `\0c`)"))).select(*docs.columns, "copy")
