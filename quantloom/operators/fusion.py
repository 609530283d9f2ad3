"""Fusion of ranked lists and votes.

Ballots are rows (model, rank, code, ...), so every rule is one grouping by code or item with a partial sum in each
task; a model with very many picks is no hot key.  Ties are broken by an explicit last column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .opinions import first_known


def ranked(rows: DataFrame, *order: Column | str, most: int | None = None, name: str = "place") -> DataFrame:
    """rows with their place in the order; the first `most` of them."""
    out = rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return out if most is None else out.where(F.col(name) <= most)


def borda(picks: DataFrame, weights: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Borda fusion of picks(model, rank, code, score[, pos, name, sector, reasoning]).

    A pick is worth max(0, 21 - rank) times its model's weight (1 if none); rank defaults to 99, score to 70.  The sum is
    divided by the number of models that picked at all.  Order: that mean, ballots, mean score, code, all descending.
    With pos, the order of the picks, there are also name and sector, the first that are not empty, and reasonings, the first
    three that are not, each with its model's name; they are gathered for the chosen codes only.
    """
    p = picks.withColumns({"rank": F.coalesce("rank", F.lit(99)), "score": F.coalesce("score", F.lit(70)).cast("double")}).where(F.trim(F.col("code").cast("string")) != "")
    p = p.join(weights, "model", "left") if weights is not None else p.withColumn("weight", F.lit(1.0))
    models = picks.agg(F.greatest(F.countDistinct("model"), F.lit(1)).alias("models"))
    points = F.greatest(F.lit(0), 21 - F.col("rank")) * F.coalesce("weight", F.lit(1.0))
    by = p.groupBy("code").agg(F.sum(points).alias("borda"), F.avg("score").alias("mean_score"), F.count("*").alias("ballots"))
    by = by.crossJoin(F.broadcast(models))  # one row
    by = by.withColumns({"mean_score": F.round("mean_score", 1), "borda_mean": F.round(F.col("borda") / F.col("models"), 2)}).drop("models")
    best = ranked(by, F.desc("borda_mean"), F.desc("ballots"), F.desc("mean_score"), F.desc("code"), most=most)
    if "pos" not in picks.columns:
        return best
    own = p.join(best.select("code"), "code", "left_semi")
    known = own.groupBy("code").agg(first_known("name", "pos").alias("name"), first_known("sector", "pos").alias("sector"))
    said = own.where("reasoning <> ''").withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy("pos"))).where("_n <= 3")
    line = F.struct("_n", F.concat(F.lit("["), "model", F.lit("] "), "reasoning").alias("line"))
    said = said.groupBy("code").agg(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]).alias("reasonings"))
    return best.join(known, "code", "left").join(said, "code", "left").withColumn("reasonings", F.coalesce("reasonings", F.array().cast("array<string>")))


def star_arbitration(opinions: DataFrame, weights: dict[str, float], other: float = 0.15) -> DataFrame:
    """opinions(expert, code, stars): weighted stars as percent, and a bonus for 2, 3, 4 or more experts."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("expert")], F.lit(other))
    by = opinions.groupBy("code").agg(F.sum(F.col("stars") * w * 20).alias("weighted"), F.count("*").alias("experts"))
    bonus = F.when(F.col("experts") >= 4, 1.5).when(F.col("experts") >= 3, 1.0).when(F.col("experts") >= 2, 0.5).otherwise(0.0)
    return by.withColumns({"bonus": bonus, "final": F.round(F.col("weighted") + bonus * 5, 2)})


def rerank(picks: DataFrame, pool: DataFrame, most: int = 15) -> DataFrame:
    """Sum of 20 - min(rank, 20) by code; the best `most`, of which those in the pool stay."""
    by = picks.groupBy("code").agg(F.sum(20 - F.least(F.coalesce("rank", F.lit(99)), F.lit(20))).alias("points"))
    return ranked(by, F.desc("points"), "code", most=most).join(pool.select("code").distinct(), "code", "left_semi")


def panel_consensus(votes: DataFrame, item: str = "code", score: str = "score", most: int = 10) -> DataFrame:
    """Votes and mean score of an item; consensus is the mean plus 5 for each further vote."""
    by = votes.groupBy(item).agg(F.count("*").alias("votes"), F.round(F.avg(score), 1).alias("mean"))
    by = by.withColumn("consensus", F.col("mean") + 5 * (F.col("votes") - 1))
    return ranked(by, F.desc("consensus"), item, most=most)


def vote(votes: DataFrame, by: str, then: Column, item: str = "item", most: int = 5) -> DataFrame:
    """Items by votes, then by an aggregate called `by`, then by name."""
    g = votes.groupBy(item).agg(F.count("*").alias("votes"), then.alias("then"))
    return ranked(g, F.desc("votes"), F.asc("then") if by == "asc" else F.desc("then"), item, most=most)


def majority(votes: DataFrame, voter: str = "voter", item: str = "item") -> DataFrame:
    """The item with most votes if they reach half of the voters, rounded up; a voter's null is a vote for nothing."""
    n = votes.agg(F.countDistinct(voter).alias("voters"))
    g = votes.where(F.col(item).isNotNull()).select(voter, item).distinct().groupBy(item).agg(F.count("*").alias("votes"))
    top = ranked(g, F.desc("votes"), item, most=1).crossJoin(F.broadcast(n))  # one row each
    return top.where(F.col("votes") >= F.greatest(F.lit(1), F.floor(F.col("voters") / 2) + F.col("voters") % 2))


def first_mode(rows: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """The most frequent value of each group, the first seen on a tie."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return n.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def chart_votes(votes: DataFrame, signals: dict[str, int]) -> DataFrame:
    """votes(voter, code, signal, pos): the first vote's signal counts 3, 2 or 1; score = 20 * signal + 5 * votes."""
    worth = F.coalesce(F.create_map(*[F.lit(x) for kv in signals.items() for x in kv])[F.col("signal")], F.lit(1))
    g = votes.groupBy("code").agg(F.min_by(worth, "pos").alias("signal"), F.count("*").alias("models"))
    return ranked(g.withColumn("score", F.col("signal") * 20 + F.col("models") * 5), F.desc("signal"), F.desc("models"), "code")


def keep_first(rows: DataFrame, pos: str, *key: str) -> DataFrame:
    """Order-preserving dedupe: the first row of each key."""
    least = F.row_number().over(Window.partitionBy(*key).orderBy(pos))
    return rows.withColumn("_n", least).where("_n = 1").drop("_n")


def nearest(vectors: DataFrame, query: list[float], most: int, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The `most` vectors with the highest cosine similarity; one scan, a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.withColumn("similarity", dot / (norm * size)).orderBy(F.desc("similarity"), key).limit(most)
