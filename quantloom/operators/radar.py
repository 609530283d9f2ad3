"""What a panel of models says of the market and its concepts, as one consensus.

Every list is cut by a row number before it is collected, so a concept that all answers name holds no more than its few
entries; order is the answers' own (pos), with the place in a list (at) behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def modes(rows: DataFrame, defaults: dict[str, str | None], pos: str = "pos") -> DataFrame:
    """One row with the most frequent value of each column of defaults, the first seen of equals; the default if none has any.

    Null and empty values don't count.  All columns go through one grouping as (column, value) rows.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("value")) for c in defaults])
    x = rows.select(F.col(pos).alias("pos"), F.explode(pairs).alias("x")).select("pos", "x.*").where("value <> ''")
    n = x.groupBy("c", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = lambda c: F.max_by(F.when(F.col("c") == c, F.col("value")), F.when(F.col("c") == c, F.struct("n", -F.col("first"))))
    return n.agg(*[F.coalesce(best(c), F.lit(d)).alias(c) for c, d in defaults.items()])


def first_texts(rows: DataFrame, column: Column, most: int, *key: str) -> DataFrame:
    """(key, texts): the first `most` values that are neither null nor empty of each key, in the order of pos and at."""
    x = rows.select(*key, "pos", "at", column.alias("_t")).where("_t <> ''")
    n = F.row_number().over(Window.partitionBy(*key).orderBy("pos", "at") if key else Window.orderBy("pos", "at"))
    kept = x.withColumn("_n", n).where(F.col("_n") <= most)
    return kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda s: s["_t"]).alias("texts"))


def distinct_first(rows: DataFrame, item: str, by: Column, most: int, *key: str) -> DataFrame:
    """(key, items): of the array column's elements the first of each `by` (null and empty ones don't count), at most `most`."""
    x = rows.select(*key, "pos", "at", F.posexplode(item).alias("_i", "_item")).withColumn("_by", by).where("_by <> ''")
    x = x.groupBy(*key, "_by").agg(F.min_by("_item", F.struct("pos", "at", "_i")).alias("_item"), F.min(F.struct("pos", "at", "_i")).alias("_at"))
    n = F.row_number().over(Window.partitionBy(*key).orderBy("_at"))
    kept = x.withColumn("_n", n).where(F.col("_n") <= most)
    return kept.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_item"))), lambda s: s["_item"]).alias("items"))


#: What stands where no model says anything.
NO_TREND, NO_TEMPERATURE, NO_PHASE, NO_STAGE, NO_SCORE, NO_CONFIDENCE = "sideways", "normal", "", "unknown", 50, 70.0


def market_consensus(answers: DataFrame) -> DataFrame:
    """One row: trend, temperature, phase (see modes), score, reasoning, signals, summary, hint, advice.

    answers: model, pos, trend, temperature, phase, score, reasoning, signals, summary, hint, advice; one row an answer.  score is
    the mean, rounded half to even, NO_SCORE without any.  reasoning, signals and advice are the first three joined by '; ',
    the model's name before each; summary and hint the first.
    """
    x = answers.withColumn("at", F.lit(0))
    named = lambda c: F.when(F.col(c) != "", F.concat(F.lit("["), "model", F.lit("] "), c))
    out = modes(answers, {"trend": NO_TREND, "temperature": NO_TEMPERATURE, "phase": NO_PHASE})
    out = out.crossJoin(answers.agg(F.coalesce(F.bround(F.avg("score")).cast("long"), F.lit(NO_SCORE)).alias("score")))  # one row each
    for name, column, most in (("reasoning", named("reasoning"), 3), ("signals", named("signals"), 3), ("summary", F.col("summary"), 1), ("hint", F.col("hint"), 1), ("advice", named("advice"), 3)):
        out = out.crossJoin(first_texts(x, column, most).select(F.coalesce(F.array_join("texts", "; "), F.lit("")).alias(name)))
    return out


def concept_consensus(predictions: DataFrame, most: int = 8) -> DataFrame:
    """(rank, concept, votes, confidence, stage, signals, space, reasoning, leaders, etfs, risk): the `most` concepts named most.

    predictions: model, pos, at, concept, confidence, stage, signals, space, reasoning, risk, leaders (array of string), etfs
    (array of (code, name)).  Names are trimmed, empty and null ones don't count.  Order: votes, mean confidence at 1 place,
    both descending, then first named.  confidence null is NO_CONFIDENCE; stage is the most frequent, the first seen of
    equals, NO_STAGE without any.  leaders: the first five different; etfs: the first three of different codes; signals: the
    first three joined by '; ', reasoning: two, with the models' names; space and risk: the first.
    """
    x = predictions.withColumn("concept", F.trim("concept")).where("concept <> ''")
    order = F.struct("pos", "at")
    g = x.groupBy("concept").agg(F.count("*").alias("votes"), F.round(F.avg(F.coalesce("confidence", F.lit(NO_CONFIDENCE))), 1).alias("confidence"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.orderBy(F.desc("votes"), F.desc("confidence"), "first")).cast("long")
    g = g.withColumn("rank", rank).where(F.col("rank") <= most).drop("first")
    x = x.join(g.select("concept"), "concept", "left_semi")  # few concepts from here on
    n = x.where("stage <> ''").groupBy("concept", "stage").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    place = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "first"))
    g = g.join(n.withColumn("_n", place).where("_n = 1").select("concept", "stage"), "concept", "left").withColumn("stage", F.coalesce("stage", F.lit(NO_STAGE)))
    named = F.when(F.col("reasoning") != "", F.concat(F.lit("["), "model", F.lit("] "), "reasoning"))
    for name, column, k in (("signals", F.col("signals"), 3), ("space", F.col("space"), 1), ("reasoning", named, 2), ("risk", F.col("risk"), 1)):
        texts = first_texts(x, column, k, "concept").select("concept", F.array_join("texts", "; ").alias(name))
        g = g.join(texts, "concept", "left").withColumn(name, F.coalesce(name, F.lit("")))
    g = g.join(distinct_first(x, "leaders", F.col("_item"), 5, "concept").withColumnRenamed("items", "leaders"), "concept", "left")
    g = g.join(distinct_first(x, "etfs", F.col("_item.code"), 3, "concept").withColumnRenamed("items", "etfs"), "concept", "left")
    return g.select("rank", "concept", "votes", "confidence", "stage", "signals", "space", "reasoning", "leaders", "etfs", "risk")


def sector_votes(panel: DataFrame, most: int = 5) -> DataFrame:
    """(sector, votes, mean_rank, mean_score, first, place) of panel(sector, rank, score, pos): the panel's best sectors.

    Names are trimmed, empty ones don't count; rank null is 5, score null 70.  Order: votes descending, mean rank at 2 places,
    first named (pos); mean_score at 1 place.
    """
    x = panel.withColumn("sector", F.trim("sector")).where("sector <> ''")
    g = x.groupBy("sector").agg(F.count("*").alias("votes"), F.round(F.avg(F.coalesce("rank", F.lit(5))), 2).alias("mean_rank"), F.round(F.avg(F.coalesce("score", F.lit(70)).cast("double")), 1).alias("mean_score"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.orderBy(F.desc("votes"), "mean_rank", "first")).cast("long")
    return g.withColumn("place", place).where(F.col("place") <= most)


def screened_sectors(screen: DataFrame, most: int = 5) -> DataFrame:
    """(sector, votes, mean_score, first, place) of screen(sector, score, pos): by votes and mean score, both descending."""
    x = screen.withColumn("sector", F.trim("sector")).where("sector <> ''")
    g = x.groupBy("sector").agg(F.count("*").alias("votes"), F.avg(F.coalesce("score", F.lit(70)).cast("double")).alias("mean_score"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.orderBy(F.desc("votes"), F.desc("mean_score"), "first")).cast("long")
    return g.withColumn("place", place).where(F.col("place") <= most)


def chosen_sectors(panel: DataFrame, screen: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """(place, sector, source): the panel's sectors, and if they are fewer than `least` those of the screen behind them.

    One plan, decided by a count inside it: the screen's rows pass only while the panel's count is below `least`.  At most
    `most` sectors; one that both name stands where the panel has it.
    """
    own = sector_votes(panel, most).select("sector", "place", F.lit("panel").alias("source"))
    few = own.agg((F.count("*") < least).alias("few"))  # one row
    more = screened_sectors(screen, most).join(own, "sector", "left_anti").crossJoin(F.broadcast(few)).where("few")
    both = own.unionByName(more.select("sector", "place", F.lit("screen").alias("source")))
    place = F.row_number().over(Window.orderBy("source", "place")).cast("long")
    return both.withColumn("place", place).where(F.col("place") <= most).select("place", "sector", "source")
