"""Merging of events that several models report: clusters by title, votes on who gains.

The rule depends on order: a title joins the first cluster, in the order of their beginnings, one of whose first words it
contains, and begins one of its own if there is none.  Here all titles are decided at once, in rounds.  Of each word only
two numbers count, the first cluster and the first open title that has it among its first words, so a word that a third of
all titles share is one row and makes no pairs.  A title with an earlier cluster at one of the words that it contains is
no beginning; one without it that no earlier open title could still stop begins a cluster; the others wait for the next
round.  In the end each title takes the least cluster among its words.  The rounds are as many as the longest chain of
titles that wait for each other, which in unsorted reports grows with the logarithm of their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.feeds import stored

#: Characters of a title that count, its words that name a cluster, and their least length.
TITLE, WORDS, SHORTEST = 20, 3, 2


def _title_words(t: Column) -> Column:
    """The first words of a title, of SHORTEST characters or more."""
    words = F.filter(F.split(t, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    return F.filter(F.array_distinct(F.slice(words, 1, WORDS)), lambda w: F.length(w) >= SHORTEST)


def _parts(t: Column) -> Column:
    """All parts of a title that could be a word: at most TITLE^2 / 2 of them."""
    n = F.length(t)
    ends = lambda i: F.transform(F.sequence(F.lit(SHORTEST), n - i + 1), lambda m: F.substring(t, i, m))
    found = F.flatten(F.transform(F.sequence(F.lit(1), n - SHORTEST + 1), ends))
    return F.array_distinct(F.when(n >= SHORTEST, found).otherwise(F.array().cast("array<string>")))


def _known(kind: str) -> Column:
    """A kind that joins: null is a kind like any other."""
    return F.coalesce(F.col(kind).cast("string"), F.lit("\0"))


def event_clusters(events: DataFrame, by: str = "kind", title: str = "title", pos: str = "pos") -> DataFrame:
    """(kind, t, at, cluster, place) for each title of each kind: its cluster's title and the place where that begins.

    t: the title's first TITLE characters, null as ''.  events are in the order of pos, which no two of a kind share.  at is
    t's first place.  A title without a word of SHORTEST characters meets no other, and equal ones don't meet each other: as
    a later one takes the place of the earlier, `at` and `place` stay the first one's.  Null is a kind of its own.  An empty
    table gives no rows.
    """
    found = _clusters(events.select(_known(by).alias("kind"), F.col(title).alias("title"), F.col(pos).alias("pos")))
    return found.withColumn("kind", F.nullif("kind", F.lit("\0")))


def _clusters(events: DataFrame) -> DataFrame:
    t = F.coalesce(F.substring("title", 1, TITLE), F.lit(""))
    first = stored(events.select("kind", t.alias("t"), F.col("pos").cast("long").alias("pos")).groupBy("kind", "t").agg(F.min("pos").alias("at")))
    named = first.select("kind", "at", F.explode(_title_words(F.col("t"))).alias("word"))
    words = named.select("kind", "word").distinct()
    # where a title holds a cluster's word: the only large table, written once
    holds = stored(first.select("kind", "at", F.explode(_parts(F.col("t"))).alias("word")).join(words, ["kind", "word"], "left_semi"))
    named = stored(named)

    open_ = first.select("kind", "at")
    begun = open_.where(F.lit(False))
    # a round reads the open titles' rows, and words of clusters begun in the last one: earlier clusters stopped none of them
    named_open, holds_open, fresh = named, holds, named.where(F.lit(False))
    while not open_.isEmpty():
        waiting = named_open.groupBy("kind", "word").agg(F.min("at").alias("first_open"))
        taken = fresh.groupBy("kind", "word").agg(F.min("at").alias("first_begun"))
        met = holds_open.join(waiting, ["kind", "word"], "left").join(taken, ["kind", "word"], "left")
        least = met.groupBy("kind", "at").agg(F.min("first_open").alias("first_open"), F.min("first_begun").alias("first_begun"))
        joins = F.coalesce(F.col("first_begun") < F.col("at"), F.lit(False))
        begins = ~joins & ~F.coalesce(F.col("first_open") < F.col("at"), F.lit(False))
        now = stored(open_.join(least, ["kind", "at"], "left").select("kind", "at", joins.alias("joins"), begins.alias("begins")))
        begun = begun.unionByName(now.where("begins").select("kind", "at"))
        open_ = now.where("not joins and not begins").select("kind", "at")
        fresh = named_open.join(now.where("begins"), ["kind", "at"], "left_semi")
        named_open, holds_open = (stored(x.join(open_, ["kind", "at"], "left_semi")) for x in (named_open, holds_open))

    begun = stored(begun)
    of_word = named.join(begun, ["kind", "at"], "left_semi").groupBy("kind", "word").agg(F.min("at").alias("place"))
    place = holds.join(of_word, ["kind", "word"]).groupBy("kind", "at").agg(F.min("place").alias("place"))
    out = first.join(place, ["kind", "at"], "left").withColumn("place", F.least("place", "at"))
    return out.join(first.select("kind", F.col("t").alias("cluster"), F.col("at").alias("place")), ["kind", "place"]).select("kind", "t", "at", "cluster", "place")


def merged_events(events: DataFrame, most: int = 5, beneficiaries: int = 10) -> DataFrame:
    """(kind, rank, cluster, model_votes, certainty, event, beneficiaries): the `most` clusters of each kind.

    events: kind, pos, title, certainty, model, beneficiaries (array of (code, score, logic)).  A cluster's event is the one of
    greatest certainty (the first of them; null is 0).  Clusters are in the order of model_votes, the number of their events,
    then certainty, both descending, then of their beginnings.  A beneficiary has one vote from each mention, the models that
    named it, its best score (null is 0) and the logic given first with that score; codes that are null or empty don't count;
    they are in the order of votes and score, both descending, then of their first mention.  Of wordless titles only the last
    event counts.
    """
    t = F.coalesce(F.substring("title", 1, TITLE), F.lit(""))
    # stored, as the reports' whole texts may stand behind it
    events = stored(events.select(_known("kind").alias("kind"), "pos", "title", "certainty", "model", "beneficiaries"))
    x = events.withColumn("t", t).join(_clusters(events).select("kind", "t", "cluster", "place"), ["kind", "t"])
    wordless = F.size(_title_words(F.col("t"))) == 0
    last = F.max("pos").over(Window.partitionBy("kind", "t"))
    x = stored(x.withColumns({"certainty": F.coalesce("certainty", F.lit(0)), "_last": last}).where(~wordless | (F.col("pos") == F.col("_last"))))
    key = ["kind", "place"]
    best = F.struct(-F.col("certainty"), F.col("pos"))
    c = x.groupBy(*key).agg(F.first("cluster").alias("cluster"), F.count("*").alias("model_votes"), F.max("certainty").alias("certainty"), F.min_by("title", best).alias("event"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("model_votes"), F.desc("certainty"), "place"))
    c = c.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)

    b = x.join(c.select(*key), key, "left_semi").select(*key, "pos", "model", F.posexplode("beneficiaries").alias("at", "b")).where("b.code <> ''")
    b = b.select(*key, F.col("b.code").alias("code"), F.struct("pos", "at").alias("seen"), "model", F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce("b.logic", F.lit("")).alias("logic"))
    models = F.transform(F.array_sort(F.collect_list(F.struct("seen", "model"))), lambda s: s["model"])
    b = b.groupBy(*key, "code").agg(F.count("*").alias("votes"), models.alias("models"), F.max("score").alias("score"), F.min_by("logic", F.struct(-F.col("score"), F.col("seen"))).alias("logic"), F.min("seen").alias("seen"))
    at = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("votes"), F.desc("score"), "seen"))
    b = b.withColumn("at", at).where(F.col("at") <= beneficiaries)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("at", "code", "votes", "score", "logic", "models"))), lambda s: s.dropFields("at"))
    b = b.groupBy(*key).agg(rows.alias("beneficiaries"))
    return c.join(b, key, "left").select(F.nullif("kind", F.lit("\0")).alias("kind"), "rank", "cluster", "model_votes", "certainty", "event", "beneficiaries")
