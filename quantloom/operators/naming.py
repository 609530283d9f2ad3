"""Names of one vocabulary looked up in another by stages, the cheap ones first.

Each stage sees only the names that the stages before it left: equal forms of the name by an equi-join, then containment
either way by an index of parts, then aliases that stand for keywords.  Containment is an equality of parts: a name gives
its parts of the lengths that keys have, a key its parts of the lengths of open names, so no stage compares all with all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.feeds import stored


def parts(text: Column, lengths: Column) -> Column:
    """The distinct parts of the text that have one of the lengths (an array of numbers above 0)."""
    of = lambda m: F.when(F.length(text) >= m, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - m + 1, F.lit(1))), lambda i: F.substring(text, i, m)))
    return F.array_distinct(F.flatten(F.array_compact(F.transform(lengths, of))))


def containing(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """Distinct (text, word) where the text contains the word; nulls and empty words are in no pair."""
    t = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct()
    w = words.where(F.col(word) != "").select(F.col(word).alias("word")).distinct()
    lengths = w.agg(F.array_sort(F.collect_set(F.length("word"))).alias("lengths"))  # as many numbers as the longest word has characters
    found = t.crossJoin(F.broadcast(lengths)).select("text", F.explode(parts(F.col("text"), F.col("lengths"))).alias("word"))
    return found.join(w, "word").select("text", "word")


def either_way(names: DataFrame, keys: DataFrame, name: str = "name", key: str = "key") -> DataFrame:
    """Distinct (name, key) where one contains the other."""
    down = containing(names, keys, name, key).toDF("name", "key")
    return down.unionByName(containing(keys, names, key, name).select(F.col("word").alias("name"), F.col("text").alias("key"))).distinct()


def _first(pairs: DataFrame, *order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return pairs.withColumn("_n", n).where("_n = 1").drop("_n")


#: The name itself.
SAME: tuple[Callable[[Column], Column], ...] = (lambda c: c,)


def resolve(names: DataFrame, keys: DataFrame, forms: Sequence[Callable[[Column], Column]] = SAME, contained: bool = True) -> DataFrame:
    """(name, key, value, stage) of each distinct name: the key it means and that key's value; both null, stage null, if none.

    keys: key, value, ord; a key of several rows counts once, by the least ord and value.  Stage 'exact': the first of the
    name's forms that is a key.  Stage 'contained', for the rest: the key of least ord that contains the name or is contained
    in it.  Null and empty names have no key, as have names of an empty vocabulary.
    """
    names = names.select("name").where("name is not null").distinct()
    k = keys.where("key is not null").groupBy("key").agg(F.min(F.struct("ord", "value")).alias("k")).select("key", "k.ord", "k.value")
    tried = names.where("name <> ''").select("name", F.posexplode(F.array(*[f(F.col("name")) for f in forms])).alias("form", "key"))
    exact = stored(_first(tried.join(k, "key"), "form").select("name", "key", "value", F.lit("exact").alias("stage")))
    found = exact
    if contained:
        rest = stored(names.where("name <> ''").join(exact, "name", "left_anti"))
        near = _first(either_way(rest, k).join(k, "key"), "ord", "key")
        found = found.unionByName(near.select("name", "key", "value", F.lit("contained").alias("stage")))
    return names.join(found, "name", "left")


def suffixed(suffix: str) -> Callable[[Column], Column]:
    return lambda c: F.concat(c, F.lit(suffix))


def stripped(mark: str) -> Callable[[Column], Column]:
    """The name without the marks at its end."""
    return lambda c: F.rtrim(c, F.lit(mark))


def keywords(names: DataFrame, aliases: DataFrame, marks: Sequence[str] = ()) -> DataFrame:
    """(name, keyword): the keywords of every alias that contains a name or is contained in it, else the name without marks.

    aliases: alias, keyword (a row for each of its keywords).  The marks go wherever they stand, and spaces around the rest;
    a name of which nothing is left, and an empty one, has no keyword.
    """
    names = names.select("name").where("name <> ''").distinct()
    near = either_way(names, aliases, "name", "alias").withColumnRenamed("key", "alias")
    met = near.join(aliases, "alias").select("name", "keyword").distinct()
    plain = F.col("name")
    for m in marks:
        plain = F.replace(plain, F.lit(m), F.lit(""))
    rest = names.join(met, "name", "left_anti").select("name", F.trim(plain).alias("keyword"))
    return met.unionByName(rest).where("keyword <> ''")


def members(names: DataFrame, keys: DataFrame, listed: DataFrame, catalogue: DataFrame, aliases: DataFrame, forms: Sequence[Callable[[Column], Column]] = SAME, marks: Sequence[str] = ()) -> DataFrame:
    """(name, code, stage): the securities that each sector name means.

    The name's key (see resolve) has its members in listed(value, code).  A name without a key or whose key lists nobody takes
    the securities of catalogue(code, industry) whose industry contains one of its keywords (stage 'keyword'; a null industry
    contains none).  Names that mean nobody have no row.
    """
    r = stored(resolve(names, keys, forms))
    own = stored(r.where("value is not null").join(listed.select("value", "code").distinct(), "value").select("name", "code", "stage"))
    rest = names.select("name").where("name is not null").distinct().join(own, "name", "left_anti")
    words = stored(keywords(rest, aliases, marks))
    hit = containing(catalogue, words, "industry", "keyword").toDF("industry", "keyword")
    more = words.join(hit, "keyword").select("name", "industry").distinct().join(catalogue.select("industry", "code"), "industry")
    return own.unionByName(more.select("name", "code", F.lit("keyword").alias("stage")).distinct())
