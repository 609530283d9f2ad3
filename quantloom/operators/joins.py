"""Joins of the funnel: dimensions with defaults, full outer merges, missing-key fills, ordered and fuzzy matches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.sources.feeds import stored


def append_virtual_bars(bars: DataFrame, quotes: DataFrame) -> DataFrame:
    """bars and, where a code has no bar of that day, a bar from a valid quote (open, close and volume above 0)."""
    valid = quotes.where("o > 0 and c > 0 and v > 0")
    new = valid.join(bars.select("code", "d"), ["code", "d"], "left_anti")
    cols = ["code", "d", "o", "h", "l", "c", "v"]
    return bars.select(*cols, F.lit(False).alias("virtual")).unionByName(new.select(*cols, F.lit(True).alias("virtual")))


def first_source(sources: list[tuple[DataFrame, int]], key: str = "code") -> DataFrame:
    """For each key the rows of the first source that has its minimum of rows: sources are (rows, minimum) by priority."""
    all_ = None
    for k, (rows, least) in enumerate(sources):
        n = F.count("*").over(Window.partitionBy(key))
        part = rows.withColumn("_n", n).where(F.col("_n") >= least).drop("_n").withColumn("source", F.lit(k))
        all_ = part if all_ is None else all_.unionByName(part)
    first = F.min("source").over(Window.partitionBy(key))
    return all_.withColumn("_f", first).where("source = _f").drop("_f")


def fill_missing(first: DataFrame, second: DataFrame, key: str = "code") -> DataFrame:
    """first, and the rows of second whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def fuzzy_first(left: DataFrame, names: DataFrame, name: str = "name", key: str = "key", order: str = "ord") -> DataFrame:
    """left with the first key, exact before contained, that equals or contains its name or is contained in it.

    names is a small dimension; the theta join is Spark's nested loop over it once its size is checked.
    """
    exact = F.col(name) == F.col(key)
    hit = exact | F.col(name).contains(F.col(key)) | F.col(key).contains(F.col(name))
    pairs = left.join(names, hit, "left")
    best = F.row_number().over(Window.partitionBy(name).orderBy(F.when(exact, 0).otherwise(1), order))
    return pairs.withColumn("_n", best).where("_n = 1").drop("_n")


#: Bits of the filter of title beginnings: so many for each (two are set), within bounds; 2^28 bits are 32 MB.
FILTER_BITS, LEAST_BITS, MOST_BITS = 256, 2**16, 2**28


def event_matches(events: DataFrame, key: str = "doc_id", title: str = "title", n: int = 10) -> DataFrame:
    """(eid, doc_id): for each key the least key whose title's first n characters its title holds, or that holds its own.

    An inverted index of n-character windows (shorter ones for titles under n) stands for the theta join; what meets is
    aggregated by window and by title, so a window that many titles hold makes no pairs.  A bit table of the titles' beginnings
    goes to the tasks, and only windows with a set bit are shuffled; an equality join decides about these.  An empty title is
    held by all; a null title matches nothing.
    """
    t = events.select(F.unhex(F.sha2(title, 256)).alias("h"), F.substring(title, 1, n).alias("k"), F.col(key).cast("long").alias("id"), F.col(title).alias("t")).where("t is not null")
    first = t.groupBy("k").agg(F.min("id").alias("first_id"))
    met = held_windows(t.select("h", "id", "t"), first).groupBy("h", "k").agg(F.min("id").alias("id")).join(first, "k")
    holds = met.groupBy("h").agg(F.min("first_id").alias("holds"))
    holder = met.groupBy("k").agg(F.min("id").alias("held_by"))
    best = t.select("h", "k").distinct().join(holds, "h", "left").join(holder, "k", "left").select("h", F.least("holds", "held_by").alias("best"))
    ids = events.select(F.col(key).alias("eid"), F.unhex(F.sha2(title, 256)).alias("h"))
    return ids.join(best, "h", "left").groupBy("eid").agg(F.min("best").alias("doc_id"))


def held_windows(titles: DataFrame, first: DataFrame) -> DataFrame:
    """(h, id, k): the windows of titles(h, id, t) that are a k of first(k, ...), and few others, each once a row."""

    def window_hashes(t: str, m: int):
        """64-bit hashes of all windows of m code points of a text."""
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(points) - m + 1
        h = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for i in range(m):
                h = (h ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            k = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([int(window_hashes(x, len(x)).view("int64")[0]) for x in k], pa.int64())], names=["hash"])

    hashes = stored(first.where("k <> ''").select("k").mapInArrow(hashed, "hash long").distinct())
    bits = LEAST_BITS
    while bits < min(MOST_BITS, FILTER_BITS * hashes.count()):
        bits *= 2
    # two bits a hash; words of 64 bits, packed into rows of 1,024 words, at most 4,096 rows
    bit = hashes.select(F.explode(F.array("hash", F.shiftright("hash", 32))).alias("bit")).select(F.col("bit").bitwiseAND(bits - 1).alias("bit"))
    words = bit.select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"))
    words = words.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    packed = words.groupBy(F.shiftright("word", 10).alias("row")).agg(F.collect_list(F.struct("word", "mask")).alias("words"))
    table = np.zeros(bits // 64, np.int64)
    for row in packed.toLocalIterator():
        for word, mask in row.words:
            table[word] = mask
    lengths = [m for (m,) in first.select(F.length("k")).distinct().collect()]  # at most n + 1
    shared = titles.sparkSession.sparkContext.broadcast(table.tobytes())

    def cut(batches):
        import pyarrow as pa

        set_ = np.frombuffer(shared.value, np.int64)
        for batch in batches:
            rows = ([], [], [])
            for h, id_, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = set()
                for m in lengths:
                    if m == 0:
                        found.add("")
                        continue
                    hash_ = window_hashes(text, m).view(np.int64)
                    bit, other = hash_ & (bits - 1), (hash_ >> 32) & (bits - 1)
                    found.update(text[i : i + m] for i in np.flatnonzero(set_[bit >> 6] >> (bit & 63) & set_[other >> 6] >> (other & 63) & 1))
                rows[0].extend([h] * len(found))
                rows[1].extend([id_] * len(found))
                rows[2].extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string())], names=["h", "id", "k"])

    return titles.mapInArrow(cut, "h binary, id long, k string")


def enhanced_events(original: DataFrame, enhanced: DataFrame, n: int = 10, certain: int = 50) -> DataFrame:
    """enhanced(eid, title, verified, certainty) with oid, the least original(oid, title) whose first n characters its title
    holds or that holds its own; without one, only verified events of `certain` or more stay.

    Titles are short: each gives its parts of up to n characters once, and parts meet by equality.
    """
    parts = lambda t, m: F.when(F.length(t) >= m, F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - m + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(m))))
    windows = lambda t: F.array_distinct(F.flatten(F.filter(F.array(*[parts(t, m) for m in range(1, n + 1)]), lambda x: x.isNotNull())))
    o = original.where("title is not null").groupBy("title").agg(F.min("oid").alias("oid"))
    e = enhanced.where("title is not null").select("title").distinct()
    held = e.select("title", F.explode(windows(F.col("title"))).alias("k")).join(o.groupBy(F.substring("title", 1, n).alias("k")).agg(F.min("oid").alias("oid")), "k").select("title", "oid")
    holds = o.select("oid", F.explode(windows(F.col("title"))).alias("k")).groupBy("k").agg(F.min("oid").alias("oid"))
    holder = e.select("title", F.substring("title", 1, n).alias("k")).join(holds, "k").select("title", "oid")
    best = held.unionByName(holder).groupBy("title").agg(F.min("oid").alias("oid"))
    return enhanced.join(best, "title", "left").where(F.col("oid").isNotNull() | (F.col("verified") & (F.col("certainty") >= certain)))


def reordered(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """items(code, pos, ...) in the order of wanted(code, at), then the rest in their own; unknown and repeated codes drop out."""
    first = wanted.groupBy("code").agg(F.min("at").alias("at"))
    j = items.join(first, "code", "left")
    place = F.row_number().over(Window.orderBy(F.col("at").asc_nulls_last(), "pos")).cast("long")
    return j.withColumn("place", place).drop("at")


def contains_any(column: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | column.contains(w)
    return hit
