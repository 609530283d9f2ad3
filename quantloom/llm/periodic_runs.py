"""Periodic runs of words: stretches that repeat themselves, found by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least 2q long, that no neighbouring word extends.  Periods below
SHORT are found by direct scans, one comparison of the text with itself for each lag.  Longer ones go by scales: for periods
from 2^k to 2^(k+1) the text's m-grams (m = 2^(k-1)) are numbered exactly by prefix doubling, and of each window of m + 1
m-grams (2^k words, at most a period) the least in a mixed order is its minimizer.  Windows a period apart inside a run hold the same
words, so their minimizers are equal and lie exactly a period apart: pairs of equal minimizers at such distances seed the
extension, which compares by the numbered grams and is exact.

Inside a run of a short period the same m-gram returns again and again.  Such a row of equal minimizers is one group, found
in the runs of smaller scales: pairs inside a group are multiples of its period and seed nothing, and of two groups only
pairs with the first member of one are needed, since any other pair can be shifted left.  So texts of one word repeated
cost no more than others.

At scale: a text is one row of a map; nothing is shuffled.  A text of n words needs about 4 n log2(n) bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import extended, small_batches, texts, with_columns, with_text_last, without
from .shingles import mix

#: Periods below this are found by direct scans; a power of two.
SHORT = 32
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words, and only these, get equal numbers below the number of words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def _stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], equal.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _primitive(w: np.ndarray, start: int, q: int) -> bool:
    """Whether q is the smallest period of a stretch from start that has period q and is at least 2q long."""
    rest, f = q, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f == 0:
            p = q // f
            if np.array_equal(w[start : start + q], w[start + p : start + p + q]):
                return False
            while rest % f == 0:
                rest //= f
        f += 1
    return True


def _short_runs(w: np.ndarray, longest: int, least: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs of periods up to `longest`; those shorter than `least` words may be missing."""
    out, n = [], len(w)
    for q in range(1, min(longest, n // 2) + 1):
        most = max(q, least - q)  # so many equal words in a row are needed
        if not (w[most - 1 : n - q : most] == w[most - 1 + q :: most]).any():  # and each such row holds one of these places
            continue
        starts, ends = _stretches(w[:-q] == w[q:])
        long = ends - starts >= most
        out += [(s, e + q, q) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if _primitive(w, s, q)]
    return out


def _minimizers(gram: np.ndarray, width: int) -> np.ndarray:
    """Places of the least gram (in a mixed order; ties: the first) of each window of `width` grams, ascending."""
    order = np.argsort(mix(np.arange(int(gram.max()) + 1).astype(np.uint64)))
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    n = len(gram)
    value = place[gram] * n + np.arange(n)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.int64).max)
    padded[:n] = value
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.minimum(behind[: n - width + 1], ahead[width - 1 : n])
    return np.unique(windows % n)


def _seeds(gram: np.ndarray, m: int, low: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of pairs of equal minimizers low to 2 low - 1 apart; inside: the number of a gram's run, or -1."""
    at = _minimizers(gram, m + 1)
    at = at[np.argsort(gram[at], kind="stable")]
    alone = np.flatnonzero(inside[at] < 0)
    group = inside[at] + len(gram)
    group[alone] = alone  # below len(gram), so apart from runs
    first = np.concatenate(([True], (np.diff(gram[at]) != 0) | (np.diff(group) != 0)))
    far = 4 * len(gram) + 4 * low
    key = gram[at] * far + at
    one = np.flatnonzero(first)
    places, distances = [], []
    for lo, hi in ((low, 2 * low), (1 - 2 * low, 1 - low)):
        begin, end = np.searchsorted(key, key[one] + lo), np.searchsorted(key, key[one] + hi)
        count = end - begin
        i = np.repeat(one, count)
        j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        keep = group[i] != group[j]
        i, j = i[keep], j[keep]
        places.append(np.minimum(at[i], at[j]))
        distances.append(np.abs(at[i] - at[j]))
    pairs = np.unique(np.stack((np.concatenate(distances), np.concatenate(places))), axis=1)
    return pairs[1], pairs[0]


def _extend(levels: list[np.ndarray], n: int, at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch [left, right) around each place where words d apart are equal; levels: numbered grams of 1, 2, 4 ... words."""
    left, right = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        gram, m, going = levels[k], 1 << k, np.arange(len(at))
        while len(going):  # often at most once, but at the last level
            going = going[right[going] + d[going] + m <= n]
            going = going[gram[right[going]] == gram[right[going] + d[going]]]
            right[going] += m
        going = np.arange(len(at))
        while len(going):
            going = going[left[going] >= m]
            going = going[gram[left[going] - m] == gram[left[going] - m + d[going]]]
            left[going] -= m
    return left, right


def _numbered(levels: list[np.ndarray], m: int) -> bool:
    """Number grams of twice the words by pairs until they have m words or, by halves, would have more; False if they are all different."""
    while True:
        gram, half = levels[-1], 1 << (len(levels) - 1)
        if not len(gram) or int(gram.max()) + 1 == len(gram):
            return False
        if 2 * half > m:
            return True
        levels.append(np.unique(gram[:-half] * (int(gram.max()) + 1) + gram[half:], return_inverse=True)[1])


def runs(w: np.ndarray, least: int = 12, short: int = SHORT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbered words at least max(least, 2 period) long, by start, then period."""
    n, low, levels = len(w), short, [w]
    # a run holds each gram of so many words of its beginning twice; where grams are all different, longer ones are too
    if not _numbered(levels, least // 2):
        return []
    found = _short_runs(w, short - 1, min(least, short // 2))
    while 2 * low <= n:
        m = low // 2
        if not _numbered(levels, m):
            break
        gram = levels[-1]
        inside = np.full(len(gram), -1)
        for number, (start, end, q) in enumerate(found):
            if 2 * q <= m <= end - start:
                inside[start : end - m + 1] = number
        place, d = _seeds(gram, m, low, inside)
        if len(place):
            left, right = _extend(levels, n, place, d)
            long = right - left >= d
            for s, e, q in sorted(set(zip(left[long].tolist(), right[long].tolist(), d[long].tolist(), strict=True))):
                if _primitive(w, s, q):
                    found.append((s, e + q, q))
        low *= 2
    return sorted((s, e - s, q) for s, e, q in found if e - s >= max(least, 2 * q))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by a space."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """docs with n_words (long), runs (array of (start, length, period) by start, then period) and collapsed (string).

    Words are maximal runs of characters other than ASCII white space, numbered from 0; a run is at least max(least, twice
    its smallest period) words long, and its neighbours don't continue it.  `collapsed` holds the words that are in no run
    after its first period, joined by one space.  Null, empty and blank texts have 0 words, no runs and an empty
    `collapsed`.  Texts of any length are read whole.  Equal rows get equal results.  Columns of docs with the names of the
    results, in any case, are replaced; all others stay.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = with_text_last(docs, text)
    last = docs.columns[-1]
    docs = without(docs, "n_words", "runs", "collapsed")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found, rest = [], [], []
            for t in texts(batch, last):
                words = (t or b"").split()
                own = runs(word_numbers(words), least)
                n.append(len(words))
                found.append([{"start": s, "length": k, "period": q} for s, k, q in own])
                rest.append(collapsed(words, own).decode("utf-8", "replace"))
            yield with_columns(batch.drop_columns([last]), n_words=pa.array(n, pa.int64()), runs=pa.array(found, _RUNS), collapsed=pa.array(rest, pa.string()))

    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    out = extended(docs.drop(last).schema, ("n_words", T.LongType()), ("runs", T.ArrayType(run)), ("collapsed", T.StringType()))
    return docs.mapInArrow(scan, out)


def longest_run(column: str = "runs") -> Column:
    """The run of greatest length; ties: the smallest start, then the smallest period.  Null without runs."""
    ranked = F.transform(column, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"), r.alias("run")))
    return F.array_min(ranked)["run"]


def runs_digest(column: str = "runs") -> Column:
    """sha256 of the runs' `start,length,period`, each with a line feed."""
    lines = F.transform(column, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)


def planted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with a repeating end in one of ten texts, by the checksum of the id: a test bed whose runs are known.

    With h the CRC32 of the id in decimal, g = floor(h / 10), n the number of words: if h % 10 is 0 and n > 0, each word from
    a = g % n on is the original word a + (i - a) % p with p = 1 + floor((n - a) / (3 + g % 8)), and one space joins the
    words.  Other texts, and those with a null id, stay.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.expr(rf"regexp_extract_all(`{text}`, '[^\\x20\\x09-\\x0D]+', 0)")
    n = F.size("\0words").cast("long")
    a = F.pmod(F.col("\0g"), n)
    p = 1 + F.floor((n - a) / (3 + F.col("\0g") % 8))
    return (
        docs.withColumn("\0words", F.when(h % 10 == 0, words)).withColumn("\0g", g)
        .withColumn("\0a", F.when(n > 0, a)).withColumn("\0p", F.when(n > 0, p))
        .withColumn("\0at", F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < F.col("\0a"), i).otherwise(F.col("\0a") + (i - F.col("\0a")) % F.col("\0p")))))
        .withColumn(text, F.when(n > 0, F.array_join(F.transform("\0at", lambda i: F.get("\0words", i.cast("int"))), " ")).otherwise(F.col(text)))
        .drop("\0words", "\0g", "\0a", "\0p", "\0at")
    )
