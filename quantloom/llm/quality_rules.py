"""Quality rules: repetition and symbol counts of a text, and cross-document line frequency by host.

Normalised lines are hashed; for each host, the distinct documents (distinct texts: copies of a text are one) that hold a
line are counted, and lines above the limit are removed.  A document left with too few of its words is depleted.

At scale: one pass over the texts writes base counts and 64-bit line hashes; counting, limits and joins work on those
narrow rows.  A line that a third of a host's documents hold is summed in each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, small_batches, texts

MARKS = b"#*$%&|<>"
_NOT_MARKS = bytes(sorted(set(range(256)) - set(MARKS)))
_SPACE = b" \t\n\x0b\x0c\r"


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.split() if text else []
    if not words:
        return 0, 0, len(text.translate(None, _NOT_MARKS)) if text else 0, 0, 0
    word_chars = len(b"".join(words).decode())
    seen: set[bytes] = set()
    dup = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += bool(line.strip(_SPACE))
        else:
            seen.add(line)
    repeat = 0
    if len(words) > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        size = len(number)
        code = (ids[:-2] * size + ids[1:-1]) * size + ids[2:] if size < 2_000_000 else _wide_code(ids)
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        hit = np.zeros(len(code), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        repeat = int(covered.sum())
    return len(words), word_chars, len(text.translate(None, _NOT_MARKS)), dup, repeat


def _wide_code(ids: np.ndarray) -> np.ndarray:
    """Windows of a text with over two million different words: pairs get numbers first, so that nothing overflows."""
    _, pair = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)
    return pair[:-1] * (int(ids.max()) + 1) + ids[2:]


def normal_line(line: bytes) -> bytes:
    """A-Z lower-cased, digits as 0, runs of white space as one space, trimmed."""
    return b" ".join(line.lower().translate(_DIGITS).split())


_DIGITS = bytes(48 if 48 <= i <= 57 else i for i in range(256))


def judge(docs: DataFrame, text: str = "text", host: str = "source", doc_id: str = "doc_id", line_limit: int = 20, min_words: int = 50, max_repeat_percent: int = 50, min_left_percent: int = 30, min_left_words: int = 20, count: str = "texts") -> DataFrame:
    """Judge documents by base rules and by what is left of them without their host's frequent lines.

    A line is frequent on a host if more than line_limit of the host's distinct texts hold it, however many it has; with
    count="documents" copies of a text count one by one, so that the lines of a text copied often are frequent.
    A document that lost lines is depleted if less than min_left_percent of its words is left, or fewer than
    min_left_words.

    Result: a row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_lines,
    n_left_words (long), base_failed, depleted, kept (boolean).  A null host is a host of its own.  Null, empty and
    wordless texts: all counts of words 0, base_failed.  Repeated rows are judged alike.  Lines without words have no
    key.  Texts of any length are read whole.  Other columns of docs play no part; an empty table gives no rows.
    """
    if count not in ("texts", "documents"):
        raise ValueError("count: texts or documents")
    spark = docs.sparkSession
    small_batches(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, lines, sizes = [], [], [], []
            for t in texts(batch, "text"):
                counts.append(base_counts(t))
                keys.append(int.from_bytes(blake2b(t or b"", digest_size=8).digest(), "little", signed=True))
                mine: dict[int, list[int]] = {}
                for line in (t or b"").split(b"\n"):
                    k = normal_line(line)
                    if k:
                        x = mine.setdefault(xxhash.xxh3_64_intdigest(k), [0, 0])
                        x[0] += 1
                        x[1] += k.count(b" ") + 1
                lines.append(list(mine))
                sizes.append(list(mine.values()))
            hashes = [np.array(x, np.uint64).view(np.int64) for x in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(keys, pa.int64()), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(5)), pa.array(hashes, pa.list_(pa.int64())), pa.array([[s[0] for s in x] for x in sizes], pa.list_(pa.int32())), pa.array([[s[1] for s in x] for x in sizes], pa.list_(pa.int32()))],
                names=["doc_id", "host", "of", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "times", "words"],
            )

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"))
    schema = "doc_id long, host string, of long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, times array<int>, words array<int>"
    scanned = materialize(rows.mapInArrow(scan, schema))
    distinct = materialize(scanned.groupBy("host", "of").agg(F.count("*").alias("copies"), F.first("lines").alias("lines"), F.first("times").alias("times"), F.first("words").alias("words")))
    held_by = F.count("*") if count == "texts" else F.sum("copies")
    per_line = distinct.select("host", "copies", F.explode("lines").alias("line")).groupBy("host", "line").agg(held_by.alias("texts_with")).where(F.col("texts_with") > line_limit)
    frequent = per_line.select(F.col("host").alias("h"), F.col("line").alias("l"))
    spread = distinct.select("host", "of", F.explode(F.arrays_zip("lines", "times", "words")).alias("x"))
    # few lines are frequent: Spark broadcasts them, else it splits the partitions of a host's or a line's many rows
    removed = spread.join(materialize(frequent), spread["host"].eqNullSafe(F.col("h")) & (F.col("x.lines") == F.col("l"))).groupBy("host", "of").agg(F.sum("x.times").alias("removed"), F.sum("x.words").alias("lost"))
    removed = materialize(removed.select(F.col("host").alias("h"), F.col("of").alias("o"), "removed", "lost"))
    out = scanned.drop("lines", "times", "words").join(removed, F.col("host").eqNullSafe(F.col("h")) & (F.col("of") == F.col("o")), "left")
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = F.col("lost").isNotNull() & ((100 * left < min_left_percent * F.col("n_words")) | (left < min_left_words))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed_lines"), left.cast("long").alias("n_left_words"), failed.alias("base_failed"), depleted.alias("depleted"), (~failed & ~depleted).alias("kept"))
