"""Line deduplication with a once-seen and a twice-seen Bloom filter.

Pass 1 hashes every line key once per document and fills two filters, one for hashes seen and one for hashes seen
again; filters of different tasks merge exactly as if one task had seen all (a bit that two tasks have both seen
counts as seen twice).  A false positive costs a shuffled row, never a wrong result; a repeated key is never missed.
Pass 2 shuffles only keys that the twice-seen filter suspects, as (digest, documents, first document) summed per task
beforehand, and confirms them by SHA-256 digest.  Pass 3 rewrites the texts against the confirmed set, which is
broadcast when it is small enough and otherwise joined by digest.

At scale: the filters have 16 bits for each line of the corpus, up to 2^30 bits (128 MB, which a task holds twice while it
fills them and once while it looks up); beyond some 10^8 lines a fuller filter lets more keys reach the exact pass, which
stays exact.  How full they are is logged.  A key that a third of all documents hold reaches the shuffle once per task.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import extended, materialize, small_batches, texts, with_columns, without

SPACE = b" \t\n\x0b\x0c\r"
PROBES = 4
SEGMENTS = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


def line_key(line: bytes) -> bytes:
    """The line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return line.strip(SPACE).lower()


def keys_of(text: bytes | None) -> set[bytes]:
    """Distinct non-empty line keys of a text."""
    found = {line_key(x) for x in text.split(b"\n")} if text else set()
    found.discard(b"")
    return found


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES positions for each 64-bit hash, by double hashing."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)
    return (hashes[:, None] + i * step[:, None]) % np.uint64(bits)


class TwoBlooms:
    """Bits of the hashes seen once or more, and of those seen twice or more."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    @staticmethod
    def has(filter_: np.ndarray, positions: np.ndarray) -> np.ndarray:
        return ((filter_[positions >> np.uint64(3)] >> (positions & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    @staticmethod
    def put(filter_: np.ndarray, positions: np.ndarray) -> None:
        flat = positions.ravel()
        np.bitwise_or.at(filter_, flat >> np.uint64(3), np.left_shift(np.uint8(1), (flat & np.uint64(7)).astype(np.uint8)))

    def add(self, hashes: np.ndarray) -> None:
        unique, counts = np.unique(hashes, return_counts=True)
        if not len(unique):
            return
        at = bit_positions(unique, self.bits)
        again = self.has(self.once, at) | (counts > 1)
        self.put(self.twice, at[again])
        self.put(self.once, at)

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return self.has(self.twice, bit_positions(hashes, self.bits)) if len(hashes) else np.zeros(0, bool)


def bits_for(docs: DataFrame, text: str) -> int:
    """16 bits for each line of the corpus, as a power of two within bounds."""
    lines = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (16 * int(lines)).bit_length()))


def twice_filter(docs: DataFrame, text: str, bits: int) -> bytes:
    """The twice-seen filter over all documents: bits / 8 bytes, however large the corpus."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pending = TwoBlooms(bits), []
        for batch in batches:
            for t in texts(batch, text):
                pending += [xxhash.xxh3_64_intdigest(k) for k in keys_of(t)]
            if len(pending) > 100_000:
                seen.add(np.array(pending, np.uint64))
                pending = []
        seen.add(np.array(pending, np.uint64))
        if seen.once.any():
            part = bits // 8 // SEGMENTS
            for s in range(SEGMENTS):
                pieces = [zlib.compress(f[s * part : (s + 1) * part].tobytes(), 1) for f in (seen.once, seen.twice)]
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [pieces[0]], "twice": [pieces[1]]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for s, *pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(p), np.uint8) for p in pieces)
                if s not in held:
                    held[s] = [once.copy(), twice.copy()]
                else:
                    held[s][1] |= twice | (held[s][0] & once)
                    held[s][0] |= once
        for s, (once, twice) in held.items():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([s], pa.int32()), "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    schema = "segment int, once binary, twice binary"
    parts = docs.select(text).mapInArrow(fill, schema)
    near = parts.repartition(4 * SEGMENTS, "segment", F.spark_partition_id() % 16).mapInArrow(merge, schema)
    rows = near.repartition(SEGMENTS, "segment").mapInArrow(merge, schema).select("segment", "twice").collect()
    out = bytearray(bits // 8)
    for r in rows:
        piece = zlib.decompress(r["twice"])
        out[r["segment"] * len(piece) : (r["segment"] + 1) * len(piece)] = piece
    full = int(np.bitwise_count(np.frombuffer(out, np.uint8)).sum()) / bits
    logging.getLogger(__name__).info("twice-seen filter: %d bits, %.2f %% set", bits, 100 * full)
    return bytes(out)


def _held_filter(twice, bits: int) -> TwoBlooms:
    """A look at the broadcast twice-seen filter, without a copy of its own."""
    seen = TwoBlooms.__new__(TwoBlooms)
    seen.bits, seen.twice = bits, np.frombuffer(twice.value, np.uint8)
    return seen


def repeated_lines(docs: DataFrame, text: str, order: str, min_docs: int, bits: int, twice) -> DataFrame:
    """(digest, docs, first) of the line keys that min_docs or more documents hold; first: the least `order` among them.

    twice: the broadcast twice-seen filter.
    """

    def suspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _held_filter(twice, bits)
        counts: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            n, first = (np.array(x, np.int64) for x in zip(*counts.values(), strict=True))
            return pa.RecordBatch.from_pydict({"digest": list(counts), "docs": n, "first": first})

        for batch in batches:
            for t, at in zip(texts(batch, text), batch.column(1).to_pylist(), strict=True):
                keys = list(keys_of(t))
                hits = seen.suspects(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64))
                for k in np.flatnonzero(hits):
                    at = 2**63 - 1 if at is None else at
                    x = counts.setdefault(sha256(keys[k]).digest(), [0, at])
                    x[0] += 1
                    x[1] = min(x[1], at)
            if len(counts) > 200_000:
                yield flush()
                counts = {}
        if counts:
            yield flush()

    found = docs.select(text, F.col(order).cast("long")).mapInArrow(suspect, "digest binary, docs long, first long")
    return found.groupBy("digest").agg(F.sum("docs").alias("docs"), F.min("first").alias("first")).where(F.col("docs") >= min_docs)


def _rewrite(text: bytes | None, drop, keep_first: bool) -> tuple[bytes, int, int]:
    lines = (text or b"").split(b"\n")
    kept, seen = [], set()
    for line in lines:
        key = line_key(line)
        gone = bool(key) and drop(sha256(key).digest())
        if gone and keep_first and drop(sha256(key).digest(), True) and key not in seen:
            seen.add(key)
            gone = False
        if not gone:
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, text: str = "text", order: str = "doc_id", min_docs: int = 10, keep: str = "none", filter_bits: int | None = None, broadcast_keys: int = 100_000) -> DataFrame:
    """Remove lines whose key is found in min_docs or more documents.

    keep: "none" removes every occurrence; "first" leaves the first one in the document with the least `order`.
    filter_bits: bits of each Bloom filter; by default from the number of lines.  broadcast_keys: confirmed keys to
    broadcast at most (100,000 are 3 MB to the driver and some 15 MB in a worker); beyond it they are joined by digest,
    where Spark splits the partitions of a digest or a text that very many rows share.

    Result: the columns of docs with `text` rewritten, and n_lines, n_dropped (long), which replace columns of those
    names.  Null or empty text: one empty line, nothing dropped, text "".  Empty lines have no key and stay.  Texts of any
    length are read whole.  Repeated
    rows count as documents.  With keep="first", a null or repeated `order` counts as the largest or as one document.
    An empty table gives an empty table.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep: none or first")
    spark = docs.sparkSession
    small_batches(spark)
    docs = without(docs, "n_lines", "n_dropped")
    bits = filter_bits or bits_for(docs, text)
    twice = spark.sparkContext.broadcast(twice_filter(docs, text, bits))
    keys = materialize(repeated_lines(docs, text, order, min_docs, bits, twice))
    schema = extended(docs.schema, ("n_lines", T.LongType()), ("n_dropped", T.LongType()))
    first = keep == "first"
    if keys.count() <= broadcast_keys:
        held = spark.sparkContext.broadcast({bytes(r["digest"]): r["first"] for r in keys.select("digest", "first").collect()})

        def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            drop = held.value
            for batch in batches:
                orders = batch.column(batch.schema.get_field_index(order)).to_pylist() if first else [None] * batch.num_rows
                out = [_rewrite(t, lambda d, mine=False, at=at: drop.get(d) == at if mine else d in drop, first) for t, at in zip(texts(batch, text), orders, strict=True)]
                yield _result(batch, text, out)

        return docs.mapInArrow(rewrite, schema)
    return _rewrite_joined(docs, keys, text, order, first, schema, bits, twice)


def _result(batch: pa.RecordBatch, text: str, out: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    kind = batch.schema.field(text).type
    body = pa.array([x[0] for x in out], pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).cast(kind)
    return with_columns(batch, **{text: body, "n_lines": pa.array([x[1] for x in out], pa.int64()), "n_dropped": pa.array([x[2] for x in out], pa.int64())})


def suspected_pairs(docs: DataFrame, text: str, bits: int, twice) -> DataFrame:
    """(of, digest): for each text, by its digest, the lines that the twice-seen filter suspects; few of a corpus' lines."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _held_filter(twice, bits)
        for batch in batches:
            pairs = set()
            for t in texts(batch, text):
                keys = list(keys_of(t))
                hits = np.flatnonzero(seen.suspects(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)))
                if len(hits):
                    of = sha256(t).digest()
                    pairs |= {(of, sha256(keys[k]).digest()) for k in hits}
            yield pa.RecordBatch.from_pydict({"of": pa.array([p[0] for p in pairs], pa.binary()), "digest": pa.array([p[1] for p in pairs], pa.binary())})

    return docs.select(text).mapInArrow(lines, "of binary, digest binary").distinct()


def _rewrite_joined(docs: DataFrame, keys: DataFrame, text: str, order: str, first: bool, schema: T.StructType, bits: int, twice) -> DataFrame:
    """The path beyond broadcast_keys: a text's digest stands for it, so the lists of lines to drop need no row id."""
    drops = suspected_pairs(docs, text, bits, twice).join(keys.select("digest", "first"), "digest").groupBy("of").agg(F.collect_list(F.struct("digest", "first")).alias("drops"))
    joined = docs.withColumn("\0of", F.unhex(F.sha2(F.col(text).cast("binary"), 256))).join(drops.withColumnRenamed("of", "\0of").withColumnRenamed("drops", "\0drops"), "\0of", "left").drop("\0of")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = batch.column(batch.schema.get_field_index(order)).to_pylist()
            out = []
            for t, at, drops in zip(texts(batch, text), orders, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                held = {d["digest"]: d["first"] for d in drops or []}
                out.append(_rewrite(t, lambda d, mine=False, at=at, held=held: held.get(d) == at if mine else d in held, first))
            yield _result(pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]), text, out)

    return joined.mapInArrow(rewrite, schema)
