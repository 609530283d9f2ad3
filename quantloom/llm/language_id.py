"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its character 2- to 4-grams inside words (word boundaries count as characters),
hashed to BUCKETS.  Embeddings and softmax are learned together on a bounded sample of labelled documents and on pieces
of them; probabilities are calibrated by a temperature on documents kept aside, and so is the score below which a
prediction is rejected.  A linear softmax of a mean is a mean of per-bucket logits, so prediction is one table lookup
per n-gram.

At scale: training is on at most `sample_docs` documents, whose n-gram counts (at most BUCKETS each) come to the driver;
prediction is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import extended, small_batches, with_columns, without
from .shingles import mix

BUCKETS = 1 << 14
DIMENSIONS = 16
PIECE_WORDS = 12
PIECES = 4
PIECE_CHARS = 1 << 20
UNKNOWN = "und"
_LETTER = np.zeros(1 << 16, bool)
_LETTER[[i for i in range(1 << 16) if chr(i).isalpha()]] = True


def grams(text: str) -> np.ndarray | None:
    """Buckets of the text's n-grams; None if it has no letter."""
    out, letters = [], False
    for i in range(0, len(text), PIECE_CHARS):
        c = np.frombuffer(text[i : i + PIECE_CHARS].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[np.minimum(c, 0xFFFF)]
        high = c > 0xFFFF
        if high.any():
            letter[high] = [chr(x).isalpha() for x in c[high]]
        if not letter.any():
            continue
        letters = True
        # one boundary between words, one at either end
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        x = np.where(letter, c, 0)[keep].astype(np.uint64)
        x = np.concatenate([[np.uint64(0)], x, [np.uint64(0)]])
        inner = x != 0
        h, ok = x, np.ones(len(x), bool)
        for n in (2, 3, 4):
            if len(x) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
            ok = ok[:-1] & (inner[n - 2 : len(x) - 1] if n > 2 else True)
            out.append((mix(h[ok]) & np.uint64(BUCKETS - 1)).astype(np.int32))
    if not letters:
        return None
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass
class LanguageModel:
    languages: list[str]
    logits: np.ndarray  # of a bucket
    bias: np.ndarray
    temperature: float
    reject_below: float

    def probabilities(self, buckets: np.ndarray) -> np.ndarray:
        z = (self.logits[buckets].mean(axis=0) if len(buckets) else 0) + self.bias
        z = z / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); ("und", 0) for null, a text without letters, or without a model."""
        buckets = grams(text) if text and self.languages else None
        if buckets is None:
            return UNKNOWN, 0.0
        p = self.probabilities(buckets)
        k = int(p.argmax())
        return self.languages[k], float(min(1.0, max(0.0, p[k])))


def held_out(doc_id: str, folds: int = 3, fold: int = 1) -> Column:
    """True for documents that a model must not learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _sample(docs: DataFrame, text: str, lang: str, doc_id: str, sample_docs: int, per_language: int, most_languages: int) -> tuple[list[str], list]:
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(doc_id)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not counts:
        return [], []
    each = max(2, min(per_language, sample_docs // len(counts)))
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, 1.3 * each / n) * (1 << 20))))])
    chosen = labelled.where(F.pmod("h", F.lit(1 << 20)) < rate[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang_, t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = t.split()
                starts = np.random.default_rng(h & 0xFFFFFFFF).integers(0, max(1, len(words) - PIECE_WORDS), PIECES)
                for k, piece in enumerate([t, *(" ".join(words[s : s + PIECE_WORDS]) for s in starts)]):
                    b = grams(piece)
                    if b is not None and len(b):
                        i, n = np.unique(b, return_counts=True)
                        rows.append((lang_, h, k, i, (n / n.sum()).astype(np.float32)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.list_(pa.float32()))], names=["lang", "h", "piece", "buckets", "shares"])

    table = chosen.mapInArrow(count, "lang string, h long, piece int, buckets array<int>, shares array<float>").toArrow()
    rows = table.select(["lang", "h", "piece"]).to_pylist()
    for name in ("buckets", "shares"):  # as slices of the table: as lists of numbers they would take ten times its memory
        slices = (c.values.to_numpy()[i:j] for c in table[name].chunks for i, j in zip(c.offsets.to_numpy(), c.offsets.to_numpy()[1:], strict=False))
        for row, x in zip(rows, slices, strict=True):
            row[name] = x
    rows.sort(key=lambda r: (r["lang"], r["h"], r["piece"]))
    taken: dict[str, set] = {}
    kept = []
    for r in rows:
        seen = taken.setdefault(r["lang"], set())
        if r["h"] in seen or len(seen) < each:
            seen.add(r["h"])
            kept.append(r)
    return sorted(counts), kept


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = 2000, per_language: int = 300, most_languages: int = 1000, epochs: int = 6, reject_rate: float = 0.001, above_chance: float = 0.15) -> LanguageModel:
    """Learn from at most per_language documents of a language and about sample_docs in all, none of them held out.

    most_languages: bound of the sample of labelled rows in languages; the commonest are learnt, others never predicted.
    Documents with a null text or language teach nothing; repeated rows are one document; an empty table gives a model
    that knows no language.  Ties in a language's sample go by a hash of id and text.
    reject_rate: share of correctly predicted calibration documents that the rejection threshold may lose.
    above_chance: part of the way from chance to certainty that the threshold never passes, so that short texts and
    texts in two languages, whose best language is still likelier than chance, are not rejected.
    """
    small_batches(docs.sparkSession)
    languages, rows = _sample(docs, text, lang, doc_id, sample_docs, per_language, most_languages)
    number = {x: k for k, x in enumerate(languages)}
    data = [(np.array(r["buckets"], np.int64), np.array(r["shares"], np.float32), number[r["lang"]], r["piece"], r["h"] % 4 == 0) for r in rows]
    rng = np.random.default_rng(11)
    e = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.1).astype(np.float32)
    w = np.zeros((DIMENSIONS, max(1, len(languages))), np.float32)
    w += (rng.standard_normal(w.shape) * 0.1).astype(np.float32)
    b = np.zeros(w.shape[1], np.float32)
    learn = [x for x in data if not x[4]] or data
    weight = np.bincount([x[2] for x in learn], minlength=w.shape[1]).astype(np.float32) if learn else b
    weight = np.where(weight > 0, weight.max(initial=1) / np.maximum(weight, 1), 0)
    for epoch in range(epochs):
        rate = 2.0 * (1 - epoch / epochs)
        for k in rng.permutation(len(learn)):
            i, share, y, *_ = learn[k]
            v = share @ e[i]
            z = v @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= min(weight[y], 10.0)
            # a mean over many n-grams moves each of them a little: the step is scaled up
            e[i] -= rate * 10 * share[:, None] * (w @ p)[None, :]
            w -= rate * 0.1 * np.outer(v, p)
            b -= rate * 0.01 * p
    model = LanguageModel(languages if learn else [], e @ w, b, 1.0, 0.0)
    aside = [x for x in data if x[4]]
    if aside and learn:
        z = np.array([x[1] @ model.logits[x[0]] + b for x in aside])
        y = np.array([x[2] for x in aside])

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(axis=1))).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.2, 5, 33)), key=loss)
        s = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
        top = (s / s.sum(axis=1, keepdims=True))[np.argmax(s, axis=1) == y].max(axis=1, initial=0)
        chance = 1 / len(languages)
        model.reject_below = min(float(np.quantile(top, reject_rate)), chance + above_chance * (1 - chance)) if len(top) else 0.0
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The columns of docs and lang_pred (string), score (double), rejected (boolean), which replace columns of those names.

    Null, empty and letterless texts: "und", 0, rejected.  Ties go to the first language by code point.  The whole text
    is read, whatever its length.  Repeated rows are judged alike; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    docs = without(docs, "lang_pred", "score", "rejected")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            out = [m.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield with_columns(batch, lang_pred=pa.array([x[0] for x in out], pa.string()), score=pa.array([x[1] for x in out], pa.float64()), rejected=pa.array([x[0] == UNKNOWN or x[1] < m.reject_below for x in out], pa.bool_()))

    return docs.mapInArrow(predict, extended(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())))
