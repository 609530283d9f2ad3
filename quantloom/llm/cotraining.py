"""Quality classification by co-training of a text view and a metadata view, with a toxicity head.

The text view sees the words (the mean log-odds of hashed words and word beginnings between good and bad documents) and
what the text looks like (shares of letter classes, symbols, word and line lengths, repetition); the metadata view sees
source, language and length.  A document that trains gets its log-odds from the half of the training set that it is not
in, since its own words would vouch for themselves.  Each starts from labelled documents, and in every round hands the
documents that it is surest of to the other's training set, as long as it was as right as it was sure on labelled
documents kept aside; there the two are calibrated and combined in the end.  Toxicity is a matter of single words, so its head sums log-odds of hashed words and word beginnings
that are far commoner in toxic documents.

At scale: training is on at most `sample_rows` labelled and `pool_rows` other documents; their features (24 numbers and
at most `sample_words` word buckets a document, those of least hash and so a fair sample of its words) come to the driver, never their texts.  Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import extended, small_batches, texts, with_columns, without
from .shingles import word_hashes

META_BUCKETS = 512
WORD_BUCKETS = 1 << 18
STEMS = (4, 5, 6)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:'\"()-?", b"!", b"|<>{}[]\\^~`", b"#*$%&@=+_/")):
    _CLASS[list(_chars)] = _k + 1
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def text_features(text: bytes | None) -> np.ndarray:
    """Shares and log lengths that describe a text; zeros for null or empty."""
    out = np.zeros(24)
    if not text:
        return out
    n = len(text)
    out[:10] = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=10)[:10] / n
    words = text.split()
    lines = text.split(b"\n")
    out[10:16] = (np.sqrt(out[6:9].sum()), np.sqrt(out[7]), np.sqrt(out[8]), np.sqrt(out[9]), np.sqrt(out[3]), np.sqrt(out[2]))
    if words:
        distinct = len(set(words))
        out[16:22] = (np.log1p(len(words)) / 10, n / len(words) / 20, distinct / len(words), sum(w.isupper() for w in words) / len(words), sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / len(words), len(words) / len(lines) / 50)
    out[22] = 1 - len(set(lines)) / len(lines)
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Buckets of source, language and length; nulls have buckets of their own."""
    size = -1 if n_chars is None else int(np.log2(max(1, n_chars)) * 2)
    return [xxhash.xxh3_64_intdigest(f"{k}\0{v}") % META_BUCKETS for k, v in enumerate((source, lang, size))]


def word_buckets(text: bytes | None) -> np.ndarray:
    """Distinct buckets of the text's words and of their first bytes, case and punctuation aside."""
    if not text:
        return np.zeros(0, np.int64)
    words = set(text.lower().translate(_PLAIN).split())
    parts = words | {w[:k] + b"\0" for w in words for k in STEMS if len(w) > k}
    if not parts:
        return np.zeros(0, np.int64)
    return np.unique((word_hashes(b" ".join(parts)) % np.uint64(WORD_BUCKETS)).astype(np.int64))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Newton's method for ridge logistic regression of soft labels y with weights w; the last column of x is 1."""
    beta = np.zeros(x.shape[1])
    w = w / w.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * beta
        hess = (x * (w * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ x + ridge * np.eye(len(beta))
        beta -= np.clip(np.linalg.solve(hess, grad), -3, 3)
    return beta


def _one_hot(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), META_BUCKETS + 1))
    for k, r in enumerate(rows):
        x[k, r] = 1
    x[:, -1] = 1
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def word_odds(words: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Smoothed log-odds of each word bucket between documents labelled 1 and 0, none beyond 3."""
    counts, total = np.zeros((2, WORD_BUCKETS), np.float32), np.zeros(2)
    for w, y in zip(words, labels, strict=True):
        counts[int(y > 0.5), w] += 1
        total[int(y > 0.5)] += 1
    odds = np.log((counts[1] + 1) / (total[1] + 2)) - np.log((counts[0] + 1) / (total[0] + 2))
    return np.clip(np.where(counts.sum(axis=0) >= 2, odds, 0), -3, 3).astype(np.float32)


def mean_odds(odds: np.ndarray, words: np.ndarray) -> float:
    return float(odds[words].mean()) if len(words) else 0.0


@dataclass
class QualityModel:
    text: np.ndarray | None
    odds: np.ndarray | None  # of each word bucket
    mean: np.ndarray
    scale: np.ndarray
    meta: np.ndarray
    blend: np.ndarray  # of the two views' log-odds and 1
    toxic: np.ndarray | None  # weight of each word bucket
    toxic_line: tuple[float, float]
    handed_over: list[int] = field(default_factory=lambda: [0, 0])  # pseudo-labels that the text and the metadata view got

    def quality(self, text: np.ndarray, meta: list[int], words: np.ndarray) -> float:
        if self.text is None:
            return 0.5
        a = float(np.append((text - self.mean) / self.scale, (mean_odds(self.odds, words) * 4, 1)) @ self.text)
        b = float(self.meta[meta].sum() + self.meta[-1])
        return float(1 / (1 + np.exp(-np.clip(self.blend @ (np.clip(a, -12, 12), np.clip(b, -12, 12), 1), -30, 30))))

    def toxicity(self, buckets: np.ndarray) -> float:
        if self.toxic is None or not len(buckets):
            return 0.0
        a, b = self.toxic_line
        return float(1 / (1 + np.exp(-np.clip(a * min(12.0, float(self.toxic[buckets].sum())) + b, -30, 30))))


def _features(rows: DataFrame, sample_words: int) -> list[dict]:
    """Features of rows (h, text, source, lang, n_chars, quality, toxic), in the order of h; words as arrays."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = texts(batch, "text")
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in ("h", "source", "lang", "n_chars", "quality", "toxic")}
            meta = [meta_features(*x) for x in zip(*(cols[n].to_pylist() for n in ("source", "lang", "n_chars")), strict=True)]
            yield pa.RecordBatch.from_arrays([cols["h"], pa.array([text_features(x) for x in t], pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.int32())), pa.array([word_buckets(x)[:sample_words] for x in t], pa.list_(pa.int32())), cols["quality"], cols["toxic"]], names=["h", "x", "meta", "words", "quality", "toxic"])

    table = rows.mapInArrow(take, "h long, x array<double>, meta array<int>, words array<int>, quality int, toxic int").toArrow()
    words = []
    for part in table["words"].chunks:
        flat, ends = part.values.to_numpy(), part.offsets.to_numpy()
        words += [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]
    out = table.drop_columns(["words"]).to_pylist()
    for row, w in zip(out, words, strict=True):
        row["words"] = w
    return sorted(out, key=lambda r: (r["h"], str(r["meta"]), r["x"]))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", doc_id: str = "doc_id", sample_rows: int = 6000, pool_rows: int = 4000, rounds: int = 4, sure: float = 0.95, hand_over: int = 200, sample_words: int = 4000) -> QualityModel:
    """Learn from at most about sample_rows labelled documents and pool_rows others; every fourth labelled one calibrates.

    sure: probability from which a view's opinion is handed over; hand_over: how many of each class in a round;
    rounds=1 is training on labels alone; sample_words: word buckets of a training document, those of least hash, while scoring
    takes all words of a text.  Labels of unknown documents and null ids teach nothing; a repeated row counts
    as often as it is there; ties in certainty go by the order of a hash of the id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    grain = 1 << 20
    part = lambda h, rate: F.pmod(h, F.lit(grain)) < int(min(1.0, rate) * grain)
    marks = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("\0d"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    n = marks.count()
    chosen = marks.where(part(F.xxhash64("\0d"), sample_rows / max(1, n)))
    d = docs.select(F.col(doc_id).alias("\0e"), F.xxhash64(F.col(doc_id), F.lit("h")).alias("h"), F.col(text).cast("string").alias("text"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), F.col(n_chars).cast("long").alias("n_chars"))
    known = _features(d.join(F.broadcast(chosen), F.col("\0e") == F.col("\0d")).drop("\0d", "\0e"), sample_words)  # bounded by sample_rows
    pool = _features(d.where(part(F.xxhash64("\0e", F.lit("p")), pool_rows / max(1, docs.count()))).drop("\0e").withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")}), sample_words)
    good = [r for r in known if r["quality"] is not None]
    fold = [r["h"] % 4 == 0 for r in good]
    learn, aside = [r for r, f in zip(good, fold, strict=True) if not f], [r for r, f in zip(good, fold, strict=True) if f]
    blank = QualityModel(None, None, np.zeros(24), np.ones(24), np.zeros(META_BUCKETS + 1), np.zeros(3), None, (1.0, 0.0))
    if len({r["quality"] for r in learn}) == 2 and aside:
        raw = np.array([r["x"] for r in learn])
        blank.mean, blank.scale = raw.mean(axis=0), raw.std(axis=0) + 1e-6
        everyone = [*learn, *pool]
        words, half = [r["words"] for r in everyone], np.array([r["h"] // 4 % 2 for r in everyone])
        looks = lambda rows: (np.array([r["x"] for r in rows]) - blank.mean) / blank.scale
        design = lambda rows, odds: np.hstack([looks(rows), odds[:, None] * 4, np.ones((len(rows), 1))])
        one_hot = _one_hot([r["meta"] for r in everyone])
        y = np.array([float(r["quality"] > 0) for r in learn])
        aside_y, aside_one_hot = np.array([float(r["quality"] > 0) for r in aside]), _one_hot([r["meta"] for r in aside])
        label = [np.concatenate([y, np.full(len(pool), np.nan)]) for _ in range(2)]
        beta = [None, None]
        for _ in range(rounds):
            have = [~np.isnan(x) for x in label]
            odds = np.zeros(len(everyone))
            for k in (0, 1):
                other = np.flatnonzero(have[0] & (half != k))
                table = word_odds([words[i] for i in other], label[0][other])
                odds[half == k] = [mean_odds(table, words[i]) for i in np.flatnonzero(half == k)]
            x = [design(everyone, odds), one_hot]
            for v in (0, 1):
                weight = np.where(np.arange(len(everyone))[have[v]] < len(learn), 1.0, 0.3)
                beta[v] = logistic(x[v][have[v]], label[v][have[v]], weight, 1e-3 if v == 0 else 1e-2)
            blank.odds = word_odds([words[i] for i in np.flatnonzero(have[0])], label[0][have[0]])
            aside_odds = np.array([mean_odds(blank.odds, r["words"]) for r in aside])
            tested = [np.clip(a, -12, 12) for a in (design(aside, aside_odds) @ beta[0], aside_one_hot @ beta[1])]
            new = [x_.copy() for x_ in label]
            for v in (0, 1):
                p, kept_aside = sigmoid(x[v] @ beta[v]), sigmoid(tested[v])
                open_ = np.flatnonzero(np.isnan(label[1 - v]))
                for value, rank in ((1.0, -p[open_]), (0.0, p[open_])):
                    # a view that was not as right as it was sure on the documents kept aside hands nothing over
                    claims = aside_y[(kept_aside >= sure) if value else (kept_aside <= 1 - sure)]
                    if ((claims == value).sum() + 1) / (len(claims) + 2) < sure:
                        continue
                    best = open_[np.argsort(rank, kind="stable")[:hand_over]]
                    best = best[(p[best] >= sure) if value else (p[best] <= 1 - sure)]
                    new[1 - v][best] = value
            blank.handed_over = [int(np.isnan(a).sum() - np.isnan(b).sum()) + n for a, b, n in zip(label, new, blank.handed_over, strict=True)]
            # what is handed over after the last round trains nobody
            label = new
        blank.text, blank.meta = beta
        blank.blend = logistic(np.stack([*tested, np.ones(len(aside))], axis=1), aside_y, np.ones(len(aside)), 1e-3)
        blank.blend[:2] = np.maximum(blank.blend[:2], 0)
    marked = [r for r in known if r["toxic"] is not None]
    learn = [r for r in marked if r["h"] % 4] or marked
    counts = np.zeros((2, WORD_BUCKETS))
    total = np.zeros(2)
    for r in learn:
        c = int(r["toxic"] > 0)
        counts[c, r["words"]] += 1
        total[c] += 1
    if total.min() > 0:
        odds = np.log((counts[1] + 0.5) / (total[1] + 1)) - np.log((counts[0] + 0.5) / (total[0] + 1))
        blank.toxic = np.where((counts[1] >= 3) & (odds > 2.5), odds, 0.0)
        rows = [r for r in marked if r["h"] % 4 == 0]
        s = np.array([[min(12.0, blank.toxic[r["words"]].sum()), 1] for r in rows]).reshape(-1, 2)
        y = np.array([float(r["toxic"] > 0) for r in rows])
        blank.toxic_line = tuple(logistic(s, y, np.ones(len(y)), 1e-4)) if len(set(y)) == 2 else (1.0, -4.0)
    return blank


def score_documents(docs: DataFrame, model: QualityModel, text: str = "text", source: str = "source", lang: str = "lang", n_chars: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """The columns of docs and quality_score, toxic_score (double, 0 to 1), kept (boolean), which replace such columns.

    kept: quality_score >= threshold and toxic_score < threshold.  Null and empty texts are scored by their metadata
    and as texts of zero length; whole texts are read.  Repeated rows are scored alike; an empty table gives an empty
    table.  Without labels of both classes a score is 0.5 (quality) or 0 (toxicity).
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    docs = without(docs, "quality_score", "toxic_score", "kept")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            t = texts(batch, text)
            meta = [meta_features(None if a is None else str(a), None if b is None else str(b), c) for a, b, c in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (source, lang, n_chars)), strict=True)]
            words = [word_buckets(x) for x in t]
            q = [m.quality(text_features(x), y, w) for x, y, w in zip(t, meta, words, strict=True)]
            s = [m.toxicity(w) for w in words]
            yield with_columns(batch, quality_score=pa.array(q, pa.float64()), toxic_score=pa.array(s, pa.float64()), kept=pa.array([a >= threshold and b < threshold for a, b in zip(q, s, strict=True)], pa.bool_()))

    return docs.mapInArrow(score, extended(docs.schema, ("quality_score", T.DoubleType()), ("toxic_score", T.DoubleType()), ("kept", T.BooleanType())))
