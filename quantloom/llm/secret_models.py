"""Secrets in texts: fixed base patterns, and further tokens by two character Markov models.

Base spans (assign, access, hex) follow fixed patterns.  Other long tokens are judged by the ratio of their likelihood
under two second-order Markov models of characters: one of random strings (keys, tokens, digests), one of ordinary
identifiers (words, compounds in the usual notations, names with numbers, dates and versions).  Both are trained from
labelled samples: tokens of the texts themselves, the values of base spans as random and words as ordinary, with random
strings over the usual alphabets and compounds of the sampled words in the usual notations beside them; or samples of
the user's own.  The least ratio accepted is set on samples kept aside.

At scale: one pass takes the samples (each task offers its `sample` tokens of least hash, a bound that does not grow with
the texts), one pass scans.  Nothing is shuffled but the offers; the models are one table of SYMBOLS^3 floats.
"""

from __future__ import annotations

import heapq
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import extended, materialize, small_batches, with_columns, with_text_last, without

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# all matches of [0-9a-f]+ are whole runs, so the look-behind changes nothing but the time
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A text without one of these, in lower case, has no assign span.
_WORDS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind; leftmost non-overlapping matches of each kind that are long enough."""
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# -- candidates
#: A candidate is a run of these of at least MIN_LENGTH characters, at most two = behind it.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
MIN_LENGTH = 16
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of tokens outside the spans taken that may be random: no plain numbers, no UUIDs (they name things), no
    parts of addresses with ://, no pieces of words with other letters."""
    spans, k = sorted((s, e) for _, s, e in taken), 0
    seen, word, scheme = 0, 0, -1  # the beginning of the word and the last :// before what was seen
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        while start < end and text[start] in "-_/+":
            start += 1
        while start < end and text[end - 1] in "-_/+":
            end -= 1
        token = text[start:end]
        if len(token) < MIN_LENGTH or token.isdecimal() or _UUID.fullmatch(token):
            continue
        if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
            continue
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if k < len(spans) and spans[k][0] < end:
            continue
        word = max(word, *(text.rfind(c, seen, start) + 1 for c in " \t\n\r\x0b\x0c"))
        scheme = max(scheme, text.rfind("://", max(seen - 2, 0), start))
        seen = start
        if scheme < word:
            yield start, end


# -- models
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: The symbols are these, one for all other characters, and one before a token's beginning.
SYMBOLS = len(_ALPHABET) + 2
_SYMBOL = np.full(256, SYMBOLS - 2, np.int64)
_SYMBOL[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))


def trigrams(token: str) -> np.ndarray:
    """The token's trigrams of symbols as numbers, one for each character."""
    s = np.concatenate(([SYMBOLS - 1] * 2, _SYMBOL[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]))
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def log_likelihoods(tokens: list[str]) -> np.ndarray:
    """Log probability of a symbol after two others (SYMBOLS^3), smoothed by the shorter contexts (Witten and Bell's weights)."""
    counts = np.zeros(SYMBOLS**3)
    for t in tokens:
        np.add.at(counts, trigrams(t), 1)
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    p = np.full(SYMBOLS, 1 / (SYMBOLS - 1))
    for c in (counts.sum(axis=(0, 1)), counts.sum(axis=0), counts):
        kinds, total = (c > 0).sum(axis=-1, keepdims=True), c.sum(axis=-1, keepdims=True)
        p = np.where(total > 0, (c + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(np.maximum(p, 1e-12)).ravel()


@dataclass(frozen=True)
class SecretModel:
    """ratio: the log-likelihood ratio of each trigram, random against ordinary; least: the least sum accepted."""

    ratio: np.ndarray
    least: float
    held_out: tuple[float, float]  # shares of random and of ordinary samples kept aside that are accepted

    def score(self, token: str) -> float:
        return float(self.ratio[trigrams(token)].sum())


def random_strings(n: int, seed: int = 0) -> list[str]:
    """n random strings of 16 to 64 characters over the alphabets of keys, tokens and digests."""
    r = random.Random(seed)
    lower, upper, digits = _ALPHABET[:26], _ALPHABET[26:52], _ALPHABET[52:62]
    alphabets = [digits + "abcdef", digits + "ABCDEF", lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", upper + digits, lower + digits, upper + "234567"]
    return ["".join(r.choices(alphabets[k % len(alphabets)], k=r.randint(16, 64))) for k in range(n)]


def compounds(words: list[str], n: int, seed: int = 0) -> list[str]:
    """n identifiers made of words in the usual notations, with numbers, dates and versions between them."""
    r, out = random.Random(seed), []
    while words and len(out) < n:
        w = [r.choice(words) for _ in range(r.randint(2, 5))]
        if r.random() < 0.4:
            w.insert(r.randint(1, len(w)), r.choice((str(r.randint(0, 9)), str(r.randint(1900, 2100)), f"v{r.randint(0, 12)}", f"{r.randint(2000, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", str(r.randint(0, 99999)))))
        camel = "".join(x[:1].upper() + x[1:].lower() for x in w)
        forms = [joint.join(w).lower() for joint in ("_", "-", "/")]
        out.append(r.choice([*forms, "".join(w), "_".join(w).upper(), camel, camel[:1].lower() + camel[1:]]))
    return out


_WORD = re.compile(r"[A-Za-z][A-Za-z0-9]*+(?:[_-][A-Za-z0-9]++)*+")
_PIECE = re.compile(r"[_-]")
#: Of so many words a task remembers that it has offered them.
REMEMBERED = 500_000


def offered(texts: Iterator[str | None], sample: int) -> list[tuple[str, bool, int]]:
    """(token, random, hash): of the values of base spans and of the words and identifiers the `sample` distinct ones of least hash."""
    kept: dict[bool, dict[str, int]] = {True: {}, False: {}}
    worst = {True: 1 << 64, False: 1 << 64}
    seen: set[str] = set()

    def offer(token: str, label: bool) -> None:
        h = xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) >> 1
        if h < worst[label] and token not in kept[label]:
            kept[label][token] = h
            if len(kept[label]) >= 2 * sample:
                trim(label)

    def trim(label: bool) -> None:
        kept[label] = dict(heapq.nsmallest(sample, kept[label].items(), key=lambda x: (x[1], x[0])))
        if len(kept[label]) == sample:
            worst[label] = max(kept[label].values())

    for text in texts:
        if not text:
            continue
        spans = base_spans(text)
        for kind, start, end in spans:
            m = _ASSIGN.fullmatch(text, start, end) if kind == "assign" else None
            value = m[1] if m else text[start:end]
            if any(c.isdigit() for c in value):  # `token = something` isn't random
                offer(value, True)
        for _, start, end in reversed(spans):
            text = f"{text[:start]} {text[end:]}" if end <= len(text) else text[:start]
        new = set(text.split()) - seen
        if len(seen) > REMEMBERED:
            seen.clear()
        seen |= new
        for w in new:
            w = w.strip(".,;:!?()[]\"'")
            # long pieces of mixed characters may be secrets themselves, so they are no samples of ordinary ones
            if len(w) <= 40 and _WORD.fullmatch(w) and all(len(x) < MIN_LENGTH or x[1:].islower() for x in _PIECE.split(w)):
                offer(w, False)
    for label in kept:
        trim(label)
    return [(t, label, h) for label, own in kept.items() for t, h in own.items()]


def label_samples(docs: DataFrame, text: str = "text", sample: int = 4000) -> DataFrame:
    """(token, random, hash): up to `sample` distinct tokens of each label, those of least hash over all texts."""
    small_batches(docs.sparkSession)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = offered((t for b in batches for t in b.column(0).to_pylist()), sample)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))], names=["token", "random", "hash"])

    # written, so that the texts are read once for both labels
    offers = materialize(docs.select(F.col(text).cast("string")).mapInArrow(take, "token string, random boolean, hash long").groupBy("random", "token").agg(F.min("hash").alias("hash")))
    best = [offers.where("random" if label else "not random").orderBy("hash", "token").limit(sample) for label in (True, False)]
    return best[0].unionByName(best[1])


def train(samples: DataFrame | list[tuple[str, bool]], synthetic: int = 8000, false_share: float = 0.0005, floor: float = 12.0) -> SecretModel:
    """Models of the samples (columns token and random, a bounded table such as label_samples gives) and `synthetic` strings of each label.

    Every fifth token, by its hash, is kept aside, with compounds of these words; the least ratio accepted lets pass at most `false_share` of the ordinary
    ones of them that are long enough to be candidates, and is `floor` at least, the odds at which a token is random
    beforehand.  Null tokens and labels don't count.  The result depends on the set of samples only.
    """
    rows = samples if isinstance(samples, list) else [(r["token"], r["random"]) for r in samples.select("token", "random").collect()]
    rows = sorted({(t, bool(label)) for t, label in rows if t and label is not None})
    aside = lambda t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace"), 1) % 5 == 0
    parts: dict[tuple[bool, bool], list[str]] = {(label, kept): [t for t, own in rows if own == label and aside(t) == kept] for label in (True, False) for kept in (True, False)}
    for kept, n in ((False, synthetic), (True, synthetic // 4)):
        parts[True, kept] += random_strings(n, seed=kept)
        # compounds kept aside are made of words kept aside, so that they measure words never seen
        words = [t for t in parts[False, kept] if t.isalpha() and t.isascii()] or list("abcdefghijklmnopqrstuvwxyz")
        # few words make few compounds: counts are to grow with what is known of the language
        parts[False, kept] += compounds(words, min(n, 2 * len(words)), seed=kept)
    ratio = log_likelihoods(parts[True, False]) - log_likelihoods(parts[False, False])
    model = SecretModel(ratio.astype(np.float32), 0.0, (0.0, 0.0))
    scores = {label: np.array([model.score(t) for t in parts[label, True] if len(t) >= MIN_LENGTH]) for label in (True, False)}
    least = max(floor, float(np.quantile(scores[False], 1 - false_share, method="higher")) + 1e-3) if len(scores[False]) else floor
    return SecretModel(model.ratio, least, tuple(float((scores[k] > least).mean()) if len(scores[k]) else 0.0 for k in (True, False)))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, model: SecretModel, text: str = "text") -> DataFrame:
    """docs with base and added: arrays of (kind, start, end), by start and kind, in code points, the end exclusive.

    `base` holds the matches of the fixed patterns; `added` the other tokens of MIN_LENGTH characters or more whose ratio
    is above the model's least; they overlap neither base spans nor each other.  Null and empty texts have no spans; texts
    of any length are read whole.  Equal rows get equal spans.  Columns of docs named base or added, in any case, are
    replaced; the text and all others stay.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = with_text_last(docs, text)
    last = docs.columns[-1]
    docs = without(docs, "base", "added")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                own = base_spans(t) if t else []
                more = [("random", s, e) for s, e in candidates(t, own) if model.score(t[s:e]) > model.least] if t else []
                for out, spans in ((base, own), (added, more)):
                    out.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield with_columns(batch.drop_columns([last]), base=pa.array(base, _SPAN), added=pa.array(added, _SPAN))

    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return docs.mapInArrow(scan, extended(docs.drop(last).schema, ("base", span), ("added", span)))


def redacted(text: str = "text", spans: str = "added", mark: str = "[secret]") -> Column:
    """The text with each of the spans, which don't overlap, replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))


def joined_spans(column: Column | str) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = F.create_map(*[x for k, name in enumerate(KINDS) for x in (F.lit(name), F.lit(k))])
    keyed = F.transform(column, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
