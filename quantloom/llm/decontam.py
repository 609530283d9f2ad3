"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by an item of n words if a run of its words is within k = floor((1 - similarity) * n) word
edits of the item: with any_length a run of any length, else one of n words (its whole text if that is shorter).  Words
are lower-cased runs without ASCII punctuation.

CGK walks drift apart with the number of edits, so long items are looked for by pieces of about PIECE words: of a
passage within the edits allowed, one piece at least is within its own share of them.

For each document, in one pass and without a shuffle:
1. Windows that cannot match a piece are left out by the q-gram lemma: within k edits, n words share n - q + 1 - k * q
   word q-grams.  This loses nothing: where that number is not above 0, all windows are looked at.
2. The CGK random walk turns a window into symbols: step j writes the word under the cursor, and a random bit of (j,
   word) says whether the cursor moves on.  Few edits leave most symbols equal, whatever they shift.
3. Each repetition samples a few symbols; equal samples make a candidate.  Walks are as many as `recall` asks for at
   the limit of similarity, by simulated walks of that length.
4. Candidates are confirmed by exact word edit distance of the whole item to any part of the words around the window.

At scale: the item set is read in blocks of `block_items`; only a block's arrays are broadcast.  Documents never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import extended, small_batches, with_columns, without

Q = 3
SYMBOLS = 3
SAMPLINGS = 8
PIECE = 25
WALK = 1.8
POOL = 1 << 20
_PUNCTUATION = {c: " " for c in map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")}


def words_of(text: str | None) -> list[str]:
    return text.lower().translate(_PUNCTUATION).split() if text else []


def edits_allowed(n: int, similarity: float) -> int:
    return math.floor((1 - similarity) * n + 1e-9)


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distances of the rows of a and b."""
    columns = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(columns, (len(a), len(columns))).astype(np.int32)
    for i in range(a.shape[1]):
        new = row + 1
        np.minimum(new[:, 1:], row[:, :-1] + (b != a[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - columns, axis=1) + columns
    return row[:, -1]


def least_distances(text: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least word edit distances of the rows of b to any part of the rows of text."""
    columns = np.arange(b.shape[1] + 1)
    row = np.broadcast_to(columns, (len(text), len(columns))).astype(np.int32)
    least = row[:, -1].copy()
    for i in range(text.shape[1]):
        new = row + 1
        new[:, 0] = 0
        np.minimum(new[:, 1:], row[:, :-1] + (b != text[:, i : i + 1]), out=new[:, 1:])
        row = np.minimum.accumulate(new - columns, axis=1) + columns
        np.minimum(least, row[:, -1], out=least)
    return least


def pieces(n: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces by which an item of n words is looked for."""
    count = max(1, round(n / PIECE))
    cuts = [n * k // count for k in range(count + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def sampled(tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, classes: np.ndarray, bits: np.ndarray, spots: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """LSH keys (rows, SAMPLINGS) of windows under one random walk; classes: the piece lengths they stand for."""
    steps = int(WALK * classes.max())
    out = np.empty((len(starts), steps), np.int64)
    cursor = np.zeros(len(starts), np.int64)
    end = bits.shape[1] - 1
    for j in range(steps):
        inside = cursor < lengths
        symbol = np.where(inside, tokens[starts + np.minimum(cursor, lengths - 1)], end)
        out[:, j] = symbol
        cursor += (bits[j // 63, symbol] >> (j % 63)) & 1
    at = (spots[None, :] * np.floor(WALK * classes)[:, None]).astype(np.int64)
    picked = np.take_along_axis(out, at, axis=1).reshape(len(starts), SAMPLINGS, SYMBOLS)
    return (picked * salt).sum(axis=2) * 1_000_003 + classes[:, None]


#: Walks beyond which a similarity is refused, rather than searched with less recall than asked for.
MOST_WALKS = 1000


@lru_cache(maxsize=256)
def walks_needed(n: int, similarity: float, recall: float) -> int:
    """Walks that find a piece of n words at the limit of similarity with probability `recall`.

    Simulated for substitutions, losses and additions; the worst counts.  The samplings of a walk are one trial.
    """
    pairs, rounds, edits = 64, 48, edits_allowed(n, similarity)
    rng = np.random.default_rng(n)
    length = n + 2 * edits
    own = np.arange(pairs * n).reshape(pairs, n)
    v = pairs * (n + length) + 1
    salt = rng.integers(1, 2**62, (SYMBOLS,), dtype=np.int64) | 1
    most = 1
    for kind in ("other", "lost", "added"):
        rows = []
        for words in own:
            at = rng.choice(n, edits, replace=False)
            foreign = pairs * n + rng.integers(0, pairs * length, length)
            rows.append(np.delete(words, at) if kind == "lost" else np.insert(words, at, foreign[:edits]) if kind == "added" else np.where(np.isin(np.arange(n), at), foreign[:n], words))
            rows[-1] = np.append(rows[-1], foreign)[:length]
        tokens = np.concatenate([own.ravel(), *rows])
        starts = np.append(np.arange(pairs) * n, pairs * n + np.arange(pairs) * length)
        lengths = np.repeat([n, n + edits], pairs)
        hits = np.zeros(pairs)
        for _ in range(rounds):
            bits = rng.integers(0, 2**63, (math.ceil(WALK * n / 63) + 1, v), dtype=np.int64)
            keys = sampled(tokens, starts, lengths, np.full(2 * pairs, n), bits, rng.random(SAMPLINGS * SYMBOLS), salt)
            hits += (keys[:pairs] == keys[pairs:]).any(axis=1)
        # pairs differ: the mean of their chances of being missed, each chance with a trial's half added
        missed = 1 - (hits + 0.5) / (rounds + 1)
        while (missed**most).mean() > 1 - min(recall, 0.999999):
            most += 1
            if most > MOST_WALKS:
                raise ValueError(f"recall {recall} of items of {n} words at similarity {similarity} takes more than {MOST_WALKS} walks")
    return most


def word_edits(a: list[str], b: list[str]) -> int:
    """Edit distance of two short lists of words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Items:
    """A block of benchmark items: vocabulary, q-grams by piece length, and LSH keys of the pieces."""

    def __init__(self, rows: list[tuple[int | None, str | None]], similarity: float, recall: float, min_words: int, any_length: bool = False, run_words: int = 4):
        self.similarity, self.any_length = similarity, any_length
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.whole: dict[tuple[str, ...], list[int | None]] = {}
        self.short: list[tuple[int | None, list[str], int]] = []
        self.parts: dict[int, dict[tuple[str, ...], list[tuple[int, int]]]] = {}
        for item, text in rows:
            words = words_of(text)
            if words and len(words) < min(min_words, run_words):
                self.whole.setdefault(tuple(words), []).append(item)
            elif words and len(words) < min_words:
                # of edits + 1 parts of a passage within the edits allowed one is as it is in the item
                edits = edits_allowed(len(words), similarity)
                for k in range(edits + 1):
                    a, b = k * len(words) // (edits + 1), (k + 1) * len(words) // (edits + 1)
                    self.parts.setdefault(b - a, {}).setdefault(tuple(words[a:b]), []).append((len(self.short), a))
                self.short.append((item, words, edits))
            elif words:
                self.ids.append(item)
                self.tokens.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        cut = [(k, i, j) for k, t in enumerate(self.tokens) for i, j in pieces(len(t))]
        parts = [self.tokens[k][i:j] for k, i, j in cut]
        self.item_of, self.offset = (np.array([c[x] for c in cut], np.int64) for x in (0, 1))
        self.lengths = np.array([len(t) for t in parts], np.int64)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.classes = np.unique(self.lengths)
        v = len(self.vocabulary) + 2
        codes = [(self.code(t[:-2], t[1:-1], t[2:]), np.searchsorted(self.classes, len(t))) for t in parts if len(t) >= Q]
        pairs = np.unique(np.array([(c, k) for cs, k in codes for c in cs], np.int64).reshape(-1, 2), axis=0)
        self.gram, first = np.unique(pairs[:, 0], return_index=True)
        self.gram_from, self.gram_to = first, np.append(first[1:], len(pairs))
        self.gram_class = pairs[:, 1]
        self.walks = np.array([walks_needed(int(n), similarity, recall) for n in self.classes], np.int64)
        longest, most = (int(self.classes[-1]), int(self.walks.max())) if len(self.classes) else (1, 0)
        rng = np.random.default_rng(5)
        self.bits = rng.integers(0, 2**63, (most, math.ceil(WALK * longest / 63) + 1, v), dtype=np.int64)
        self.spots = rng.random((most, SAMPLINGS * SYMBOLS))
        self.salt = rng.integers(1, 2**62, (SYMBOLS,), dtype=np.int64) | 1
        self.keys: list[list[tuple[np.ndarray, np.ndarray]]] = []
        if self.tokens:
            flat = np.concatenate(parts)
            starts = np.append(0, np.cumsum(self.lengths)[:-1])
            for w in range(most):
                mine = np.flatnonzero(self.walks_of(self.lengths) > w)
                k = self.sample(flat, starts[mine], self.lengths[mine], self.lengths[mine], w)
                orders = [np.argsort(k[:, s], kind="stable") for s in range(SAMPLINGS)]
                self.keys.append([(k[o, s], mine[o]) for s, o in enumerate(orders)])

    def walks_of(self, lengths: np.ndarray) -> np.ndarray:
        return self.walks[np.searchsorted(self.classes, lengths)]

    def code(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a * 2_000_003 + b) * 2_000_003 + c  # wraps for huge vocabularies; a clash only adds a candidate

    def need(self, n):
        """Least number of q-grams that a matching window of a piece of n words has in common with it."""
        return n - Q + 1 - Q * np.floor((1 - self.similarity) * n + 1e-9).astype(np.int64)

    def quoted(self, words: list[str]) -> list[int | None]:
        """Items of less than min_words words that the document holds within the edits allowed, or is as a whole."""
        found, seen = list(self.whole.get(tuple(words), ())), set()
        for n, table in self.parts.items():
            starts = {p[0] for p in table}
            for i in [i for i in range(len(words) - n + 1) if words[i] in starts]:
                for k, offset in table.get(tuple(words[i : i + n]), ()):
                    if k not in seen and self._short_match(words, i - offset, k):
                        seen.add(k)
        return found + [self.short[k][0] for k in seen]

    def _short_match(self, words: list[str], at: int, k: int) -> bool:
        """Whether a passage that begins within the edits of `at` is within them of short item k."""
        _, own, edits = self.short[k]
        for start in range(max(0, at - edits), min(max(0, len(words) - 1), at + edits) + 1):
            lengths = range(max(1, len(own) - edits), len(own) + edits + 1) if self.any_length else (len(own),)
            if any(word_edits(own, words[start : start + m]) <= edits for m in lengths):
                return True
        return False

    def sample(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, classes: np.ndarray, walk: int) -> np.ndarray:
        return sampled(tokens, starts, lengths, classes, self.bits[walk], self.spots[walk], self.salt)

    def windows(self, tokens: np.ndarray, doc_from: np.ndarray, doc_to: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, length, class) of the windows that share enough q-grams with pieces of a length."""
        empty = (np.zeros(0, np.int64),) * 3
        found = []
        for n in map(int, self.classes[self.need(self.classes) <= 0]):
            # so many edits may leave no q-gram whole: every window is looked at
            slack = edits_allowed(n, self.similarity)
            last = np.maximum(doc_to - max(1, n - slack), doc_from)
            starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(doc_from, last, strict=True)])
            ends = np.minimum(starts + n + slack, doc_to[np.searchsorted(doc_from, starts, side="right") - 1])
            found.append((starts, ends - starts, np.full(len(starts), n, np.int64)))
        gathered = lambda: tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else empty
        known = tokens > 0
        at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:]) if len(tokens) >= Q else np.zeros(0, np.int64)
        if not len(at) or not len(self.gram):
            return gathered()
        codes = self.code(tokens[at], tokens[at + 1], tokens[at + 2])
        spot = np.minimum(np.searchsorted(self.gram, codes), len(self.gram) - 1)
        hit = self.gram[spot] == codes
        at, spot = at[hit], spot[hit]
        doc = np.searchsorted(doc_from, at, side="right") - 1
        inside = at + Q <= doc_to[doc]
        at, spot = at[inside], spot[inside]
        if not len(at):
            return gathered()
        n_of = self.gram_to[spot] - self.gram_from[spot]
        where = np.repeat(at, n_of)
        offset = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        kind = self.gram_class[np.repeat(self.gram_from[spot], n_of) + offset]
        for c in np.unique(kind):
            n, p = int(self.classes[c]), where[kind == c]
            slack = edits_allowed(n, self.similarity)  # a piece's passage may be longer or shorter by so many words
            need = int(self.need(n))
            if need <= 0 or len(p) < need:
                continue
            head, tail = p[: len(p) - need + 1], p[need - 1 :]
            near = tail - head <= n + slack - Q
            head, tail = head[near], tail[near]
            d = np.searchsorted(doc_from, head, side="right") - 1
            same = tail < doc_to[d]
            head, tail, d = head[same], tail[same], d[same]
            if not len(head):
                continue
            low = np.maximum(tail - n - slack + Q, doc_from[d])
            high = np.minimum(head, np.maximum(doc_to[d] - n + slack, doc_from[d]))
            count = np.maximum(high - low + 1, 0)
            starts = np.unique(np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            if len(starts):
                ends = np.minimum(starts + n + slack, doc_to[np.searchsorted(doc_from, starts, side="right") - 1])
                found.append((starts, ends - starts, np.full(len(starts), n, np.int64)))
        return gathered()

    def matches(self, tokens: np.ndarray, doc_from: np.ndarray, doc_to: np.ndarray) -> set[tuple[int, int]]:
        """Confirmed (document, item) of documents that lie one after another in tokens; 0 stands for unknown words."""
        starts, lengths, classes = self.windows(tokens, doc_from, doc_to)
        pool = max(1, POOL // max(1, int(WALK * (classes.max() if len(classes) else 1))))
        found: set[tuple[int, int]] = set()
        for i in range(0, len(starts), pool):
            s, n, c = starts[i : i + pool], lengths[i : i + pool], classes[i : i + pool]
            pairs = []
            walks = self.walks_of(c)
            for w in range(int(walks.max())):
                mine = np.flatnonzero(walks > w)
                keys = self.sample(tokens, s[mine], n[mine], c[mine], w)
                for k in range(SAMPLINGS):
                    table, order = self.keys[w][k]
                    a, b = np.searchsorted(table, keys[:, k], "left"), np.searchsorted(table, keys[:, k], "right")
                    hits = np.flatnonzero(b > a)
                    m = (b - a)[hits]
                    rank = np.repeat(a[hits], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                    pairs.append(np.repeat(mine[hits], m) * len(self.lengths) + order[rank])
            both, votes = np.unique(np.concatenate(pairs), return_counts=True)
            window, piece = both // len(self.lengths), both % len(self.lengths)
            right = self.lengths[piece] == c[window]
            window, piece, votes = window[right], piece[right], votes[right]
            doc = np.searchsorted(doc_from, s[window], side="right") - 1
            self._confirm(tokens, s[window] - self.offset[piece], self.item_of[piece], votes, doc, doc_from, doc_to, found)
        return found

    def _confirm(self, tokens, at, item, votes, doc, doc_from, doc_to, found) -> None:
        """Adds what is within the edits allowed: first the place with most votes of each (document, item), then the rest.

        at: where the item would start without edits before its piece.  Places go together by k + 1.
        """
        if not len(at):
            return
        limits = np.array([edits_allowed(int(n), self.similarity) for n in self.sizes], np.int64)
        at = at // (limits[item] + 1) * (limits[item] + 1)
        order = np.lexsort((-votes, at, item, doc))
        at, item, doc, votes = at[order], item[order], doc[order], votes[order]
        new = np.append(True, (at[1:] != at[:-1]) | (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]))
        at, item, doc, votes = at[new], item[new], doc[new], votes[new]
        order = np.lexsort((-votes, item, doc))
        at, item, doc = at[order], item[order], doc[order]
        best = np.ones(len(doc), bool)
        best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        for turn in (best, ~best):
            open_ = np.flatnonzero(turn)
            open_ = open_[[(int(doc[k]), int(item[k])) not in found for k in open_]] if len(open_) else open_
            shape = self.sizes[item[open_]]
            for n in map(int, np.unique(shape)):
                mine, limit = open_[shape == n], edits_allowed(n, self.similarity)
                step = max(1, (1 << 22) // (n + 1))
                for i in range(0, len(mine), step):
                    part = mine[i : i + step]
                    spots = at[part][:, None] + np.arange(-limit, n + 3 * limit)
                    inside = (spots >= doc_from[doc[part]][:, None]) & (spots < doc_to[doc[part]][:, None])
                    # what lies outside the document equals no word
                    words = np.where(inside, tokens[np.clip(spots, 0, len(tokens) - 1)], -1)
                    good = part[least_distances(words, np.stack([self.tokens[k] for k in item[part]])) <= limit]
                    if not self.any_length:
                        good = [k for k in good if self._in_window(tokens, int(at[k]), limit, self.tokens[item[k]], int(doc_from[doc[k]]), int(doc_to[doc[k]]))]
                    found.update((int(doc[k]), int(item[k])) for k in good)

    def _in_window(self, tokens, at: int, limit: int, item: np.ndarray, low: int, high: int) -> bool:
        """Whether a window of as many words as the item, near `at`, is within the edits allowed."""
        n = len(item)
        last = max(high - n, low)
        starts = np.arange(min(max(at - limit, low), last), min(max(at + 2 * limit, low), last) + 1)
        windows = tokens[starts[:, None] + np.arange(min(n, high - low))]
        return bool((edit_distances(windows, np.broadcast_to(item, (len(starts), n))) <= limit).any())


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = 0.8, recall: float = 0.999, min_words: int = 8, block_items: int = 20_000, any_length: bool = False, run_words: int = 4) -> DataFrame:
    """Mark the documents that hold a passage of a benchmark item.

    similarity: 1 - edits / words of the item that still count.  recall: of the LSH step, at the limit of similarity.
    min_words: shorter items are looked up by exact parts instead of LSH, by the same definition and with no loss.
    run_words: items of fewer words count only where the whole text equals them, since a few words occur anywhere.
    any_length: passages may be longer or shorter than the item, so that an added or a lost word is one edit.

    Result: the columns of docs and contaminated (boolean), items (sorted distinct item ids), which replace columns of
    those names.  Null and empty texts: false, no items; texts of any length are read whole.  Repeated rows are judged
    alike, an empty table gives an empty table.  Null item ids mark a document but are not listed; items
    without words match nothing; repeated items are all listed.  An empty benchmark marks nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = without(docs, "contaminated", "items")
    out = out.withColumns({"contaminated": F.lit(False), "items": F.array().cast("array<bigint>")})
    schema = extended(out.drop("contaminated", "items").schema, ("contaminated", T.BooleanType()), ("items", T.ArrayType(T.LongType())))
    rows = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    blocks = -(-rows.count() // block_items)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast(sorted(((r["item"], r["text"]) for r in part.toLocalIterator()), key=str))
        out = out.mapInArrow(_marker(held, text, similarity, recall, min_words, any_length, run_words), schema)
    return out


def _marker(held, text: str, similarity: float, recall: float, min_words: int, any_length: bool, run_words: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(held.value, similarity, recall, min_words, any_length, run_words)
        known = items.vocabulary
        for batch in batches:
            docs = [words_of(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            to = np.cumsum([len(d) for d in docs], dtype=np.int64)
            of = np.append(0, to[:-1])
            tokens = np.fromiter((known.get(w, 0) for d in docs for w in d), np.int64, int(to[-1]) if len(to) else 0)
            filled = np.flatnonzero(to > of)  # empty documents have no place in the concatenation
            hits: dict[int, set] = {}
            for d, i in items.matches(tokens, of[filled], to[filled]):
                hits.setdefault(int(filled[d]), set()).add(items.ids[i])
            if items.whole or items.short:
                for k, d in enumerate(docs):
                    for i in items.quoted(d) if d else ():
                        hits.setdefault(k, set()).add(i)
            before = batch.column(batch.schema.get_field_index("items")).to_pylist()
            was = batch.column(batch.schema.get_field_index("contaminated")).to_pylist()
            lists = [sorted({*b, *(i for i in hits.get(k, ()) if i is not None)}) for k, b in enumerate(before)]
            yield with_columns(batch, contaminated=pa.array([w or k in hits for k, w in enumerate(was)], pa.bool_()), items=pa.array(lists, pa.list_(pa.int64())))

    return mark
