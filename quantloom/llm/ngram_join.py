"""Set-similarity join of word-shingle sets by prefix trees, and the components of its links.

1. Each text becomes a set of shingle hashes in one global order: rare shingles by hash, frequent ones last by count.
   Texts with equal sets share a node and are one from here on.  A node is 64 bits of a 128-bit digest of the set;
   where two digests share these, all but one of them take other bits, so two sets are one only if 128 bits agree.
2. Two sets with Jaccard >= threshold share a token among the first n - ceil(threshold * n) + 1 of either.  Only these
   prefix tokens are shuffled; a node is alone unless one of them occurs at a node of fitting size and slot counts (the
   counts of a set's tokens in SLOTS classes: they differ by no more than the sets do).
3. The other nodes' whole sets go to buckets by a shared token, twice with other tokens and other blocks.  The sets of a
   block stand in one trie along the global order, so sets that begin alike share their first runs.  A probe goes down
   it by levels, counts its overlap with a shared run once, and leaves a subtree once the overlap so far plus the most
   that can remain is too small, or once all below is in the probe's component: more links change nothing there.
4. Components of the links so far; then the nodes that still share a prefix token with one of another component.  Of
   a token's rows, those that pass the bounds on sizes, positions and sketches (the parities of a set's tokens in slots,
   which differ in no more slots than the sets in tokens) are joined to families, by a forest: at most a row out for a
   row in, never a row for each pair.  A family's whole sets then stand in one trie as in step 3, so each node's set is
   moved once.  Linked nodes are of one family, so no link between components is lost.

At scale: to the driver come the list of frequent shingles (at most `frequent`), a bitmap of 256 bits an open node (at
most FILTER_BITS bits) and the nodes whose digests clash (of 10^10 sets some three), never links, components or
fingerprints.  Blocks are bounded in sets and in shingles.  The rows of a token with more than HOT of them meet by pairs
of parts in steps 2 and 4, so no task gets more than two parts of one token; so do those of a family beyond a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .runtime import materialize, release, small_batches, tables, texts
from .shingles import shingle_set

SLOTS, LEAST_SKETCH = 128, 1024
WHOLE_GROUP = 20_000
HOT = 500
FILTER_BITS = 1 << 28
BLOCK_SETS = 2_000
BLOCK_SHINGLES = 8_000_000


class Threshold:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, n):
        """Least size of a set linked with one of size n."""
        return -(-self.num * n // self.den)


class Trie:
    """Distinct ordered sets as one radix tree, held in arrays: a run of tokens that several sets begin with stands once.

    Sets are leaves in lexicographic order, so what is below a node is a range of leaves.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">i8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        sets = [sets[k] for k in self.order]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        nodes: list[list[int]] = [[-1, 0, 0, 0, 0]]  # parent, where the run starts and ends in its first leaf's set, first leaf, last leaf
        open_ = [0]
        self.leaf = [-1]
        for k, s in enumerate(sets):
            common = 0
            if k:
                m = min(len(s), len(sets[k - 1]))
                differs = np.flatnonzero(s[:m] != sets[k - 1][:m])
                common = int(differs[0]) if len(differs) else m
            below = None
            while nodes[open_[-1]][2] > common:
                below = open_.pop()
                nodes[below][4] = k - 1
            if nodes[open_[-1]][2] < common:  # the run below splits
                nodes.append([open_[-1], nodes[below][1], common, nodes[below][3], k - 1])
                self.leaf.append(-1)
                nodes[below][0], nodes[below][1] = len(nodes) - 1, common
                open_.append(len(nodes) - 1)
            nodes.append([open_[-1], common, len(s), k, k])
            self.leaf.append(k)
            open_.append(len(nodes) - 1)
        for node in open_:
            nodes[node][4] = len(sets) - 1
        parent, self.start, self.end, self.first, self.last = np.array(nodes, np.int64).T
        self.leaf = np.array(self.leaf, np.int64)
        self.offset = np.append(0, np.cumsum(self.end - self.start))
        runs = np.concatenate([sets[f][a:b] for f, a, b in zip(self.first, self.start, self.end, strict=True)])
        self.words, self.runs = np.unique(runs, return_inverse=True)
        self.children = np.argsort(parent, kind="stable")[1:]  # the root comes first
        self.child_from = np.searchsorted(parent[self.children], np.arange(len(nodes)))
        self.child_to = np.append(self.child_from[1:], len(self.children))
        self.shortest, self.longest = (np.array([f(self.sizes[a : b + 1]) for a, b in zip(self.first, self.last, strict=True)], np.int64) for f in (np.min, np.max))
        self.sets = sets
        self.member = np.zeros(len(self.words), bool)

    def _hits(self, node: np.ndarray, skip: np.ndarray, most: int | None = None) -> np.ndarray:
        """Tokens of the nodes' runs that the marked probe holds, from `skip` on, at most `most` of each."""
        n = self.end[node] - self.start[node] - skip
        if most is not None:
            n = np.minimum(n, most)
        n = np.maximum(n, 0)
        to = np.cumsum(n)
        spots = np.repeat(self.offset[node] + skip - to + n, n) + np.arange(to[-1])
        seen = np.append(0, np.cumsum(self.member[self.runs[spots]]))
        return seen[to] - seen[to - n]

    def linked(self, k: int, limit: Threshold, group: np.ndarray) -> np.ndarray:
        """Later leaves linked with leaf k and not of its group: overlaps are counted once for all sets below a node.

        A subtree is left where it holds no such leaf, or where the overlap so far plus the most that can remain is less
        than the least overlap of a link.
        """
        n = int(self.sizes[k])
        spots = np.searchsorted(self.words, self.sets[k])
        self.member[spots] = True
        changes = np.append(0, np.cumsum(group[1:] != group[:-1]))
        least, most = limit.least(n), n * limit.den // limit.num
        front, overlap, found = self.children[self.child_from[0] : self.child_to[0]], None, []
        overlap = np.zeros(len(front), np.int64)
        while len(front):
            after = np.maximum(self.first[front], k + 1)
            open_ = (self.last[front] > k) & (self.shortest[front] <= most) & (self.longest[front] >= least)
            open_ &= (group[np.minimum(after, len(group) - 1)] != group[k]) | (changes[self.last[front]] != changes[np.minimum(after, len(group) - 1)])
            front, overlap = front[open_], overlap[open_]
            if not len(front):
                break
            need = limit.overlap(n, np.maximum(self.shortest[front], least))
            longest = np.minimum(self.longest[front], most)
            # first as many tokens as may be missed and one more: most subtrees end here
            chunk = int((longest - limit.overlap(n, longest)).max()) + 1
            overlap = overlap + self._hits(front, np.zeros(len(front), np.int64), chunk)
            read = np.minimum(self.end[front] - self.start[front], chunk)
            open_ = overlap + longest - self.start[front] - read >= need
            front, overlap, read, need, longest = (x[open_] for x in (front, overlap, read, need, longest))
            if not len(front):
                break
            overlap = overlap + self._hits(front, read)
            open_ = overlap + longest - self.end[front] >= need
            front, overlap = front[open_], overlap[open_]
            leaf = self.leaf[front]
            at = np.flatnonzero(leaf > k)
            size = self.sizes[leaf[at]]
            at = at[(overlap[at] >= limit.overlap(n, size)) & (size >= least) & (size <= most)]
            found.append(leaf[at])
            count = self.child_to[front] - self.child_from[front]
            to = np.cumsum(count)
            overlap = np.repeat(overlap, count)
            front = self.children[np.repeat(self.child_from[front] - to + count, count) + np.arange(int(to[-1]) if len(to) else 0)]
        self.member[spots] = False
        hits = np.concatenate(found) if found else np.zeros(0, np.int64)
        return hits[group[hits] != group[k]]


def linked_pairs(sizes_sets: list[tuple[int, np.ndarray]], limit: Threshold, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect each component of (id, ordered set) fully: one for each two components that a probe joins.

    labels: what is one component already, whose own links are not looked for.
    """
    trie = Trie([s for _, s in sizes_sets])
    names = [sizes_sets[k][0] for k in trie.order]
    group = np.arange(len(names)) if labels is None else np.unique(labels, return_inverse=True)[1][trie.order]
    links = []
    for k in range(len(names) - 1):
        hits = trie.linked(k, limit, group)
        if len(hits):
            other, first = np.unique(group[hits], return_index=True)
            links += [(names[k], names[j]) for j in hits[first]]
            group[np.isin(group, other)] = group[k]
    return links


def ordered(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set as sorted int64 in the global order: rare ones by hash, then frequent ones by rank."""
    out = (shingles >> np.uint64(2)).astype(np.int64)
    if len(frequent) and len(shingles):
        spot = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        hit = frequent[spot] == shingles
        out[hit] = (1 << 62) + rank[spot[hit]]
        out.sort()
    return out


def frequent_shingles(docs: DataFrame, text: str, width: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank by count) of shingles that many documents hold: they only decide the order, not the result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            unique, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(8, n // 200)
            return pa.RecordBatch.from_pydict({"h": unique[often].view(np.int64), "n": counts[often].astype(np.int64)})

        for batch in batches:
            for t in texts(batch, text):
                s = shingle_set(t.lower() if t else t, width)
                key = blake2b(s.tobytes(), digest_size=8).digest()
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    size, n = size + len(s), n + 1
            if size > 4_000_000:
                yield flush()
                held, size, n, seen = [], 0, 0, set()
        if held:
            yield flush()

    top = docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 16").orderBy(F.desc("n"), "h").limit(keep).collect()
    h = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - 1 - np.arange(len(h), dtype=np.int64))[order]


def ngram_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 3, threshold: tuple[int, int] = (90, 100), frequent: int = 50_000, node_bits: int = 64) -> DataFrame:
    """Components of documents whose sets of word shingles have Jaccard >= threshold[0] / threshold[1].

    Result: a row per row of docs: doc_id, n_shingles, component_id (long); other columns of docs play no part.
    component_id is the least doc_id reachable by links.  Null texts and texts without words: no shingles, linked with
    nothing, component_id their own doc_id.  Texts of fewer than `width` words are one shingle.  Equal texts link.  A
    null doc_id takes its component's least doc_id, null if there is none; rows of one doc_id are judged by their texts.
    Texts of any length count whole; an empty table gives no rows.
    node_bits: bits of a node's first name; fewer only make more names clash, which other bits then tell apart.
    """
    from math import gcd

    g = gcd(*threshold)
    limit = Threshold(threshold[0] // g, threshold[1] // g)
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(frequent_shingles(docs, text, width, frequent))

    def one(t: bytes | None) -> tuple[np.ndarray, int, int]:
        tokens = ordered(shingle_set(t.lower() if t else t, width), *held.value)
        node, mark = (int(x) for x in np.frombuffer(blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64))
        return tokens, node >> 64 - node_bits, mark

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            nodes, marks, sizes, prefixes, slots = [], [], [], [], []
            for t in texts(batch, text):
                tokens, node, mark = one(t)
                n = len(tokens)
                new = n and (node, mark) not in seen
                seen.add((node, mark))
                nodes.append(node if n else None)
                marks.append(mark if n else None)
                sizes.append(n)
                prefixes.append(tokens[: n - limit.least(n) + 1] if new else None)
                slots.append(np.minimum(np.bincount(tokens & (SLOTS - 1), minlength=SLOTS), 255).astype(np.uint8).tobytes() if new else None)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(slots, pa.binary()), batch.column(1)], names=["node", "mark", "n", "prefix", "slots", "doc_id"])

    mark = tables()
    # a copy within the task has no prefix of its own
    described = materialize(docs.select(text, F.col(doc_id).cast("long").alias("doc_id")).mapInArrow(describe, "node long, mark long, n long, prefix array<long>, slots binary, doc_id long"))
    clashes = described.where("node is not null").groupBy("node").agg(F.min("mark").alias("first"), F.max("mark").alias("last")).where("first <> last").select("node", "first")
    firsts = {r["node"]: r["first"] for r in clashes.collect()}
    if firsts:
        clash = F.broadcast(spark.createDataFrame(list(firsts.items()), "node long, first long"))  # some three of 10^10
        own = F.when(F.col("mark") != F.col("first"), F.col("node").bitwiseXOR(F.col("mark"))).otherwise(F.col("node"))
        described = described.join(clash, "node", "left").withColumn("node", own).drop("first")

    def named(t: bytes | None) -> tuple[np.ndarray, int]:
        tokens, node, mark = one(t)
        return tokens, node ^ mark if firsts.get(node, mark) != mark else node

    active = _active(described, limit)
    # prefixes and slots are read no more
    described = materialize(described.select("node", "n", "doc_id"))
    release(spark, mark, keep=2)
    found = described.select("node", "doc_id")
    if not active.isEmpty():
        labels = _labels(docs, text, active, limit, named)
        least = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        by_label = least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        components = by_label.groupBy("label").agg(F.min("least").alias("component_id"))
        of_node = by_label.join(components, "label").select("node", "component_id")
    else:
        of_node = found.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    return described.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _by_token(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Rows sorted by their first column, cut between its values: (columns, False) holds whole groups.

    A group of more than `most` rows comes in parts as (columns, True), so no task holds more of it than that.
    """
    rest: list[np.ndarray] | None = None
    passing = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if passing is not None and len(now[0]):
            cut = int(np.searchsorted(now[0], passing, side="right"))
            if cut:
                yield [c[:cut] for c in now], True
            now = [c[cut:] for c in now]
        if not len(now[0]):
            continue
        passing = None
        if rest is not None:
            now = [np.concatenate(p) for p in zip(rest, now, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1]))  # the last token may go on
        if cut:
            yield [c[:cut] for c in now], False
        rest = [c[cut:] for c in now]
        if most is not None and len(rest[0]) > most:
            passing = rest[0][0]
            yield rest, True
            rest = None
    if rest is not None:
        yield rest, False


def _narrow(spark, df: DataFrame) -> DataFrame:
    """materialize() with large Arrow batches, for rows of a few numbers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        return materialize(df)
    finally:
        spark.conf.set(key, was)


def _active(described: DataFrame, limit: Threshold) -> DataFrame:
    """(token, node, n, pos) where another node with the token in its prefix passes the bounds on sizes, positions and slots.

    A token with more than HOT rows is checked by pairs of parts of its rows; one with more than WHOLE_GROUP passes
    unchecked, its rows spread by node: more rows than needed change nothing but the work.
    """
    spark, mark = described.sparkSession, tables()
    first = described.where("prefix is not null")
    rows = first.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", "node", F.col("pos").cast("long").alias("pos"))
    hot = materialize(rows.groupBy("token").count().where(F.col("count") > HOT).select("token"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows next to one of the same token and a fitting size; only the last row waits for the next batch."""
        held: list[np.ndarray] | None = None
        known = False  # that the row held has a fitting one before it
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            token, n, node, pos = now
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, n, node, pos = token[new], n[new], node[new], pos[new]
            fits = (token[1:] == token[:-1]) & (n[:-1] >= limit.least(n[1:]))
            hit = np.zeros(len(token), bool)
            hit[0] = known
            hit[1:] |= fits
            hit[:-1] |= fits
            known, held = bool(hit[-1]), [token[-1:], n[-1:], node[-1:], pos[-1:]]
            hit[-1] = False
            yield pa.RecordBatch.from_pydict({"token": token[hit], "n": n[hit], "node": node[hit], "pos": pos[hit]})
        if held is not None and known:
            yield pa.RecordBatch.from_pydict(dict(zip(("token", "n", "node", "pos"), held, strict=True)))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, n, node, pos, slots, token), _ in _by_token(batches):
            ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
            starts = np.append(0, ends[:-1])
            hit = np.zeros(len(cell), bool)
            counts = np.frombuffer(b"".join(slots), np.uint8).reshape(len(slots), SLOTS)
            for size in np.unique(ends - starts):
                if size == 1:
                    continue
                group = starts[ends - starts == size]
                for gap in range(1, size):  # all groups of a size at once, neighbours first
                    a = (group[:, None] + np.arange(size - gap)).ravel()
                    b = a + gap
                    fits = n[a] >= limit.least(n[b])
                    if not fits.any():
                        break
                    open_ = fits & ~(hit[a] & hit[b]) & (1 + np.minimum(n[a] - 1 - pos[a], n[b] - 1 - pos[b]) >= limit.overlap(n[a], n[b]))
                    a, b = a[open_], b[open_]
                    for i in range(0, len(a), 1 << 15):
                        x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
                        apart = np.abs(counts[x].astype(np.int16) - counts[y]).sum(axis=1)
                        good = apart <= n[x] + n[y] - 2 * limit.overlap(n[x], n[y])
                        hit[x[good]] = True
                        hit[y[good]] = True
            yield pa.RecordBatch.from_pydict({"token": token[hit], "n": n[hit], "node": node[hit], "pos": pos[hit]})

    parts = rows.join(hot, "token", "left_anti").repartition("token").sortWithinPartitions("token", "n", "node")
    shared = _narrow(spark, parts.mapInArrow(near, "token long, n long, node long, pos long").unionByName(rows.join(hot, "token", "left_semi").dropDuplicates(["token", "node"])))
    big = materialize(shared.groupBy("token").count().where(F.col("count") > HOT).select("token", F.when(F.col("count") <= WHOLE_GROUP, F.ceil(F.col("count") / HOT)).alias("parts")))
    checked = shared.join(big.where("parts is null"), "token", "left_anti").join(big.where("parts is not null"), "token", "left")
    slots = checked.select("node").distinct().join(first.select("node", "slots"), "node").groupBy("node").agg(F.first("slots").alias("slots"))
    part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts"))
    wide = checked.join(slots, "node").withColumn("part", part)

    def compared(rows_: DataFrame, cell) -> DataFrame:
        cells = rows_.select(cell.alias("cell"), "n", "node", "pos", "slots", "token").repartition("cell").sortWithinPartitions("cell", "n", "node")
        return cells.mapInArrow(alike, "token long, n long, node long, pos long")

    found = compared(wide.where("parts is null"), F.col("token"))
    # rows of a token in parts: most find another one in their own; only the others are compared with all parts
    many = materialize(wide.where("parts is not null"))
    own = materialize(compared(many, F.xxhash64("token", "part")))
    left = many.join(own.select("token", "node"), ["token", "node"], "left_anti").withColumn("with", F.explode(F.expr("sequence(0, parts - 1)"))).where("with <> part")
    again = compared(many.withColumn("with", F.col("part")).unionByName(left), F.xxhash64("token", "with"))
    found = found.unionByName(own).unionByName(again).distinct()
    active = materialize(found.unionByName(shared.join(big.where("parts is null"), "token", "left_semi").select("token", "n", "node", "pos")))
    release(spark, mark, keep=1)
    return active


def _bitmap(names: DataFrame) -> tuple[bytes, int]:
    """A filter with the bit of every node set, and its number of bits: 256 a node up to FILTER_BITS.

    Beyond that it lets more whole sets pass to the semi-join behind it, and none is missed.
    """
    size = min(FILTER_BITS, 1 << max(12, (256 * names.count()).bit_length()))
    bit = F.pmod("node", F.lit(size))
    rows = names.groupBy(F.floor(bit / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {size}) % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes(), size


def _labels(docs: DataFrame, text: str, active: DataFrame, limit: Threshold, named) -> DataFrame:
    """(node, label) of the active nodes that have links."""
    spark = docs.sparkSession
    names = materialize(active.select("node").distinct())
    held = spark.sparkContext.broadcast(_bitmap(names))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        size = held.value[1]
        bits = np.frombuffer(held.value[0], np.int64)
        for batch in batches:
            out = []
            for t in texts(batch, text):
                tokens, node = named(t)
                bit = node % size
                if not len(tokens) or node in seen or not int(bits[bit // 64]) >> (bit % 64) & 1:
                    continue
                seen.add(node)
                out.append((node, len(tokens), tokens.tobytes(), sketch(tokens)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["node", "n", "tokens", "sketch"])

    sets = docs.select(text).mapInArrow(whole, "node long, n long, tokens binary, sketch binary").join(names, "node", "left_semi")
    sets = materialize(sets.dropDuplicates(["node"]))

    # two rounds of buckets: the first shared token, then the one that another hash puts first, each in random blocks
    bucket_of = active.groupBy("node").agg(F.min("token").alias("a"), F.min_by("token", F.xxhash64("token")).alias("b"), F.first("n").alias("n"))
    bucket_of = bucket_of.select("node", "n", F.posexplode(F.array("a", "b")).alias("round", "token"))
    load = bucket_of.groupBy("round", "token").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    load = load.withColumn("blocks", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)))
    placed = bucket_of.drop("n").join(load.select("round", "token", "blocks"), ["round", "token"]).withColumn("block", F.pmod(F.xxhash64("node", "round"), F.col("blocks")))
    placed = placed.select("node", F.xxhash64("round", "token", "block").alias("bucket"))

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, labels_ = None, [], []

        def done() -> list[tuple[int, int]]:
            return linked_pairs(held, limit, labels_) if len(set(labels_)) > 1 else []

        out = []
        for batch in batches:
            for bucket, node, label, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    out += done()
                    now, held, labels_ = bucket, [], []
                held.append((node, np.frombuffer(tokens, np.int64)))
                labels_.append(label)
            if out:
                yield _edges(out)
                out = []
        out += done()
        if out:
            yield _edges(out)

    def joined(rows: DataFrame) -> DataFrame:
        """Links (a, b) between different labels of a bucket's (node, label)."""
        blocks = rows.join(sets.select("node", "tokens"), "node").select("bucket", "node", "label", "tokens").repartition("bucket").sortWithinPartitions("bucket")
        return materialize(blocks.mapInArrow(join_blocks, "a long, b long").distinct())

    edges = joined(placed.withColumn("label", F.col("node")))
    labels = connected(edges)

    # what is left: nodes in different components that share a prefix token
    labelled = active.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    labelled = labelled.join(materialize(mixed), "token", "left_semi")
    met = _meeting(labelled, "token", F.lit(1), HOT).join(sets.select("node", "sketch"), "node")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _ in _by_token(batches):
            cell = columns[0]
            ends = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
            out = []
            for i, j in zip(np.append(0, ends[:-1]), ends, strict=True):
                out += _forest(*(c[i:j] for c in columns[1:]), limit)
            if out:
                yield _edges(out)

    cells = met.select("cell", "n", "node", "pos", "label", "part", "sketch").repartition("cell").sortWithinPartitions("cell", "n", "node")
    families = materialize(cells.mapInArrow(near, "a long, b long").distinct())
    if families.isEmpty():
        return labels
    members = materialize(connected(families).withColumnRenamed("label", "family").join(labels, "node", "left").join(sets.select("node", "n"), "node").withColumn("label", F.coalesce("label", "node")))
    late = joined(_meeting(members, "family", F.greatest("n", F.lit(max(1, BLOCK_SHINGLES // BLOCK_SETS))), BLOCK_SHINGLES).select(F.col("cell").alias("bucket"), "node", "label"))
    if late.isEmpty():
        return labels
    return connected(edges.unionByName(late))


def _meeting(rows: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """rows of (key, node, label, ...) with (cell, part): two of a key and of different labels meet in a cell.

    Where a key's rows weigh more than `most`, those outside its largest component meet the others by parts of both; in a
    cell of two parts only rows of different parts need to be compared.
    """
    sides = rows.groupBy(key, "label").agg(F.sum(weight).alias("load")).groupBy(key).agg(F.max_by("label", "load").alias("major"), F.max("load").alias("most"), F.sum("load").alias("all"))
    big = materialize(sides.where(F.col("all") > most).select(key, "major", F.ceil(F.col("most") / most).alias("majors"), F.ceil((F.col("all") - F.col("most")) / most).alias("minors")))
    whole = F.lit(0).cast("long").alias("part")
    few = rows.join(big, key, "left_anti").select(F.col(key).alias("cell"), *[c for c in rows.columns if c != key], whole)
    many = rows.join(big, key).withColumn("major", F.col("label") == F.col("major"))
    many = many.withColumn("own", F.pmod(F.xxhash64("node", F.lit("part")), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))))
    meet = lambda col: F.explode(F.sequence(F.lit(0).cast("long"), F.col(col) - 1))
    named_cell = lambda kind, x, y: F.xxhash64(key, F.lit(kind), x, y).alias("cell")
    body = [c for c in rows.columns if c != key]
    across = many.where("major").withColumn("other", meet("minors")).select(named_cell("across", "other", "own"), *body, whole)
    across = across.unionByName(many.where("not major").withColumn("other", meet("majors")).select(named_cell("across", "own", "other"), *body, F.lit(1).cast("long").alias("part")))
    among = many.where("not major").withColumn("other", meet("minors")).select(named_cell("among", F.least("own", "other"), F.greatest("own", "other")), *body, F.col("own").cast("long").alias("part"))
    return few.unionByName(across).unionByName(among)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def sketch(tokens: np.ndarray) -> bytes:
    """The parities of a set's tokens in slots, as many as tokens up to the next power of 2, LEAST_SKETCH at least."""
    slots = max(LEAST_SKETCH, 1 << (len(tokens) - 1).bit_length())
    return np.packbits((np.bincount(tokens & (slots - 1), minlength=slots) & 1).astype(bool)).tobytes()


def _apart(one: bytes, others: np.ndarray) -> np.ndarray:
    """Slots in which a sketch differs from each of the others, of two sizes in those of the smaller."""
    out = np.zeros(len(others), np.int64)
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x, y = np.frombuffer(one, np.uint64)[None], np.frombuffer(b"".join(others[at]), np.uint64).reshape(len(at), -1)
        while x.shape[1] != y.shape[1]:  # a half of the slots falls on the other
            z = max(x, y, key=lambda z: z.shape[1])
            half = z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :]
            x, y = (half, y) if z is x else (x, half)
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _forest(n: np.ndarray, node: np.ndarray, pos: np.ndarray, label: np.ndarray, part: np.ndarray, sketches: np.ndarray, limit: Threshold) -> list[tuple[int, int]]:
    """Pairs of a cell's rows that join all those that may be linked across components, directly or by others: fewer than rows.

    Rows of different labels may be linked if they pass the bounds on sizes, positions and sketches; of two parts, across them.
    """
    kinds, counts = np.unique(label, return_counts=True)
    if len(kinds) < 2:
        return []
    two = part.min() != part.max()
    rest = label != kinds[counts.argmax()]
    open_ = np.ones(len(n), bool)
    group, out = np.arange(len(n)), []
    for i in np.flatnonzero(rest):
        # each such row against all others; two of them meet once
        open_[i] = False
        ok = open_ & (label != label[i]) & (group != group[i]) & (np.minimum(n, n[i]) >= limit.least(np.maximum(n, n[i])))
        ok &= 1 + np.minimum(n - 1 - pos, n[i] - 1 - pos[i]) >= limit.overlap(n, n[i])
        if two:
            ok &= part != part[i]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        at = at[_apart(sketches[i], sketches[at]) <= n[at] + n[i] - 2 * limit.overlap(n[at], n[i])]
        if len(at):
            other, k = np.unique(group[at], return_index=True)
            out += [(int(node[i]), int(node[j])) for j in at[k]]
            group[np.isin(group, other)] = group[i]
    return out
