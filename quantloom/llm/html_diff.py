"""Main text of web pages by nearest-URL differencing, with the zones of the markup as a prior.

Pages of a host with equal lines are one page here, since the difference of a page and its copy says nothing of the
template.  Pages are put in order of host and path, and each is paired with the neighbour on its host whose path agrees
with its own for longer.  The pair's text lines are aligned by their longest common subsequence: those are the shared
lines.  All pairs of a host together say how often the lines of a place in the markup are shared.

A shared line is deleted where its place is one of shared lines, and how much of that it takes depends on the zone:
in an article more than half of the place's lines (a template inside an article's tags), so that a passage which
articles quote or repeat stays; outside of one a few in a hundred.  Menus, adverts, forms, comments and the like go in
any case, since unlike lines of a template may still be unshared.  Where the difference leaves nothing of an article,
or none is marked, what it leaves of the rest is the main text.

At scale: line hashes move.  One range exchange of them by (host, path) spreads a host with a third of all pages over
many tasks; a task holds three pages at a time, and pages at the edges of tasks find their neighbours through a narrow
table of edges.  Positions to delete come back to the pages by a join that Spark broadcasts if its files are small; if
they are not, that join moves each page's html once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .html_blocks import ARTICLE, BODY, placed_blocks
from .runtime import materialize, small_batches
from .url_filters import host_of, path_of

#: Share of a place's lines that makes its shared lines template lines, by zone, and the lines of doubt added to its own.
ARTICLE_SHARE, ARTICLE_DOUBT, BODY_SHARE = 0.5, 8, 0.05


def _growth(a: list[int], b: list[int]) -> np.ndarray:
    """How long a longest common subsequence of a and b[:j] is, for j from 0 to len(b).

    Bit-parallel: a bit of b's positions is cleared where the length grows.
    """
    spots: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        spots.setdefault(x, []).append(j)
    often: dict[int, int] = {}  # masks of values with many positions; few fit, so memory stays linear
    full = grown = (1 << len(b)) - 1
    for x in a:
        at = spots.get(x)
        if at is None:
            continue
        mask = often.get(x)
        if mask is None:
            bits = bytearray(at[-1] // 8 + 1)
            for j in at:
                bits[j >> 3] |= 1 << (j & 7)
            mask = int.from_bytes(bits, "little")
            if len(at) > 64:
                often[x] = mask
        hit = grown & mask
        grown = (grown + hit | grown - hit) & full
    left = np.unpackbits(np.frombuffer(grown.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(left == 0))


def common_subsequence(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of one longest common subsequence, always the same one.

    Halves a and splits b where both halves together have most in common, so memory is linear in the two lengths; time
    is len(a) * len(b) / 64 over what both have and what is not a common head or tail.
    """
    hit: set[int] = set()
    open_ = [(list(range(len(a))), b)]
    while open_:
        x, y = open_.pop()
        head, most = 0, min(len(x), len(y))
        while head < most and a[x[head]] == y[head]:
            head += 1
        tail = 0
        while tail < most - head and a[x[-1 - tail]] == y[-1 - tail]:
            tail += 1
        hit.update(x[:head])
        hit.update(x[len(x) - tail :])
        x, y = x[head : len(x) - tail], y[head : len(y) - tail]
        both = {a[i] for i in x} & set(y)
        x, y = [i for i in x if a[i] in both], [v for v in y if v in both]
        if len(x) < 2:
            hit.update(x)
            continue
        half = len(x) // 2
        upper = _growth([a[i] for i in x[:half]], y)
        lower = _growth([a[i] for i in x[: half - 1 : -1]], y[::-1])[::-1]
        cut = int((upper + lower).argmax())
        open_ += [(x[:half], y[:cut]), (x[half:], y[cut:])]
    return hit


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def parse(html: str | None) -> tuple[list[str], list[int], list[int], list[int]]:
    """(texts, zones, 64-bit hashes, places with their zone) of a page's blocks."""
    found = placed_blocks(html) if html else []
    signed = lambda x: x - (1 << 63)
    return [t for t, _, _ in found], [z for _, z, _ in found], [signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for t, _, _ in found], [signed(p // 4 * 4 + z) for _, z, p in found]


def main_text(texts: list[str], zones: list[int], deleted: set[int]) -> str:
    """What is left of the article's blocks; of the others but noise where that is nothing."""
    for zone in (ARTICLE, BODY):
        left = " ".join(t for k, (t, z) in enumerate(zip(texts, zones, strict=True)) if z == zone and k not in deleted)
        if left:
            return left
    return ""


def shared_with_nearest(page: dict, before: dict | None, after: dict | None) -> list[dict]:
    """For each place of the page, its number of lines and the positions of those that the nearest neighbour shares.

    Rows of another host are no neighbours.
    """
    near = [n for n in (before, after) if n is not None and n["host"] == page["host"]]
    # the one before on a tie
    other = max(near, key=lambda n: shared_prefix(page["path"], n["path"]))["hashes"] if near else []
    out = {x: {"place": x, "n": 0, "shared": []} for x in page["places"]}
    for x in page["places"]:
        out[x]["n"] += 1
    for at in sorted(common_subsequence(page["hashes"], other)):
        out[page["places"][at]]["shared"].append(at)
    return list(out.values())


_HASHES = ("hashes", pa.list_(pa.int64()))
_PLACES = ("places", pa.list_(pa.int64()))
_LINES = [("k", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("path", pa.string()), _HASHES, _PLACES]
_SIDE = pa.struct([("host", pa.string()), ("path", pa.string()), _HASHES])
_SHARED = [("k", pa.int64()), ("host", pa.string()), ("by_place", pa.list_(pa.struct([("place", pa.int64()), ("n", pa.int64()), ("shared", pa.list_(pa.int32()))])))]
_SORTED = [*_SHARED, _PLACES, ("path", pa.string()), _HASHES, ("part", pa.int32()), ("row", pa.int64()), ("last", pa.bool_()), ("before", _SIDE), ("after", _SIDE)]
_DONE = [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64()), ("n_deleted", pa.int64())]


def _batch(rows: list[dict], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _schema(fields: list[tuple[str, pa.DataType]]):
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(pa.schema(fields))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            _, _, hashes, places = parse(row.pop("html"))
            out.append(row | {"hashes": hashes, "places": places})
        yield _batch(out, _LINES)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge each page between its neighbours in the task; the first and the last page are left with what is known."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    side = lambda n: n and {k: n[k] for k in ("host", "path", "hashes")}

    def rows() -> Iterator[dict | None]:
        seen = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["k"] != seen:  # copies stand together
                    seen = r["k"]
                    yield r
        yield None

    before = now = None
    row, out = 0, []
    for after in rows():
        if now is not None:
            mine = {"k": now["k"], "host": now["host"], "part": part, "row": row, "last": after is None}
            if row and after is not None:
                mine["by_place"] = shared_with_nearest(now, before, after)
            else:
                mine |= side(now) | {"places": now["places"], "before": side(before), "after": side(after)}
            out.append(mine)
            row += 1
        before, now = now, after
        if len(out) >= 128:
            yield _batch(out, _SORTED)
            out = []
    if out:
        yield _batch(out, _SORTED)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([{"k": r["k"], "host": r["host"], "by_place": shared_with_nearest(r, r["before"] or r["outer_before"], r["after"] or r["outer_after"])} for r in batch.to_pylist()], _SHARED)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            texts, zones, _, _ = parse(r["html"])
            deleted = set(r["deleted"] or ())
            out.append({"page_id": r["page_id"], "url": r["url"], "text": main_text(texts, zones, deleted), "n_shared": r["n_shared"] or 0, "n_deleted": len(deleted)})
        yield _batch(out, _DONE)


def deletions(judged: DataFrame) -> DataFrame:
    """(k, n_shared, deleted) of pages with shared lines, from (k, host, by_place): the lines of template places."""
    spread = judged.select("k", "host", F.explode("by_place").alias("x")).select("k", "host", "x.*")
    shares = spread.groupBy("host", "place").agg(F.sum("n").alias("n"), F.sum(F.size("shared")).alias("hits")).where("hits > 0")
    article = F.col("hits") > ARTICLE_SHARE * (F.col("n") + ARTICLE_DOUBT)
    template = shares.where(F.when(F.pmod("place", F.lit(4)) == ARTICLE, article).otherwise(F.col("hits") >= BODY_SHARE * F.col("n"))).select("host", "place")
    # written, so that Spark broadcasts it where it is small: else the rows of a host's template places would meet in one task
    template = materialize(template.withColumn("template", F.lit(True)))
    known = spread.where("size(shared) > 0").join(template, ["host", "place"], "left")
    return known.groupBy("k").agg(F.sum(F.size("shared")).alias("n_shared"), F.flatten(F.collect_list(F.when(F.col("template"), F.col("shared")))).alias("deleted"))


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """A row per row of pages: page_id, url, text (never null), n_shared (lines shared with the nearest page of other
    lines), n_deleted (those of them that are template lines).

    Null and empty html: text "".  A null url has an empty host; such pages are neighbours of each other.  Ties in the
    order of host, path and page_id are broken by url and a hash of the row, so the result doesn't depend on partitions.
    Rows equal in page_id, url and html are one page, and get its text.  Other columns of pages play no part; an empty
    table gives no rows.  A page of any length is taken whole.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).withColumn("k", F.xxhash64("page_id", "url", "html"))
    named = rows.select("k", "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    lines = materialize(named.mapInArrow(_hashed, _schema(_LINES)))
    order = ["host", "path", "page_id", "url", "k"]
    # of pages with equal lines the first stands for all
    same = F.xxhash64("host", "hashes").alias("same")
    lead = lines.select(same, *order).groupBy("same").agg(F.min(F.struct(*order))["k"].alias("lead"))
    lead_of = materialize(lines.select("k", same).distinct().join(lead, "same").select("k", "lead"))
    leads = lines.join(lead_of.where("k = lead").select("k"), "k", "left_semi").select(*lines.columns)
    paired = materialize(leads.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_paired, _schema(_SORTED)))
    edge = paired.where("row = 0 or last")
    # two rows a task
    line = Window.orderBy("part", "row")
    side = F.struct("host", "path", "hashes")
    outer = edge.select("part", "row", F.lag(side).over(line).alias("outer_before"), F.lead(side).over(line).alias("outer_after"))
    at_edges = edge.join(outer, ["part", "row"]).mapInArrow(_resolved, _schema(_SHARED))
    judged = materialize(paired.where("row > 0 and not last").select("k", "host", "by_place").unionByName(at_edges))
    of_lead = materialize(deletions(judged)).withColumnRenamed("k", "lead")
    # written, so that its size is known before the pages are read
    found = materialize(lead_of.join(of_lead, "lead").select("k", "n_shared", "deleted"))
    return rows.join(found, "k", "left").mapInArrow(_extracted, _schema(_DONE))
