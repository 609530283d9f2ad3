"""Centroid clustering of integer vectors with a progressive nearest-centroid search in the Walsh-Hadamard domain.

The transform H of 2^k components is integer and keeps distances up to a factor: |Hx - Hc|^2 = 2^k |x - c|^2.  Its
coefficients are taken by sequency, coarse to fine.  The squared differences of the first blocks are a lower bound of the
distance, so a centroid whose partial sum is already greater than the whole distance of another one can't be nearest and
is given up; the rest are summed to the last coefficient.  Only strictly worse centroids go, so ties are all finished and
the smaller number wins; all of it is integer arithmetic, so the search returns what a full scan would.

At scale: a pass over the vectors for each round, without any exchange of vectors.  Each task sums its vectors for each
centroid; one row for a centroid and task is shuffled.  The driver holds the centroids only, k * 64 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, release, small_batches, tables

#: Components that are scaled beyond this don't fit: squared differences of transforms have to stay below 2^63.
LARGEST = 1 << 24
#: Where the blocks of coefficients end; after each one, worse centroids are given up.
BLOCKS = (1, 2, 4, 8, 16, 32)


def sequency_order(width: int) -> np.ndarray:
    """The rows of the Hadamard matrix by their number of sign changes."""
    changes = np.count_nonzero(np.diff(walsh_hadamard(np.eye(width, dtype=np.int64)), axis=1), axis=1)
    return np.argsort(changes, kind="stable")


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The exact transform of each row of x, in the natural order of rows; the width is a power of two."""
    n, width = x.shape
    y, half = x.astype(np.int64), 1
    while half < width:
        pairs = y.reshape(n, width // (2 * half), 2, half)
        y = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return y


class Search:
    """Nearest of fixed centroids for batches of vectors."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.width = centroids.shape[1]
        self.order = sequency_order(self.width)
        self.coarse_first = walsh_hadamard(centroids)[:, self.order]
        self.blocks = list(zip((0, *[b for b in BLOCKS if b < self.width]), (*[b for b in BLOCKS if b < self.width], self.width), strict=True))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid for each row of x, and how many coefficients were compared."""
        y, c, rows = walsh_hadamard(x)[:, self.order], self.coarse_first, np.arange(len(x))
        # the centroid nearest by the first coefficients gives the first whole distance to beat
        head = self.blocks[min(2, len(self.blocks) - 1)][1]
        first = ((y[:, None, :head] - c[None, :, :head]) ** 2).sum(axis=2).argmin(axis=1)
        best = ((y - c[first]) ** 2).sum(axis=1)
        at, to = np.divmod(np.arange(len(x) * len(c)), len(c))
        partial, compared = np.zeros(len(at), np.int64), len(x) * (head * len(c) + self.width)
        for low, high in self.blocks:
            d = y[at, low:high] - c[to, low:high]
            compared += d.size
            partial += np.einsum("ij,ij->i", d, d)
            stays = partial <= best[at]
            at, to, partial = at[stays], to[stays], partial[stays]
        # the pairs of a row are in ascending order of centroids: the first least one is the smaller number
        found = np.lexsort((to, partial, at))
        found = found[np.concatenate(([True], at[found][1:] != at[found][:-1]))] if len(found) else found
        assert len(found) == len(rows)
        return to[found].astype(np.int32), partial[found] // self.width, compared


def scaled_vectors(vectors: DataFrame, embedding: str, vec_id: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v): rows of exactly `width` finite components below LARGEST / scale, as integers floor(scale * x)."""
    x = F.col(embedding).cast("array<double>")
    fits = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST / scale))
    ints = F.transform(x, lambda e: F.floor(e * scale).cast("int"))
    return vectors.where((F.size(x) == width) & fits).select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(table: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (count, sums of components)} of its nearest vectors."""
    k, width = centroids.shape

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, total, count = Search(centroids), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), width)
                to, _, _ = search.nearest(x)
                np.add.at(total, to, x)
                count += np.bincount(to, minlength=k)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(count[has]), pa.array(list(total[has]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = table.select("v").mapInArrow(partial_sums, "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(width)]) for r in rows}


def cluster_vectors(
    vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: str = "2:"
) -> DataFrame:
    """A row for each vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid (array), n_cluster.

    Kept are rows of exactly `width` components (a power of two) that are neither null nor non-finite and smaller than
    LARGEST / scale, as integers floor(scale * x); null, shorter and longer arrays have no row.  The first centroids are the
    k kept vectors of least sha256(seed + vec_id), in this order; repeated ids by their components, null ids never.  With
    fewer than k such rows there are as many centroids, without any (an empty table too) no rows.  Each of `rounds` rounds
    assigns every vector to its nearest centroid (ties: the smaller number) and moves the centroids to floor(sum / count) of
    each component; centroids without vectors stay.  Repeated rows count and return as often as they are there.  Other
    columns play no part.  Distances are squared and exact.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    mark = tables()
    table = materialize(scaled_vectors(vectors, embedding, vec_id, width, scale))
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = table.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    if not first:
        out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, n_cluster long, centroid array<long>"
        return spark.createDataFrame([], out)
    centroids = np.array([r["v"] for r in first], np.int64)
    for _ in range(rounds):
        for c, (n, sums) in _sums(table, centroids).items():
            centroids[c] = [s // n for s in sums]  # the floor of the exact quotient

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            to, distance, _ = search.nearest(_matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = materialize(table.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    release(spark, mark, keep=1)  # the vectors are read no more
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"), F.count("*").alias("n_cluster")).collect()
    whole = sum(r["cluster_inertia"] for r in sums)
    rows = [(r["cluster"], r["cluster_inertia"], whole, r["n_cluster"], [int(x) for x in centroids[r["cluster"]]]) for r in sums]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, n_cluster long, centroid array<long>")
    # at most k rows
    return assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "n_cluster", "centroid")


def centroid_digest(centroid: str = "centroid") -> Column:
    """sha256 of the components as decimal integers, comma-joined."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)

