"""Centroid clustering by the threshold algorithm over per-dimension sorted lists.

Vectors become integers (floor(scale * x)), so that distances, sums and ties
are exact.  For each dimension the centroids' values are kept as a sorted list.
A vector enters every list at its own value and walks outward, one centroid a
list and step, nearer side first; a centroid met for the first time gets its
exact distance.  The distances of the values at the walks' ends (the frontier)
bound what any centroid not met yet can have: once the sum of their squares is
strictly greater than the best exact distance, no such centroid can be nearer,
nor as near with a smaller number, and the walk stops.

Each round is one pass: tasks assign their vectors and emit one row of counts
and component sums per cluster, Spark adds them, and the new centroids
(clusters x dimensions whole numbers, whatever the data) come to the driver.

Defined results: vectors that are null, of another length, or hold null or
non-finite components are left out.  Equal distances go to the smaller number;
equal hashes (repeated ids, null ids, whose number is the empty text) are ordered
by their components; fewer vectors than clusters make fewer clusters; an empty
table has no clusters.  Repeated rows count as often as they come.  Components
beyond 2^26 after scaling would overflow a long distance and raise an error.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

LARGEST = 1 << 26
BATCH = 1024  # vectors that walk together


class SortedLists:
    """The sorted lists of a set of centroids (clusters x dimensions, int64)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dims = centroids.shape
        self.order = np.argsort(centroids, axis=0, kind="stable").T.copy()  # dimension x rank -> centroid
        self.values = np.take_along_axis(centroids, self.order.T, axis=0).T.copy()

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, squared distance and number of exact distances of each vector (row of ``v``)."""
        n = len(v)
        best, dist, met = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
        at = np.arange(n)  # vectors still walking
        right = np.stack([np.searchsorted(self.values[d], v[:, d]) for d in range(self.dims)], axis=1) if n else np.zeros((0, self.dims), np.int64)
        left, seen = right - 1, np.zeros((n, self.k), bool)
        dim, far = np.arange(self.dims), np.iinfo(np.int64).max
        for _ in range(self.k):
            x = v[at]
            below = np.where(left >= 0, x - self.values[dim, np.maximum(left, 0)], far)
            above = np.where(right < self.k, self.values[dim, np.minimum(right, self.k - 1)] - x, far)
            down = below <= above
            rank = np.where(down, left, right)
            left, right = left - down, right + ~down
            new = np.zeros_like(seen)
            new[np.arange(len(at))[:, None], self.order[dim, rank]] = True
            new &= ~seen
            seen |= new
            row, c = np.nonzero(new)  # by row, then by centroid
            exact = ((x[row] - self.centroids[c]) ** 2).sum(axis=1)
            np.add.at(met, at[row], 1)
            ranked = np.lexsort((c, exact, row))
            first = ranked[np.unique(row[ranked], return_index=True)[1]]
            r, c, exact = at[row[first]], c[first], exact[first]
            nearer = (exact < dist[r]) | ((exact == dist[r]) & (c < best[r]))
            best[r[nearer]], dist[r[nearer]] = c[nearer], exact[nearer]
            frontier = (np.minimum(below, above) ** 2).sum(axis=1)
            on = (frontier <= dist[at]) & ~seen.all(axis=1)
            if not on.any():
                break
            at, left, right, seen = at[on], left[on], right[on], seen[on]
        return best, dist, met


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``id`` and ``q`` (array<bigint>) of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fits = (F.size(vec_col) == dims) & F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.select(F.col(id_col).alias("id"), F.col(vec_col), x.alias("x")).where(F.coalesce(fits, F.lit(False)))
    small = F.forall(F.col("x"), lambda c: F.abs(c * scale) < LARGEST)
    whole = F.when(small, F.transform("x", lambda c: F.floor(c * scale))).otherwise(F.raise_error(F.lit("a component is too large for whole distances")).cast("array<bigint>"))
    return kept.select("id", whole.alias("q"))


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``salt`` and id, in that order."""
    h = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(h.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], dtype=np.int64)


def _batches(batches: Iterator[pa.RecordBatch], dims: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, part.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> (number, component sums) of the vectors nearest to it."""
    k, dims = centroids.shape

    def sums(batches):
        lists, n, total = SortedLists(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v in _batches(batches, dims):
            cluster, _, _ = lists.nearest(v)
            n += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, v)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = vectors.select("q").mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
    each = parts.select("cluster", F.posexplode(F.array_prepend("total", F.col("n"))).alias("d", "s")).groupBy("cluster", "d").agg(F.sum("s").alias("s"))
    out: dict[int, list[int]] = {}
    for r in each.orderBy("cluster", "d").collect():  # clusters x (dimensions + 1) rows
        out.setdefault(r["cluster"], []).append(r["s"])
    return {c: (s[0], s[1:]) for c, s in out.items()}


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cluster, distance and met (exact distances it took) per vector."""
    dims = centroids.shape[1]
    id_type = vectors.schema["id"].dataType.simpleString()

    def rows(batches):
        lists = SortedLists(centroids)
        for part, v in _batches(batches, dims):
            cluster, dist, met = lists.nearest(v)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster.astype(np.int32)), pa.array(dist), pa.array(met.astype(np.int32))], names=["id", "cluster", "distance", "met"])

    return vectors.select("id", "q").mapInArrow(rows, f"id {id_type}, cluster int, distance bigint, met int")


def cluster(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1:") -> DataFrame:
    """Per vector: id, cluster, distance, met, cluster_inertia, inertia and centroid (array<bigint>)."""
    spark = rows.sparkSession
    vectors = materialise(whole_vectors(rows, id_col, vec_col, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, salt)
    if not len(centroids):
        none = "cast(null as int) cluster, 0L distance, 0 met, 0L cluster_inertia, 0L inertia, q centroid"
        return vectors.selectExpr("id", *none.split(", "))
    for _ in range(rounds):
        for c, (n, total) in cluster_sums(vectors, centroids).items():
            centroids[c] = [s // n for s in total]
    placed = materialise(assign(vectors, centroids), "placed")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # one row a cluster
    whole = sum(r["s"] for r in sums)
    facts = spark.createDataFrame([(r["cluster"], r["s"], whole, centroids[r["cluster"]].tolist()) for r in sums], "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return placed.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "met", "cluster_inertia", "inertia", "centroid")


def digest(centroid: list[int]) -> str:
    """Lowercase hex SHA-256 of the components joined by commas (what ``centroid_digest`` gives for a column)."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def centroid_digest(column: str):
    return F.sha2(F.array_join(F.col(column).cast("array<string>"), ","), 256)
