"""Centroid clustering of whole-number vectors with an annulus search.

Components are scaled and rounded down to integers, so that distances, sums and
means are exact and do not depend on how rows are spread over tasks. Centroids
are sorted by norm. The distance to the centroids next in norm bounds how far
the nearest one can be; by the triangle inequality its norm lies within that
bound of the vector's norm, so a binary search finds the run of centroids to be
compared. The run is widened by a hair against rounding, and all of it, ties at
its border included, is compared in integers.

A round is one pass over the vectors: every task sums its own vectors by
cluster, Spark sums the tasks' sums, and the driver gets one number for each
cluster and component, whatever the number of rows.

Defined results: vectors that are null, of another length or hold a null or a
number that is not finite take no part; a null id is a value like others and is
hashed as ``null``; repeated rows take part each, and of equal ids the smaller
vector comes first among the initial centroids; with fewer vectors than
centroids each is one; of equally near centroids the smaller number wins; a
centroid without vectors stays; an empty table gives an empty result; other
columns are not read. A component of 2^27 or more after scaling is an error, as
squared distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import local_table, written

#: Components of this size or more are refused: 64 squares of twice that fill a signed 64-bit number.
LIMIT = 1 << 27
#: Numbers that are compared at once in a task: rows of (vector, centroid) pairs times dimensions.
COMPARED = 1 << 20


def kept_vectors(vectors: DataFrame, dims: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)`` of the vectors of ``dims`` finite components."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dims) & ~F.exists("v", odd))


def whole_numbers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a column of lists of one length, as 64-bit integers."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    if x.size and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component of {LIMIT / scale:g} or more")
    return x.astype(np.int64)


class Annulus:
    """Centroids in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        norm = np.sqrt((centroids * centroids).sum(1).astype(float))
        self.number = np.argsort(norm, kind="stable")
        self.norm, self.centroids = norm[self.number], centroids[self.number]

    def _distance(self, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(rows), np.int64), max(1, COMPARED // x.shape[1])
        for a in range(0, len(rows), step):
            gap = x[rows[a : a + step]] - self.centroids[cols[a : a + step]]
            out[a : a + step] = np.einsum("ij,ij->i", gap, gap)
        return out

    def candidates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the first and one past the last centroid, in the order of norms, that may be nearest."""
        norm, every, most = np.sqrt((x * x).sum(1).astype(float)), np.arange(len(x)), len(self.norm) - 1
        above = np.clip(np.searchsorted(self.norm, norm), min(1, most), most)
        near = np.minimum(*(self._distance(x, every, np.maximum(above - k, 0)) for k in (0, 1)))
        bound = np.sqrt(near.astype(float)) * (1 + 1e-9) + 1e-9 * (1 + norm + self.norm[-1])
        return np.searchsorted(self.norm, norm - bound, "left"), np.searchsorted(self.norm, norm + bound, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each vector."""
        if not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, end = self.candidates(x)
        size = end - first
        start = np.cumsum(size) - size
        rows = np.repeat(np.arange(len(x)), size)
        cols = np.arange(len(rows)) - np.repeat(start - first, size)
        distance = self._distance(x, rows, cols)
        best = np.minimum.reduceat(distance, start)
        number = np.where(distance == best[rows], self.number[cols], len(self.norm))
        return np.minimum.reduceat(number, start), best


def initial_centroids(kept: DataFrame, k: int, dims: int, scale: float, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:id``, in ascending order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return whole_numbers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), dims, scale)


def _passes(dims: int, scale: float, centroids: np.ndarray) -> tuple[Callable, Callable]:
    """Two functions over Arrow batches: sums by cluster (component -1: the number of vectors), and the assignment of each vector."""
    search = Annulus(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            x = whole_numbers(batch.column(0), dims, scale)
            cluster, _ = search.nearest(x)
            np.add.at(total, cluster, x)
            count += np.bincount(cluster, minlength=len(count))
        full = np.flatnonzero(count)
        cells = np.column_stack([count[full], total[full]])
        names = [np.repeat(full, dims + 1).astype(np.int32), np.tile(np.arange(-1, dims, dtype=np.int32), len(full)), cells.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in names], names=["cluster", "i", "s"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = search.nearest(whole_numbers(batch.column(1), dims, scale))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return sums, assign


def next_centroids(kept: DataFrame, centroids: np.ndarray, scale: float) -> np.ndarray:
    """One round: the exact rounded-down means of the vectors of each centroid."""
    dims = centroids.shape[1]
    sums, _ = _passes(dims, scale, centroids)
    cells = kept.select("v").mapInArrow(sums, "cluster int, i int, s long").groupBy("cluster", "i").agg(F.sum("s").alias("s")).collect()
    total = {(r["cluster"], r["i"]): r["s"] for r in cells}
    out = centroids.copy()
    for c in {c for c, _ in total}:
        out[c] = [total[c, i] // total[c, -1] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each kept vector, and the final centroids."""
    spark, kept = vectors.sparkSession, kept_vectors(vectors, dims, id_col, vector_col)
    kind = kept.schema["vec_id"].dataType.simpleString()
    centroids = initial_centroids(kept, k, dims, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), centroids
    for _ in range(rounds):
        centroids = next_centroids(kept, centroids, scale)
    _, assign = _passes(dims, scale, centroids)
    placed = written(kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "placed")
    sums = placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row for each centroid
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = local_table(spark, [(r["cluster"], r["s"], digest(r["cluster"])) for r in sums], "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = placed.join(F.broadcast(about), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(r["s"] for r in sums)).cast("long").alias("inertia"), "centroid_sha256"), centroids
