"""Centroid clustering with partial-distance search over integer vectors.

Components become integers, floor(scale * x), so every distance, sum and mean is exact and results don't depend on how rows
are dealt. A round is one pass over the staged integers: a task assigns its vectors and hands out one row of counts and
component sums a cluster; Spark adds those rows, at most `k` a task, and the driver holds the new centroids, `k` times
`dims` numbers. No vector leaves its task before the last pass.

Assignment: dimensions stand in descending order of their variance over all vectors. Squared differences of the first quarter of them
are summed for every centroid; the least of these is finished first and becomes the current best. For each other centroid,
the vectors whose partial sum isn't strictly above their best go on with the next dimensions, and so on until those left have all
dimensions. Equal distances go to the smaller number, which is why a sum equal to the best goes on.

Contract:
* vectors that are null, not of `dims` components, or hold a null or non-finite component take no part and get no row.
* rows of null id take part; rows repeated with one id are vectors of their own; other columns are ignored.
* the first centroids are the `k` vectors of least sha256 of `salt` and id (null: the word null), then of smallest components;
  with fewer vectors there are as many centroids.
* a centroid without vectors stays where it is; centroids may coincide, and the smaller number then takes all.
* an integer component beyond 2**27 in size is an error, since squared distances then might not fit a long.
* an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage_table

_BLOCK = 4096
_MOST = 1 << 27


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, x): the vectors that take part, x an array of `dims` ints."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))

    def whole(x: Column) -> Column:
        y = F.floor(F.lit(scale) * x)
        return F.when(F.abs(F.lit(scale) * x) <= _MOST, y.cast("int")).otherwise(F.raise_error(F.lit(f"a component beyond {_MOST} / {scale}")).cast("int"))

    return rows.where((F.size("v") == dims) & finite).select("vec_id", F.transform("v", whole).alias("x"))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    away = x - c
    return np.einsum("ij,ij->i", away, away)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to the nearest centroid of each row, and how many squared differences that took."""
    x, c = x[:, order], centroids[:, order]
    dims = x.shape[1]
    steps = sorted({0, -(-dims // 4), -(-dims // 2), dims})
    first = steps[1]
    partial = np.stack([_squares(x[:, :first], c[j, :first]) for j in range(len(c))], axis=1)
    best = partial.argmin(axis=1)
    distance = partial[np.arange(len(x)), best] + _squares(x[:, first:], c[best, first:])
    work = partial.size * first + len(x) * (dims - first)
    guess = best.copy()
    for j in range(len(c)):
        rows = np.flatnonzero((partial[:, j] <= distance) & (guess != j))
        so_far = partial[rows, j]
        for a, b in zip(steps[1:], steps[2:]):
            so_far = so_far + _squares(x[rows, a:b], c[j, a:b])
            work += len(rows) * (b - a)
            left = so_far <= distance[rows]
            rows, so_far = rows[left], so_far[left]
        wins = (so_far < distance[rows]) | (best[rows] > j)
        best[rows[wins]], distance[rows[wins]] = j, so_far[wins]
    return best, distance, work


class Clustering:
    """Centroids after `rounds` rounds over all vectors that take part."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:"):
        self.dims = dims
        self.vectors = stage_table(integers(vectors, id_col, vec_col, dims, scale), "integers")
        key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
        first = self.vectors.orderBy(key, "x").limit(k).select("x").collect()
        self.centroids = np.array([r["x"] for r in first], np.int64).reshape(-1, dims)
        self.order = self._by_variance() if len(first) else np.arange(dims)
        for _ in range(rounds if len(first) else 0):
            self._round()

    def _by_variance(self) -> np.ndarray:
        """Dimensions by descending variance; it only steers the work, so doubles do."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, total, squares = 0, np.zeros(dims), np.zeros(dims)
            for b in batches:
                x = matrix(b.column("x"), dims).astype(float)
                rows, total, squares = rows + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, rows)), pa.array(total), pa.array(squares)], names=["dim", "n", "total", "squares"])

        parts = self.vectors.select("x").mapInArrow(run, "dim int, n long, total double, squares double")
        found = parts.groupBy("dim").agg((F.sum("squares") / F.sum("n") - F.pow(F.sum("total") / F.sum("n"), 2)).alias("variance"))
        return np.array([r["dim"] for r in found.orderBy(F.desc("variance"), "dim").collect()])

    def _round(self) -> None:
        centroids, order, dims = self.centroids, self.order, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
            for b in batches:
                for at in range(0, b.num_rows, _BLOCK):
                    x = matrix(b.column("x").slice(at, _BLOCK), dims)
                    cluster = nearest(x, centroids, order)[0]
                    by = np.argsort(cluster, kind="stable")
                    own, starts = np.unique(cluster[by], return_index=True)
                    count[own] += np.diff(np.append(starts, len(by)))
                    total[own] += np.add.reduceat(x[by], starts, axis=0)
            own = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

        parts = self.vectors.select("x").mapInArrow(run, "cluster int, n long, total array<long>")
        sums = [F.sum(F.get("total", d).cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
        moved = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
            moved[r["cluster"]] = [int(s) // r["n"] for s in r[2:]]
        self.centroids = moved

    def assign(self) -> DataFrame:
        """vec_id, cluster, distance (squared) of every vector that takes part."""
        centroids, order, dims = self.centroids, self.order, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, _BLOCK):
                    cluster, distance, _ = nearest(matrix(b.column("x").slice(at, _BLOCK), dims), centroids, order)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id").slice(at, _BLOCK), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

        kind = self.vectors.schema["vec_id"].dataType.simpleString()
        return self.vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")

    def report(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
        assigned = stage_table(self.assign(), "assigned")
        sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("cluster_inertia")).collect()
        total = sum(r["cluster_inertia"] for r in sums)
        facts = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(",".join(map(str, self.centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
        clusters = assigned.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most
