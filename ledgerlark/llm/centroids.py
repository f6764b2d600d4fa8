"""Centroid clustering of integer vectors: float32 products shortlist centroids, exact integers decide.

A row's scores against all centroids come from one float32 matrix product.  A
bound on its rounding error (the usual one for a dot product of d terms in any
order, times the two norms) makes each score an interval that surely holds the
exact value.  Where only one interval reaches below the least upper end, that
centroid is the nearest; where several do, those are worked out in 64-bit
integers and the lowest number wins a tie.  Distances that are returned are
exact integers always.

Tasks send the exact sums of their rows, cut into limbs of 40 bits, so Spark
adds them as longs whatever their size; the driver gets k * (d + 1) sums of a
round, never rows.  Each round reads the vectors once.

Cases: vectors that are null, of another length, or hold null or non-finite
components are left out; so an empty table, or one without any kept vector,
gives an empty result.  With fewer kept vectors than k there are as many
centroids as vectors.  Rows that repeat an id are vectors of their own; equal
hashes among the first centroids are ordered by their components.  A null id is
clustered but starts no centroid.  Components too large for 64-bit distances
are worked out in Python's integers; a distance or sum that is no long is null.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import Scratch
from ledgerlark.llm.wordhash import tidy

K, ROUNDS, SCALE, DIMS = 16, 3, 64, 64
_LIMB = 40
_LONG = 2**63 - 1
#: Rows of a matrix product, and exact distances worked out at once.
_ROWS, _PAIRS = 4_096, 1 << 16


def sound(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has ``dims`` components, none of them null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dims) & fine


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for a power of two."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


class Centroids:
    """Centroids as exact integers, with what the screening needs of them."""

    def __init__(self, rows: Sequence[Sequence[int]]) -> None:
        self.rows = [list(map(int, r)) for r in rows]
        d = len(self.rows[0])
        #: Components up to this give distances that fit in 64 bits.
        self.most = math.isqrt(_LONG // d) // 2
        self.small = all(abs(v) <= self.most for r in self.rows for v in r)
        if self.small:
            self.at = np.array(self.rows, np.int64)
            self.single = self.at.T.astype(np.float32)
            self.square = (self.at * self.at).sum(1)
            self.norm = np.sqrt(self.square.astype(np.float64))
            u = 2.0**-24
            self.gamma = (d + 2) * u / (1 - (d + 2) * u)  # two more for rounding the components themselves

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row (int64, components up to ``most``), and the exact distance."""
        dot = (x.astype(np.float32) @ self.single).astype(np.float64)
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        score = self.square - 2 * dot
        wide = 2.0 * self.gamma * norm[:, None] * self.norm + 2.0**-49 * (self.square + 2 * np.abs(dot))
        wide *= 1 + 2.0**-40
        near = score - wide <= (score + wide).min(1)[:, None]
        best = near.argmax(1)
        row, k = np.nonzero(near & (near.sum(1) > 1)[:, None])
        if len(row):
            exact = np.concatenate([self._distance(x[row[i : i + _PAIRS]], k[i : i + _PAIRS]) for i in range(0, len(row), _PAIRS)])
            order = np.lexsort((k, exact, row))
            first = np.ones(len(row), bool)
            first[1:] = row[order][1:] != row[order][:-1]
            best[row[order][first]] = k[order][first]
        return best, self._distance(x, best)

    def _distance(self, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        apart = x - self.at[k]
        return (apart * apart).sum(1)

    def nearest_of_large(self, x: list[int]) -> tuple[int, int]:
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(self.rows))[::-1]

    def digest(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in self.rows]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def assigned(column: pa.Array, centroids: Centroids, scale: int, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of a column of sound vectors: where it starts, integer vectors, clusters and distances (objects where 64 bits do not hold them)."""
    every = _matrix(column, dims)
    for lo in range(0, len(every), _ROWS):
        x = every[lo : lo + _ROWS]
        large = (np.abs(x) >= centroids.most / scale).any(1) if centroids.small else np.ones(len(x), bool)
        ints = np.floor(np.where(large[:, None], 0.0, x) * scale).astype(np.int64)
        if not large.any():
            yield lo, ints, *centroids.nearest(ints)
            continue
        cluster, distance = np.zeros(len(x), np.int64), np.zeros(len(x), object)
        ints = ints.astype(object)
        if not large.all():
            cluster[~large], distance[~large] = centroids.nearest(ints[~large].astype(np.int64))
        for i in np.flatnonzero(large).tolist():
            ints[i] = own = [whole(v, scale) for v in x[i].tolist()]
            cluster[i], distance[i] = centroids.nearest_of_large(own)
        yield lo, ints, cluster, distance


@tidy
def _sums(batches: Iterator[pa.RecordBatch], centroids: Centroids, scale: int, dims: int) -> Iterator[pa.RecordBatch]:
    """cluster, position (-1: the number of vectors), limb, part: the exact sums of a task's vectors."""
    total = np.zeros((len(centroids.rows), dims), object)
    count = np.zeros(len(centroids.rows), np.int64)
    for batch in batches:
        for _, ints, cluster, _ in assigned(batch.column("v"), centroids, scale, dims):
            count += np.bincount(cluster, minlength=len(count))
            for k in np.unique(cluster).tolist():
                # 4,096 components below 2 ** 31 each where they are int64
                total[k] += ints[cluster == k].sum(0).astype(object)
    rows = [(k, -1, 0, n) for k, n in enumerate(count.tolist()) if n]
    for k, own in enumerate(total.tolist()):
        for j, v in enumerate(own):
            sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
            while v:
                rows.append((k, j, limb, sign * (v & ((1 << _LIMB) - 1))))
                v, limb = v >> _LIMB, limb + 1
    if rows:
        k, j, limb, part = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(j, pa.int32()), pa.array(limb, pa.int32()), pa.array(part, pa.int64())], names=["cluster", "position", "limb", "part"])


@tidy
def _assign(batches: Iterator[pa.RecordBatch], centroids: Centroids, scale: int, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, ints, cluster, distance in assigned(batch.column("v"), centroids, scale, dims):
            far = [None if d > _LONG else int(d) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(cluster)), pa.array(cluster, pa.int32()), pa.array(far, pa.int64())], names=["id", "cluster", "distance"])


def moved(kept: DataFrame, centroids: Centroids, scale: int, dims: int) -> Centroids:
    """One round: every non-empty centroid becomes the componentwise floor of its vectors' mean."""
    parts = kept.mapInArrow(partial(_sums, centroids=centroids, scale=scale, dims=dims), "cluster int, position int, limb int, part long")
    # k * (d + 1) rows, times the limbs of the largest sum
    sums: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "position", "limb").agg(F.sum("part").alias("part")).collect():
        at = (r["cluster"], r["position"])
        sums[at] = sums.get(at, 0) + (r["part"] << (_LIMB * r["limb"]))
    return Centroids([[sums.get((k, j), 0) // sums[k, -1] for j in range(dims)] if (k, -1) in sums else row for k, row in enumerate(centroids.rows)])


def cluster_vectors(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = "1:") -> DataFrame:
    """One row for each kept vector: its id, cluster, distance, cluster_size, cluster_inertia, inertia, centroid_sha256, centroid.

    Components are floor(scale * x); the first centroids are the k vectors with
    the smallest sha256 of ``seed`` and the id.  ``scale`` is a power of two.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "centroids")
    kind = dict(vectors.dtypes)[id_column]
    kept = vectors.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(sound(F.col("v"), dims))
    named = kept.where("id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), "v")
    first = [[whole(x, scale) for x in r["v"]] for r in named.orderBy("h", "v").limit(k).collect()]  # k rows
    shape = f"id {kind}, cluster int, distance long, cluster_size long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<string>"
    if not first:
        return spark.createDataFrame([], shape).withColumnRenamed("id", id_column)
    centroids = Centroids(first)
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale, dims)
    rows = scratch.save(kept.mapInArrow(partial(_assign, centroids=centroids, scale=scale, dims=dims), f"id {kind}, cluster int, distance long"), "assigned")
    fits = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(20,0)")))
    seen = {r["cluster"]: (r["n"], r["s"]) for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), fits.alias("s")).collect()}  # k rows
    long = lambda s: int(s) if s is not None and s <= _LONG else None
    every = None if any(s is None for _, s in seen.values()) else sum(s for _, s in seen.values())
    facts = [(c, n, long(s), long(every), h, list(map(str, row))) for c, (h, row) in enumerate(zip(centroids.digest(), centroids.rows)) if c in seen for n, s in (seen[c],)]
    about = spark.createDataFrame(facts, "cluster int, cluster_size long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<string>")
    out = rows.join(F.broadcast(about), "cluster")  # k rows
    return out.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_size", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
