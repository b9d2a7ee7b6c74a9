"""Exact centroid clustering with a LAESA pivot table (operator 13).

The distances of every vector to a few fixed pivots are computed once and stored
beside the vector. In each round the centroids' distances to the same pivots are
known, and the triangle inequality bounds the distance of a vector and a
centroid from below by the largest difference of their pivot distances. The
centroid with the smallest bound is measured first; of the others only those
whose bound does not exceed the best distance so far are measured. Bounds are
doubles with a slack above their rounding; distances are exact integers.

A round is one pass over the stored table. Tasks give one sum for each cluster
and component, Spark adds them up, and k * dim sums reach the driver: this grows
with the number of centroids, not with the table. Nothing is grouped by vector,
so equal vectors, however many, need no special care.

Defined results: vectors null, of another length than `dim`, or with null or
non-finite components take no part. Rows are clustered one by one, also where
ids repeat; a null id is hashed as an empty text, and starts that tie in their
hash are taken in the order of their components. With fewer rows than k there
are as many centroids as rows; an empty table gives no rows. Components beyond
2**62 after scaling count as 2**62; distances and sums that a long can't hold are
shown as its largest value, but decided exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.shared import shared_table

MOST = 2.0**62  # of a component's magnitude
FITS = 1 << 27  # below it, squared distances of up to 64 components stay under 2**63
LONGEST = (1 << 63) - 1
SAMPLE = 256  # vectors that pivots are chosen from: cost only, never the result
WIDE = "decimal(38,0)"


@dataclass
class Clustering:
    """centroids: components by number; assigned: vec_id, cluster, distance (squared)."""

    centroids: list[list[int]]
    assigned: DataFrame

    def digests(self) -> list[str]:
        """Of each centroid's components, as decimals joined by commas."""
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """vec_id and v, the integers floor(scale * x), of the rows that take part."""
    bad = F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    y = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))
    rows = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda c: F.floor(y(c)).cast("long")).alias("v"))


def start_order(id_col: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to c: longs where they fit, else Python's integers."""
    if v.shape[1] <= 64 and (not v.size or max(-int(v.min()), int(v.max())) < FITS) and max(-int(c.min()), int(c.max())) < FITS:
        d = v - c
        return np.einsum("ij,ij->i", d, d)
    d = v.astype(object) - c.astype(object)
    return (d * d).sum(1)


def roots(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64))


def chosen_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Each next pivot is the vector of the sample with the largest sum of distances to those before it."""
    total, at = np.zeros(len(sample)), [0]
    while len(at) < min(n, len(sample)):
        total += roots(squared(sample, sample[at[-1]]))
        total[at] = -1.0
        at.append(int(total.argmax()))
    return sample[at]


def nearest(v: np.ndarray, table: np.ndarray, centroids: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and exact squared distance of each row's nearest centroid (ties: smaller number), and how many distances were measured.

    table: the rows' distances to the pivots; to_pivots: the centroids'.
    """
    n, k = len(v), len(centroids)
    low = np.zeros((n, k))
    for c in range(k):
        gap = np.abs(table - to_pivots[c]) - 1e-12 * (table + to_pivots[c])
        low[:, c] = gap.max(1)
    first = low.argmin(1)
    best, best_at, measured = np.zeros(n, np.int64), first.copy(), n
    for c in np.unique(first):
        rows = np.nonzero(first == c)[0]
        d2 = squared(v[rows], centroids[c])
        if d2.dtype == object and best.dtype != object:
            best = best.astype(object)
        best[rows] = d2
    for c in range(k):
        rows = np.nonzero((first != c) & (low[:, c] <= roots(best) * (1 + 1e-12)))[0]
        measured += len(rows)
        if len(rows):
            d2 = squared(v[rows], centroids[c])
            if d2.dtype == object and best.dtype != object:
                best = best.astype(object)
            less = (d2 < best[rows]) | ((d2 == best[rows]) & (c < best_at[rows]))
            best[rows[less]], best_at[rows[less]] = d2[less], c
    return best_at, best, measured


def _with_pivots(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1), pivots.shape[1])
            table = np.stack([roots(squared(v, p)) for p in pivots], 1)
            d = pa.ListArray.from_arrays(pa.array(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)), pa.array(table.ravel()))
            yield pa.record_batch([b.column(0), b.column(1), d], ["vec_id", "v", "d"])

    return run


def _decimals(values) -> pa.Array:
    from decimal import Decimal

    return pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0))


def _sums(centroids: np.ndarray, to_pivots: np.ndarray):
    """Rows (v, d) to one row for each cluster and component of the task: cluster, i, n, total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for b in batches:
            v, d = _matrix(b.column(0), dim), _matrix(b.column(1), to_pivots.shape[1])
            at, _, _ = nearest(v, d, centroids, to_pivots)
            fits = not v.size or max(-int(v.min()), int(v.max())) < FITS
            for c in np.unique(at):
                own = v[at == c]
                n[c] += len(own)
                total[c] += (own if fits else own.astype(object)).sum(0).astype(object)
        c = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(np.repeat(c, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(c))), pa.array(np.repeat(n[c], dim)), _decimals(total[c].ravel())], ["cluster", "i", "n", "total"])

    return run


def _assigned(centroids: np.ndarray, to_pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d2, _ = nearest(_matrix(b.column(1), centroids.shape[1]), _matrix(b.column(2), to_pivots.shape[1]), centroids, to_pivots)
            yield pa.record_batch([b.column(0), pa.array(at.astype(np.int32)), _decimals(d2)], ["vec_id", "cluster", "distance"])

    return run


def kmeans(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, scale: int = 1024, seed: int = 3, pivots: int = 8) -> Clustering:
    """Lloyd's rounds from the k rows that come first by the hash of `seed:id`, and a last assignment."""
    whole = whole_vectors(vectors, id_col, vec_col, dim, scale)
    first = whole.orderBy(start_order(F.col("vec_id"), seed), "v").limit(max(SAMPLE, k)).select("v").collect()
    if not first:
        return Clustering([], whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast(WIDE).alias("distance")))
    sample = np.array([r["v"] for r in first], np.int64)
    centroids, fixed = sample[:k], chosen_pivots(sample, pivots)
    table = shared_table(whole.mapInArrow(_with_pivots(fixed), "vec_id long, v array<long>, d array<double>"), "pivot-table")

    def to_pivots(c: np.ndarray) -> np.ndarray:
        return np.stack([roots(squared(c, p)) for p in fixed], 1)

    for _ in range(rounds):
        sums = table.select("v", "d").mapInArrow(_sums(centroids, to_pivots(centroids)), f"cluster int, i int, n long, total {WIDE}")
        sums = sums.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").cast(WIDE).alias("total"))
        moved = centroids.copy()
        for r in sums.collect():  # k * dim rows
            moved[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
        if (moved == centroids).all():  # later rounds would only repeat this one
            break
        centroids = moved
    assigned = table.mapInArrow(_assigned(centroids, to_pivots(centroids)), f"vec_id long, cluster int, distance {WIDE}")
    return Clustering(centroids.tolist(), shared_table(assigned, "assigned"))


def _long(c: Column) -> Column:
    return F.least(c, F.lit(LONGEST).cast(WIDE)).cast("long")


def with_inertia(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    spark = found.assigned.sparkSession
    sums = {r["cluster"]: int(r["s"]) for r in found.assigned.groupBy("cluster").agg(F.sum("distance").cast(WIDE).alias("s")).collect()} if found.centroids else {}  # k rows
    rows = [(c, min(sums[c], LONGEST), min(sum(sums.values()), LONGEST), x) for c, x in enumerate(found.digests()) if c in sums]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", _long(F.col("distance")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")
