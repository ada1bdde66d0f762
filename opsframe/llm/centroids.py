"""Exact centroid clustering with n-simplex projections as a filter.

The distances of a vector to a few pivots are measured once and turned into the coordinates of an apex above the simplex
that the pivots span.  The Euclidean distance of two apexes never exceeds the distance of the vectors, and with one apex
mirrored below the simplex it never falls short of it.  A centroid whose lower bound lies above another centroid's upper
bound, or above the distance of the centroid with the least lower bound, cannot be nearest; what is left is compared in whole
numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.base import quoted
from opsframe.session import scratch_folder

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 16
SCALE = 256
#: Components are whole numbers up to this size, so that squared distances of vectors fit into 64 bits.
LARGEST = 1 << 27
#: Part of the largest distance that a pivot must rise above the simplex of those before it.
_HEIGHT = 0.02
#: Part of the largest distance by which a bound may be off in floating point, with plenty to spare.
_SLACK = 1e-6
_BLOCK = 1024


@dataclass(frozen=True)
class Simplex:
    """Pivots in general position; ``corner[i]`` has the coordinates of pivot i, zero from place i on."""

    pivots: np.ndarray
    corner: np.ndarray

    @staticmethod
    def over(candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
        """Take candidates in order as long as each stands clear of the simplex so far."""
        chosen: list[np.ndarray] = []
        corner = np.zeros((most, most))
        wide = np.sqrt(max((float(squared(candidates, c[None])[:, 0].max()) for c in candidates[:1]), default=0.0))
        for vector in candidates:
            if len(chosen) == most:
                break
            if not chosen:
                chosen.append(vector)
                continue
            built = Simplex(np.array(chosen), corner[: len(chosen)])
            apex = built.apexes(np.sqrt(squared(vector[None], built.pivots).astype(np.float64)))[0]
            if apex[-1] > _HEIGHT * wide:
                corner[len(chosen), : len(apex)] = apex
                chosen.append(vector)
        return Simplex(np.array(chosen).reshape(len(chosen), -1), corner[: len(chosen)])

    def apexes(self, distances: np.ndarray) -> np.ndarray:
        """Coordinates of points by their distances to all pivots: within the simplex's space, then the height above it."""
        m, n = distances.shape
        out = np.zeros((m, n))
        first = distances[:, 0] ** 2
        for i in range(1, n):
            edge = self.corner[i]
            known = out[:, : i - 1] @ edge[: i - 1]
            out[:, i - 1] = (first - distances[:, i] ** 2 + edge @ edge - 2 * known) / (2 * edge[i - 1])
        out[:, n - 1] = np.sqrt(np.maximum(first - (out[:, : n - 1] ** 2).sum(1), 0))
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` and a few rows of ``b``, in whole numbers."""
    out = np.empty((len(a), len(b)), np.int64)
    for j, row in enumerate(b):
        apart = a - row
        out[:, j] = (apart * apart).sum(1)
    return out


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of all vectors with apexes ``a`` to those with apexes ``b``."""
    base = (a[:, None, :-1] - b[None, :, :-1]) ** 2
    base = base.sum(2)
    return (
        np.sqrt(base + (a[:, None, -1] - b[None, :, -1]) ** 2),
        np.sqrt(base + (a[:, None, -1] + b[None, :, -1]) ** 2),
    )


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, simplex: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each vector (ties: the smaller number), its squared distance, and exact comparisons made."""
    tops = simplex.apexes(np.sqrt(squared(centroids, simplex.pivots).astype(np.float64)))
    cluster = np.empty(len(vectors), np.int32)
    distance = np.empty(len(vectors), np.int64)
    compared = 0
    for at in range(0, len(vectors), _BLOCK):
        own = slice(at, at + _BLOCK)
        low, high = bounds(apexes[own], tops)
        slack = _SLACK * (1 + high.max())
        exact = np.full(low.shape, np.iinfo(np.int64).max)
        line = np.arange(len(low))
        guess = low.argmin(1)
        apart = vectors[own] - centroids[guess]
        exact[line, guess] = (apart * apart).sum(1)
        limit = np.minimum(high.min(1), np.sqrt(exact[line, guess].astype(np.float64))) + slack
        left, right = np.nonzero((low <= limit[:, None]) & (exact == np.iinfo(np.int64).max))
        apart = vectors[own][left] - centroids[right]
        exact[left, right] = (apart * apart).sum(1)
        cluster[own] = exact.argmin(1)
        distance[own] = exact.min(1)
        compared += len(guess) + len(left)
    return cluster, distance, compared


def whole_vectors(table: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and the whole numbers floor(256 x) of each vector that has all its components, none null or non-finite."""
    parts = quoted(vector)
    usable = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = table.filter((F.size(parts) == dimensions) & usable)
    return kept.select(quoted(key).alias("vec_id"), F.transform(parts, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, prefix: str = "2:") -> np.ndarray:
    """The vectors with the smallest hashes of their ids; null ids come last, rows of one id by their components."""
    digest = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in rows.collect()], np.int64)  # k rows


def _blocks(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def projected(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """``vectors`` with their apexes, from distances to the pivots that are measured here once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _blocks(batch.column("v"), np.int64)
            if np.abs(v).max() > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST // SCALE}, squared distances would not fit into 64 bits")
            apexes = simplex.apexes(np.sqrt(squared(v, simplex.pivots).astype(np.float64)))
            lists = []
            for block, kind in ((v, pa.int32()), (apexes, pa.float64())):
                ends = np.arange(0, block.size + 1, block.shape[1], dtype=np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(block.ravel(), kind)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *lists], ["vec_id", "v", "apex"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(work, f"vec_id {kind}, v array<int>, apex array<double>")


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, simplex: Simplex) -> Iterator[tuple]:
    for batch in batches:
        if batch.num_rows:
            v = _blocks(batch.column("v"), np.int64)
            yield batch, v, *nearest(v, _blocks(batch.column("apex"), np.float64), centroids, simplex)


def moved(points: DataFrame, centroids: np.ndarray, simplex: Simplex) -> np.ndarray:
    """Centroids after one round: componentwise floor of the mean of their vectors; without vectors they stay."""
    k, n = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, n), np.int64)
        for _, v, cluster, _, _ in _assigned(batches, centroids, simplex):
            count += np.bincount(cluster, minlength=k)
            np.add.at(total, cluster, v)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": used.astype(np.int32), "n": count[used], "total": total[used].tolist()})

    sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(n)]
    parts = points.mapInArrow(work, "cluster int, n long, total array<long>")
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most one row a centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(n)]
    return out


def cluster(
    table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS,
    key: str = "vec_id", vector: str = "embedding", prefix: str = "2:", pivots: int = PIVOTS,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector.

    A null vector, one with another number of components, or one with a null, NaN or infinite component is left out.
    Repeated rows count and are returned each; ties go to the smaller centroid number; with fewer vectors than
    centroids there are as many centroids as vectors; an empty table gives no rows; other columns are not
    looked at.  Null ids are clustered too, but start no centroid while other vectors do.  Components beyond 524,288 are an error.
    Vectors never leave the executors: each round brings back one sum a centroid.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table, key, vector, dimensions)
    centroids = first_centroids(vectors, k, prefix)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    if np.abs(centroids).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST // SCALE}, squared distances would not fit into 64 bits")
    simplex = Simplex.over(centroids, pivots)
    folder = scratch_folder(spark, "apexes")
    projected(vectors, simplex).write.parquet(folder)
    points = spark.read.parquet(folder)
    for _ in range(rounds):
        centroids = moved(points, centroids, simplex)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, cluster, distance, _ in _assigned(batches, centroids, simplex):
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"]
            )

    folder = scratch_folder(spark, "assigned")
    points.mapInArrow(last, schema).write.parquet(folder)
    assigned = spark.read.parquet(folder)
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.element_at(F.array(*[F.lit(inertia.get(i, 0)).cast("long") for i in range(len(centroids))]), F.col("cluster") + 1)
    name = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    return assigned.select(
        "vec_id", "cluster", "distance", own.alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), name.alias("centroid_sha256"),
    )
