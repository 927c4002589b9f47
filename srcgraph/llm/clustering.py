"""Centroid clustering in exact integers, with block-norm screening.

Vectors are integers, and each keeps the norms of its segments. By
Cauchy-Schwarz the squared distance of two vectors is at least the sum, over
the segments, of the squared difference of their norms. So a vector is
screened against all centroids by these few norms; centroids are tried by
growing bound, and those whose bound exceeds the distance already found get no
exact distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch, without

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
SEGMENT = 8
#: Components from here on could give distances beyond 64 bits.
GREATEST = 1 << 27


def segment_norms(vectors: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Norm of each segment of each row."""
    edges = np.arange(0, vectors.shape[1], segment)
    return np.sqrt(np.add.reduceat(vectors * vectors, edges, axis=1).astype(np.float64))


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact distances taken); of equally near ones the smaller number."""
    n, k = len(vectors), len(centroids)
    own = segment_norms(centroids, segment)
    bound = np.zeros((n, k))
    for j in range(norms.shape[1]):
        bound += (norms[:, j : j + 1] - own[:, j]) ** 2
    # Norms are rounded: a bound counts as less than it is by far more than its error.
    bound -= 1e-9 * (np.square(norms).sum(axis=1)[:, None] + np.square(own).sum(axis=1)) + 1e-6
    order = np.argsort(bound, axis=1, kind="stable")
    best, at, taken = np.full(n, np.iinfo(np.int64).max), np.full(n, k, dtype=np.int64), 0
    rows = np.arange(n)
    for step in range(k):
        tried = order[rows, step]
        open_ = bound[rows, tried] <= best[rows]
        rows, tried = rows[open_], tried[open_]
        if not len(rows):
            break
        d = np.square(vectors[rows] - centroids[tried]).sum(axis=1)
        taken += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (tried < at[rows]))
        best[rows[better]], at[rows[better]] = d[better], tried[better]
    return at, best, taken


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v, norms): vectors of so many components, none null, NaN or infinite, as integers floor(scale * x), with the norms of their segments.

    Others are left out. A component of 2^27 or more in size is an error.
    """
    values = F.col(vector_col).cast("array<double>")
    finite = F.forall(values, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(values, lambda x: F.when(F.abs(x * scale) < GREATEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long")))
    kept = rows.where((F.size(vector_col) == dimensions) & finite).select(F.col(id_col).alias("id"), whole.alias("v"))

    def normed(batches):
        for batch in batches:
            norms = segment_norms(_matrix(batch.column(1), dimensions, np.int64))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(norms.ravel()), norms.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "v", "norms"])

    return kept.mapInArrow(normed, f"id {kept.schema[0].dataType.simpleString()}, v array<bigint>, norms array<double>")


def starts(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose `seed:id` has the smallest SHA-256, in its order; fewer if there are fewer. Equal identifiers go by components; null ones never start."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.where(F.col("id").isNotNull()).select(key.alias("key"), "v").orderBy("key", "v").limit(k)
    return np.array([r.v for r in first.collect()], dtype=np.int64)  # k rows


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of those nearest to each. Tasks sum before the shuffle, so each sends a row for a centroid."""
    k, width = centroids.shape

    def sums(batches):
        total, count = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), width, np.int64)
            at, _, _ = nearest(v, _matrix(batch.column(1), -(-width // SEGMENT), np.float64), centroids)
            np.add.at(total, at, v)
            count += np.bincount(at, minlength=k)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int32()), pa.array([int(count[c])]), pa.array([total[c].tolist()], pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = vectors.select("v", "norms").mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    out = centroids.copy()
    for r in each.collect():  # k rows
        out[r.cluster] = [x // r.n for x in r.total]
    return out


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance, exact): exact is the number of exact distances that the vector's batch took, on its first row."""
    width = centroids.shape[1]

    def assign(batches):
        for batch in batches:
            at, distance, taken = nearest(_matrix(batch.column(1), width, np.int64), _matrix(batch.column(2), -(-width // SEGMENT), np.float64), centroids)
            exact = np.zeros(len(at), dtype=np.int64)
            exact[:1] = taken
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(distance), pa.array(exact)], names=["id", "cluster", "distance", "exact"])

    return vectors.mapInArrow(assign, f"id {vectors.schema[0].dataType.simpleString()}, cluster int, distance bigint, exact bigint")


def cluster(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256, exact (distances taken, summed by batch).

    See quantised() for what is kept and starts() for where centroids start;
    cluster numbers follow their order. A centroid without vectors stays where
    it is. Rows that repeat an identifier are vectors of their own. Without any
    vector, or any with an identifier, the result is empty. Further columns are not read. The driver
    holds k centroids; tasks hold one batch.
    """
    spark = rows.sparkSession
    with Scratch(spark, "clusters") as scratch:
        vectors = scratch.write(quantised(without(rows.select(id_col, vector_col)), id_col, vector_col, dimensions, scale), "vectors")
        centroids = starts(vectors, k, seed)
        if not len(centroids):
            assigned = vectors.where("false").select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("exact"))
        else:
            for _ in range(rounds):
                centroids = _moved(vectors, centroids)
            assigned = _assigned(vectors, centroids)
        assigned = scratch.keep(scratch.write(assigned, "assigned"))
    totals = {r.cluster: r.total for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(c, t, sum(totals.values()), digest(centroids[c])) for c, t in totals.items()]
    side = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(side), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact")
