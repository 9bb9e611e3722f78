"""Clustering by centroids in whole numbers, with block-norm screening.

A vector is cut into segments. Of each segment, its mean and the norm of what is
left beside the mean are kept: two numbers in place of eight. Since the mean and
the rest are orthogonal, and by Cauchy and Schwarz two rests are at least as far
apart as their norms, the distance of two such short vectors is never more than
that of the whole ones. It is one small matrix product for a batch and all
centroids. The centroid that looks nearest gets an exact distance first; of the
others, only those whose bound is not above it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, read, release, written

DIMS, SCALE, CENTROIDS, ROUNDS, SEGMENTS = 64, 64, 16, 3, 8
#: Components are held within this, so that a squared distance of 64 of them fits 64 bits.
LARGEST = 2**27
#: Short vectors are stored in single precision: a relative error of 2**-24 each, taken off every bound with room to spare.
SLACK = 1e-6
#: Vectors compared at once.
BLOCK = 4096


def short(whole: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Means and rest norms of the segments of whole-number vectors, scaled so that distances compare."""
    parts = whole.reshape(len(whole), segments, -1)
    n = parts.shape[2]
    sums = parts.sum(2)
    rest = n * (parts * parts).sum(2) - sums * sums  # exact: n times the squared norm of the rest
    return np.concatenate((sums / np.sqrt(n), np.sqrt(rest / n)), 1)


def nearest(whole: np.ndarray, brief: np.ndarray, centroids: np.ndarray, brief_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each vector, ties to the smaller number, and how many exact distances it took."""
    a, b = np.linalg.norm(brief, axis=1), np.linalg.norm(brief_centroids, axis=1)
    square = a[:, None] ** 2 + b**2 - 2 * (brief @ brief_centroids.T)
    bound = np.maximum(np.sqrt(np.maximum(square, 0)) - SLACK * (a[:, None] + b), 0) ** 2
    rows = np.arange(len(whole))
    first = bound.argmin(1)
    off = whole - centroids[first]
    known = np.full(bound.shape, np.iinfo(np.int64).max)
    known[rows, first] = (off * off).sum(1)
    left = bound <= known[rows, first][:, None] * (1 + SLACK)
    left[rows, first] = False
    i, j = np.nonzero(left)
    for s in range(0, len(i), BLOCK):
        x, y = i[s : s + BLOCK], j[s : s + BLOCK]
        off = whole[x] - centroids[y]
        known[x, y] = (off * off).sum(1)
    best = known.argmin(1)
    return best, known[rows, best], len(rows) + len(i)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def prepared(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, the vector ``v`` in whole numbers and its short form ``z``, of the vectors that are kept."""
    e = F.col(vector_col).cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    kept = vectors.where((F.size(e) == dims) & finite).select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e"))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                v = np.clip(np.floor(scale * _matrix(part.column(1))), -LARGEST, LARGEST).astype(np.int64)
                z = short(v, segments).astype(np.float32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(kind)) for x, kind in ((v.astype(np.int32), pa.int32()), (z, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["vec_id", "v", "z"])
        release()

    return kept.mapInArrow(run, "vec_id long, v array<int>, z array<float>")


def _compared(rows: DataFrame, centroids: np.ndarray, segments: int, each, schema: str) -> DataFrame:
    """``each(batches)`` over (batch, centroid, distance) of every batch, in tasks."""
    brief = short(centroids, segments)

    def run(batches):
        def found():
            for batch in batches:
                for s in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(s, BLOCK)
                    v, z = _matrix(part.column(1)).astype(np.int64), _matrix(part.column(2)).astype(float)
                    best, distance, _ = nearest(v, z, centroids, brief)
                    yield part.column(0), v, best, distance

        yield from each(found())
        release()

    return rows.select("vec_id", "v", "z").mapInArrow(run, schema)


def _moved(rows: DataFrame, centroids: np.ndarray, segments: int) -> np.ndarray:
    """Each centroid replaced by the floor of the mean of its vectors; those without vectors stay."""

    def each(found):
        k, dims = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, v, best, _ in found:
            for c in np.unique(best).tolist():
                own = v[best == c]
                count[c] += len(own)
                total[c] += own.sum(0)
        met = np.flatnonzero(count)
        sums = pa.array(total[met].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]), sums], ["c", "n", "sums"])

    # A task gives a row a centroid; the driver gets a row a centroid and component.
    parts = _compared(rows, centroids, segments, each, "c int, n long, sums array<long>").select("c", "n", F.posexplode("sums").alias("i", "x"))
    out = centroids.copy()
    for c, i, n, x in parts.groupBy("c", "i").agg(F.sum("n"), F.sum(F.col("x").cast("decimal(38,0)"))).collect():
        out[c, i] = int(x) // n
    return out


def starts(rows: DataFrame, centroids: int = CENTROIDS) -> np.ndarray:
    """The vectors with the least SHA-256 of ``1:<vec_id>``, in that order; equal ids go by their components."""
    sha = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(sha.alias("sha"), "v").orderBy("sha", "v").limit(centroids).collect()
    return np.array([r["v"] for r in first], np.int64)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, segments: int = SEGMENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that is kept.

    Kept are vectors of exactly ``dims`` components, none of them null or not
    finite; others, null vectors too, have no row. A component becomes
    floor(scale * x), held within 2**27 so that distances fit. Repeated rows are
    vectors of their own, a null id starts as an empty one and comes out null.
    With fewer vectors than ``centroids`` there are as many centroids as vectors;
    an empty table gives an empty result. Sums beyond 64 bits come out null.
    All is exact: screening only spares distances that can't be the least.
    """
    spark = vectors.sparkSession
    rows = written(prepared(vectors, dims, scale, segments, id_col, vector_col), "vectors")
    now = starts(rows, centroids)
    schema = "vec_id long, cluster int, distance long"
    if not len(now):
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        now = _moved(rows, now, segments)

    def each(found):
        for ids, _, best, distance in found:
            yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    out = written(_compared(rows, now, segments, each, schema), "assigned")
    drop(rows)
    # A row a centroid.
    named = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(now.tolist())]
    own, c = fresh("own"), fresh("c")
    sums = out.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = sums.agg(F.try_sum("cluster_inertia").alias("inertia"))
    side = spark.createDataFrame(named, f"{c} int, centroid_sha256 string").join(sums.withColumnRenamed("cluster", own), F.col(own) == F.col(c)).crossJoin(F.broadcast(total)).drop(own)
    return out.join(F.broadcast(side), F.col("cluster") == F.col(c)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clustering(spark, sf_dir):
    """All vectors of ``embeddings``; which are kept, and null and repeated ids, as in ``cluster``."""
    return cluster(read(spark, sf_dir, "embeddings"))
