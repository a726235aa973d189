"""Centroid clustering of integer vectors by scalar lookup tables, in exact arithmetic.

Vectors are written once as integers. In each round a task tabulates, for each dimension, each integer that occurs in
a batch of its vectors, and each centroid, the squared difference; distances are gathered from that table and summed,
so that a difference is squared once for each value and not once for each vector. A task returns a row of sums for
each centroid, and the driver holds the centroids alone: k times the number of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import python_ready, stage

#: Components beyond this count as this, so that every distance is a long.
LIMIT = 1 << 27


def integer_vectors(df: DataFrame, dims: int = 64, scale: float = 64.0, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, of the vectors with exactly dims components, none null, NaN or infinite.

    Components beyond LIMIT or below -LIMIT are held there. The id may be null.
    """
    x = F.col(column)
    good = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floor = lambda c: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(scale) * c.cast("double")))).cast("int")
    return df.where(x.isNotNull() & good).select(F.col(id_col).alias("vec_id"), F.transform(x, floor).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; ties by the smaller vector, null ids last."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64).reshape(len(rows), len(rows[0].v) if rows else 0)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of v to each centroid, by a table of squared differences."""
    total = np.zeros((len(v), len(centroids)), np.int64)
    for d in range(v.shape[1]):
        values, where = np.unique(v[:, d], return_inverse=True)
        total += ((values[:, None] - centroids[None, :, d]) ** 2)[where]
    return total


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if n := len(batch):
            yield batch, batch.column("v").flatten().to_numpy().astype(np.int64).reshape(n, -1)


def new_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The exact floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for _, v in _batches(batches):
            nearest = distances(v, centroids).argmin(1)
            counts += np.bincount(nearest, minlength=k)
            for c in np.unique(nearest):
                sums[c] += v[nearest == c].sum(0)
        own = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(own, pa.int32()), pa.array(counts[own]), *[pa.array(sums[own, d]) for d in range(dims)]], names=["c", "n", *[f"s{d}" for d in range(dims)]])

    names = [f"s{d}" for d in range(dims)]
    parts = vectors.select("v").mapInArrow(run, ", ".join(["c int", "n long", *[f"{s} long" for s in names]]))
    out = centroids.copy()
    for row in parts.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).collect():  # k rows
        out[row.c] = [row[s] // row.n for s in names]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance: the nearest centroid of each vector, the smaller number among equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in _batches(batches):
            far = distances(v, centroids)
            nearest = far.argmin(1)
            yield pa.record_batch([batch.column("vec_id"), pa.array(nearest, pa.int32()), pa.array(far[np.arange(len(v)), nearest])], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, seed: int = 1) -> DataFrame:
    """Every vector with its cluster after so many rounds of exact k-means.

    df has vec_id and embedding; other columns are ignored, whatever their names. Returns vec_id, cluster, distance
    (squared, to the cluster's centroid), cluster_inertia and inertia (distances summed over the cluster and over all;
    beyond long: the largest long) and centroid, the integer vector. Vectors are those of integer_vectors(): null
    ones, those of another length and those with a component null, NaN or infinite have no row. Each row counts,
    repeated ones and those without an id too; an id that is null starts no centroid unless there are too few others.
    With fewer than k vectors there are as many centroids as vectors; equal ones leave all vectors to the
    smallest number. An empty table gives an empty result.
    """
    spark = df.sparkSession
    python_ready(spark)
    vectors = stage(integer_vectors(df, dims), "vectors")
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = new_centroids(vectors, centroids)
    out = "cluster_inertia long, inertia long, centroid array<long>"
    if not len(centroids):
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, {out}")
    found = stage(assigned(vectors, centroids), "assigned")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    held = lambda x: min(x, (1 << 63) - 1)
    rows = [(c, held(s), held(sum(sums.values())), centroids[c].tolist()) for c, s in sorted(sums.items())]
    return found.join(F.broadcast(spark.createDataFrame(rows, f"cluster int, {out}")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
