"""Exact top-k by inner product with block-at-a-time pruning.

Vectors that are alike are put next to each other: by the nearest of a bounded number of pivots, which a tree of
principal directions has put in order. Ranges of that order are slices, and a slice has blocks of BLOCK
vectors. A block keeps the largest and smallest component of its vectors for each dimension (term); with a
query these bound every score in the block, and those of a slice every score in the slice. For each query a
task visits the blocks of its slice from the highest bound down, scores a block through its forward index (its
rows), and stops at the first block whose bound falls below the query's k-th score so far.

A first pass looks at the slice where vectors like the query are; its k-th score is a floor for all others.
Bounds of slices are then held against floors, and only queries that a slice can still serve are sent to it, in
groups and in bounded tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import bounded_sample, python_ready, stage
from kinfold.llm.running import running_sums

#: Vectors in a block, in a slice, and queries in a group.
BLOCK, SLICE, GROUP = 64, 8192, 2048
#: Bound of the pivots, and of the vectors that they are taken from.
PIVOTS, SAMPLE_ROWS = 1024, 20_000
_EXACT = float(1 << 53)


def integer_vectors(df: DataFrame, id_col: str = "vec_id", column: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as long. Rows with a null id, a null vector, or a null, NaN or infinite component are left out."""
    x = F.col(column)
    whole = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # a component beyond the range of long is held at its end
    limit = float(1 << 62)
    floor = lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), F.lit(scale) * c.cast("double")))).cast("long")
    return df.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, floor).alias("v"))


def _dot(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products, in floats where these are exact, else in whole numbers held within long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(1, q.shape[1])
    if most < _EXACT:
        return (q.astype(np.float64) @ d.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**63:
        return q @ d.T
    return np.clip(q.astype(object) @ d.T.astype(object), -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _matrix(lists: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and each row of high and low, no less than any score of vectors between them."""
    f, high, low = q.astype(float), high.astype(float), low.astype(float)
    # rounding can only be a few parts in 2**53; the bound is widened by more
    return np.maximum(f, 0) @ high.T + np.minimum(f, 0) @ low.T + 1e-12 * (np.abs(f) @ np.maximum(np.abs(high), np.abs(low)).T)


def pivot_order(x: np.ndarray, parts: int) -> np.ndarray:
    """As many vectors of x as parts, at most: the mean of each part of a tree that halves x along its main direction, in the tree's order."""
    todo, out = [(x, parts)], []
    while todo:
        own, n = todo.pop()
        if n < 2 or len(own) < 2:
            out.append(own.mean(0))
            continue
        centred = own - own.mean(0)
        v = np.random.default_rng(1).standard_normal(own.shape[1])
        for _ in range(8):  # power iteration
            v = centred.T @ (centred @ v)
            v /= max(np.linalg.norm(v), 1e-300)
        order = np.argsort(centred @ v, kind="stable")
        half = len(own) // 2
        todo += [(own[order[half:]], n - n // 2), (own[order[:half]], n // 2)]
    return np.stack(out) if out else np.zeros((0, x.shape[1]))


def search_slice(ids: np.ndarray, d: np.ndarray, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vector, score) of the k best of one slice, none below floor, and how many blocks were scored."""
    starts = np.arange(0, len(ids), BLOCK)
    bound = bounds(q, np.stack([d[s : s + BLOCK].max(0) for s in starts]), np.stack([d[s : s + BLOCK].min(0) for s in starts]))
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s = np.full((len(qids), k), np.iinfo(np.int64).min)
    best_i = np.full((len(qids), k), np.iinfo(np.int64).max)
    kth, scored = floor.astype(float), 0
    for turn in range(len(starts)):
        block = order[:, turn]
        # a score equal to the k-th can still win by its smaller id
        live = bound[np.arange(len(qids)), block] >= kth
        if not live.any():
            break
        for b in np.unique(block[live]):
            rows = np.flatnonzero(live & (block == b))
            part = slice(starts[b], starts[b] + BLOCK)
            scored += len(rows)
            s = _dot(q[rows], d[part])
            better = s.max(1) >= kth[rows]
            rows, s = rows[better], s[better]
            if not len(rows):
                continue
            own = ids[part][None, :] == qids[rows][:, None]
            s_all = np.concatenate([best_s[rows], np.where(own, np.iinfo(np.int64).min, s)], axis=1)
            i_all = np.concatenate([best_i[rows], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(ids[part], s.shape))], axis=1)
            top = np.lexsort((i_all, ~s_all), axis=1)[:, :k]
            best_s[rows], best_i[rows] = np.take_along_axis(s_all, top, 1), np.take_along_axis(i_all, top, 1)
            full = best_i[rows, -1] != np.iinfo(np.int64).max
            kth[rows] = np.where(full, np.maximum(kth[rows], best_s[rows, -1].astype(float)), kth[rows])
    ok = (best_i != np.iinfo(np.int64).max) & (best_s >= floor.astype(float)[:, None])
    return np.repeat(qids, ok.sum(1)), best_i[ok], best_s[ok], scored


def placed(df: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """df (vec_id, v) with pivot, the place of the nearest pivot by direction, and near, how near it is."""
    length = np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    held = df.sparkSession.sparkContext.broadcast((pivots / length).T)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            s = _matrix(g["v"], width).astype(float) @ held.value
            best = s.argmax(1)
            yield pd.DataFrame({"vec_id": g["vec_id"], "v": g["v"], "pivot": best.astype(np.int32), "near": s[np.arange(len(g)), best]})

    return df.select("vec_id", "v").mapInPandas(run, "vec_id long, v array<long>, pivot int, near double")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query over all vectors but its own.

    vectors and queries hold vec_id and v (integers). Ties go to the smaller vec_id. Shorter vectors count
    as filled up with zeros. Rows repeated with one id are found as often as they occur. Fewer vectors than
    k give as many ranks; empty tables give an empty result. report, if given, takes an accumulator "scored"
    of the (query, block) pairs that are scored once the result is read, and how many pairs there are.

    How much is pruned depends on the vectors. Where they lie in clusters, blocks have tight bounds;
    directions that are independent in 64 dimensions leave no bound of this kind below the k-th score, and
    every block is scored.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    n, m, width = vectors.count(), queries.count(), vectors.select("v").union(queries.select("v")).agg(F.max(F.size("v"))).first()[0] or 1
    if not n or not m:
        return vectors.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    slices, groups = max(1, -(-n // SLICE)), max(1, -(-m // GROUP))
    scored = spark.sparkContext.accumulator(0)
    if report is not None:
        report |= {"scored": scored, "pairs": m * -(-n // BLOCK)}
    # at most SAMPLE_ROWS vectors
    some = bounded_sample(vectors.select("vec_id", "v"), SAMPLE_ROWS, "vec_id").toPandas()
    pivots = pivot_order(_matrix(some["v"], width).astype(float), min(PIVOTS, max(1, n // BLOCK)))
    # slices of SLICE vectors, whatever partitions the session has
    by_place = running_sums(placed(vectors, pivots, width), [], [F.col("pivot"), F.col("near"), F.col("vec_id")], {"at": F.lit(1)}, "places")
    ranged = stage(by_place.withColumn("slice", F.expr(f"cast((at - 1) div {SLICE} as int)")).drop("at"), "slices")
    # one row for each slice and pivot
    home = stage(ranged.groupBy("pivot", "slice").agg(F.count("*").alias("n")).groupBy("pivot").agg(F.max_by("slice", F.struct("n", "slice")).alias("slice")), "homes")
    grouped = stage(placed(queries, pivots, width).withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")).drop("near"), "queries")
    result = "query_id long, vec_id long, score long"

    def run(key: tuple, d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        d = d.sort_values(["pivot", "near", "vec_id"], kind="stable")
        *found, blocks = search_slice(d["vec_id"].to_numpy(), _matrix(d["v"], width), q["vec_id"].to_numpy(), _matrix(q["v"], width), q["floor"].to_numpy(), k)
        scored.add(int(blocks))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    def meet(q: DataFrame) -> DataFrame:
        """Queries (slice, group, vec_id, v, floor) in each slice: a slice and a group in one task, and no more than that in memory."""
        left = ranged.join(stage(q.select("slice", "group").distinct(), "meetings"), "slice")
        return left.groupBy("slice", "group").cogroup(q.groupBy("slice", "group")).applyInPandas(run, result)

    # a pivot without vectors has no home: any slice will do for a floor
    lowest = -(1 << 63)
    at_home = grouped.join(F.broadcast(home), "pivot", "left").select(F.coalesce("slice", F.lit(0)).alias("slice"), "group", "vec_id", "v", F.lit(lowest).alias("floor"))
    at_home = stage(at_home, "home-queries")
    first = stage(meet(at_home), "first")
    floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("floor")).otherwise(lowest).alias("floor"))
    asking = stage(at_home.drop("floor").withColumnRenamed("slice", "home").join(floors.dropDuplicates(["vec_id"]), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(lowest))), "floors")

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, low = {}, {}
        for g in batches:
            v = _matrix(g["v"], width)
            for s in g["slice"].unique():
                own = v[(g["slice"] == s).to_numpy()]
                high[s], low[s] = np.maximum(high.get(s, own[0]), own.max(0)), np.minimum(low.get(s, own[0]), own.min(0))
        yield pd.DataFrame({"slice": list(high), "high": [x.tolist() for x in high.values()], "low": [x.tolist() for x in low.values()]})

    def reached(key: tuple, e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(e) or not len(q):
            return pd.DataFrame({"slice": [], "vec_id": []}).astype({"slice": "int32", "vec_id": "int64"})
        e = [(s, np.stack(g["high"]).max(0), np.stack(g["low"]).min(0)) for s, g in e.groupby("slice")]
        ok = bounds(_matrix(q["v"], width), np.stack([x[1] for x in e]), np.stack([x[2] for x in e])) >= q["floor"].to_numpy().astype(float)[:, None]
        ok &= q["home"].to_numpy()[:, None] != np.array([x[0] for x in e])[None, :]
        at, s = np.nonzero(ok)
        return pd.DataFrame({"slice": np.array([x[0] for x in e], np.int32)[s], "vec_id": q["vec_id"].to_numpy()[at]})

    # SLICE slices, or fewer, and a group of queries in one task
    parts = -(-slices // SLICE)
    ends = ranged.select("slice", "v").mapInPandas(extremes, "slice int, high array<long>, low array<long>").withColumn("part", F.pmod("slice", F.lit(parts)))
    ends = stage(ends.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), "ends")
    wanted = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    open_ = stage(ends.groupBy("part", "group").cogroup(wanted.groupBy("part", "group")).applyInPandas(reached, "slice int, vec_id long").distinct(), "open")
    rest = meet(stage(open_.join(asking.drop("home"), "vec_id").select("slice", "group", "vec_id", "v", "floor"), "open-queries"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
