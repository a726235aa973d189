import hashlib
import random

import numpy as np
import pytest

from kinfold.llm import centroids


def brute(rows, k, rounds, dims, seed=1):
    """rows of (vec_id, integers)."""
    near = lambda v, cs: min((sum((x - y) ** 2 for x, y in zip(v, c)), i) for i, c in enumerate(cs))
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [list(v) for _, v in sorted(rows, key=rank)[:k]]
    for _ in range(rounds):
        own = [near(v, cs)[1] for _, v in rows]
        for c in range(len(cs)):
            mine = [v for (_, v), o in zip(rows, own) if o == c]
            if mine:
                cs[c] = [sum(v[d] for v in mine) // len(mine) for d in range(dims)]
    far = [near(v, cs) for _, v in rows]
    per = {c: sum(d for d, o in far if o == c) for c in range(len(cs))}
    return sorted(((i if i is not None else -1), c, d, per[c], sum(per.values()), cs[c]) for (i, _), (d, c) in zip(rows, far))


def run(spark, rows, scale=64, dims=3, **kw):
    df = spark.createDataFrame([(i, [x / scale for x in v] if v is not None else None, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int")
    found = centroids.cluster(df, dims=dims, **kw)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in found.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.randrange(-40, 40) for _ in range(3)]) for i in range(300)] + [(900 + i, [7, 7, 7]) for i in range(200)]
    assert run(spark, rows, k=9, rounds=3) == brute(rows, 9, 3, 3)


def test_edges(spark):
    rows = [(1, [1, 2, 3]), (1, [1, 2, 3]), (None, [5, 5, 5]), (2, [1, 2, 3])]
    assert run(spark, rows, k=3, rounds=2) == brute(rows, 3, 2, 3)  # equal starts: the larger numbers stay empty
    assert run(spark, rows, k=16, rounds=1) == brute(rows, 16, 1, 3)
    assert run(spark, [], k=3) == run(spark, [(1, None)], k=3) == run(spark, [(1, [1, 2])], k=3) == []


def test_odd_components(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.1]), (2, [nan, 0.0]), (3, [inf, 0.0]), (4, [None, 0.0]), (5, None), (6, [1.0]), (7, [1e300, -1e300]), (8, [])]
    got = centroids.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), dims=2)
    assert {r.vec_id: r.v for r in got.collect()} == {1: [6, -7], 7: [centroids.LIMIT, -centroids.LIMIT]}
    df = spark.createDataFrame([(i, [1e300 * (-1) ** i] * 64) for i in range(40)], "vec_id long, embedding array<double>")
    found = centroids.cluster(df, k=1, rounds=0).collect()
    assert len(found) == 40 and max(r.inertia for r in found) == (1 << 63) - 1 and max(r.distance for r in found) == 64 * (2 * centroids.LIMIT) ** 2


def test_distances_by_table():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (5, 6))
    assert (centroids.distances(v, c) == ((v[:, None] - c[None]) ** 2).sum(2)).all()
