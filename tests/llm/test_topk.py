import duckdb
import numpy as np

from kinfold.llm import queries as Q
from kinfold.llm import topk


def brute(rows, k, every):
    out = []
    for i, v in rows:
        if i % every == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def test_query_equals_sql(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(con.sql(Q.ORACLE["op3_block_pruned_top_k"]).fetchall())
    assert sorted(map(tuple, Q.op3_block_pruned_top_k(spark, d).collect())) == want
    monkeypatch.setattr(topk, "SLICE", 100)
    monkeypatch.setattr(topk, "PIVOTS", 8)
    monkeypatch.setattr(topk, "GROUP", 7)
    monkeypatch.setattr(topk, "BLOCK", 16)
    assert sorted(map(tuple, Q.op3_block_pruned_top_k(spark, d).collect())) == want


def test_ties_repeats_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 50)
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(i, [1, 1, 0]) for i in range(120)] + [(200 + i, rng.integers(-3, 4, 3).tolist()) for i in range(60)] + [(300, []), (301, [5]), (320, [1 << 40, -(1 << 40), 3])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, v array<long>, slice int")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 7).collect()
    limit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(a, b, c, limit(s)) for a, b, c, s in brute(rows, 7, 20)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 320"), df.where("vec_id = 320")).count() == 0


def test_vectors_left_out(spark):
    rows = [(1, [0.5, None]), (2, None), (None, [1.0]), (3, [float("nan")]), (4, [float("inf")]), (5, [-0.01, 0.99]), (6, []), (7, [1e30, -1e30])]
    got = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id: r.v for r in got} == {5: [-1, 63], 6: [], 7: [1 << 62, -(1 << 62)]}


def test_blocks_are_pruned():
    d = np.zeros((8 * topk.BLOCK, 8), np.int64)
    for c in range(8):
        d[c * topk.BLOCK : (c + 1) * topk.BLOCK, c] = 50
    ids, q = np.arange(len(d)), np.eye(8, dtype=np.int64)
    *_, scored = topk.search_slice(ids, d, np.arange(10_000, 10_008), q, np.full(8, -(1 << 63)), 20)
    assert scored == 8


def test_clusters_are_pruned(spark, monkeypatch):
    """Vectors around 40 centres in no order: few blocks are scored, few slices are asked, and the result is that of all scores."""
    monkeypatch.setattr(topk, "SLICE", 256)
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 60
    v = (centres[rng.integers(0, 40, 1600)] + rng.standard_normal((1600, 16)) * 3).astype(int)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    report = {}
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), 10, report).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, 10, 20)
    assert report["pairs"] == 80 * 100 and report["scored"].value < 0.2 * report["pairs"]
