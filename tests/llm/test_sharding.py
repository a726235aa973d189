import random
import zlib
from itertools import product

from kinfold.llm import queries as Q
from kinfold.llm import sharding


def check(rows, got, shards):
    assert len(got) == len(rows)
    by, total, slots = {}, [0] * shards, {}
    for r in got:
        total[r.shard] += r.size
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    for i, t in rows:
        by.setdefault(t or "", set()).add(i)
    where = {}
    for r in got:
        where.setdefault(r.doc_id, set()).add(r.shard)
    for ids in by.values():
        assert len(set().union(*(where[i] for i in ids))) == 1
    for s in slots.values():
        assert sorted(k for k, _ in s) == list(range(len(s)))
    return total


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = Q.op10_differencing_shards(spark, d).collect()
    total = check(rows, got, 16)
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in got)
    assert max(total) - min(total) < 0.001 * sum(total)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, Q.op10_differencing_shards(spark, d).collect()), key=str)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "x"), (4, "x"), (None, "y"), (5, "long " * 40000)] + [(i, "hot text") for i in range(10, 500)]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], "doc_id long, text string, shard int, digest string")
    check(rows, sharding.balanced_shards(df, 4).collect(), 4)
    assert sharding.balanced_shards(df.limit(0), 4).count() == 0


def test_differencing_is_tight():
    rng = random.Random(1)
    for ways in (2, 3):
        sizes = [rng.randrange(1, 60) for _ in range(9)]
        got = sharding.karmarkar_karp(sizes, ways)
        spread = lambda p: max(s := [sum(x for x, w in zip(sizes, p) if w == k) for k in range(ways)]) - min(s)
        best = min(spread(p) for p in product(range(ways), repeat=9))
        assert best <= spread(got) <= best + 12
    sizes = [int(rng.paretovariate(1.2) * 1000) for _ in range(4000)]
    got = sharding.karmarkar_karp(sizes, 16)
    total = [sum(x for x, w in zip(sizes, got) if w == k) for k in range(16)]
    assert max(total) - min(total) <= max(1, 1e-5 * sum(sizes)) or max(total) == max(sizes)
    assert sharding.karmarkar_karp([], 4) == [] and sharding.karmarkar_karp([5], 3) == [0]
