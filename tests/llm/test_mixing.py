import re

import duckdb
import pytest

from kinfold.llm import mixing
from kinfold.llm import queries as Q

D = "/root/testdata/sf0.01"


def fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Share by weight again and again until nothing is above its limit."""
    w = {s: weights[i % 3] for i, s in enumerate(sizes)}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, got):
    assert len(got) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source = {i: s for i, _, s in rows}
    sizes = {}
    for s in sorted({s for _, _, s in rows if s is not None}) + [None]:
        mine = [count(t) for _, t, x in rows if x == s]
        if mine:
            sizes[s] = sum(mine)
    want, taken = fill(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    largest = {s: max(count(t) for _, t, x in rows if x == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_query_equals_sql_and_meets_targets(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{D}/documents.parquet'")
    want = sorted(con.sql(Q.ORACLE["op5_systematic_mix"]).fetchall())
    rows = Q.op5_systematic_mix(spark, D).collect()
    assert sorted(tuple(r) for r in rows) == want
    assert rows and sorted(tuple(r) for r in Q.op5_systematic_mix(spark, D).collect()) == want
    check([tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "source").collect()], rows)


def test_odd_rows(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "x y z", None), (4, "w " * 9000, "a"), (5, "p q", "B"), (6, "p q", "B"), (7, "é é z", "ab")] + [(i, "some words here", "hot") for i in range(10, 200)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.copies(df)
    check(rows, got.withColumn("taken", got["copies"] * got["size"]).collect())
    mix = mixing.mixed(df)
    assert mix.columns == df.columns
    want = {r.doc_id: r.copies for r in got.collect() if r.copies}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == want
    twice = df.union(df)
    assert mixing.mixed(twice).count() == mixing.copies(twice).agg({"copies": "sum"}).first()[0]
    assert mixing.copies(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0


def test_each_row_takes_its_own_copies(spark):
    from collections import Counter

    text = lambda k, n: " ".join([f"t{k}"] * n)
    rows = [(i, text(k, 1 + 37 * k % 50), "abc"[k % 3]) for k, i in enumerate([None, 1] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.copies(docs).collect():
        want[r.doc_id, r.size, round(r.target, 6)] += r.copies
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    target = fill(dict(sorted(sizes.items())))
    for r in mixing.mixed(docs).collect():
        got[r.doc_id, len(r.text.split()), round(target[r.source], 6)] += 1
    assert got == +want
