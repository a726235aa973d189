"""Batches by a byte budget against a sequential cut."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import cuts


def sequential(rows, budget):
    out, batch, used = {}, -1, None
    for k, s in sorted(rows):
        if used is None or used + s > budget:
            batch, used = batch + 1, 0
        out[k] = batch
        used += s
    return out


def sizes(kind, n):
    rng = random.Random(kind)
    return {
        "uniform": lambda i: 7, "mixed": lambda i: rng.randint(1, 60), "large": lambda i: 1000 if rng.random() < 0.1 else rng.randint(0, 30),
        "all large": lambda i: 5000 + i, "none": lambda i: 0, "first": lambda i: 3000 if i == 0 else 1,
    }[kind], n


@pytest.mark.parametrize(("kind", "budget"), [("uniform", 100), ("mixed", 100), ("large", 100), ("all large", 64), ("none", 10), ("first", 40), ("mixed", 10**9), ("uniform", 1)])
def test_batches_equal_a_sequential_cut(spark, kind, budget):
    f, n = sizes(kind, 700)
    rows = [(i * 3 - 500, f(i)) for i in range(n)]
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "id int, bytes int").repartition(3)
    got = {r.id: r.batch for r in cuts.labelled(table, "id", F.col("bytes"), budget).collect()}
    assert got == sequential(rows, budget)


def test_cuts_of_text_keys_and_odd_rows(spark):
    rows = [("b", 6), ("a", None), ("", 4), (None, 9), ("c", -3), ("ä", 11), ("d", 1)]
    found = cuts.cuts(spark.createDataFrame(rows, "k string, n long"), "k", F.col("n"), 10).orderBy("batch").collect()
    assert [tuple(r) for r in found] == [(0, 4, 10, "", "c"), (1, 1, 1, "d", "d"), (2, 1, 11, "ä", "ä")]
    assert cuts.cuts(spark.createDataFrame([], "k string, n long"), "k", F.col("n"), 10).count() == 0
    with pytest.raises(ValueError, match="at least one byte"):
        cuts.cuts(spark.createDataFrame(rows, "k string, n long"), "k", F.col("n"), 0)


def test_pointers_get_fewer_with_each_doubling(spark, monkeypatch):
    """Only rows where a group of buckets can be entered keep a pointer, also where no two chains meet."""
    kept, through = [], cuts._through
    monkeypatch.setattr(cuts, "_through", lambda p, onto, k: kept.append(p.count()) or through(p, onto, k))
    rows = spark.range(4000).select(F.col("id").alias("i"), F.lit(10).cast("long").alias("size"), (F.col("id") * 10).alias("before"))
    assert {r.i for r in cuts.starts(rows, 100).collect()} == set(range(0, 4000, 10))
    assert len(kept) == 9 and all(later <= 0.6 * now + 20 for now, later in zip(kept[1:], kept[2:]))
