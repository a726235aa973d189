"""Difference sketches, deletes by partition overwrite, measured unique keys."""

import hashlib
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinfold.operators import partition_delete, sketch_diff, unique_keys
from kinfold.operators.closure import Keys
from kinfold.operators.verify import row_diff


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sides(spark, n, differing):
    a = spark.range(n).withColumn("v", F.col("id") * 3)
    b = a.where(f"id % {3 * n // differing + 1} <> 1").withColumn("v", F.when(F.col("id") % (3 * n // differing + 1) == 2, -1).otherwise(F.col("v")))
    return a, b.union(spark.range(n, n + differing // 3).withColumn("v", F.col("id")))


@pytest.mark.parametrize(("capacity", "differing"), [(400, 300), (100, 3000), (2000, 3)])
def test_sketch_finds_the_rows_that_differ(spark, capacity, differing):
    """Within its capacity and far beyond it."""
    a, b = sides(spark, 5000, differing)
    want = pairs(row_diff(a, b, "id"))
    assert len(want) >= differing * 0.8
    assert pairs(sketch_diff.sketch_diff(a, b, "id", capacity)) == want
    x, y = sketch_diff.sketch(a, "id", capacity).persist(), sketch_diff.sketch(b, "id", capacity).persist()
    assert x.count() <= sketch_diff.parts_for(capacity) * sketch_diff.CELLS
    assert pairs(sketch_diff.sketch_diff(a, b, "id", capacity, x, y)) == want
    assert sketch_diff.sketch_diff(a, a, "id", capacity, x, x).count() == 0


def test_parts_come_apart_within_the_capacity(spark):
    a, b = sides(spark, 20_000, 900)
    cells = sketch_diff.subtract(sketch_diff.sketch(a, "id", 1200), sketch_diff.sketch(b, "id", 1200))
    rows = sketch_diff.peeled(cells)
    assert rows.where("side = 0").count() == 0
    assert {(r.key, r.side) for r in rows.collect()} == {(r.key, s) for r in row_diff(a, b, "id").collect() for s in {"source_only": (1,), "destination_only": (-1,), "changed": (1, -1)}[r.difference]}
    beyond = sketch_diff.peeled(sketch_diff.subtract(sketch_diff.sketch(a, "id", 50), sketch_diff.sketch(b, "id", 50)))
    assert {r.side for r in beyond.collect()} == {0} and beyond.count() <= sketch_diff.parts_for(50)


def test_tables_are_read_again_only_for_parts_that_stay_closed(spark, tmp_path, monkeypatch):
    a, b = sides(spark, 3000, 90)
    x, y = sketch_diff.sketch(a, "id", 400).persist(), sketch_diff.sketch(b, "id", 400).persist()
    x.count(), y.count()
    monkeypatch.setattr(sketch_diff.digest_tree, "tree_diff", lambda *_: pytest.fail("no part is closed"))
    assert sketch_diff.sketch_diff(a, b, "id", 400, x, y).count() == row_diff(a, b, "id").count()


def test_sketch_of_odd_rows(spark):
    schema = "id int, v string"
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "n"), (None, "m"), (-7, ""), (5, "r"), (5, "r"), (8, "d"), (8, "d")], schema)
    b = spark.createDataFrame([(1, "x"), (2, ""), (None, "n"), (0, "z"), (-7, ""), (5, "r"), (5, "r")], schema).select("v", "id")
    # (8, d) occurs twice, so that its part is left to the tree
    got = {tuple(r) for r in sketch_diff.sketch_diff(a, b, "id", 16_000).collect()}
    assert got == {(2, "changed"), (None, "source_only"), (0, "destination_only"), (8, "source_only")}
    empty = a.limit(0)
    assert sketch_diff.sketch_diff(empty, empty, "id").count() == 0
    assert {r.difference for r in sketch_diff.sketch_diff(b, empty.select("id", "v"), "id", 16_000).collect()} == {"source_only"}
    with pytest.raises(TypeError, match="whole-number"):
        sketch_diff.sketch(a, "v", 10)


def prints(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def laid_out(spark, path):
    rows = spark.range(400).select("id", (F.col("id") % 40).cast("string").alias("v"), F.when(F.col("id") < 300, F.concat(F.lit("p/ "), F.floor(F.col("id") / 100).cast("string"))).alias("part"))
    partition_delete.lay_out(rows, path, "part")
    return {tuple(r) for r in spark.read.parquet(path).select("id", "v", "part").collect()}


def test_other_partitions_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows, before = laid_out(spark, path), prints(f"{tmp_path}/t")
    keys = spark.createDataFrame([(i,) for i in [*range(100, 200), 205, 350, 9999, None]], "k long")
    done = partition_delete.delete_keys(spark, path, Keys("id", keys), "part")
    assert pairs(done) == sorted([("p/ 1", 100, 100, 0), ("p/ 2", 100, 1, 99), (None, 100, 1, 99)], key=str)
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "v", "part").collect()} == {r for r in rows if not (100 <= r[0] < 200 or r[0] in (205, 350))}
    after = prints(path)
    kept = {f: h for f, h in before.items() if "%2F 0" in f}
    assert kept and all(after.get(f) == h for f, h in kept.items())
    assert not (set(before) - set(kept)) & set(after)
    assert not Path(path, partition_delete.ASIDE).exists() and not list(Path(path).glob("*1"))
    assert partition_delete.delete_keys(spark, path, Keys("id", keys), "part").count() == 0 and prints(path) == after


def test_a_whole_table_can_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    laid_out(spark, path)
    done = partition_delete.delete_keys(spark, path, Keys("id", spark.range(400)), "part")
    assert done.agg(F.sum("deleted"), F.sum("left")).first() == (400, 0) and not prints(path)


@pytest.mark.parametrize("broken", ["rows", "list", "overwrite"])
def test_a_delete_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch, broken):
    """Before the list is there the delete has not happened; after it resume() ends it, even with partitions already taken away."""
    path = f"{tmp_path}/t"
    rows = laid_out(spark, path)
    keys = Keys("id", spark.createDataFrame([(i,) for i in [*range(100, 200), 205]], "id long"))
    with monkeypatch.context() as m:
        if broken == "rows":
            m.setattr(partition_delete, "_aside", lambda *_: 1 / 0)
        else:
            m.setattr(partition_delete, "_apply", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            partition_delete.delete_keys(spark, path, keys, "part")
    if broken == "overwrite":
        for f in Path(path).glob("part=p%2F 2/*"):
            f.unlink()
    else:
        assert {tuple(r) for r in spark.read.parquet(path).select("id", "v", "part").collect()} == rows
    assert partition_delete.resume(spark, path, "part") == (broken != "rows")
    gone = set() if broken == "rows" else {*range(100, 200), 205}
    assert {tuple(r) for r in spark.read.parquet(path).select("id", "v", "part").collect()} == {r for r in rows if r[0] not in gone}
    assert not partition_delete.resume(spark, path, "part")


def test_minimal_unique_keys(spark):
    data = [(i, i // 4, i % 4, i % 2, None if i == 3 else i, f"n{i % 10}") for i in range(40)]
    t = spark.createDataFrame(data, "id int, a int, b int, `c.d` int, e int, f string")
    names = ["a", "b", "c.d", "f", "e"]
    got = {tuple(r.columns) for r in unique_keys.minimal_keys(t, names).collect()}
    at = {n: i for i, n in enumerate(["id", "a", "b", "c.d", "e", "f"])}
    every = [c for k in (1, 2, 3) for c in combinations(sorted(n for n in names if n != "e"), k) if len({tuple(r[at[n]] for n in c) for r in data}) == len(data)]
    assert got == {c for c in every if not any(set(u) < set(c) for u in every)} and ("a", "b") in got
    assert [tuple(r.columns) for r in unique_keys.minimal_keys(t, most=1).collect()] == [("id",)]
    assert unique_keys.minimal_keys(t.limit(0)).count() == 0
    assert unique_keys.minimal_keys(t.union(t)).count() == 0


def test_supersets_are_not_looked_at(spark, monkeypatch):
    t = spark.range(500).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y"))
    looked = []
    exact = unique_keys.is_unique
    monkeypatch.setattr(unique_keys, "is_unique", lambda df, c: looked.append(c) or exact(df, c))
    assert [tuple(r.columns) for r in unique_keys.minimal_keys(t).collect()] == [("id",)]
    assert looked == [("id",)]  # estimates rule out x, y and both together
