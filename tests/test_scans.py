"""File skipping, closures of many batches, digest trees and measured foreign keys."""

import pytest
from pyspark.sql import functions as F

from kinfold import catalogue
from kinfold.graph import Graph
from kinfold.operators import digest_tree, many, measured
from kinfold.operators.closure import closure, root_batch
from kinfold.operators.verify import row_diff
from kinfold.operators.zones import Zoned

SF = "/root/testdata/sf0.01"


def test_batches_open_only_the_files_they_need(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).withColumn("odd", F.col("id") % 2).repartitionByRange(10, "id").write.parquet(path)
    zoned = Zoned.of(spark, path, "id")
    assert zoned.zones.count() == 10
    got = [([r.id for r in keys.collect()], last, files) for keys, last, files in zoned.batches(None, 60)]
    assert [k for keys, _, _ in got for k in keys] == list(range(1000)) and all(keys == sorted(keys) and last == keys[-1] for keys, last, _ in got)
    assert all(len(keys) == 60 for keys, _, _ in got[:-1]) and max(files for _, _, files in got) <= 4
    batch, files = zoned.next_batch("odd = 1", 499, 10)
    assert [r.id for r in batch.collect()] == list(range(501, 521, 2)) and files == 2
    assert len(batch.inputFiles()) == 2
    rows, files = zoned.holding(spark.createDataFrame([(320,), (355,), (None,)], "k long"))
    assert sorted(r.id for r in rows.collect()) == [320, 355] and files <= 2
    assert zoned.holding(spark.createDataFrame([(5000,)], "k long"))[1] == 0


def test_overlapping_files_and_nulls(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(300).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("k")).repartition(6).write.parquet(path)
    zoned = Zoned.of(spark, path, "k")
    got = [r.k for keys, _, _ in zoned.batches("k > 50", 40) for r in keys.collect()]
    assert got == [i for i in range(51, 300) if i % 7]
    empty = f"{tmp_path}/e"
    spark.range(0).write.parquet(empty)
    assert list(Zoned.of(spark, empty, "id").batches(None, 5)) == []


def test_many_batches_equal_single_closures(spark):
    """Batches run one after another, each taking what no earlier one has."""
    g, tables = catalogue.diamond(), catalogue.diamond_tables(spark, SF)
    roots = many.labelled_roots(tables["nation"], "n_nationkey", 9)
    found = many.labelled_closure(g, tables, roots)
    taken = set()
    for b in range(3):
        keys = roots.where(F.col("batch") == b).select("n_nationkey")
        single = closure(g, tables, keys)["links"].rows
        own = {r[0] for r in single.collect()} - taken
        taken |= own
        assert {r[0] for r in found["links"].where(F.col("batch") == b).collect()} == own
    whole = many.labelled_rows(g, tables, found)["links"]
    assert whole.columns == ["link", "custkey", "suppkey", "batch"] and whole.count() == len(taken)


def test_tables_are_scanned_once_however_many_batches(spark):
    tables = catalogue.job_tables(spark, SF)
    found = many.labelled_closure(catalogue.job_graph(), tables, many.labelled_roots(tables["customer"], "c_custkey", 10))
    plan = found["lineitem"]._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_linenumber" in x and "Relation" in x for x in plan.splitlines()) == 1
    assert found["lineitem"].agg(F.countDistinct("batch")).first()[0] > 100


def test_leaf_without_key_and_null_foreign_keys(spark):
    g = Graph("a")
    g.add_table("a", "id")
    g.add_table("b", None)
    g.add_edge("a", "b", "a_id")
    tables = {"a": spark.createDataFrame([(1,), (2,)], "id long"), "b": spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (2, "z")], "a_id long, v string")}
    found = many.labelled_closure(g, tables, many.labelled_roots(tables["a"], "id", 1))
    assert sorted(map(tuple, found["b"].collect())) == [(1, 0), (2, 1)]
    assert sorted(tuple(r)[:2] for r in many.labelled_rows(g, tables, found)["b"].collect()) == [(1, "x"), (1, "x"), (2, "z")]
    assert sorted((r.batch, r.table, r.rows) for r in many.batch_counts(g, tables, found).collect()) == [(0, "a", 1), (0, "b", 2), (1, "a", 1), (1, "b", 1)]


@pytest.mark.parametrize("ranges", [64, 0])
def test_tree_finds_the_rows_that_differ(spark, monkeypatch, ranges):
    monkeypatch.setattr(digest_tree, "RANGES", ranges)
    a = spark.range(4000).withColumn("v", F.col("id") * 3)
    b = a.where("id not in (7, 3999)").withColumn("v", F.when(F.col("id") == 1234, -1).otherwise(F.col("v"))).union(spark.createDataFrame([(9000, 1), (-5, 1)], "id long, v long"))
    shape = digest_tree.Shape.over(a, "id", 20, 4)
    assert shape.fanout**shape.depth >= 200
    x, y = digest_tree.digest_tree(a, "id", shape).persist(), digest_tree.digest_tree(b, "id", shape).persist()
    got = digest_tree.tree_diff(a, b, "id", shape, x, y)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, row_diff(a, b, "id").collect())) and got.count() == 5
    leaves = digest_tree.differing_leaves(x, y, shape)
    assert leaves.count() == 4  # 7 and -5, 1234, 3999, and the last for 9000
    assert digest_tree.rows_of(a, "id", shape, leaves).count() < 200
    assert digest_tree.tree_diff(a, a, "id", shape, x, x).count() == 0
    whole = {r.level: r.rows for r in x.groupBy("level").agg(F.sum("rows").alias("rows")).collect()}
    assert set(whole.values()) == {4000} and max(whole) == shape.depth
    assert digest_tree.Shape.over(a.limit(0), "id").depth == 1


def test_comparing_trees_grows_with_their_depth(spark):
    """The plan was doubled by each level, and a tree read its table once for each level."""
    a = spark.range(3000).withColumn("v", F.col("id") * 3)
    b = a.withColumn("v", F.when(F.col("id") % 1000 == 7, -1).otherwise(F.col("v")))
    shape = digest_tree.Shape.over(a, "id", 5, 4)
    assert shape.depth == 5
    ranges = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    x, y = digest_tree.digest_tree(a, "id", shape), digest_tree.digest_tree(b, "id", shape)
    assert ranges(x) == 1
    leaves = digest_tree.differing_leaves(x, y, shape)
    assert ranges(leaves) == 2 * (shape.depth + 1)  # each level is taken from both trees
    assert sorted(r.leaf for r in leaves.collect()) == sorted({i // shape.width for i in (7, 1007, 2007)})


@pytest.mark.parametrize("n", [300, 5200, 10_000])
def test_a_tree_is_a_fixed_share_of_its_table(spark, n):
    """Leaves were up to fanout times smaller than asked for, so that a tree grew in steps of 16."""
    a = spark.range(n)
    shape = digest_tree.Shape.over(a, "id", 20)
    leaves = digest_tree.digest_tree(a, "id", shape).where(F.col("level") == shape.depth)
    got = [r.rows for r in leaves.collect()]
    assert sum(got) == n and max(got) <= 20 and len(got) <= n // 20 + 1


def test_ranges_reach_the_reader(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    rows = digest_tree.rows_of(t, "id", digest_tree.Shape(0, 100, 10, 1), spark.createDataFrame([(3,)], "leaf long"))
    assert "GreaterThanOrEqual(id,300)" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 100


def test_measured_foreign_keys(spark):
    tables = {"p": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, code string"), "c": spark.createDataFrame([(2, 1, "a", 9), (5, None, "b", 1), (6, 3, None, 2)], "id long, p long, code string, far long"), "e": spark.createDataFrame([], "id long")}
    columns = {"p": ["id", "code"], "c": ["id", "p", "code", "far"], "e": ["id"]}
    found = measured.foreign_keys(tables, columns)
    assert [tuple(r) for r in found.collect()] == [("c", "p", "p", "id")]  # codes have a null, so they are no key; no rows prove nothing
    declared = spark.createDataFrame([("c", "p", "p", "id")], found.schema)
    assert measured.undeclared(found, declared).count() == 0
    assert {(r.column, r.other) for r in measured.inclusions(tables, columns).collect()} == {("c.p", "p.id"), ("c.code", "p.code"), ("p.code", "c.code")}


def test_root_batch_and_zones_agree(spark):
    zoned = catalogue.orders_by_key(spark, SF)
    want = root_batch(catalogue.table(spark, SF, "orders"), "o_orderkey", "o_custkey < 700", 5000, 500)
    got, files = zoned.next_batch("o_custkey < 700", 5000, 500)
    assert [r[0] for r in got.collect()] == [r[0] for r in want.collect()] and files < 16
