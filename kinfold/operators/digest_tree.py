"""Comparing two tables through trees of digests over ranges of their key.

A leaf is a range of the key; its digest is the sum of the digests of its rows, so that a node's is the sum of its
children's and a tree is one grouping of the table and one small grouping for each level. Trees are kept: when
one side is compared again only its own has to be made again. A comparison starts at the root and goes down only where
two nodes differ. Rows are read for the leaves that are left, by ranges of the key, which Parquet files in the
order of the key answer with a few row groups.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.digest import digest_sums, row_digest, sums_text
from kinfold.operators.verify import row_diff

#: Ranges that are given to the reader as conditions; for more of them the leaf of each row is computed and joined.
RANGES = 64


@dataclass(frozen=True)
class Shape:
    """Leaves are ranges of width keys from start on; a node has fanout children; there are fanout ** depth leaves. Keys outside belong to the first or last leaf, null keys to the first."""

    start: int
    width: int
    fanout: int = 16
    depth: int = 3

    @classmethod
    def over(cls, table: DataFrame, key: str, rows_per_leaf: int = 10_000, fanout: int = 16) -> Shape:
        """A shape for the keys of a table, whose leaves have about so many rows if keys are spread evenly."""
        r = table.agg(F.min(key).alias("a"), F.max(key).alias("b"), F.count(key).alias("n")).first()
        a, b = (int(r.a), int(r.b)) if r.n else (0, 0)
        depth = 1
        while fanout**depth * rows_per_leaf < r.n:
            depth += 1
        # not all of fanout ** depth: leaves would be up to fanout times smaller, and a tree as much larger
        return cls(a, (b - a) * rows_per_leaf // max(1, r.n) + 1, fanout, depth)

    def leaf(self, key: str) -> Column:
        at = F.floor((F.col(key) - F.lit(self.start)) / F.lit(self.width)).cast("long")
        return F.coalesce(F.greatest(F.lit(0), F.least(at, F.lit(self.fanout**self.depth - 1))), F.lit(0)).cast("long")

    def within(self, key: str, leaf: int) -> Column:
        """Whether a row is in this leaf, as a condition that a Parquet reader understands."""
        low, high, last = self.start + leaf * self.width, self.start + (leaf + 1) * self.width, self.fanout**self.depth - 1
        c = F.col(key)
        cond = (c >= low if leaf else F.lit(True)) & (c < high if leaf < last else F.lit(True))
        return cond if leaf else cond | c.isNull()


def digest_tree(table: DataFrame, key: str, shape: Shape) -> DataFrame:
    """level, node, rows, digest of all nodes that have rows. Level 0 is the root, level depth the leaves. The table is read once, whatever the depth: each leaf's sums go to all nodes above it."""
    sums = ["rows", "s0", "s1", "s2", "s3"]
    rows = table.select(shape.leaf(key).alias("leaf"), row_digest(table.schema).alias("d"))
    leaves = rows.groupBy("leaf").agg(F.count("*").alias("rows"), *digest_sums())
    above = [F.struct(F.lit(k).alias("level"), F.floor(F.col("leaf") / shape.fanout ** (shape.depth - k)).cast("long").alias("node")) for k in range(shape.depth + 1)]
    each = leaves.select(F.explode(F.array(*above)).alias("at"), *sums).select("at.level", "at.node", *sums)
    nodes = each.groupBy("level", "node").agg(*[F.sum(c).cast("long" if c == "rows" else "decimal(38,0)").alias(c) for c in sums])
    return nodes.select("level", "node", "rows", sums_text().alias("digest"))


def differing_leaves(a: DataFrame, b: DataFrame, shape: Shape) -> DataFrame:
    """leaf: the leaves whose digests differ in the trees a and b. Below a node that is the same on both sides nothing is looked at. A level names the one above it once, so that the plan grows with the depth and not with its power of two."""
    both, open_ = a.select("level", "node", "digest").unionByName(b.select("level", "node", "digest")), None
    for k in range(shape.depth + 1):
        level = both.where(F.col("level") == k).select("node", "digest")
        if open_ is not None:
            up = F.floor(F.col("node") / shape.fanout).cast("long")
            # nodes are distinct; a semi-join would be pushed into both sides of the union, and double the levels above
            level = level.withColumn("_up", up).join(open_.withColumnRenamed("node", "_up"), "_up")
        # a tree has a node once: a digest that is there once is of one side
        open_ = level.groupBy("node", "digest").agg(F.count("*").alias("n")).where("n = 1").select("node").distinct()
    return open_.withColumnRenamed("node", "leaf")


def rows_of(table: DataFrame, key: str, shape: Shape, leaves: DataFrame) -> DataFrame:
    """Rows of the given leaves (leaf)."""
    few = [r.leaf for r in leaves.limit(RANGES + 1).collect()]
    if not few:
        return table.limit(0)
    if len(few) <= RANGES:
        return table.where(reduce(Column.__or__, [shape.within(key, i) for i in few]))
    return table.withColumn("_leaf", shape.leaf(key)).join(leaves.withColumnRenamed("leaf", "_leaf"), "_leaf", "left_semi").select(*table.columns)


def tree_diff(source: DataFrame, destination: DataFrame, key: str, shape: Shape, source_tree: DataFrame | None = None, destination_tree: DataFrame | None = None) -> DataFrame:
    """As row_diff(): key and difference of every row that is not the same on both sides. Rows are compared in differing leaves only; trees that were kept are not made again."""
    d = destination.select(*source.columns)
    # every level reads the trees: those that are made here are kept until the leaves are known
    made = lambda t: digest_tree(t, key, shape).coalesce(t.sparkSession.sparkContext.defaultParallelism).persist()
    a = source_tree if source_tree is not None else made(source)
    b = destination_tree if destination_tree is not None else made(d)
    leaves = differing_leaves(a, b, shape).persist()
    leaves.count()
    for kept, tree in ((source_tree, a), (destination_tree, b)):
        if kept is None:
            tree.unpersist()
    return row_diff(rows_of(source, key, shape, leaves), rows_of(d, key, shape, leaves), key)
