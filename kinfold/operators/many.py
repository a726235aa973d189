"""The closures of many batches in one pass over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.graph import Graph


def labelled_roots(root: DataFrame, key: str, size: int) -> DataFrame:
    """key, batch: root keys in batches of a size, in ascending order, from 0. Places are counted in ranges."""
    from kinfold.operators.closure import numbered

    return numbered(root.select(key), key).select(key, F.floor((F.col("i") - 1) / size).cast("long").alias("batch"))


def labelled_closure(graph: Graph, tables: dict[str, DataFrame], roots: DataFrame) -> dict[str, DataFrame]:
    """For every table its key and batch: the first batch whose closure has the row. roots: root key and batch, each key once.

    Labels go down the tree with the keys. A row that several parents lead to gets the smallest of their labels, as it
    would if the batches were run one after another and each took away what it found. Every table is joined once for
    each of its edges, however many batches there are. A leaf without a key gives its foreign key and batch: all rows
    of one parent have its label. A null foreign key leads nowhere.
    """
    first = roots.columns[0]
    found = {graph.root: roots.select(F.col(first).alias(graph.keys[graph.root]), "batch")}
    for t in graph.copy_order()[1:]:
        key, edges = graph.keys[t], graph.edges_to(t)
        each = []
        for e in edges:
            parents = found[e.parent]
            labels = parents.select(F.col(parents.columns[0]).alias(e.foreign_key), "batch")
            # parents have each key once, so a child's rows keep their number
            each.append(tables[t].select(*dict.fromkeys([key or e.foreign_key, e.foreign_key])).join(labels, e.foreign_key).select(F.col(key or e.foreign_key), "batch"))
        rows = reduce(DataFrame.unionByName, each)
        found[t] = rows if key is not None and len(edges) == 1 else rows.groupBy(key or edges[0].foreign_key).agg(F.min("batch").alias("batch"))
    return found


def labelled_rows(graph: Graph, tables: dict[str, DataFrame], found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Whole rows of every table with the batch that takes them."""
    return {t: tables[t].join(labels, labels.columns[0]) for t, labels in found.items()}


def batch_counts(graph: Graph, tables: dict[str, DataFrame], found: dict[str, DataFrame]) -> DataFrame:
    """batch, position, table, rows of every batch and table that it has rows of."""
    each = []
    for i, t in enumerate(graph.copy_order()):
        labels = found[t]
        rows = labels if graph.keys[t] is not None else tables[t].select(labels.columns[0]).join(labels, labels.columns[0])
        each.append(rows.groupBy("batch").agg(F.count("*").alias("rows")).select("batch", F.lit(i).alias("position"), F.lit(t).alias("table"), "rows"))
    return reduce(DataFrame.unionByName, each)
