"""The referential closure of selected root rows, as key tables that are never collected."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.predicates import where as predicate
from kinfold.graph import Graph


def root_batch(root: DataFrame, key: str, where: str | None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Keys of the next batch: those that satisfy the predicate and lie above the checkpoint, ascending."""
    cond = predicate(where)
    rows = root if cond is None else root.filter(cond)
    if after is not None:
        rows = rows.filter(F.col(key) > F.lit(after).cast(root.schema[key].dataType))
    rows = rows.select(key)
    return rows.orderBy(key).limit(limit) if limit is not None else rows


@dataclass
class Keys:
    """Rows of a table: those whose column is among rows."""

    column: str
    rows: DataFrame

    def of(self, table: DataFrame) -> DataFrame:
        return table.join(self.rows, self.column, "left_semi").select(*table.columns)


def expand(child: DataFrame, fk: str, parents: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the child's rows that refer to one of the parents. A null foreign key never matches."""
    p = parents.select(F.col(parents.columns[0]).alias(fk))
    return child.join(p, fk, "left_semi").select(*columns)


def closure(graph: Graph, tables: dict[str, DataFrame], root_keys: DataFrame) -> dict[str, Keys]:
    """Keys of every table that the root keys lead to, parents first.

    A table with several parents gets the union of what each leads to, without repeats. A leaf without a
    key of its own is selected by its foreign key.
    """
    found = {graph.root: Keys(graph.keys[graph.root], root_keys)}
    for t in graph.copy_order()[1:]:
        key, edges = graph.keys[t], graph.edges_to(t)
        if key is None:
            (e,) = edges
            found[t] = Keys(e.foreign_key, expand(tables[t], e.foreign_key, found[e.parent].rows, [e.foreign_key]).distinct())
            continue
        each = [expand(tables[t], e.foreign_key, found[e.parent].rows, [key]) for e in edges]
        found[t] = Keys(key, each[0] if len(each) == 1 else reduce(DataFrame.union, each).distinct())
    return found


def discovery_stats(graph: Graph, tables: dict[str, DataFrame], found: dict[str, Keys]) -> DataFrame:
    """tables_scanned (with at least one row), records_found, levels."""
    counts = table_counts(graph, tables, found)
    return counts.agg(F.count(F.when(F.col("rows") > 0, 1)).alias("tables_scanned"), F.sum("rows").alias("records_found"), (F.max(F.when(F.col("rows") > 0, F.col("level"))) + 1).cast("int").alias("levels"))


def table_counts(graph: Graph, tables: dict[str, DataFrame], found: dict[str, Keys]) -> DataFrame:
    """position, table, level, rows, in the copy order."""
    levels = graph.levels()
    each = []
    for i, t in enumerate(graph.copy_order()):
        rows = found[t].of(tables[t]) if graph.keys[t] is None else found[t].rows
        each.append(rows.agg(F.count("*").alias("rows")).select(F.lit(i).alias("position"), F.lit(t).alias("table"), F.lit(levels[t]).alias("level"), "rows"))
    return reduce(DataFrame.union, each)


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with i, their place in the order of key from 1.

    Rows are dealt into ranges, numbered within each and shifted by the rows of the ranges before, so that
    no task sorts them all.
    """
    from pyspark.sql import Window

    ranged = rows.repartitionByRange(key).withColumn("_r", F.spark_partition_id()).persist()
    per = ranged.groupBy("_r").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = ranged.withColumn("i", F.row_number().over(Window.partitionBy("_r").orderBy(key)))
    return within.join(F.broadcast(per), "_r").select(*rows.columns, (F.col("_before") + F.col("i")).cast("long").alias("i"))


def batches(keys: DataFrame, key: str, size: int) -> DataFrame:
    """batch, rows, first_key, checkpoint: how ascending keys fall into batches of a size."""
    rows = numbered(keys.select(F.col(key).alias("k")), "k")
    batch = F.floor((F.col("i") - 1) / size).cast("long")
    return rows.groupBy(batch.alias("batch")).agg(F.count("*").alias("rows"), F.min("k").alias("first_key"), F.max("k").alias("checkpoint"))
