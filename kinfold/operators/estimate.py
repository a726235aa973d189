"""What a job would do: row counts by nested semi-joins, batches, and the size of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.digest import byte_size
from kinfold.graph import Graph, GraphError
from kinfold.operators.closure import closure, root_batch, table_counts

PLACEHOLDERS = 65_535


def estimate(graph: Graph, tables: dict[str, DataFrame], where: str) -> DataFrame:
    """position, table, rows of the whole closure, in the copy order."""
    for t in graph.keys:
        if t != graph.root and len(graph.edges_to(t)) != 1:
            raise GraphError(f"table {t!r} has {len(graph.edges_to(t))} parents; an estimate needs one")
    keys = root_batch(tables[graph.root], graph.keys[graph.root], where)
    return table_counts(graph, tables, closure(graph, tables, keys)).select("position", "table", "rows")


def batch_count(rows: int, size: int) -> int:
    return -(-rows // size)


def payload(table: DataFrame, name: str, batch_size: int, key: str | None, where: str | None = None) -> DataFrame:
    """table, sample_rows, bytes of the sample, projected_bytes of a full batch: the first batch_size rows by key."""
    from kinfold.functions.predicates import where as predicate

    cond = predicate(where)
    rows = table if cond is None else table.filter(cond)
    sample = rows.orderBy(*([key] if key else table.columns)).limit(batch_size)
    sums = sample.select(byte_size(table.schema).alias("b")).agg(F.count("*").alias("sample_rows"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"))
    projected = F.when(F.col("sample_rows") > 0, F.expr(f"bytes * {batch_size} div sample_rows")).otherwise(0).cast("long")
    return sums.select(F.lit(name).alias("table"), "sample_rows", "bytes", projected.alias("projected_bytes"))


def placeholders(columns: int, batch_size: int) -> dict:
    """Whether one statement could carry a batch, and how many rows a statement takes."""
    return {"columns": columns, "placeholders": columns * batch_size, "too_many": columns * batch_size >= PLACEHOLDERS, "rows_per_statement": max(1, PLACEHOLDERS // columns)}
