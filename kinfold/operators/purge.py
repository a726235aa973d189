"""Removing the closure from the source, and checks on what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.closure import Keys, numbered


def remaining(table: DataFrame, keys: Keys) -> DataFrame:
    return table.join(keys.rows, keys.column, "left_anti").select(*table.columns)


def delete_chunks(keys: DataFrame, key: str, size: int, table: str) -> DataFrame:
    """table, chunk, rows of a delete in chunks of a size. Chunks are told apart by the order of keys; needed for pacing reports only."""
    chunk = F.floor((F.col("i") - 1) / size).cast("long").alias("chunk")
    return numbered(keys.select(key), key).groupBy(chunk).agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), "chunk", "rows")


def orphans(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows with a foreign key that no parent has. Rows without one are not orphans."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(key).alias(fk)), fk, "left_anti").select(*child.columns)


def key_uniqueness(table: DataFrame, key: str) -> DataFrame:
    """rows, distinct_keys, null_keys."""
    return table.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_keys"), F.count(F.when(F.col(key).isNull(), 1)).alias("null_keys"))
