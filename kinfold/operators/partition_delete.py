"""Deletes from partitioned Parquet that rewrite only the partitions that have deleted keys.

The rows that stay in those partitions are first written aside, below the table in a folder that readers pass over; then they
replace their partitions by a dynamic partition overwrite, and partitions of which nothing stays are removed. Files
of all other partitions are not touched. Spark takes an old partition away before it moves the new one in, so a
run that is lost in between has its rows in the folder aside: resume() ends it, or drops what was not complete. One
writer at a time.
"""

from __future__ import annotations

import json
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.operators.closure import Keys

ASIDE = "_deleting"


def lay_out(table: DataFrame, path: str, partition: str) -> None:
    """Write a table in partitions of one of its columns, in few files each; a large partition is split among tasks."""
    table.hint("rebalance", partition).write.partitionBy(partition).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _among(partition: str, values: list) -> F.Column:
    known = F.col(partition).isin([v for v in values if v is not None])
    return known | F.col(partition).isNull() if None in values else known


def delete_keys(spark: SparkSession, path: str, keys: Keys, partition: str, where: str | None = None) -> DataFrame:
    """Remove rows whose column is among the keys. Returns partition, before, deleted, left of each partition that had such rows.

    where, a condition on the partition column, spares the look at partitions that cannot have any. Null keys delete
    nothing. Repeating a delete changes nothing.
    """
    resume(spark, path, partition)
    table = spark.read.parquet(path)
    seen = table.where(where) if where else table
    doomed = keys.rows.select(F.col(keys.rows.columns[0]).alias(keys.column)).where(F.col(keys.column).isNotNull())
    # one row a partition: no more than the file listing that every read of the table makes
    hit = [r[0] for r in seen.select(partition, keys.column).join(doomed, keys.column, "left_semi").select(partition).distinct().collect()]
    schema = T.StructType([T.StructField(partition, table.schema[partition].dataType), *[T.StructField(c, T.LongType()) for c in ("before", "deleted", "left")]])
    if not hit:
        return spark.createDataFrame([], schema)
    rows = table.where(_among(partition, hit))
    before = {r[0]: r[1] for r in rows.groupBy(partition).count().collect()}
    staying = rows.join(doomed, keys.column, "left_anti").select(*table.columns)
    staying.hint("rebalance", partition).write.partitionBy(partition).parquet(f"{path}/{ASIDE}/rows")
    left = {r[0]: r[1] for r in _aside(spark, path, table.schema).groupBy(partition).count().collect()}
    counts = spark.createDataFrame([(v, before[v], before[v] - left.get(v, 0), left.get(v, 0)) for v in hit], schema)
    # the list is written last: once it is there the delete is decided
    counts.withColumn("schema", F.lit(table.schema.json())).coalesce(1).write.parquet(f"{path}/{ASIDE}/list")
    _apply(spark, path, partition)
    return counts


def _aside(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/{ASIDE}/rows").select(*schema.names)


def _apply(spark: SparkSession, path: str, partition: str) -> None:
    marks = spark.read.parquet(f"{path}/{ASIDE}/list").collect()  # one row a partition
    schema = T.StructType.fromJson(json.loads(marks[0]["schema"]))
    _aside(spark, path, schema).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    # an overwrite leaves alone the partitions that it has no row for
    if gone := [r[partition] for r in marks if not r.left]:
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
        for r in spark.read.schema(schema).parquet(path).where(_among(partition, gone)).select(folder).distinct().collect():
            _remove(spark, unquote(r.folder))
    _remove(spark, f"{path}/{ASIDE}")


def resume(spark: SparkSession, path: str, partition: str) -> bool:
    """End a delete that was broken off: carry it out if it was decided, else drop what it had written. Tells whether it was carried out."""
    if not _exists(spark, f"{path}/{ASIDE}"):
        return False
    if not _exists(spark, f"{path}/{ASIDE}/list/_SUCCESS"):
        _remove(spark, f"{path}/{ASIDE}")
        return False
    _apply(spark, path, partition)
    return True
