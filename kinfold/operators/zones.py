"""Keyset scans that open only the files whose keys they need.

A zone map has the least and the largest key and the rows of every file of a table. It is made by one pass over
the key column, and serves all batches of a run. Files of a table that was written in ranges of its key hardly
overlap, so that a batch reads one or two of them; where all overlap, a batch reads all, as without a map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.predicates import where as predicate
from kinfold.operators.closure import root_batch

#: Files of the first look for a batch, and how many are named in one read at most: beyond that the table is read with a filter on its key.
FIRST, NAMED = 2, 4096


def zone_map(table: DataFrame, key: str) -> DataFrame:
    """file, rows, low, high of each file that table, a plain read of Parquet, has rows with a key in."""
    at = F.col("_metadata.file_path").alias("file")
    return table.select(at, F.col(key).alias("k")).where("k is not null").groupBy("file").agg(F.count("*").alias("rows"), F.min("k").alias("low"), F.max("k").alias("high"))


@dataclass
class Zoned:
    """A Parquet table with a zone map of one of its columns. zones should be a written or cached table."""

    spark: SparkSession
    path: str
    key: str
    zones: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, path: str, key: str) -> Zoned:
        return cls(spark, path, key, zone_map(spark.read.parquet(path), key).persist())

    def _read(self, files: list[str] | None) -> DataFrame:
        whole = self.spark.read.parquet(self.path)
        if files is None:
            return whole
        return self.spark.read.schema(whole.schema).option("basePath", self.path).parquet(*files) if files else whole.limit(0)

    def next_batch(self, where: str | None, after: object, limit: int) -> tuple[DataFrame, int]:
        """The limit smallest keys above after that satisfy the predicate, ascending, and how many files were opened for them.

        Files are taken by their least key. Those taken hold every key below the least key of the next file, so the
        batch is complete once they give enough keys below that; if not, twice as many are looked at.
        """
        later = self.zones if after is None else self.zones.where(F.col("high") > F.lit(after))
        n, kind = FIRST, self.spark.read.parquet(self.path).schema[self.key].dataType
        while True:
            # at most NAMED rows
            first = later.orderBy("low", "file").limit(min(n, NAMED) + 1).collect()
            more = len(first) > min(n, NAMED)
            some, end = (first[:-1], first[-1].low) if more else (first, None)
            if more and n > NAMED:
                some, end = None, None
            rows = self._read(None if some is None else [r.file for r in some])
            if end is not None:
                rows = rows.where(F.col(self.key) < F.lit(end).cast(kind))
            batch = root_batch(rows, self.key, where, after, limit)
            if end is None or batch.count() == limit:
                return batch, self.zones.count() if some is None else len(some)
            n *= 2

    def batches(self, where: str | None, limit: int, after: object = None) -> Iterator[tuple[DataFrame, object, int]]:
        """All batches in ascending order: keys, the last key, and files opened. The driver holds one checkpoint."""
        while True:
            batch, files = self.next_batch(where, after, limit)
            batch = batch.persist()
            last = batch.agg(F.max(self.key)).first()[0]
            if last is None:
                batch.unpersist()
                return
            yield batch, last, files
            batch.unpersist()
            after = last

    def holding(self, keys: DataFrame, where: str | None = None) -> tuple[DataFrame, int]:
        """Rows whose key is among keys (one column), and how many files were opened: those whose range meets the range of keys."""
        name = keys.columns[0]
        span = keys.agg(F.min(name).alias("a"), F.max(name).alias("b")).first()
        met = [] if span.a is None else self.zones.where((F.col("low") <= F.lit(span.b)) & (F.col("high") >= F.lit(span.a))).select("file").limit(NAMED + 1).collect()
        rows = self._read([r.file for r in met] if len(met) <= NAMED else None)
        cond = predicate(where)
        rows = rows if cond is None else rows.filter(cond)
        return rows.join(keys.select(F.col(name).alias(self.key)), self.key, "left_semi").select(*rows.columns), len(met)
