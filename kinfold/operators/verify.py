"""Comparing the copied rows of source and destination, by count or by digest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.digest import row_digest, table_digest
from kinfold.operators.closure import Keys

METHODS = ("count", "sha256", "skip")


class VerificationError(RuntimeError):
    def __init__(self, results: list):
        self.results = results
        super().__init__("; ".join(f"{r.table}: source {r.source_rows} rows, destination {r.destination_rows}" + (", digests differ" if r.source_rows == r.destination_rows else "") for r in results if not r.match))


def by_count(found: dict[str, Keys], source: dict[str, DataFrame], destination: dict[str, DataFrame]) -> DataFrame:
    """table, source_rows, destination_rows, match. Counts show that keys are there, not that rows are equal."""
    count = lambda side, t, n: found[t].of(side[t]).agg(F.count("*").alias(n))
    each = [count(source, t, "source_rows").crossJoin(count(destination, t, "destination_rows")).select(F.lit(t).alias("table"), "source_rows", "destination_rows") for t in found]
    return reduce(DataFrame.union, each).withColumn("match", F.col("source_rows") == F.col("destination_rows"))


def by_digest(found: dict[str, Keys], source: dict[str, DataFrame], destination: dict[str, DataFrame]) -> DataFrame:
    """table, source_rows, destination_rows, match: counts and digests both equal."""
    each = []
    for t in found:
        a, b = found[t].of(source[t]), found[t].of(destination[t]).select(*source[t].columns)
        x, y = table_digest(a), table_digest(b)
        both = x.select(F.col("rows").alias("source_rows"), F.col("digest").alias("d1")).crossJoin(y.select(F.col("rows").alias("destination_rows"), F.col("digest").alias("d2")))
        each.append(both.select(F.lit(t).alias("table"), "source_rows", "destination_rows", ((F.col("source_rows") == F.col("destination_rows")) & (F.col("d1") == F.col("d2"))).alias("match")))
    return reduce(DataFrame.union, each)


def row_diff(source: DataFrame, destination: DataFrame, key: str) -> DataFrame:
    """key and difference of every row that is not the same on both sides: source_only, destination_only or changed."""
    a = source.select(F.col(key).alias("key"), row_digest(source.schema).alias("d1"))
    d = destination.select(*source.columns)
    b = d.select(F.col(key).alias("key"), row_digest(d.schema).alias("d2"))
    kind = F.when(F.col("d2").isNull(), "source_only").when(F.col("d1").isNull(), "destination_only").when(F.col("d1") != F.col("d2"), "changed")
    return a.join(b, "key", "full").select("key", kind.alias("difference")).filter("difference is not null")


def verify(method: str, found: dict[str, Keys], source: dict[str, DataFrame], destination: dict[str, DataFrame]) -> list:
    """All tables are compared; any mismatch is an error."""
    if method not in METHODS:
        raise ValueError(f"unknown verification method {method!r}")
    if method == "skip":
        return []
    compared = by_count(found, source, destination) if method == "count" else by_digest(found, source, destination)
    results = compared.collect()  # one row for each table
    if not all(r.match for r in results):
        raise VerificationError(results)
    return results
