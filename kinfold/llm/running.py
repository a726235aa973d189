"""Running sums within keys, however many rows a key has, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import stage


def running_sums(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], name: str, keep: bool = False) -> DataFrame:
    """df with, for each of sums, the sum of its expression over the rows of the same keys up to and including this one.

    Rows are dealt out by ranges of (keys, order), so that a key of any size is spread over many tasks,
    and each remembers its range. Sums within a range are windows of bounded size; sums of the earlier
    ranges of a key come from a table with one row for each key and range. Rows with a null key are left
    out. Rows that order does not tell apart take an arbitrary order. keep: of the table that the result reads.
    """
    for n in ("_range", "_before"):
        assert n not in df.columns
    ranged = stage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()), name, keep=keep)
    names = list(sums)
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(sums[n]).alias(f"_t_{n}") for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in names])
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({n: F.sum(sums[n]).over(within) for n in names})
    # the windows are dealt out by the same keys as the join: the rows move once
    return local.join(before, [*keys, "_range"]).select(*df.columns, *[(F.col(n) + F.col(f"_b_{n}")).alias(n) for n in names])
