"""Copying rows to the destination, idempotently or strictly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class DuplicateKeyError(RuntimeError):
    def __init__(self, table: str, key: object):
        self.table, self.key = table, key
        super().__init__(f"table {table!r}: key {key!r} is already in the destination")


def _absent(incoming: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """As in SQL, a key with a null part conflicts with nothing."""
    return incoming.join(existing.select(*key), list(key), "left_anti").select(*incoming.columns)


def insert_ignore(incoming: DataFrame, existing: DataFrame, key: Sequence[str] | None, unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """Rows of incoming that can be added: no conflict with existing rows, or with each other, on the key or any unique key.

    Of incoming rows that conflict with each other the one with the smallest key stays. Without a key
    whole rows are compared, nulls being values.
    """
    if key is None:
        marked = existing.select(*incoming.columns).distinct()
        on = [incoming[c].eqNullSafe(marked[c]) for c in incoming.columns]
        return incoming.distinct().join(marked, on, "left_anti")
    out = incoming
    for k in dict.fromkeys((tuple(key), *map(tuple, unique))):
        out = _absent(out, existing, k)
        nulls = F.lit(False)
        for c in k:
            nulls = nulls | F.col(c).isNull()
        order = [F.col(c) for c in (*key, *[c for c in out.columns if c not in key])]
        first = F.row_number().over(Window.partitionBy(*k).orderBy(*order))
        out = out.withColumn("_first", first).filter(nulls | (F.col("_first") == 1)).drop("_first")
    return out


def insert_missing(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of a table without a key that are to be added: each as often as incoming holds it more often than existing.

    Whole rows are compared, nulls being values. What was added once adds nothing when it comes again.
    """
    return incoming.exceptAll(existing.select(*incoming.columns))


def conflicts(incoming: DataFrame, existing: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of incoming rows that the destination has already."""
    return incoming.select(*key).join(existing.select(*key), list(key), "left_semi").distinct()


def strict_insert(table: str, incoming: DataFrame, existing: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """incoming, if none of its keys is in the destination or occurs twice; else DuplicateKeyError."""
    for k in keys:
        for found in (conflicts(incoming, existing, k), incoming.dropna(subset=list(k)).groupBy(*k).count().filter("count > 1").select(*k)):
            if row := found.limit(1).collect():
                raise DuplicateKeyError(table, row[0][0] if len(k) == 1 else tuple(row[0]))
    return incoming


def needs_strict(method: str, skip_verify: bool, has_secondary_unique: bool) -> bool:
    """Only a digest can prove that a row which is there already is the right one."""
    return method == "count" or skip_verify or has_secondary_unique
