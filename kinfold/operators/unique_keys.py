"""Unique keys as the data has them: the smallest sets of columns that no two rows share.

Sets are looked at level by level, by their number of columns. A set that holds a unique one is unique but not
minimal, and is never looked at. All sets of a level are estimated in one scan by distinct-count sketches; a set whose
estimate is out of reach of the number of rows is not unique. Estimates only rule out: what is left is confirmed
exactly, by a grouping.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative standard deviation of an estimate, and how many of these it may lie below the number of rows.
ERROR, DEVIATIONS = 0.02, 8
#: Sets that are estimated in one scan: a task holds a sketch of about 10 kB for each.
AT_ONCE = 64


def _value(columns: tuple[str, ...]) -> Column:
    """A hash of all columns: repeated sets have repeated hashes, so that distinct hashes are never more than distinct sets."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def candidates(columns: list[str], size: int, unique: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Sets of a size, in the order of their names, that hold no unique set."""
    return [c for c in combinations(sorted(columns), size) if not any(set(u) <= set(c) for u in unique)]


def possible(table: DataFrame, sets: list[tuple[str, ...]], rows: int) -> list[tuple[str, ...]]:
    """The sets whose estimated distinct count does not rule out that they are unique."""
    floor = rows * (1 - DEVIATIONS * ERROR)
    found = []
    for i in range(0, len(sets), AT_ONCE):
        some = sets[i : i + AT_ONCE]
        counts = table.agg(*[F.approx_count_distinct(_value(c), ERROR).alias(f"c{j}") for j, c in enumerate(some)]).first()
        found += [c for c, n in zip(some, counts) if n >= floor]
    return found


def is_unique(table: DataFrame, columns: tuple[str, ...]) -> bool:
    """Exactly: no two rows have the same values in all columns."""
    return table.groupBy(*[f"`{c}`" for c in columns]).agg(F.count("*").alias("_n")).where("_n > 1").select(F.lit(1)).isEmpty()


def minimal_keys(table: DataFrame, columns: list[str] | None = None, most: int = 3) -> DataFrame:
    """columns: every minimal unique set of at most so many of the columns, each in the order of names.

    A key has no nulls: columns with one take no part. A table without rows proves nothing and has no key.
    """
    names = columns or table.columns
    table = table.select(*[F.col(f"`{c}`") for c in names])
    counts = table.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")) for c in names]).first()
    rows, usable = counts[0], [c for c, n in zip(names, counts[1:]) if n == counts[0]]
    unique: list[tuple[str, ...]] = []
    for size in range(1, min(most, len(usable)) + 1) if rows else ():
        unique += [c for c in possible(table, candidates(usable, size, unique), rows) if is_unique(table, c)]
    return table.sparkSession.createDataFrame([(list(c),) for c in unique], "columns array<string>")
