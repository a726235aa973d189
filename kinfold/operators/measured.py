"""Foreign keys as the data has them: which columns' values are all among those of a key.

All values of all columns are grouped once, each with the set of columns that hold it. A column is included in another
if the other is in the set of each of its values. There are few different sets, however many values: pairs of columns
are counted over sets, and no pair of columns is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def value_text(table: DataFrame, column: str) -> F.Column:
    """A value as text that is equal for equal values of whole-number columns of any width, of decimals, or of texts."""
    kind = table.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.concat(F.lit("n"), c.cast("string"))
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return F.concat(F.lit("n"), c.cast("string"))
    return F.concat(F.lit(f"{kind.simpleString()}:"), c.cast("string"))


def column_values(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """value, column (as table.column): the distinct values of each column, without nulls."""
    each = [tables[t].select(value_text(tables[t], c).alias("value"), F.lit(f"{t}.{c}").alias("column")) for t, names in columns.items() for c in names]
    return reduce(DataFrame.unionByName, each).where("value is not null").distinct()


def inclusions(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """column, other, values: columns with at least one value, all of which the other column has, and how many these are."""
    # a set has no more entries than there are columns
    held = column_values(tables, columns).groupBy("value").agg(F.array_sort(F.collect_set("column")).alias("holders"))
    sets = held.groupBy("holders").agg(F.count("*").alias("n"))
    total = sets.select(F.explode("holders").alias("column"), "n").groupBy("column").agg(F.sum("n").alias("values"))
    pairs = sets.select(F.explode("holders").alias("column"), "holders", "n").select("column", F.explode("holders").alias("other"), "n").where("column <> other")
    both = pairs.groupBy("column", "other").agg(F.sum("n").alias("both"))
    return both.join(total, "column").where(F.col("both") == F.col("values")).select("column", "other", "values")


def unique_columns(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """column: those whose values are all there and all different. Each table is read once."""
    each = []
    for t, names in columns.items():
        counts = tables[t].agg(F.count("*").alias("_rows"), *[F.countDistinct(f"`{c}`").alias(c) for c in names])
        flags = F.array(*[F.struct(F.lit(f"{t}.{c}").alias("column"), ((F.col(f"`{c}`") == F.col("_rows")) & (F.col("_rows") > 0)).alias("unique")) for c in names])
        each.append(counts.select(F.explode(flags).alias("x")).select("x.*"))
    return reduce(DataFrame.unionByName, each).where("unique").select("column")


def foreign_keys(tables: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """child, child_column, parent, parent_column: columns whose values are all among those of a unique column of another table."""
    found = inclusions(tables, columns).join(unique_columns(tables, columns).withColumnRenamed("column", "other"), "other")
    part = lambda c, i: F.element_at(F.split(F.col(c), r"\.", 2), i)
    out = found.select(part("column", 1).alias("child"), part("column", 2).alias("child_column"), part("other", 1).alias("parent"), part("other", 2).alias("parent_column"))
    return out.where("child <> parent")


def undeclared(measured: DataFrame, declared: DataFrame) -> DataFrame:
    """Measured foreign keys that a graph or catalog does not have. declared: child, child_column, parent, parent_column."""
    return measured.join(declared, ["child", "child_column", "parent", "parent_column"], "left_anti")
