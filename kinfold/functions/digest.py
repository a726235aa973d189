"""Digests of rows and tables that depend on values alone, not on row order, partitioning or chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(name: str, kind: T.DataType) -> Column:
    """A column as text that is the same for equal values. Text and binary carry their length, so that no value runs into the next; null is a marker no value can have."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        text = F.concat(F.octet_length(c).cast("string"), F.lit(":0x"), F.lower(F.hex(c)))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        # by the bits: hex of a big-endian encoding would need a UDF, while Java's shortest text is exact
        text = F.when(c == 0, F.lit("0.0")).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        text = F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    elif isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        text = F.to_json(F.struct(c))
        text = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("~"))


def row_digest(schema: T.StructType) -> Column:
    """SHA-256 over name=value of all columns in the order of their names."""
    parts = [F.concat(F.lit(f"{f.name}="), canonical(f.name, f.dataType)) for f in sorted(schema.fields, key=lambda f: f.name)]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def digest_sums(digest: Column | str = "d") -> list[Column]:
    """Aggregates s0 to s3: sums of the four 60-bit leading pieces of SHA-256 texts.

    Sums of a multiset do not depend on order, count repeated rows, and add up over any parts of a table, so they
    are combined before rows move and no task holds a table's digests.
    """
    d = F.col(digest) if isinstance(digest, str) else digest
    return [F.coalesce(F.sum(F.conv(F.substring(d, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)]


def sums_text(rows: Column | str = "rows", *sums: str) -> Column:
    """SHA-256 over a number of rows and its sums."""
    return F.sha2(F.concat_ws(",", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in (rows, *(sums or ("s0", "s1", "s2", "s3")))]), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever the order and partitions of its rows. Repeated rows count as often as they occur."""
    return df.select(row_digest(df.schema).alias("d")).agg(F.count("*").alias("rows"), *digest_sums()).select("rows", sums_text().alias("digest"))


def byte_size(schema: T.StructType) -> Column:
    """About how many bytes a row takes in a statement: 4 for null, length + 2 for text and binary, else 8."""
    size = lambda f: F.when(F.col(f"`{f.name}`").isNull(), 4).otherwise(F.octet_length(F.col(f"`{f.name}`")) + 2 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8))
    return reduce(lambda a, b: a + b, [size(f) for f in schema.fields]).cast("long")
