"""Comparing two tables through difference sketches: invertible Bloom tables that are peeled to the rows that differ.

Keys are dealt into parts by a hash, and every part has a small table of cells. A row goes into one cell of each of
HASHES groups of its part; a cell holds how many rows it has and the exclusive ors of their keys, fingerprints and check
values. All of these combine before rows move, so a sketch costs one pass and a shuffle of cells, and its size is that of
the capacity, whatever the table's. Subtracting two sketches leaves the rows that only one side has: equal rows cancel.
A cell with one row left names it; taking it out of its other cells frees further ones. Each part is peeled on its own,
so a group is CELLS rows at most. A part with more differences than it can hold, or with rows that occur twice on
one side, stays unpeeled, and only its rows are compared by a digest tree: results are whole at any number of
differences. Two different rows are taken for the same if 64-bit hashes of both collide.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.digest import row_digest
from kinfold.operators import digest_tree

#: Cells of a part, in HASHES groups, and the rows that a part is planned for (a changed row is two): a quarter of its cells, so that a part
#: seldom gets more than it can hold, and groups wide enough that two rows seldom share all their cells.
CELLS, HASHES, PLANNED = 256, 4, 64

_CELL = ["n", "s", "k", "f", "c"]


def parts_for(capacity: int) -> int:
    return max(1, -(-capacity // PLANNED))


def _part(key: str, parts: int) -> F.Column:
    """By the key alone: both versions of a changed row are in the same part."""
    return F.pmod(F.xxhash64(F.col(key).cast("long"), F.lit(1)), F.lit(parts)).cast("int")


def _checked(table: DataFrame, key: str) -> None:
    if not isinstance(table.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"a difference sketch needs a whole-number key, {key!r} is {table.schema[key].dataType.simpleString()}")


def sketch(table: DataFrame, key: str, capacity: int) -> DataFrame:
    """part, cell, n (rows), s (sum of 31 bits of check values), k, f, c (exclusive or of keys, fingerprints, check values). Only cells with rows. Can be kept and compared later with another of the same capacity."""
    _checked(table, key)
    # the lowest bit of a fingerprint tells a null key from 0
    mark = F.shiftleft(F.xxhash64(row_digest(table.schema)), 1).bitwiseOR(F.col(key).isNull().cast("long"))
    rows = table.select(_part(key, parts_for(capacity)).alias("part"), F.coalesce(F.col(key).cast("long"), F.lit(0)).cast("long").alias("k"), mark.alias("f"))
    rows = rows.withColumn("c", F.xxhash64("k", "f"))
    group = CELLS // HASHES
    cells = F.array(*[(F.pmod(F.shiftright("c", 16 * i), F.lit(group)) + group * i).cast("int") for i in range(HASHES)])
    each = rows.select("part", F.explode(cells).alias("cell"), "k", "f", "c")
    return each.groupBy("part", "cell").agg(F.count("*").alias("n"), F.sum(F.col("c").bitwiseAND(F.lit(2**31 - 1))).alias("s"), *[F.bit_xor(x).alias(x) for x in "kfc"])


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells that are left of sketch a without sketch b."""
    both = a.select("part", "cell", *_CELL).unionByName(b.select("part", "cell", *[(-F.col(x)).alias(x) if x in "ns" else F.col(x) for x in _CELL]))
    left = both.groupBy("part", "cell").agg(*[(F.sum if x in "ns" else F.bit_xor)(x).alias(x) for x in _CELL])
    return left.where(" or ".join(f"{x} <> 0" for x in _CELL))


def _peeler() -> Callable:
    """A function of its own, that executors need no module of this package for."""
    cells, hashes = CELLS, HASHES

    def peel(frame):
        import pandas as pd
        from xxhash import xxh64_intdigest

        u64, group, part = (1 << 64) - 1, cells // hashes, int(frame["part"].iloc[0])
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        check = lambda k, f: xxh64_intdigest(f.to_bytes(8, "little"), xxh64_intdigest(k.to_bytes(8, "little"), 42))
        left = {int(r.cell): [int(r.n), int(r.s), int(r.k) & u64, int(r.f) & u64, int(r.c) & u64] for r in frame.itertuples()}
        found, todo = [], list(left)
        while todo:
            cell = left.get(todo.pop())
            if cell is None or abs(cell[0]) != 1:
                continue
            n, _, k, f, c = cell
            if check(k, f) != c:
                continue
            found.append((part, None if f & 1 else signed(k), n))
            for i in range(hashes):
                # arithmetic shift of the signed value, as the sketch does; the low bits are the same either way
                at = (signed(c) >> 16 * i) % group + group * i
                x = left.setdefault(at, [0, 0, 0, 0, 0])
                x[0], x[1], x[2], x[3], x[4] = x[0] - n, x[1] - n * (c & (1 << 31) - 1), x[2] ^ k, x[3] ^ f, x[4] ^ c
                if any(x):
                    todo.append(at)
                else:
                    del left[at]
        if left:
            found = [(part, None, 0)]
        return pd.DataFrame({"part": pd.Series([x[0] for x in found], dtype="int32"), "key": pd.Series([x[1] for x in found], dtype="Int64"), "side": pd.Series([x[2] for x in found], dtype="int32")})

    return peel


def peeled(cells: DataFrame) -> DataFrame:
    """part, key, side of each differing row: 1 of the first table, -1 of the second. A part that does not come apart has one row with side 0, and none other."""
    return cells.groupBy("part").applyInPandas(_peeler(), "part int, key long, side int")


def sketch_diff(source: DataFrame, destination: DataFrame, key: str, capacity: int = 4096, source_sketch: DataFrame | None = None, destination_sketch: DataFrame | None = None) -> DataFrame:
    """As row_diff(): key and difference of every row that is not the same on both sides.

    Keys should be unique. Up to about capacity differing rows (a changed one counts twice) come from the sketches alone; sketches that were kept, of this
    capacity, are not made again, and their tables are read only for parts that do not come apart. Rows without a
    key cancel like others when both sides have them, and are source_only or destination_only otherwise.
    """
    _checked(source, key)
    d = destination.select(*source.columns)
    a = source_sketch if source_sketch is not None else sketch(source, key, capacity)
    b = destination_sketch if destination_sketch is not None else sketch(d, key, capacity)
    rows = peeled(subtract(a, b)).persist()
    kind = F.when(F.col("x") == 0, "destination_only").when(F.col("y") == 0, "source_only").otherwise("changed")
    has = lambda side: F.max((F.col("side") == side).cast("int"))
    keyed = rows.where("side <> 0 and key is not null").groupBy("key").agg(has(1).alias("x"), has(-1).alias("y")).select("key", kind.alias("difference"))
    bare = rows.where("side <> 0 and key is null").select("key", F.when(F.col("side") == 1, "source_only").otherwise("destination_only").alias("difference"))
    found = keyed.unionByName(bare)
    closed = rows.where("side = 0").select("part")
    if closed.isEmpty():
        return found
    # one number a part: as many as the capacity allows
    within = lambda t: t.withColumn("_part", _part(key, parts_for(capacity))).join(F.broadcast(closed.withColumnRenamed("part", "_part")), "_part", "left_semi").select(*source.columns)
    x, y = within(source), within(d)
    rest = digest_tree.tree_diff(x, y, key, digest_tree.Shape.over(x, key))
    return found.unionByName(rest.select(F.col("key").cast("long"), "difference"))
