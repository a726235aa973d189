"""Cutting an ordered table into batches by a byte budget.

A batch takes rows in the order of a key as long as their bytes fit; a row larger than the budget is a batch of its
own. Where a batch begins depends on the one before, but no task goes through them one by one: each row gets a
pointer to the row where the next batch would begin if one began at it, found among prefix sums, and pointers are
doubled. The axis of bytes is divided into buckets as wide as the budget. A first pointer leads out of its row's
bucket, a doubled one out of a group of twice as many buckets, and only rows where a group can be entered keep one:
about half as many each time, so that all rounds together move as many narrow rows as the first. Then, from the
widest groups down, the pointers of the rows where a batch begins name further ones.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _written(df: DataFrame) -> DataFrame:
    """df without its lineage, in the session's spark.checkpoint.dir; a new local folder where it is unset and the driver runs its own tasks."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-cuts-"))
    return df.checkpoint()


def running(rows: DataFrame, order: str, sums: dict[str, Column]) -> DataFrame:
    """rows with i, their place in the order from 0, and for each name the sum of its expression over the rows before.

    Rows are dealt into ranges of the order, summed within each and shifted by the ranges before, of which there are
    as many as shuffle partitions. order should tell rows apart: its equal values are in one range.
    """
    ranged = rows.repartitionByRange(order).withColumn("_r", F.spark_partition_id()).withColumns({f"_s_{n}": F.coalesce(c, F.lit(0)).cast("long") for n, c in sums.items()}).persist()
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    total = ranged.groupBy("_r").agg(F.count("*").alias("_n"), *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    offsets = total.select("_r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_o{c}") for c in total.columns[1:]])
    upto = Window.partitionBy("_r").orderBy(order)
    within = ranged.withColumns({"_i": F.row_number().over(upto) - 1} | {f"_w_{n}": F.sum(f"_s_{n}").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"_s_{n}") for n in sums})
    found = within.join(F.broadcast(offsets), "_r").select(*rows.columns, (F.col("_i") + F.col("_o_n")).cast("long").alias("i"), *[(F.col(f"_w_{n}") + F.col(f"_o_t_{n}")).cast("long").alias(n) for n in sums])
    found = _written(found)
    ranged.unpersist()
    return found


def next_starts(rows: DataFrame, budget: int) -> DataFrame:
    """(i, size, before) -> i, g, j, jg: the row j where the batch after one that begins at i begins, and their buckets of budget bytes. j is null where the batch takes all that is left.

    The batch of a row in bucket g ends in g or g + 1, so that the row is compared with the rows of these two only:
    narrow rows of about two batches, and any number of rows of size 0 between them.
    """
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    at = rows.withColumn("g", F.expr(f"before div {budget}"))
    # the last row of the row's own bucket, for batches that no row of the next one ends
    at = at.withColumn("last", F.max("i").over(Window.partitionBy("g")))
    ask = at.select((F.col("g") + 1).alias("b"), (F.col("before") + budget).alias("v"), F.lit(True).alias("asks"), "i", "size", "before", "g", "last")
    have = at.select(F.col("g").alias("b"), F.col("before").alias("v"), F.lit(False).alias("asks"), "i", "size", "before", "g", "last")
    seen = F.max(F.when(~F.col("asks"), F.col("i"))).over(Window.partitionBy("b").orderBy("v", "asks"))
    rows = have.unionByName(ask).withColumn("seen", seen).where("asks")
    j = F.greatest(F.coalesce("seen", "last"), F.col("i") + 1)
    all_left = (F.col("before") + budget >= F.lit(total or 0)) | (F.col("i") + 1 >= F.lit(n))
    # the row after this one begins where this one ends
    jg = F.when(F.col("seen").isNotNull(), F.col("b")).when(F.col("last") > F.col("i"), F.col("g")).otherwise(F.expr(f"(before + size) div {budget}"))
    return rows.select("i", "g", F.when(~all_left, j).alias("j"), F.when(~all_left, jg).alias("jg"))


def _through(pointers: DataFrame, onto: DataFrame, shift: int) -> DataFrame:
    """pointers (i, g, j, jg), those that stay in their group of 2**shift buckets followed by the one of onto."""
    stays = F.expr(f"j is not null and shiftright(g, {shift}) = shiftright(jg, {shift})")
    # at most one row of onto has the place, so no pointer is lost or doubled
    then = onto.select(F.col("i").alias("j"), F.col("j").alias("j2"), F.col("jg").alias("jg2"))
    more = pointers.where(stays).join(then, "j").select("i", "g", F.col("j2").alias("j"), F.col("jg2").alias("jg"))
    return pointers.where(~stays).unionByName(more)


def starts(rows: DataFrame, budget: int) -> DataFrame:
    """(i, size, before), the places from 0 -> i of the rows where a batch begins."""
    direct = _written(next_starts(rows, budget))
    most = direct.agg(F.max("g")).first()[0]
    if most is None:
        return direct.select("i")
    # two batches are more than a bucket, so that one step more leads out of it
    levels = [_written(_through(direct, direct, 0))]
    for k in range(1, int(most).bit_length()):
        below = levels[-1]
        entered = below.where(f"shiftright(g, {k}) <> shiftright(jg, {k})").select(F.col("j").alias("i")).union(below.where("i = 0").select("i")).distinct()
        levels.append(_written(_through(below.join(entered, "i", "left_semi"), below, k)))
    found = direct.where("i = 0").select("i")
    for k in range(len(levels) - 1, -1, -1):
        # of the pointers out of a group of 2**k buckets, those that stay in the group of twice as many
        inner = levels[k].join(found, "i", "left_semi").where(f"shiftright(g, {k + 1}) = shiftright(jg, {k + 1})").select(F.col("j").alias("i"))
        found = _written(found.union(inner).distinct())
    return found.union(direct.join(found, "i", "left_semi").where("g = jg").select(F.col("j").alias("i"))).distinct()


def labelled(table: DataFrame, key: str, size: Column, budget: int) -> DataFrame:
    """key, size, batch (from 0) of every row with a key: batches in the order of the key, each of budget bytes at most or of one larger row.

    Keys are unique. A size is a whole number, null and less than 0 count as 0; rows of size 0 go with the rows before
    them, but not with a row above the budget. An empty table has no batches.
    """
    if budget < 1:
        raise ValueError("a budget has at least one byte")
    rows = table.select(F.col(key).alias("_key"), F.greatest(F.coalesce(size, F.lit(0)).cast("long"), F.lit(0)).alias("size")).where("_key is not null")
    placed = running(rows, "_key", {"before": F.col("size")})
    first = starts(placed.select("i", "size", "before"), budget).withColumn("begins", F.lit(1))
    flagged = placed.join(first, "i", "left").select("_key", "size", "begins")
    return running(flagged, "_key", {"earlier": F.col("begins")}).select(F.col("_key").alias(key), "size", (F.col("earlier") + F.coalesce("begins", F.lit(0)) - 1).alias("batch"))


def cuts(table: DataFrame, key: str, size: Column, budget: int) -> DataFrame:
    """batch, rows, bytes, first_key, checkpoint of each batch: a range of keys that can be copied by itself."""
    return labelled(table, key, size, budget).groupBy("batch").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min(key).alias("first_key"), F.max(key).alias("checkpoint"))
