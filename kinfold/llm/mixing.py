"""Mixing sources to target weights by systematic sampling, with DataFrame operations only.

Each document expects target / source_size copies. Expected copies are summed up along a source, one
random offset is added, and a document is emitted once for every whole number that its step crosses. Along a
source documents go from large to small, so that neighbours weigh about the same and the words taken come
near the target. Expected copies are whole multiples of 1 / UNIT: sums are exact in any order, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import WORD, free_name, passing, row_key, stage
from kinfold.llm.running import running_sums

UNIT = 1 << 30
#: Weights of the sources by code point, again and again; words of the mix as a share of all; the most copies of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def _key(source: Column) -> Column:
    """Sorts as the source does by code point, null last; never null."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, source_size -> also target: shares by weight, none above most times its size, the excess reshared by weight.

    With sources in the order of limit / weight, the common level of those below their limits is what
    is left for them over their weights; the first source whose limit lies above it fixes the level.
    One row for each source.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    limited = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("at", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("at", "source_key")
    left = limited.withColumn("all", F.lit(share) * F.sum("source_size").over(everything))
    left = left.withColumn("used", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    left = left.withColumn("level", (F.col("all") - F.col("used")) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("at") > F.col("level"), F.col("level"))).over(everything)
    return left.withColumn("level", level).select("source_key", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def copies(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target and copies of every row of docs (doc_id, text, source).

    Null texts have the size 0; a null source is a source, the last. Null and repeated ids are rows like
    any other; rows that agree in id, source and size may change places. Documents of size 0 may be
    emitted but add no words. An empty table gives an empty result. Other columns are ignored.
    """
    sized = docs.select("doc_id", _key(F.col("source")).alias("source_key"), _size().alias("size"), F.lit(1).cast("long").alias("rows"))
    with passing(docs.sparkSession):
        return _counted(stage(sized, "sizes"), [], seed, weights, share, most)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _counted(sized: DataFrame, ties: list[str], seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """copies() of sized (doc_id, source_key, size, rows, ties), where rows equal rows stand behind each other; ties also order rows that agree in size and doc_id."""
    aims = stage(targets(sized.groupBy("source_key").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, share, most), "targets", keep=True)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long") * F.col("rows")
    rows = sized.join(aims, "source_key").withColumn("expected", expected)
    order = [F.desc("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("doc_id"), *[F.col(c) for c in ties]]
    summed = running_sums(rows, ["source_key"], order, {"upto": F.col("expected")}, "mix", keep=True)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("source_key"))), 1, 7), 16, 10).cast("long") * (UNIT >> 28)
    crossed = F.floor((F.col("upto") + offset) / UNIT) - F.floor((F.col("upto") - F.col("expected") + offset) / UNIT)
    return summed.select("doc_id", *ties, "size", "source_size", "target", crossed.cast("long" if ties else "int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, all their columns, each as often as it is taken.

    Rows that agree in all columns are one, taken as often as all of them: only one of them is moved,
    however many there are. A row is known by 96 bits of hashes over its columns, so each takes its own
    copies, with or without an id of its own.
    """
    a, b, n = (free_name(docs, c) for c in ("_k1", "_k2", "_copies"))
    k1, k2 = row_key(docs)
    each = docs.select("doc_id", _key(F.col("source")).alias("source_key"), _size().alias("size"), k1.alias("k1"), k2.alias("k2"))
    with passing(docs.sparkSession):
        sized = stage(each.groupBy(*each.columns).agg(F.count("*").alias("rows")), "sizes")
        taken = _counted(sized, ["k1", "k2"], **options).where("copies > 0").select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("copies").alias(n))
    # as many rows as the mix has different ones: one plan at every size
    once = docs.withColumns({a: k1, b: k2}).dropDuplicates([a, b])
    every = once.join(taken.hint("merge"), [a, b])
    return every.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
