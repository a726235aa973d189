"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame operations only.

Only windows that share a shingle with an item can be similar to it, so each shared shingle proposes to
the item the window that aligns it with its place there. Windows and items get 64-bit SimHash fingerprints
over their shingles, weighted by how often they occur. A fingerprint is cut into RADIUS + 1 blocks: two that
differ in at most RADIUS bits agree in one block at least, so equal blocks, met in an index over (item,
block, bits), find all of them. Pairs within the radius are verified by the exact weighted similarity of
their shingles: the sum of the smaller counts over that of the larger.

At a similarity of 0.8 so wide a radius is needed that blocks have two or three bits, which alone would let
pass nearly every pair of a window and an item. So the index is asked for the items that share a shingle
with the window, not for all of its length, and what the radius selects are those that share little more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import passing, stage

SHINGLE, THRESHOLD = 5, 0.8
#: Sets with a similarity of 0.8 have a cosine of 0.89, so that 9.7 of 64 bits differ on average, with a deviation of 2.9; five of those above it.
BITS, RADIUS = 64, 24
#: Index entries that every task holds during one pass over the documents.
INDEX_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingle(of: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(of, at + j) for j in range(size)])


def _shingles(of: str, size: Column) -> Column:
    """All shingles of an array of words; fewer words make one."""
    whole = F.transform(F.sequence(F.lit(0), F.size(of) - SHINGLE), lambda i: _shingle(of, i, SHINGLE))
    return F.when(F.size(of) >= SHINGLE, whole).when(F.size(of) > 0, F.array(F.xxhash64(F.concat_ws(" ", of)))).otherwise(F.array().cast("array<long>"))


def _fingerprint(of: str) -> Column:
    """Bit b is set if more shingles have it set than not. Bits b and b + 32 are counted at once, in the halves of a long."""
    pair = 1 | 1 << 32
    counted = lambda b: F.aggregate(of, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftrightunsigned", h, b).bitwiseAND(F.lit(pair)))
    bit = lambda n, b: F.when(n * 2 > F.size(of), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    both = lambda n, b: bit(n.bitwiseAND(F.lit((1 << 32) - 1)), b).bitwiseOR(bit(F.shiftrightunsigned(n, 32), b + 32))
    each = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.struct(b.alias("b"), counted(b).alias("n")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(both(x["n"], x["b"])))


def _blocks() -> list[tuple[int, int]]:
    """(first bit, mask) of each block."""
    n = RADIUS + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, (1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:])]


def _block_values(fingerprint: str) -> Column:
    return F.array(*[F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit(mask).cast("long")).cast("int") for a, mask in _blocks()])


def _similarity(a: str, b: str) -> Column:
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return common / (F.size(a) + F.size(b) - common)


def indexed(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, length, shingles, fp) of the different texts of items, told by a digest, and (item, shingle, place, length, size) of their shingles."""
    own = items.select(words(F.col("text")).alias("w")).where(F.size("w") > 0).select(F.sha2(F.concat_ws(" ", "w"), 256).alias("item"), F.size("w").alias("length"), _shingles("w", F.size("w")).alias("shingles")).dropDuplicates(["item"])
    own = stage(own.withColumn("fp", _fingerprint("shingles")), "items", keep=True)
    spots = own.select("item", "length", F.posexplode("shingles").alias("place", "shingle")).withColumn("size", F.least("length", F.lit(SHINGLE)))
    return own, stage(spots, "spots", keep=True)


def proposed(docs: DataFrame, spots: DataFrame) -> DataFrame | None:
    """(doc_id, item, length, start, window): the windows that align a shingle of a document with the same one of an item, each once. None without items.

    A pass over the documents meets at most INDEX_ROWS spots, which every task may hold; a larger index
    takes as many passes as it needs.
    """
    tokens = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    passes = -(-spots.count() // INDEX_ROWS)
    windows = []
    for size in sorted(r.size for r in spots.select("size").distinct().collect()):  # at most SHINGLE of them
        each = tokens.where(F.col("n") >= size).select("doc_id", "w", "n", F.posexplode("w").alias("at", "_")).where(F.col("at") + size <= F.col("n"))
        hash_ = _shingle("w", F.col("at"), SHINGLE) if size == SHINGLE else F.xxhash64(F.concat_ws(" ", F.slice("w", F.col("at") + 1, size)))
        for k in range(passes):
            index = spots.where((F.col("size") == size) & (F.pmod(F.xxhash64("item", "place"), F.lit(passes)) == k)).select("item", "shingle", "place", "length")
            met = each.withColumn("shingle", hash_).join(F.broadcast(index), "shingle")
            start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("place"), F.col("n") - F.col("length")))
            windows.append(met.select("doc_id", "item", "length", start.alias("start"), F.concat_ws(" ", F.slice("w", start + 1, F.col("length"))).alias("window")))
    return reduce(DataFrame.union, windows).distinct() if windows else None


def candidates(marked: DataFrame, own: DataFrame) -> DataFrame:
    """Pairs of a window (item, fp, ...) and its item whose fingerprints differ in at most RADIUS bits, by an index over (item, block, bits)."""
    place = lambda df: df.withColumn("blocks", _block_values("fp")).select("*", F.posexplode("blocks").alias("block", "bits"))
    right = place(own.select("item", "fp")).withColumnsRenamed({"fp": "fp2", "blocks": "blocks2"})
    near = place(marked).join(right, ["item", "block", "bits"])
    # a pair that agrees in several blocks counts in the first of them
    first = F.array_position(F.zip_with("blocks", "blocks2", lambda x, y: x == y), True) == F.col("block") + 1
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS).where(first).select(*marked.columns)


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, similarity and start (the window's first word) for every document that holds a window similar to an item.

    docs has doc_id and text, items item_id and text; other columns are ignored. A document shorter than
    an item is one window. Items or documents without words match nothing; items of fewer than SHINGLE
    words match where all their words follow each other. Windows are those that align a shared shingle with
    its place in the item: of several the most similar, then the first, is returned. Null ids are ids.
    Repeated rows add nothing; empty tables give an empty result.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with passing(spark):
        own, spots = indexed(items)
        windows = proposed(docs, spots)
        if windows is None:
            return docs.select("doc_id").where("false").crossJoin(items.select("item_id").where("false")).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"))
        found = stage(windows, "windows")
        # what follows is work on each window: dealt out evenly, however few bytes they are
        dealt = found.repartition(parts, "item", "start", "doc_id").withColumn("w", F.split("window", " "))
        marked = stage(dealt.withColumn("shingles", _shingles("w", F.col("length"))).drop("w", "window").withColumn("fp", _fingerprint("shingles")), "fingerprints")
        near = candidates(marked, own).join(own.select("item", F.col("shingles").alias("s2")), "item")
        sure = near.withColumn("similarity", _similarity("shingles", "s2")).where(F.col("similarity") >= threshold)
        best = F.max(F.struct("similarity", -F.col("start")))
        pairs = stage(sure.groupBy("doc_id", "item").agg(best.alias("b")).select("doc_id", "item", "b.similarity", (-F.col("b.col2")).alias("start")), "leaks", keep=True)
    ids = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).select("item_id", F.sha2(F.concat_ws(" ", "w"), 256).alias("item")).distinct()
    return pairs.join(ids, "item").select("doc_id", "item_id", "similarity", "start")
