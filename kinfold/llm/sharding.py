"""Shards of nearly equal bytes by Karmarkar-Karp differencing; equal texts stay together.

Groups of equal texts are the indivisible items. Those of more than 1/LARGE of a shard are items of
their own: there are at most LARGE a shard. All smaller ones are hashed into as many bundles. So the
differencing itself runs over a number of items that depends on the number of shards alone, whatever
the number of documents.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stage
from kinfold.llm.running import running_sums

#: Items a shard: the bound of large groups, and the number of bundles.
LARGE = 256


def karmarkar_karp(sizes: list[int], ways: int) -> list[int]:
    """The way of each size. The two partial partitions of largest spread are combined, the largest part of one with the smallest of the other, until one is left."""
    if not sizes:
        return []
    heap = []
    for k, s in enumerate(sizes):
        parts = [(s, (k,))] + [(0, ())] * (ways - 1)
        heap.append((-s, k, parts))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = sorted(((x + y, (p, q)) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda t: -t[0])
        least = joined[-1][0]
        joined = [(s - least, m) for s, m in joined]  # only differences matter
        heapq.heappush(heap, (-joined[0][0], serial, joined))
        serial += 1
    out = [0] * len(sizes)
    for way, (_, members) in enumerate(heap[0][2]):
        todo = [members]
        while todo:
            m = todo.pop()
            if len(m) == 1:
                out[m[0]] = way
            else:
                todo.extend(m)
    return out


def balanced_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1), text_crc32, shard and slot of every row of docs.

    Equal texts share a shard; a null text counts as an empty one. slot counts the rows of a shard from
    0 without gaps, in the order of doc_id, nulls first; rows with equal ids follow in the order of their
    texts' digests. No shard can be smaller than the largest group it holds. An empty table gives an
    empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest")), "sized")
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundle = F.pmod(F.xxhash64("digest"), F.lit(shards * LARGE)).cast("string")
    groups = stage(rows.groupBy("digest").agg(F.sum("size").alias("size")), "groups")
    item = F.when(F.col("size") > total // (shards * LARGE), F.col("digest")).otherwise(bundle)
    # at most 2 * shards * LARGE rows
    items = groups.groupBy(item.alias("item")).agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "item").toPandas()
    placed = karmarkar_karp(items["size"].tolist(), shards)
    where = spark.createDataFrame(list(zip(items["item"].tolist(), placed, strict=True)), "item string, shard int")
    large, small = F.broadcast(where.where("length(item) = 32").withColumnsRenamed({"item": "digest", "shard": "own"})), F.broadcast(where.where("length(item) < 32").withColumnsRenamed({"item": "bundle", "shard": "shared"}))
    dealt = rows.withColumn("bundle", bundle).join(large, "digest", "left").join(small, "bundle", "left").withColumn("shard", F.coalesce("own", "shared")).drop("own", "shared", "bundle")
    ranked = running_sums(dealt, ["shard"], [F.col("doc_id").asc_nulls_first(), F.col("digest")], {"rank": F.lit(1)}, "shards")
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - 1).alias("slot"))
