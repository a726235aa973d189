"""A corpus from raw documents to token ids, in five stages.

Each stage takes what the one before has written and all but the last return the columns of documents.
The rows of run() cannot be expressed in SQL (trained scores, MinHash, a tokenizer); tests/llm/test_pipeline.py
holds each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, huffman, mixing, near_dedup, toxicity
from kinfold.llm.common import WORD, free_name, hot_join, passing, read, row_key, scratch, stage
from kinfold.llm.queries import word_bpe

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, by a model fitted to the labelled ones among them."""
    return toxicity.accepted(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group with 5-word shingle similarities of 0.8 or more.

    Each row counts by its own text, whatever its doc_id. The smallest has the smallest doc_id, those
    without one being last, then the smallest hash of the row. Texts without words are like nothing: of
    those that agree in all columns one row stays, and every row without a doc_id.
    """
    a, b = (free_name(docs, c) for c in ("_k1", "_k2"))
    k1, k2 = row_key(docs)
    rows = docs.withColumns({a: k1, b: k2})
    who = F.struct(F.isnull("doc_id").alias("none"), "doc_id", F.col(a).alias("k1"), F.col(b).alias("k2"))
    groups = near_dedup.near_components(rows.select(who.alias("doc_id"), "text"), shingle=5, threshold=(80, 100))
    kept = groups.where("doc_id = component_id").select(F.col("doc_id.k1").alias(a), F.col("doc_id.k2").alias(b)).distinct()
    lost = F.isnull("doc_id") & ~F.coalesce("text", F.lit("")).rlike(WORD)
    # rows that agree in all columns are one; as many rows stay as there are groups: one plan at every size
    once = rows.where(~lost).dropDuplicates([a, b]).join(kept.hint("merge"), [a, b], "left_semi")
    return once.select(docs.columns).unionByName(docs.where(lost))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window similar to a benchmark item. Each row is judged by its own text, whatever its doc_id."""
    hit, found = free_name(docs, "_hit"), free_name(docs, "_found")
    key = F.concat_ws("/", F.xxhash64("text"), F.hash("text", F.lit(7)))
    hits = decontaminate.contaminations(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    hits = stage(hits.select(F.col("doc_id").alias(hit)).distinct().withColumn(found, F.lit(True)), "hits")
    # a text may be that of any share of the rows
    judged = hot_join(docs.withColumn(hit, key), hits, [hit], how="left")
    return judged.where(F.isnull(found)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources weigh 3, 1, 2, repeating, and share 150 % of all words."""
    return mixing.mixed(docs)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids are in the Huffman-coded files, how many, and their checksum."""
    path = scratch(spark, "token-ids")
    huffman.write(docs, path, word_bpe())
    return huffman.read(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_ids", to_token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        with passing(spark):  # what a step has staged goes once its result is written
            docs = stage(step(spark, docs, sf_dir), name, keep=True)
    return docs
