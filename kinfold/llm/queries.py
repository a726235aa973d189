"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import centroids, decontaminate, huffman, line_dedup, mixing, near_dedup, parity_join, periodic, preference, quality, sharding, topk, toxicity
from kinfold.llm.common import WORD, is_held_out, read, scratch


def op1_preference_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against alternatives with another last answer, as rendered segments.

    Conversations without an answer, and the last one with an answer, make no pair.
    """
    chosen, rejected = preference.answer_pairs(read(spark, sf_dir, "conversations"))
    return preference.segments(chosen, rejected)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as Huffman-coded token ids, written and read back."""
    path = scratch(spark, "token-ids")
    huffman.write(read(spark, sf_dir, "documents"), path, word_bpe())
    return huffman.read(spark, path)


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    found = near_dedup.near_components(read(spark, sf_dir, "documents"), shingle=3, threshold=(85, 100))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op3_block_pruned_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all vectors for every 20th one."""
    vectors = topk.integer_vectors(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op4_suffix_array_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without later copies of runs of lines of 50 words or more."""
    found = line_dedup.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("kept_chars"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of each document."""
    found = mixing.copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a window similar to a benchmark item."""
    return decontaminate.contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_nb_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = read(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    found = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    found = sharding.balanced_shards(read(spark, sf_dir, "documents"), 16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, told by the crc32 of the id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).alias("words"))
    n = F.size("words")
    placed = split.withColumn("a", F.when(n > 0, F.col("g") % F.greatest(n, F.lit(1))).cast("int"))
    placed = placed.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), n - F.col("a"))), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document, and what is left of it with each run cut down to its first period."""
    found = periodic.collapse_runs(with_planted_repeats(read(spark, sf_dir, "documents")), 24, 3)
    # the greatest exponent exactly: fractions are compared crosswise; runs come by start, then period
    best = F.aggregate("runs", F.element_at("runs", 1), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op12_table_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 16 clusters, after three rounds from hashed starts."""
    found = centroids.cluster(read(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, seed=1)
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


def op13_parity_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a similarity of 0.85 or more."""
    return parity_join.jaccard_components(read(spark, sf_dir, "documents"), shingle=4, threshold=(85, 100))


QUERIES = {
    f.__name__: f
    for f in (op1_preference_segments, op2_huffman_token_ids, op3_block_pruned_top_k, op4_suffix_array_line_dedup, op5_systematic_mix, op6_minmax_near_dedup, op7_simhash_decontamination, op8_nb_ngram_toxicity, op9_additive_quality, op10_differencing_shards, op11_periodic_runs, op12_table_centroids, op13_parity_jaccard_join)
}

ORACLE: dict[str, str] = {}
ORACLE["op5_systematic_mix"] = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k
), weighed AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::INT] AS weight FROM per
), levels AS (
  SELECT *, cap / weight AS lim, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS remaining
  FROM weighed
), aims AS (
  SELECT k, source_size, CASE WHEN max(CASE WHEN lim > (total - used) / remaining THEN (total - used) / remaining END) OVER () IS NULL THEN cap
    ELSE least(cap, weight * max(CASE WHEN lim > (total - used) / remaining THEN (total - used) / remaining END) OVER ()) END AS target
  FROM levels
), steps AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 1073741824)::BIGINT ELSE 0 END AS e, ('0x' || substr(md5('mix/' || k), 1, 7))::BIGINT * 4 AS u FROM aims
), walked AS (
  SELECT doc_id, size, source_size, target, e, u,
    (sum(e) OVER (PARTITION BY k ORDER BY size DESC, md5(coalesce(doc_id::VARCHAR, '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto
  FROM sized JOIN steps USING (k)
)
SELECT doc_id, size, source_size, target, (((upto + u) // 1073741824 - (upto - e + u) // 1073741824) * size)::BIGINT AS taken FROM walked
"""

ORACLE["op1_preference_segments"] = r"""
WITH numbered AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS seq FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
  SELECT conv_id, seq AS at_seq, text, lead(conv_id) OVER (ORDER BY conv_id) AS next_conv, lead(text) OVER (ORDER BY conv_id) AS other
  FROM (SELECT *, max(seq) OVER (PARTITION BY conv_id) AS last_seq FROM numbered WHERE role = 'assistant') WHERE seq = last_seq
), pairs AS (
  SELECT * FROM answers WHERE next_conv IS NOT NULL
), turns AS (
  SELECT n.conv_id AS pair_id, n.seq, n.role, n.text AS t1, CASE WHEN n.seq = p.at_seq THEN p.other ELSE n.text END AS t2,
    CASE WHEN p.text IS NOT DISTINCT FROM p.other THEN NULL ELSE p.at_seq END AS split
  FROM numbered n JOIN pairs p ON p.conv_id = n.conv_id
), parts AS (
  SELECT pair_id, CASE WHEN split IS NULL OR seq < split THEN 'prompt' ELSE 'chosen' END AS part, seq, role, t1 AS text FROM turns
  UNION ALL SELECT pair_id, 'rejected', seq, role, t2 FROM turns WHERE seq >= split
), rendered AS (
  SELECT pair_id, part, seq, role, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS rendered FROM parts
)
SELECT pair_id, part, seq, role, rendered, part <> 'prompt' AND role IS NOT DISTINCT FROM 'assistant' AS train,
  coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
FROM rendered
"""
ORACLE["op3_block_pruned_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _centroid_rounds(k: int, rounds: int, dims: int) -> str:
    """The rounds of op12 written out: n0 has the first centroids, a<i> the assignments to n<i>."""
    def assign(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT rn, vec_id, v, d[1] AS distance, d[2] AS c FROM (
    SELECT rn, vec_id, v, (SELECT min([list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, c]) FROM n{i}) AS d FROM v)
)"""

    def move(i: int) -> str:
        return f"""n{i + 1} AS MATERIALIZED (
  SELECT n.c, coalesce(s.m, n.m) AS m FROM n{i} n LEFT JOIN (
    SELECT c, list(floor_mean ORDER BY j) AS m FROM (
      SELECT c, j, (sum(x)::BIGINT - ((sum(x)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
      FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS j FROM a{i}) GROUP BY c, j) GROUP BY c
  ) s ON s.c = n.c
)"""

    steps = [s for i in range(rounds) for s in (assign(i), move(i))]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k})
), {", ".join(steps + [assign(rounds)])}
SELECT a.vec_id, a.c::INT AS cluster, a.distance, (sum(a.distance) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(n.m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN n{rounds} n ON n.c = a.c
"""


ORACLE["op12_table_centroids"] = _centroid_rounds(16, 3, 64)
