"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Which of 2**HASH_BITS hashed n-grams a text holds is all that counts, never how often. From a bounded
sample of labelled texts come, for every n-gram, the log of the ratio of its share in texts of label 1
to its share in those of label 0. The n-grams that tell the labels apart best are kept, each worth its
ratio, and a logistic regression is fitted over them. Scoring is one pass over the texts without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded_sample, is_held_out, python_ready, stage, text_chunks

HASH_BITS = 18
SIZES = (3, 4, 5, 6)
#: Bound of the labelled rows that a fit uses, and of the n-grams that it keeps.
SAMPLE_ROWS, FEATURES = 20_000, 2048

_CODE = np.random.default_rng(8).integers(1, 1 << 32, 256, dtype=np.uint32)
_CODE[65:91] = _CODE[97:123]


@dataclass
class Model:
    weights: np.ndarray  # of every hashed n-gram, 0 for most
    bias: float


def grams(data: np.ndarray, offsets: np.ndarray, seen: np.ndarray) -> Iterator[np.ndarray]:
    """For each text its distinct hashed n-grams, A-Z lower-cased. seen: a scratch array over all hashes."""
    code = _CODE[data]
    hashed, h = [], code
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint32(0x01000193) + code[n - 1 :]
        if n in SIZES:
            hashed.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - HASH_BITS))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        own = np.concatenate([x[a : max(a, b - n + 1)] for n, x in zip(SIZES, hashed, strict=True)])
        order = np.arange(len(own), dtype=np.int32)
        seen[own] = order  # the last of equal hashes stays
        yield own[seen[own] == order]


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    seen = np.zeros(1 << HASH_BITS, np.int32)
    for data, offsets in text_chunks(column):
        yield from grams(data, offsets, seen)


def log_count_ratios(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """counts: texts of label 0 and of label 1 that hold each n-gram."""
    p = counts + smooth
    p = p / p.sum(1, keepdims=True)
    return np.log(p[1] / p[0])


def fit_logistic(items: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float = 0.3, steps: int = 150) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression over present features, each worth its scale, by Nesterov's method."""
    lengths = np.array([len(x) for x in items])
    rows = np.repeat(np.arange(len(items)), lengths)
    columns = np.concatenate(items).astype(np.int64)
    value = scale[columns]
    w, b = np.zeros(len(scale)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    # a bound of the curvature: the largest row's squared length, by power iteration over X'X
    v = np.ones(len(scale))
    for _ in range(15):
        v = np.bincount(columns, np.bincount(rows, value * v[columns], len(y))[rows] * value, len(scale))
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    rate = 1 / (0.25 * (norm + len(y)) + penalty)
    u, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, value * u[columns], len(y)) + c, -30, 30)))
        g = np.bincount(columns, (p - y)[rows] * value, len(scale)) + penalty * u
        w2, b2, t2 = u - rate * g, c - rate * (p - y).sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled texts that are not held out, taken in the order of a hash of their ids.

    labels: doc_id, toxic. Rows with a null id or label are ignored; a doc_id with several labels takes
    the highest. Repeated rows of an id and text count once, however many there are. Where ids have more different
    texts than sample_rows, as many are taken in the order of a hash of id and text. Without both labels in the
    sample, as in an empty table, the score is their share, or 0.5.
    """
    python_ready(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").where(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = bounded_sample(known, sample_rows)
    # at most sample_rows ids: a bounded broadcast, and the only texts that move
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "h"])
    texts = stage(rows.select("doc_id", "text", "h", F.col("toxic").cast("int").alias("toxic")), "labelled")
    if texts.count() > sample_rows:
        some = bounded_sample(texts.select("doc_id", "h"), sample_rows, "doc_id", "h")
        texts = stage(texts.join(F.broadcast(some), ["doc_id", "h"]).select("doc_id", "text", "h", "toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << HASH_BITS), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for y, own in zip(batch.column("toxic").to_pylist(), _each(batch.column("text")), strict=True):
                total[int(y > 0), own] += 1
                rows[int(y > 0)] += 1
        at = np.flatnonzero(total.sum(0) > 0)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], rows[0])), pa.array(np.append(total[1, at], rows[1]))], names=["gram", "n0", "n1"])

    # one row for each hashed n-gram at most
    found = texts.mapInArrow(count, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas().set_index("gram")
    n0, n1 = (int(x) for x in found.loc[-1]) if -1 in found.index else (0, 0)
    weights = np.zeros(1 << HASH_BITS, np.float32)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return Model(weights, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    found = found.drop(-1)
    counts = np.zeros((2, 1 << HASH_BITS))
    counts[0, found.index], counts[1, found.index] = found["n0"], found["n1"]
    ratio = log_count_ratios(counts)
    # how far the share of holders differs between the labels, in standard errors
    share, all_ = counts / [[n0], [n1]], counts.sum(0) / (n0 + n1)
    z = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(all_ * (1 - all_) * (1 / n0 + 1 / n1), 1e-12))
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    place = np.full(1 << HASH_BITS, -1, np.int64)
    place[best] = np.arange(len(best))

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x[x >= 0] for x in (place[g] for g in _each(batch.column("text")))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), batch.column("toxic"), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "h", "toxic", "grams"])

    # at most sample_rows rows
    rows = texts.mapInArrow(active, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, toxic int, grams array<long>").toPandas().sort_values(["doc_id", "h"], kind="stable")
    w, bias = fit_logistic([np.sort(np.asarray(x, np.int64)) for x in rows["grams"]], (rows["toxic"].to_numpy() > 0).astype(float), ratio[best])
    weights[best] = w * ratio[best]
    return Model(weights, bias)


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    total = np.array([model.weights[own].sum(dtype=np.float64) for own in _each(column)]) + model.bias
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row: 0 to 1, higher where label 1 is likelier.

    Null texts score as empty ones do, repeated rows each have their own row, an empty table gives none, and columns
    other than these two, whatever their names, are left out.
    """
    python_ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array(_scores(batch.column("text"), held.value), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all their columns, that score below the threshold. Repeated rows stay or go together; rows with a null id are judged by their text."""
    python_ready(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column("text"), held.value) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
