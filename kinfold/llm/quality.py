"""Quality: a generalised additive model with pairwise interactions over statistics of the text.

Each statistic is cut into bins at quantiles of a bounded labelled sample. Boosting goes round the
statistics in turn; each turn fits a tree of at most three leaves to the current residuals and adds it,
shrunk, to that statistic's lookup table. Then the pairs whose four quadrants explain most of what is
left get two-way tables in the same way. A score is the sum of one table entry for each statistic and
pair. Texts are read once: their statistics are kept as a narrow table, for the fit and for the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import bounded_sample, is_held_out, python_ready, stage, text_chunks, word_hashes

#: Bound of the labelled rows that a fit uses.
SAMPLE_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 8, 250, 100, 6, 0.08

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "stops", "symbols", "marks", "non_ascii", "spaces", "lines_per_word",
    "distinct_words", "commonest_word", "repeated_next", "short_words", "bars", "brackets", "line_words", "distinct_pairs",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:?", "symbols": b"#$%&*@^~=+", "marks": b"!\"'", "bars": b"|\\/_-",
    "brackets": b"<>[](){}", "non_ascii": bytes(range(128, 256)), "spaces": b" \t\r\x0b\x0c", "lines": b"\n",
}


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of NAMES for each text. Texts without bytes or words have zeros where nothing can be counted."""
    n = np.diff(offsets).astype(float)
    counts = {}
    for name, chars in _CLASSES.items():
        table = np.zeros(256, np.uint8)
        table[list(chars)] = 1
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=total[1:])
        counts[name] = np.diff(total[offsets]).astype(float)
    words, at = word_hashes(data, offsets)
    k = np.diff(at).astype(float)
    by, kw = np.maximum(n, 1), np.maximum(k, 1)
    size = np.maximum(n - counts["spaces"] - counts["lines"], 0)
    more = np.zeros((len(n), 4))
    for d in range(len(n)):
        w = words[at[d] : at[d + 1]]
        if len(w):
            _, c = np.unique(w, return_counts=True)
            pairs = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / (len(w) - 1) if len(w) > 1 else 1.0
            more[d] = len(c) / len(w), c.max() / len(w), (w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0, pairs
    return np.stack([
        np.log1p(n), np.log1p(k), size / kw, counts["upper"] / by, counts["digits"] / by, counts["stops"] / by, counts["symbols"] / by, counts["marks"] / by,
        counts["non_ascii"] / by, counts["spaces"] / by, counts["lines"] / kw, more[:, 0], more[:, 1], more[:, 2], k / by, counts["bars"] / by,
        counts["brackets"] / by, k / (counts["lines"] + 1), more[:, 3],
    ], axis=1)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, stats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(*chunk) for chunk in text_chunks(batch.column("text"))]
            flat = np.concatenate(rows).astype(np.float32) if rows else np.zeros((0, len(NAMES)), np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(NAMES)), pa.array(flat.ravel()))
            yield pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "stats"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, stats array<float>")


@dataclass
class Model:
    cuts: list[np.ndarray]  # inner bin edges of each statistic
    coarse: list[np.ndarray]  # those of the two-way tables
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        if self.pairs:
            wide = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for j in {j for p in self.pairs for j in p}}
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[wide[i], wide[j]]
        return total


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The values, bin by bin, of a tree grown best split first over sums of residuals and weights."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p in parts:
            a, b = p
            if b - a < 2:
                continue
            c = np.arange(a + 1, b)
            gain = _gain(G[c] - G[a], H[c] - H[a]) + _gain(G[b] - G[c], H[b] - H[c]) - _gain(G[b] - G[a], H[b] - H[a])
            gain[(H[c] - H[a] < 1) | (H[b] - H[c] < 1)] = 0
            if gain.max() > best[0]:
                best = (gain.max(), p, int(c[gain.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut in each of two directions at once: its gain, and the values of its four quadrants."""
    G, H = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best = (0.0, np.zeros_like(g))
    for a in range(1, g.shape[0]):
        for b in range(1, g.shape[1]):
            q = [(X[a, b], X[a, -1] - X[a, b], X[-1, b] - X[a, b], X[-1, -1] - X[a, -1] - X[-1, b] + X[a, b]) for X in (G, H)]
            gain = sum(_gain(x, y) for x, y in zip(*q, strict=True)) - _gain(G[-1, -1], H[-1, -1])
            if gain > best[0]:
                v = np.array(q[0]) / (np.array(q[1]) + 1.0)
                out = np.empty_like(g)
                out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = v
                best = (float(gain), out)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit to rows of statistics and labels 0 and 1; without both labels the score is their share, or 0.5."""
    share = (y.sum() + 1e-3) / (len(y) + 2e-3)
    model = Model([_edges(c, BINS) for c in x.T] if len(x) else [np.zeros(0)] * len(NAMES), [_edges(c, COARSE) for c in x.T] if len(x) else [np.zeros(0)] * len(NAMES), [], [], [], float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(c, col, "right") for c, col in zip(model.cuts, x.T, strict=True)]
    total = np.full(len(y), model.bias)
    p = 1 / (1 + np.exp(-total))
    for _ in range(ROUNDS):
        for j, b in enumerate(at):
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size))
            model.tables[j] += step
            total += step[b]
            p = 1 / (1 + np.exp(-total))
    wide = [np.searchsorted(c, col, "right") for c, col in zip(model.coarse, x.T, strict=True)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = wide[i] * shape[1] + wide[j]
        return cell, np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((-_quadrants(*sums(i, j)[1:])[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(model.pairs):
            cell, g, h = sums(i, j)
            step = RATE * _quadrants(g, h)[1]
            model.pair_tables[k] += step
            total += step.ravel()[cell]
            p = 1 / (1 + np.exp(-total))
    return model


def fit(described: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most sample_rows labelled rows that are not held out, taken in the order of a hash of their ids.

    labels: doc_id, quality. Rows with a null id or label are ignored; a doc_id with several labels takes
    the lowest. Where ids have more rows than that, as many different ones are taken in the order of a hash
    of id and statistics.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~is_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = bounded_sample(known, sample_rows)
    # at most sample_rows ids: a bounded broadcast
    rows = described.join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("stats")).dropDuplicates(["doc_id", "h"])
    rows = bounded_sample(rows, sample_rows, "doc_id", "h").toPandas().sort_values(["doc_id", "h"], kind="stable")
    x = np.array(rows["stats"].tolist(), np.float32).reshape(-1, len(NAMES))
    return train(x, (rows["quality"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of docs: 0 to 1, higher where label 1 is likelier. Null texts score as empty ones do."""
    python_ready(docs.sparkSession)
    described = stage(describe(docs), "statistics")
    held = docs.sparkSession.sparkContext.broadcast(fit(described, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            p = 1 / (1 + np.exp(-np.clip(held.value.logits(x), -30, 30)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return described.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
