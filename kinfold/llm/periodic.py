"""Periodic runs of words, and texts with each run cut down to its first period.

A run of period q and length m that begins at word p is a pair of suffixes, p and p + q, with m - q words in
common. Suffixes of one text are put in order by prefix doubling, whose ranks at each depth also tell the common
prefix (LCP) of any two of them. Then, as Kruskal's method does, classes of suffixes are united by decreasing LCP
of neighbours in that order: a union-find over position sets that are kept in order, the smaller set going into the
larger. Two positions that become neighbours in their set when it is made at depth l have l words in common; if
they are q <= l words apart, no position between them could be in the class unless q is a multiple of a smaller
period, so q is the smallest period and the two seed a run. Of the seeds of a run the leftmost is kept, the one
whose words before its two positions differ.

A run of `least` words and `times` periods needs an LCP of max(least - q, (times - 1) q), which is 16 words or more
for 24 and 3: only texts where some window of so many words occurs twice are put in order at all.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kinfold.llm.common import mix, python_ready

#: Words of short texts that are handled together in a task; a longer text is handled alone.
CHUNK_WORDS = 1 << 17
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def needed(least: int, times: int) -> int:
    """The smallest LCP that a run can have."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def _repeating(ids: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the documents in which a window of width words may occur twice. Hashes only choose where to look."""
    if len(ids) < width:
        return doc[:0]
    with np.errstate(over="ignore"):
        h, size = mix(ids.astype(np.uint64) + np.uint64(1)), 1
        while size < width:
            step = min(size, width - size)  # two windows of size words, overlapping at the end
            h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] + np.uint64(step))
            size += step
        whole = doc[: len(h)] == doc[width - 1 :]
        h, of = (h + mix(doc[: len(h)].astype(np.uint64) + np.uint64(7)))[whole], doc[: len(h)][whole]
    order = np.argsort(h)
    h = h[order]
    return np.unique(of[order[1:][h[1:] == h[:-1]]])


def suffix_levels(ids: np.ndarray) -> list[np.ndarray]:
    """Ranks of all positions by their first 1, 2, 4, ... symbols, until all differ; the last one ranks the suffixes. The last symbol must occur once."""
    rank = np.unique(ids, return_inverse=True)[1]
    levels, n = [rank.astype(np.int32)], len(ids)
    while rank.max(initial=-1) < n - 1:
        step = 1 << (len(levels) - 1)
        key = rank * np.int64(n + 1)
        key[: n - step] += rank[step:] + 1
        rank = np.unique(key, return_inverse=True)[1]
        levels.append(rank.astype(np.int32))
    return levels


def neighbours(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes that follow one another in the order and have at least so many symbols in common: both positions and their LCP."""
    order = np.empty(len(levels[-1]), np.int64)
    order[levels[-1]] = np.arange(len(order))
    a, b = order[:-1], order[1:]
    if (k := least.bit_length() - 1) < len(levels):
        near = levels[k][a] == levels[k][b]
        a, b = a[near], b[near]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        lcp += (levels[k][a + lcp] == levels[k][b + lcp]).astype(np.int64) << k
    near = lcp >= least
    return a[near], b[near], lcp[near]


def _seeds(a: np.ndarray, b: np.ndarray, lcp: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(position, distance, LCP) of positions that become neighbours, when classes are united by decreasing LCP, and are near enough for a run."""
    order = np.argsort(-lcp, kind="stable")
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, sets, out = list(range(len(nodes))), [[p] for p in nodes.tolist()], []
    x, y = ends[: len(a)][order].tolist(), ends[len(a) :][order].tolist()
    for i, j, depth in zip(x, y, lcp[order].tolist(), strict=True):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if len(sets[i]) < len(sets[j]):
            i, j = j, i
        large, small = sets[i], sets[j]
        up[j], sets[j] = i, None
        most, fewest, last = depth // (times - 1), least - depth, -1
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            # its neighbours in the united set, where they are from the other set
            if at and large[at - 1] > last and fewest <= p - large[at - 1] <= most:
                out.append((large[at - 1], p - large[at - 1], depth))
            if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]) and fewest <= large[at] - p <= most:
                out.append((p, large[at] - p, depth))
            last = p
        if len(small) * 16 < len(large):
            for p in small:
                large.insert(bisect_left(large, p), p)
        else:
            large += small
            large.sort()  # two ordered stretches are merged
    return out


def find_runs(texts: list[list[bytes]], least: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each list of words, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    width = needed(least, times)
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    known = {w: i for i, w in enumerate(dict.fromkeys(w for words in texts for w in words))}
    ids = np.fromiter((known[w] for words in texts for w in words), np.int64, len(doc))
    some = _repeating(ids, doc, width)
    if not len(some):
        return found
    # texts one after another, each with words of its own and an end that occurs once
    lengths = np.array([len(texts[d]) + 1 for d in some])
    begin = np.concatenate([[0], np.cumsum(lengths)])
    own = np.repeat(np.arange(len(some)), lengths)
    line = own * np.int64(len(known) + 1) + len(known)
    inside = np.ones(len(line), bool)
    inside[begin[1:] - 1] = False
    line[inside] += ids[np.isin(doc, some)] - len(known)
    for p, q, depth in _seeds(*neighbours(suffix_levels(line), width), least, times):
        if p == 0 or line[p - 1] != line[p + q - 1]:
            found[some[own[p]]].append((int(p - begin[own[p]]), depth + q, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def without_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """The periodic runs of every text, and the text without their repeats.

    docs has doc_id and text; other columns are ignored, whatever their names. Returns, for each row, doc_id, n_words,
    runs (array of start, length, period in words from 0, by start, then period) and text: the words that stay, joined
    by one space. A run is a stretch of at least `least` words and `times` (2 or more) periods, its period being the
    smallest, that no neighbouring word extends; a word is dropped if any run has it after its first period.

    Words are what the six ASCII white-space characters part. A null, empty or blank text has no words, no runs and
    the text ''. Repeated rows are returned as often as they are given; doc_id may be null and of any type. A text is
    handled whole in one task, in memory proportional to its words times the logarithm of its longest repeat.
    An empty table gives an empty result.
    """
    if times < 2 or least < 2:
        raise ValueError("a run has two periods and two words at least")
    python_ready(docs.sparkSession)

    def some(rows: list[list[bytes]]) -> pa.RecordBatch:
        runs = find_runs(rows, least, times)
        listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUNS)
        texts = pa.array([without_runs(w, r) for w, r in zip(rows, runs, strict=True)], pa.binary())
        return pa.record_batch([pa.array([len(w) for w in rows], pa.int64()), listed, texts.cast(pa.string())], names=["n_words", "runs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at, rows, size = batch.column("text").cast(pa.binary()), 0, [], 0
            for i in range(len(texts)):
                rows.append((texts[i].as_py() or b"").split())
                size += len(rows[-1])
                if size >= CHUNK_WORDS or i + 1 == len(texts):
                    part = some(rows)
                    yield pa.record_batch([batch.column("doc_id").slice(at, len(rows)), *part.columns], names=["doc_id", *part.schema.names])
                    at, rows, size = i + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, text string")
