import random
import re
import zlib

import pytest

from kinfold.llm import line_dedup
from kinfold.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, min_words):
    """(text, removed) of each document; docs in the order that decides which copy is first."""
    axis = [(d, k) for d, t in enumerate(docs) for k, _ in enumerate((t or "").split("\n"))]
    lines = [x for t in docs for x in (t or "").split("\n")]
    end = {}
    for p, (d, _) in enumerate(axis):
        end[d] = p + 1
    n_words = [len(WORD.findall(x)) for x in lines]
    first, drop = {}, set()
    for p, (d, _) in enumerate(axis):
        q, w = p, 0
        while q < end[d] and w < min_words:
            w += n_words[q]
            q += 1
        if w < min_words:
            continue
        f = first.setdefault(tuple(lines[p:q]), p)
        if f != p:
            n = 0
            while p + n < end[d] and f + n < end[axis[f][0]] and lines[p + n] == lines[f + n]:
                n += 1
            drop |= set(range(p, p + n))
    out = []
    for d, t in enumerate(docs):
        own = [p for p, (x, _) in enumerate(axis) if x == d]
        gone = [p for p in own if p in drop]
        out.append(("\n".join(lines[p] for p in own if p not in drop) if gone else t, len(own), len(gone)))
    return out


def check(spark, docs, min_words):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id long, text string, source string")
    got = line_dedup.without_repeats(df, min_words)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    assert [(r.text, r.n_lines, r.n_removed) for r in got.orderBy("doc_id").collect()] == brute(docs, min_words)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_documents(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(f"{c}{j}" for j in range(rng.randrange(4))) for c in "abcdefg"]
    docs = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(25)]
    block = "\n".join(rng.choice(pool) + str(rng.random()) for _ in range(40))
    docs += [block, f"head\n{block}\ntail", block, f"{block}\n{block}"]
    check(spark, docs, 5)


def test_edges(spark):
    long = "\n".join(f"line number {k} of a very long text" for k in range(700))
    check(spark, [None, "", "\n\n\n", long, "x\n" + long, long, "one", "one", "w " * 60, "w " * 60, "w " * 60 + "\nend"], 50)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.without_repeats(df).count() == 0
    rows = [(None, "w " * 60), (1, "w " * 60), (1, "w " * 60), (None, None)]
    got = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and sorted(r.n_removed for r in got) == [0, 0, 1, 1]


def brute_all(docs, min_words):
    """As brute(), but each run is as long as its longest match with any earlier position."""
    axis = [(d, k) for d, t in enumerate(docs) for k, _ in enumerate((t or "").split("\n"))]
    lines = [x for t in docs for x in (t or "").split("\n")]
    end = {d: p + 1 for p, (d, _) in enumerate(axis)}
    n_words = [len(WORD.findall(x)) for x in lines]
    drop, at = set(), {}
    for p, (d, _) in enumerate(axis):
        most = 0
        for f in at.setdefault(lines[p], []):
            n = 0
            while p + n < end[d] and f + n < end[axis[f][0]] and lines[p + n] == lines[f + n]:
                n += 1
            most = max(most, n)
        at[lines[p]].append(p)
        if sum(n_words[p : p + most]) >= min_words:
            drop |= set(range(p, p + most))
    out, p = [], 0
    for t in docs:
        own = range(p, p + len((t or "").split("\n")))
        gone, p = [q for q in own if q in drop], own.stop
        out.append(("\n".join(lines[q] for q in own if q not in drop) if gone else t, len(own), len(gone)))
    return out


def check_all(spark, docs, min_words):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = line_dedup.without_repeats(df, min_words).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_removed) for r in got] == brute_all(docs, min_words)


def test_longest_of_all_earlier_matches(spark):
    long, tail = "w " * 60, "ten more words that only the later copies do have"
    check_all(spark, [long, f"{long}\n{tail}", f"{long}\n{tail}"], 50)


@pytest.mark.parametrize("seed", [2, 64])
def test_random_matches_of_many_depths(spark, seed):
    rng = random.Random(seed)
    tails = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(120)]
    check_all(spark, [f"{'w ' * 9}\n{t}" for t in tails] + ["\n".join(["v " * 9] * 12)] * 2, 8)


def test_query_equals_brute_force(spark):
    """The whole query, production parameters, on whole tables."""
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    want = {i: (n, gone, len(t), zlib.crc32(t.encode())) for (i, _), (t, n, gone) in zip(rows, brute_all([t for _, t in rows], 50))}
    got = {r.doc_id: tuple(r)[1:] for r in Q.op4_suffix_array_line_dedup(spark, d).collect()}
    assert got == want and any(gone for _, gone, _, _ in want.values())


def test_blank_lines_stretch_a_run(spark):
    """Runs of hundreds of lines with few words, so that many rounds are needed."""
    block = "\n".join("" if k % 40 else f"a few words {k}" for k in range(400))
    check_all(spark, [block, "head\n" + block, block + "\n\n\nend", "\n" * 99], 20)


def test_clashing_names_and_often_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 3)
    rows = [(1, "w " * 60, k, 7, 8) for k in range(20)] + [(1, "few", k, 7, 8) for k in range(20)] + [(2, "x\n" + "w " * 60, 0, 7, 8), (3, None, 0, 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int, nth int, n_lines int")
    got = line_dedup.without_repeats(df)
    assert got.columns == ["doc_id", "text", "h", "nth", "n_lines", "_n_lines", "n_removed"]
    found = got.collect()
    assert sorted((r.doc_id, r.h) for r in found) == sorted((r[0], r[2]) for r in rows) and all(r.n_lines == 8 for r in found)
    assert sorted(r.text for r in found if r.doc_id == 1) == sorted([""] * 19 + ["w " * 60] + ["few"] * 20)
    assert [(r.text, r._n_lines, r.n_removed) for r in found if r.doc_id > 1 and r.text] == [("x", 2, 1)]
