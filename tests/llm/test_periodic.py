import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from kinfold.llm import periodic
from kinfold.llm import queries as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=24, times=3):
    """All runs by comparing every word with the one q later, for every q; then those of a smaller period are left out."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            m = j + q - i
            if m >= max(least, times * q) and not any(all(w[x] == w[x + r] for x in range(i, i + m - r)) for r in range(1, q)):
                out.append((i, m, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    drop = {x for s, m, q in runs for x in range(s + q, s + m)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def samples(seed):
    rng = random.Random(seed)
    for n in (5, 30, 60, 120):
        for letters in ("a", "ab", "abc", "abcdefgh"):
            yield [rng.choice(letters) for _ in range(n)]
    for _ in range(12):  # powers of words, joined, with faults
        w = [x for _ in range(4) for x in [rng.choice("abcd") for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 12)]
        w[rng.randrange(len(w))] = "z"
        yield w
    inner = ["a", "b"] * 5 + ["c"]
    yield inner * 6


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (2, 2), (9, 4)])
def test_runs_equal_brute_force(least, times):
    texts = list(samples(least))
    got = periodic.find_runs([[x.encode() for x in w] for w in texts], least, times)
    assert got == [brute(w, least, times) for w in texts]
    assert any(len(r) > 1 for r in got)


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(3)
    x = np.append(rng.integers(0, 3, 200), 9)
    a, b, lcp = periodic.neighbours(periodic.suffix_levels(x), 1)
    suffix = [tuple(x[i:]) for i in range(len(x))]
    order = sorted(range(len(x)), key=lambda i: suffix[i])
    want = []
    for p, q in zip(order, order[1:]):
        n = 0
        while x[p + n] == x[q + n]:
            n += 1
        if n:
            want.append((p, q, n))
    assert list(zip(a.tolist(), b.tolist(), lcp.tolist())) == want


def plain(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_fast(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(w, runs)))


def brute_fast(w):
    """As brute(), by arrays, for whole texts."""
    known = {x: i for i, x in enumerate(dict.fromkeys(w))}
    x, out = np.array([known[y] for y in w], np.int64), []
    for q in range(1, len(x) // 3 + 1):
        same = np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()):
            m = j - i + q
            if m >= max(24, 3 * q) and not any((x[i : i + m - r] == x[i + r : i + m]).all() for r in range(1, q)):
                out.append((i, m, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r.doc_id: tuple(r[c] for c in names) for r in Q.op11_periodic_runs(spark, d).collect()}
    want = {r.doc_id: plain(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    assert got == want
    assert sum(r[0] > 0 for r in want.values()) > 40


def test_edges(spark):
    long = " ".join(f"w{i % 7}" if i > 20000 else f"u{i}" for i in range(60000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a " * 23, "x"), (5, "a " * 24, "x"), (5, "a " * 24, "x"), (None, "a\tb\n" * 12 + "c", "x"), (6, "É  " * 30, "x"), (7, long, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.collapse_runs(df)
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.text))
    assert by[1] == by[2] == by[3] == [(0, [], "")]
    assert by[4] == [(23, [], "a " * 22 + "a")] and by[5] == [(24, [(0, 24, 1)], "a")] * 2
    assert by[None] == [(25, [(0, 24, 2)], "a b c")] and by[6] == [(30, [(0, 30, 1)], "É ")]
    assert by[7] == [(60000, [(20001, 39999, 7)], " ".join(long.split()[:20008]))]
    assert periodic.collapse_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.collapse_runs(df, 24, 1)


def test_planted_repeats(spark):
    rows = [(i, t) for i in range(60) for t in (None, "", "one", " ".join(f"w{k}" for k in range(i * 3)))] + [(None, "x y")]
    got = Q.with_planted_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    moved = 0
    for r, (i, t) in zip(got, rows):
        w, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            moved += 1
        assert WORD.findall(r.text or "") == w
    assert moved > 5
