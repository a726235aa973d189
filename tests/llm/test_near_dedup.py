import re
from itertools import combinations

import pytest

from kinfold.llm import near_dedup
from kinfold.llm import queries as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, k))
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for ids in index.values():
        for a, b in combinations(ids, 2):
            if (a, b) in seen:
                continue
            seen.add((a, b))
            c = len(sets[a] & sets[b])
            if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(rows, 3, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op6_minmax_near_dedup(spark, d).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_hot_group_with_links_between_members_only(spark, monkeypatch):
    """A chain: each text is linked with the next two only, so one leader never suffices."""
    monkeypatch.setattr(near_dedup, "BLOCK", 900)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100]), "x") for i in range(120)] + [(1000 + i, "same text of a hot group here", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(df).collect()}
    assert got == brute([r[:2] for r in rows], 5, 80, 100)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (5, "ONE"), (7, "a " * 50000), (8, "b c d e f g"), (9, "É b c d e f")]
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, None: None, 7: 7, 8: 8, 9: 9}
    assert {r.doc_id: r.n_shingles for r in got}[3] == 0
    assert near_dedup.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_row_repeated_for_a_third_of_the_table_meets_its_node_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(4, " ".join(words))] * 200 + [(2, near)] + [(i, f"text {i} has words of its own, {i} of them") for i in range(10, 400)]
    seen = []
    monkeypatch.setattr(near_dedup, "full_sets", lambda docs, size, f=near_dedup.full_sets: seen.append(docs.count()) or f(docs, size))
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and seen == [2]
    assert {(r.doc_id, r.component_id) for r in got} == {(i, 2 if i in (2, 4) else i) for i, _ in rows}


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_banding_misses_next_to_nothing(t):
    rows, bands = near_dedup.banding(t)
    assert (1 - t**rows) ** bands <= 5e-8 and rows * bands % 2 == 0
