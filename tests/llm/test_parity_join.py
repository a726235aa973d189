import random

import numpy as np
import pytest

from kinfold.llm import parity_join
from kinfold.llm import queries as Q
from tests.llm.test_near_dedup import brute


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(rows, 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op13_parity_jaccard_join(spark, d).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_near_the_threshold(spark):
    """Pairs of all sizes that differ by just as much as they may, or by one token more."""
    rng, rows = random.Random(5), []
    for k, n in enumerate([*range(6, 60), *range(60, 700, 23)]):
        most = parity_join.most_difference(n, n, 85, 100)
        words = [f"d{k}w{i}" for i in range(n + 3)]
        rows.append((4 * k, " ".join(words)))
        for more in (0, 2):  # a change of the end words changes as many shingles
            cut = (most + more) // 2
            rows.append((4 * k + 1 + more, " ".join(words[: n + 3 - cut] + [f"e{rng.random()}" for _ in range(cut)])))
        rows.append((4 * k + 2, " ".join(words + [f"x{k}y{i}" for i in range(most)])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect()}
    assert got == brute(rows, 4, 85, 100)


def test_hot_group_with_links_between_members_only(spark, monkeypatch):
    """A chain: each text is linked with the next two only, so one leader never suffices."""
    monkeypatch.setattr(parity_join, "BLOCK", 900)
    monkeypatch.setattr(parity_join, "BIN", 3000)
    monkeypatch.setattr(parity_join, "LEADERS", 2)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100]), "x") for i in range(120)] + [(1000 + i, "same text of a hot group here", "y") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(df).collect()}
    assert got == brute([r[:2] for r in rows], 5, 80, 100)


def test_hot_keys_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "OFTEN", 3)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: 119 - i % 5], f"end{i % 30}"])) for i in range(200)] + [(500 + i, f"lone text number {i} " * 4) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute(rows, 5, 80, 100)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one"), (5, "ONE"), (7, "a " * 50000), (8, "b c d e f g"), (9, "É b c d e f")]
    rows += [(None, "p q r s t u v w x y z"), (10, "p q r s t u v w x y z"), (10, "other text of that document"), (11, "p q r s t u v w x y z a"), (12, "P q r s t u v w x y z")]
    got = parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, None: None, 7: 7, 8: 8, 9: 9, 10: 10, 11: 10, 12: 10}
    assert parity_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        parity_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, (1, 2))


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (95, 100), (6, 10)])
def test_pigeonhole(num, den):
    """Sets that may just be linked share a band and a key in it; their sketches are no further apart than the sets."""
    rng = np.random.default_rng(7)
    for n in [*range(2, 40), 100, 333, 1000, 4000]:
        token = rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64)
        for b in {n, n * den // num, n + 1}:
            if num * b > den * n:
                continue
            common = -(-(n + b) * num // (num + den))
            x, y = token[:n], token[n - common : n - common + b]
            assert den * common >= num * (n + b - common)
            shared = set(parity_join.layouts(n, num, den)) & set(parity_join.layouts(b, num, den))
            keys = [set(np.concatenate([parity_join.block_keys(s, j, num, den) for j in shared])) - {0} for s in (x, y)]
            assert shared and keys[0] & keys[1]
            assert parity_join.near(parity_join.parity_bits(x), parity_join.parity_bits(y), n, b, num, den)


def test_unrelated_sets_do_not_meet():
    rng = np.random.default_rng(8)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (300, 320, 340, 360) for _ in range(20)]
    keys = [set(np.concatenate([parity_join.block_keys(s, j, 85, 100) for j in parity_join.layouts(len(s), 85, 100)])) - {0} for s in sets]
    assert sum(bool(keys[i] & keys[j]) for i in range(len(sets)) for j in range(i)) < 5
    sketch = parity_join.parity_bits(sets[0])
    assert len(sketch) == 8 and (parity_join.fold(sketch, 2) == parity_join.fold(parity_join.fold(sketch, 4), 2)).all()
