import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.llm import common
from kinfold.llm.common import shingle_hashes, text_chunks, word_count, word_hashes
from kinfold.llm.components import components
from kinfold.llm.running import running_sums

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = st.text(st.sampled_from("aB é\t\n\x0b\x0c\r\x1c\x85\xa0"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, max_size=8), st.integers(1, 40))
def test_word_hashes(texts, limit):
    got = []
    for data, offsets in text_chunks(pa.array(texts, pa.string()), limit):
        h, at = word_hashes(data, offsets)
        s, begin = shingle_hashes(h, at, 3)
        got += [(h[a:b].tolist(), s[c:d].tolist()) for a, b, c, d in zip(at, at[1:], begin, begin[1:])]
    assert len(got) == len(texts)
    low = [WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    names = {}
    for w, (h, s) in zip(low, got):
        assert len(h) == len(w) and all(names.setdefault(x, y) == y for x, y in zip(w, h))
        grams = [tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        assert len(s) == len(grams) and all(names.setdefault(x, y) == y for x, y in zip(grams, s))
    assert len(set(names.values())) == len(names)


def test_word_count(spark):
    rng = np.random.default_rng(5)
    texts = ["", " ", "a", "a b", " a b", "a b ", "a  b", *("".join(rng.choice(list("ab é\t\n\x0b\x0c\r\x1c\xa0"), rng.integers(1, 9))) for _ in range(500))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.n == len(WORDS.findall(r.t)) for r in df.select("t", word_count(df["t"]).alias("n")).collect())


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in up}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_running_sums(spark):
    from pyspark.sql import functions as F

    rows = [("hot", i, i % 7) for i in range(500)] + [("b", 3, 1), ("b", 1, 5), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, o int, x int")
    got = running_sums(df.repartition(5), ["k"], [F.col("o")], {"s": F.col("x"), "n": F.lit(1)}, "t").collect()
    want = {("hot", i): (sum(j % 7 for j in range(i + 1)), i + 1) for i in range(500)} | {("b", 1): (5, 1), ("b", 3): (6, 2)}
    assert {(r.k, r.o): (r.s, r.n) for r in got} == want


@pytest.mark.parametrize("bound", [3, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_join(spark, monkeypatch, bound, how):
    monkeypatch.setattr(common, "HOT_ROWS", bound)
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("gone", i) for i in range(9)] + [("b", 1), ("c", 2), (None, 3)], "k string, x int")
    table = spark.createDataFrame([("hot", 1.0), ("b", 2.0), ("unmet", 3.0)], "k string, y double")
    got = common.hot_join(rows, table, ["k"], how=how)
    want = rows.join(table, "k", how)
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert common.hot_join(rows.limit(0), table, ["k"], how=how).count() == 0


def test_names_that_are_free_and_keys_of_rows(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}), (1, "", {"a": 2}), (1, None, {"a": 1})], "_K1 int, t string, m map<string,int>")
    assert common.free_name(df, "_k1") == "__k1" and common.free_name(df, "x") == "x"
    keys = [tuple(r) for r in df.select(*common.row_key(df)).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_scratch_tables_go(spark, tmp_path):
    from pathlib import Path

    with common.passing(spark):
        common.stage(spark.range(3), "gone", str(tmp_path / "gone"))
        with common.passing(spark):
            kept = common.stage(spark.range(4), "kept", str(tmp_path / "kept"), keep=True)
        assert kept.count() == 4 and (tmp_path / "gone").exists()
    assert not Path(tmp_path / "gone").exists() and not Path(tmp_path / "kept").exists()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: self
        get = lambda self, key: None
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
