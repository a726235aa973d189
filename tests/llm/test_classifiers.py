import zlib

import numpy as np
import pytest

from kinfold.llm import quality, toxicity
from kinfold.llm import queries as Q

D = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"))
    return (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5


def run(spark, query, label):
    got = query(spark, D).toPandas().set_index("doc_id")
    assert len(got) == spark.read.parquet(f"{D}/documents.parquet").count()
    assert got["score"].between(0, 1).all() and got.notna().all().all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got["held_out"].items())
    y = spark.read.parquet(f"{D}/labels.parquet").toPandas().set_index("doc_id")[label]
    held = got.loc[y.index[got.loc[y.index, "held_out"]]]
    return held, y.loc[held.index].to_numpy()


def test_toxicity_on_held_out_labels(spark):
    held, y = run(spark, Q.op8_nb_ngram_toxicity, "toxic")
    assert auc(held["score"].to_numpy(), y) > 0.97
    assert held["predicted"].to_numpy()[y == 0].mean() < 0.01 and held["predicted"].to_numpy()[y == 1].mean() > 0.75


def test_quality_on_held_out_labels(spark):
    held, y = run(spark, Q.op9_additive_quality, "quality")
    assert auc(held["score"].to_numpy(), y) > 0.98
    assert held["predicted"].to_numpy()[y == 1].mean() > 0.98 and held["predicted"].to_numpy()[y == 0].mean() < 0.1


def documents(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", None), (4, "word " * 30000, "z"), (None, "no id", "a"), (5, "fine", "a"), (5, "fine", "a"), (6, "é\x00ü", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


@pytest.mark.parametrize("labels", [[], [(5, 1, 1)], [(4, 0, 0), (5, 1, 1), (6, None, None), (None, 1, 1), (5, 0, 0), (99, 1, 1)]])
def test_odd_rows(spark, labels):
    docs, known = documents(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a = toxicity.score(docs, model := toxicity.fit(docs, known)).collect()
    b = quality.score(docs, known).collect()
    for got in (a, b):
        assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in a)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), known)).count() == 0 and quality.score(docs.limit(0), known).count() == 0


def test_grams_are_those_of_each_text():
    from kinfold.llm.common import text_chunks
    import pyarrow as pa

    texts = ["abcdef", "ABC", "ab", None, "xyzabcdefabcdef", "é" * 7]
    seen = np.zeros(1 << toxicity.HASH_BITS, np.int32)
    ours = [set(x) for data, offsets in text_chunks(pa.array(texts), 5) for x in toxicity.grams(data, offsets, seen)]
    assert ours[1] <= ours[0] <= ours[4] and len(ours[0]) == 4 + 3 + 2 + 1 and not ours[2] and not ours[3] and len(ours[5]) == 8


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(quality.NAMES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.train(x[:3000], y[:3000])
    assert (2, 7) in model.pairs and ((model.logits(x[3000:]) > 0) == y[3000:]).mean() > 0.85


def test_an_id_with_many_rows_stays_within_the_sample(spark, monkeypatch):
    """Whatever rows a few labelled ids have, no more than sample_rows of them reach the driver."""
    rows = [(1 + k % 2, f"{'bad awful' if k % 2 else 'good kind'} words {k // 4}") for k in range(2000)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    fit_logistic, train = toxicity.fit_logistic, quality.train
    monkeypatch.setattr(toxicity, "fit_logistic", lambda items, *a: seen.append(len(items)) or fit_logistic(items, *a))
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(x)) or train(x, y))
    model = toxicity.fit(docs, known, sample_rows=100)
    quality.fit(quality.describe(docs), known, sample_rows=100)
    assert seen[0] == 100 and 2 <= seen[1] <= 100
    score = {r.doc_id: r.score for r in toxicity.score(docs.limit(2), model).collect()}
    assert score[2] > 0.5 > score[1]


def test_repeated_rows_weigh_nothing(spark):
    """Texts of ids that come again and again give the model of the texts alone, below the bound and above it."""
    rows = [(k, f"{'bad awful' if k % 3 == 0 else 'good kind'} words of {k}") for k in range(60)]
    known = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    again = spark.createDataFrame(rows + rows[:9] * 40, "doc_id long, text string")
    for bound in (20_000, 30):
        a, b = toxicity.fit(once, known, bound), toxicity.fit(again, known, bound)
        assert np.allclose(a.weights, b.weights) and a.bias == b.bias
