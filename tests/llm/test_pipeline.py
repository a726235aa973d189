import corpus_pipeline as P
from kinfold.llm import mixing
from kinfold.llm.common import read, stage
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_huffman import reference
from tests.llm.test_near_dedup import brute as groups

D = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_each_stage(spark):
    docs = read(spark, D, "documents")
    step = dict(P.STAGES)
    clean = stage(step["toxicity"](spark, docs, D), "t")
    assert clean.schema == docs.schema
    toxic = {r.doc_id for r in read(spark, D, "labels").where("toxic = 1").collect()}
    left = {r.doc_id for r in clean.collect()}
    known = {r.doc_id for r in read(spark, D, "labels").where("toxic = 0").collect()}
    assert len(toxic & left) < 0.3 * len(toxic) and len(known - left) < 0.02 * len(known)

    single = stage(step["near_dedup"](spark, clean, D), "n")
    want = groups([(r.doc_id, r.text) for r in clean.collect()], 5, 80, 100)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in want.items() if c == i} and single.schema == docs.schema

    fair = stage(step["decontamination"](spark, single, D), "d")
    hits = {d for d, _ in leaks([(r.doc_id, r.text) for r in single.collect()], [(r.item_id, r.text) for r in read(spark, D, "benchmark").collect()])}
    assert rows(fair) == [r for r in rows(single) if r[0] not in hits]

    mix = stage(step["mixing"](spark, fair, D), "m")
    copies = {r.doc_id: r.copies for r in mixing.copies(fair).collect()}
    assert rows(mix) == sorted(r for r in rows(fair) for _ in range(copies[r[0]])) and mix.schema == docs.schema

    ids = step["token_ids"](spark, mix, D).orderBy("start").collect()
    ref = reference([(i, r[1]) for i, r in enumerate(rows(mix))])
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in ids] == [ref[i] for i in range(len(ref))]


def test_run(spark):
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100


def test_odd_documents(spark):
    schema = read(spark, D, "documents").schema
    odd = [(None, None, None, None, None), (None, "no id", "en", "a", 5), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "twice", "en", "b", 5), (3, "twice", "en", "b", 5), (4, "w " * 30000, "en", "b", 60000)]
    for table in (odd, []):
        docs = spark.createDataFrame(table, schema)
        for _, step in P.STAGES:
            docs = stage(step(spark, docs, "/root/testdata/sf0.001"), "odd")
        assert docs.count() == 0 if not table else docs.count() > 0


def test_rows_without_or_with_the_same_id(spark):
    schema = read(spark, D, "documents").schema
    near_dedup, leaks_out = dict(P.STAGES)["near_dedup"], dict(P.STAGES)["decontamination"]
    make = lambda pairs: spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in pairs], schema)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    item = read(spark, D, "benchmark").first().text
    clean = [" ".join(f"{c}{k}" for k in range(60)) for c in "xyz"]
    keeps = [(None, clean[0]), (None, None), (7, clean[1])]
    assert left(leaks_out(spark, make([*keeps, (None, item), (7, item), (8, f"{clean[2]} {item}")]), D)) == sorted(keeps, key=str)
    near = lambda k: f"{clean[k]} end"
    docs = [(None, clean[0]), (None, near(0)), (3, clean[1]), (None, near(1)), (3, clean[2]), (2, near(2)), (None, None), (None, None), (5, ""), (5, ""), (6, "")]
    got = left(near_dedup(spark, make(docs), D))
    first = [g for g in got if g in docs[:2]]
    assert len(first) == 1 and [g for g in got if g not in docs[:2]] == sorted([(3, clean[1]), (2, near(2)), (None, None), (None, None), (5, ""), (6, "")], key=str)
