import json
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinfold.llm import huffman
from kinfold.llm import queries as Q


def reference(rows, end=2):
    t, at, out = Tokenizer.from_file(Q.word_bpe()), 0, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        out[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def test_query_equals_library(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op2_huffman_token_ids(spark, d).collect()}
    assert got == reference([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])


ODD = st.text(st.sampled_from("aB'st.,é0 \n\t́İΣß<|>endoftext ẞ中\x1c\x85"), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD, max_size=6))
def test_words_make_whole_texts(texts):
    texts = [*texts, "<|ENDOFTEXT|> x", "a <|endoftext|>b", "İ.", "stİ,", "\u0958. é. ẞ,"]
    e = huffman.encoder(Q.word_bpe())
    t = Tokenizer.from_file(Q.word_bpe())
    assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_other_patterns_go_through_the_library(tmp_path):
    """Steps of the same names with other patterns are no reason to encode word by word."""
    spec = json.loads(Path(Q.word_bpe()).read_text())
    assert huffman.encoder(Q.word_bpe()).by_word
    replace, split = json.loads(json.dumps(spec)), json.loads(json.dumps(spec))
    replace["normalizer"]["normalizers"][1] = {"type": "Replace", "pattern": {"Regex": "st"}, "content": " th"}
    split["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": "[a-z]+ ?[a-z]*|."}
    for i, changed in enumerate((replace, split)):
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(changed))
        texts = ["first steps, at last.", "one two\nthree", "", "STOP 12 it's"]
        own = huffman.encoder(str(path))
        assert not own.by_word
        assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in Tokenizer.from_file(str(path)).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 18))
def test_lengths_are_complete_and_limited(counts, limit):
    counts = np.array(counts)
    bits = huffman.code_lengths(counts, limit)
    used = bits[counts > 0]
    assert (bits[counts == 0] == 0).all() and (used <= limit).all() and (used > 0).all()
    if len(used) > 1:
        assert sum(Fraction(1, 1 << int(b)) for b in used) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=900))
def test_block_round_trip(ids):
    ids = np.array(ids)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=60)))
    payload, checkpoints = code.encode(ids)
    assert len(checkpoints) == -(-len(ids) // huffman.LANE)
    assert (code.decode(payload, checkpoints, len(ids)) == ids).all()


def test_too_many_ids_for_the_limit():
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9), 3)


def test_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 50)
    rows = [(5, None, "a"), (1, "", "b"), (2, "Long " * 3000, "c"), (9, "the end.", None), (3, "same", "d"), (4, "same", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string")
    huffman.write(df, f"file://{tmp_path}/a", Q.word_bpe())
    got = huffman.read(spark, f"file://{tmp_path}/a").collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == reference([r[:2] for r in rows])
    whole = {r.doc_id: r.ids for r in huffman.read(spark, f"file://{tmp_path}/a", digest=False).collect()}
    assert whole[5] == [2] and len(whole[2]) == 3001
    again = df.union(spark.createDataFrame([(None, "x", "y"), (5, None, "a"), (5, None, "a")], df.schema))
    huffman.write(again, f"file://{tmp_path}/b", Q.word_bpe())
    got = huffman.read(spark, f"file://{tmp_path}/b").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 5, 9]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    huffman.write(df.limit(0), f"file://{tmp_path}/c", Q.word_bpe())
    assert huffman.read(spark, f"file://{tmp_path}/c").count() == 0


@pytest.mark.parametrize("hot", [None, 70, 7])
def test_an_id_of_a_third_of_the_rows_is_spread(spark, tmp_path, hot):
    """By the ids that each range holds; no row is lost and ids still ascend."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        docs = spark.createDataFrame([(hot if i % 3 == 0 else i, f"text number {i} " + "of words " * 5) for i in range(900)], "doc_id long, text string")
        huffman.write(docs, str(tmp_path / "f"), Q.word_bpe())
        parts = {r.part: r.n for r in spark.read.parquet(f"{tmp_path}/f/blocks").groupBy("part").agg({"n_ids": "sum"}).toDF("part", "n").collect()}
        rows = huffman.read(spark, str(tmp_path / "f")).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    each = sorted(parts.values())
    assert each[-1] < 2 * each[len(each) // 2]
    assert len(rows) == 900 and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(900)]
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
