import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kinfold.llm import decontaminate as D
from kinfold.llm import queries as Q
from kinfold.llm.common import stage

TOKEN = re.compile(r"[^\W_]+")


def counts(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(docs, items, t=0.8):
    """The best similarity of all windows of the item's length, for each document and item."""
    out = {}
    items = [(i, w, counts(w)) for i, x in items if (w := TOKEN.findall((x or "").lower()))]
    for d, text in docs:
        w = TOKEN.findall((text or "").lower())
        grams = set(counts(w)) if len(w) >= 5 else None
        for i, v, c in items:
            if not w or (grams is not None and len(v) >= 5 and not grams & set(c)):
                continue
            best = max(
                (lambda a: sum((a & c).values()) / sum((a | c).values()))(counts(w[s : s + len(v)])) for s in range(max(1, len(w) - len(v) + 1))
            )
            if best >= t:
                out[d, i] = max(best, out.get((d, i), 0))
    return out


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = lambda t, k: [tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(k, "text").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in Q.op7_simhash_decontamination(spark, d).collect()}
    want = {k: round(v, 9) for k, v in brute(rows("documents", "doc_id"), rows("benchmark", "item_id")).items()}
    assert got == want and got


def test_edited_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([30, 60, 120])))) for i in range(30)] + [(100, "just three words"), (101, None), (102, "..."), (103, "la la la la la la la la la la")]
    docs = [(0, None), (1, ""), (2, "we say just THREE, words here"), (3, "la " * 40)]
    for k in range(200):
        w = items[k % 30][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            at = rng.randrange(len(w))
            rng.choice([lambda at=at: w.pop(at), lambda at=at: w.insert(at, word()), lambda at=at: w.__setitem__(at, word())])()
        docs.append((10 + k, " ".join([word() for _ in range(rng.choice([0, 7, 90]))] + w + [word() for _ in range(rng.choice([0, 11]))])))
    a = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(2, docs[2][1], 1)], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = D.contaminations(a, b).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found}
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert len(found) == len(got) and (2, 100) in got
    assert {k for k, v in want.items() if v > 0.8} - got.keys() == set() and all(want[k] >= v for k, v in got.items())
    assert D.contaminations(a.limit(0), b).count() == 0 and D.contaminations(a, b.limit(0)).count() == 0


def test_blocks_cover_all_bits_and_guarantee_the_radius():
    blocks = D._blocks()
    assert len(blocks) == D.RADIUS + 1 and sum(m.bit_length() for _, m in blocks) == D.BITS
    assert sum(m << a for a, m in blocks) == (1 << D.BITS) - 1


def test_native_plan(spark):
    a = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    plan = D.contaminations(a, a.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints(spark):
    rng = random.Random(9)
    rows = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 7, 300)]
    got = spark.createDataFrame([(r,) for r in rows], "h array<long>").select(D._fingerprint("h").alias("fp")).collect()
    for r, g in zip(rows, got):
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in r) * 2 > len(r))
        assert g.fp % (1 << 64) == want


def test_candidates_are_pairs_that_share_a_shingle(spark, monkeypatch):
    """The index is asked for a window's own items: pairs do not grow with windows times items, and passes do not change them."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    docs = [(k, " ".join([word(), *items[k % 60][1].split()[: 40 if k % 2 else 8], word()])) for k in range(240)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    own, spots = D.indexed(b)
    windows = D.proposed(a, spots)
    marked = stage(windows.withColumn("w", F.split("window", " ")).withColumn("shingles", D._shingles("w", F.col("length"))), "shingles")
    marked = stage(marked.withColumn("fp", D._fingerprint("shingles")), "fingerprints")
    # 120 copies, and those of the 120 windows with a tenth of the shingles in common that are as near by chance
    assert 120 <= D.candidates(marked, own).count() < windows.count() <= 240
    want = sorted(map(tuple, D.contaminations(a, b).collect()))
    assert [w[:2] for w in want] == [(k, k % 60) for k in range(1, 240, 2)]
    monkeypatch.setattr(D, "INDEX_ROWS", 500)
    assert sorted(map(tuple, D.contaminations(a, b).collect())) == want
