import duckdb

from kinfold.llm import preference
from kinfold.llm import queries as Q


def test_query_equals_sql_and_is_native(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{d}/conversations.parquet'")
    df = Q.op1_preference_segments(spark, d)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.sql(Q.ORACLE["op1_preference_segments"]).fetchall(), key=str)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda t: f"<|im_start|>{t[0] or ''}\n{t[1] or ''}<|im_end|>\n"
    out = ["".join(map(show, x)) for x in (chosen[:n], chosen[n:], rejected[n:])]
    for side in (chosen[n:], rejected[n:]):
        at, spans = 0, []
        for t in side:
            if t[0] == "assistant":
                spans.append((at, at + len(show(t))))
            at += len(show(t))
        out.append(spans)
    return tuple(out)


def test_pairs(spark):
    u, a = lambda t: ("user", t), lambda t: ("assistant", t)
    pairs = {
        1: ([u("q"), a("yes")], [u("q"), a("no"), u("why"), a("é" * 5000)]),
        2: ([u("q"), a("same")], [u("q"), a("same")]),
        3: ([u("q")], [u("q"), a("more")]),
        4: ([a(None), (None, "x"), u("")], [a(None), (None, "x"), u(None)]),
        5: ([u("only chosen")], []),
        6: ([], [a("only rejected")]),
        7: ([u("t")] * 300 + [a("x")], [u("t")] * 300 + [a("y")]),
    }
    table = lambda k: spark.createDataFrame([(p, i + 1, r, t, "x") for p, s in pairs.items() for i, (r, t) in enumerate(s[k])], "pair_id long, seq long, role string, text string, part string")
    parts = preference.segments(table(0), table(1))
    got = {r.pair_id: (r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_spans], [tuple(x) for x in r.rejected_spans]) for r in preference.examples(parts).collect()}
    assert got == {p: brute(*s) for p, s in pairs.items()}
    assert preference.segments(table(0).limit(0), table(1).limit(0)).count() == 0


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (1, None, "system", None), (None, 0, "user", "z"), (2, 0, "user", "no answer"), (3, 0, "assistant", "c"), (4, 0, None, None)]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    chosen, rejected = preference.answer_pairs(turns)
    got = preference.examples(preference.segments(chosen, rejected)).collect()
    assert [(r.pair_id, r.chosen.count("<|im_start|>"), "c" in r.rejected) for r in got] == [(1, 1, True)]
    empty = preference.answer_pairs(turns.limit(0))
    assert preference.segments(*empty).count() == 0
