import datetime as dt
import math
import threading
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.config import ReplicationConfig, ServerConfig
from kinfold.control import Channel, FileLock, HealthGate, Keepalive, Stop, StopRequested, may_force, problem_of, wait_for_sentinel
from kinfold.functions import digest, predicates
from kinfold import catalogue, state
from kinfold.operators.copy import insert_ignore, insert_missing, needs_strict
from kinfold.operators.closure import batches, numbered
from kinfold.sources import jdbc
from kinfold.config import StoreConfig


def test_dialect(spark):
    to = predicates.to_spark
    assert to("a < DATE_SUB(NOW(), INTERVAL 2 YEAR) AND b = 'DATE_SUB(x, INTERVAL 1 DAY)'") == "a < (NOW() - INTERVAL 2 YEAR) AND b = 'DATE_SUB(x, INTERVAL 1 DAY)'"
    assert to("date_add(date_sub(d, interval 1 day), INTERVAL 3 MONTH) > x") == "((d - interval 1 day) + INTERVAL 3 MONTH) > x"
    assert to("date_sub(d, 3) = e") == "date_sub(d, 3) = e"
    rows = spark.createDataFrame([(1, dt.datetime(2000, 1, 1)), (2, dt.datetime.now() + dt.timedelta(days=400))], "id int, t timestamp")
    assert [r.id for r in rows.filter(predicates.where("t < DATE_SUB(NOW(), INTERVAL 2 YEAR)")).collect()] == [1]
    assert predicates.where(" 1 = 1 ") is None and predicates.where(None) is None


def test_keys_and_names():
    big = T.DecimalType(20, 0)
    assert predicates.root_key("18446744073709551615", big) == 2**64 - 1 and predicates.root_key("-5", T.LongType()) == -5
    for text, kind in (("", T.LongType()), (None, T.LongType()), ("x", T.IntegerType()), ("9223372036854775808", T.LongType()), ("-1", big), ("1", T.StringType())):
        with pytest.raises(ValueError):
            predicates.root_key(text, kind)
    assert predicates.one_line("a\r\nb") == "a  b" and predicates.safe_name("a.b c-d") == "a_b_c-d"
    assert predicates.fold_equal("Order_Id", "order_id") and not predicates.fold_equal("É", "é")
    assert predicates.same_type("INT(11)", "int") and not predicates.same_type("decimal(10,2)", "decimal(12,2)") and predicates.same_type("bigint(20) unsigned", "BIGINT unsigned")


TYPED = "id decimal(20,0), d decimal(10,4), ts timestamp_ntz, vb binary, s string, f double"


def typed(s="plain"):
    return [
        (Decimal(1), Decimal("1234.5678"), dt.datetime(2026, 7, 17, 12), bytes.fromhex("00ff7a"), s, math.pi), (Decimal(2), None, None, None, None, None),
        (Decimal(18446744073709551615), Decimal("-0.0001"), dt.datetime(1970, 1, 1, 0, 0, 1), b"", "", 1e300),
    ]


def test_digests(spark):
    of = lambda rows: tuple(digest.table_digest(spark.createDataFrame(rows, TYPED)).first())
    assert of(typed()) == of(typed()[::-1]) and of(typed())[0] == 3
    assert of(typed()) != of(typed("tampered")) and of(typed()) != of(typed()[:2]) and of(typed()) != of(typed() + typed()[:1])
    assert of([]) == of([]) and of([]) != of(typed())
    two = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(digest.row_digest(spark.createDataFrame([], "a string, b string").schema)).first()[0]
    assert len({two("x", "y"), two("x\x00b=1:y", ""), two(None, "y"), two("~", "y"), two("", "y"), two("xy", "")}) == 6
    size = spark.createDataFrame([("é", None, 5)], "a string, b binary, c int")
    assert size.select(digest.byte_size(size.schema)).first()[0] == 4 + 4 + 8


def test_insert_ignore(spark):
    have = spark.createDataFrame([(1, "a")], "id int, u string")
    new = spark.createDataFrame([(1, "z"), (2, "a"), (3, "b"), (4, "b"), (5, None), (6, None)], "id int, u string")
    assert sorted(r.id for r in insert_ignore(new, have, ["id"], [["u"]]).collect()) == [3, 5, 6]
    whole = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None)], "id int, u string")
    assert sorted(map(tuple, insert_ignore(whole, have, None).collect())) == [(2, None)]
    assert needs_strict("count", False, False) and needs_strict("sha256", True, False) and needs_strict("sha256", False, True) and not needs_strict("sha256", False, False)


def test_insert_missing_keeps_repeated_rows(spark):
    have = spark.createDataFrame([(1, "a"), (3, None)], "id int, u string")
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, None)], "id int, u string")
    rows = insert_missing(new, have)
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, None), (2, None)]
    assert insert_missing(new, have.union(rows)).count() == 0


def test_numbered_and_replay_positions(spark):
    keys = spark.range(1005).repartition(7).select((F.col("id") * 2).alias("k"))
    assert [r.i for r in numbered(keys, "k").orderBy("k").collect()] == list(range(1, 1006))
    got = state.replay_positions(spark.createDataFrame([("10",), ("9",), ("100",)], "root_key string")).collect()
    assert {r.root_key: r.position for r in got} == {"9": 1, "10": 2, "100": 3}


def test_all_pending_keys_come_back(spark):
    sf = "/root/testdata/sf0.01"
    pending = catalogue.job_log(spark, sf).filter("status = 0").count()
    got = catalogue.QUERIES["log_replay_all"](spark, sf).collect()
    assert pending > 25 and sorted(r.position for r in got) == list(range(1, pending + 1))
    assert [r.position for r in sorted(got, key=lambda r: int(r.root_key))] == list(range(1, pending + 1))


def test_batches_of_many_ranges(spark):
    got = batches(spark.range(1005).select(F.col("id").alias("k")), "k", 100).orderBy("batch").collect()
    assert [(r.batch, r.rows, r.first_key) for r in got] == [(i, 100 if i < 10 else 5, 100 * i) for i in range(11)]


def test_jdbc():
    c = StoreConfig(jdbc_host="h", user="u", password="p", database="d", tls="required")
    assert "sslMode=VERIFY_CA" in jdbc.options(c)["url"]
    with pytest.raises(ValueError):
        jdbc.options(StoreConfig(jdbc_host="h", tls="maybe"))
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "df"

    assert jdbc.with_retry(flaky, sleep=slept.append) == "df" and slept == [1, 2]
    calls.clear()
    with pytest.raises(OSError):
        jdbc.with_retry(lambda: (_ for _ in ()).throw(OSError("no")), sleep=slept.append)


def test_locks(tmp_path):
    a, b = FileLock(str(tmp_path), "x y", "me"), FileLock(str(tmp_path), "x y", "you")
    assert a.acquire() and a.held() and not b.acquire() and not b.held()
    (tmp_path / "x_y.lock").write_text("other")
    assert not a.held()
    a.release()
    assert b.acquire(wait=1)
    b.release()
    table = {(k, held, stale, force): may_force(k, held, stale, force) for k in ("archive", "copy-only") for held in (0, 1) for stale in (0, 1) for force in (0, 1)}
    assert all(v == (not held and stale or bool(force and stale and (not held or k == "copy-only"))) for (k, held, stale, force), v in table.items())


def test_keepalive_gives_up_after_three_failures():
    lost, n = threading.Event(), []

    def beat():
        n.append(1)
        raise OSError

    k = Keepalive(beat, 0.01, lambda e: lost.set()).start()
    assert lost.wait(5) and len(n) == 3
    k.stop()


def test_sentinel(tmp_path):
    f = tmp_path / "pause"
    f.write_text("")
    threading.Timer(0.1, f.unlink).start()
    began = time.monotonic()
    assert wait_for_sentinel(str(f), Stop(), poll=0.02) and time.monotonic() - began >= 0.09
    f.write_text("")
    s = Stop()
    s.signal()
    assert not wait_for_sentinel(str(f), s, poll=0.02)
    with pytest.raises(KeyboardInterrupt):
        s.signal()


def test_health():
    s = ServerConfig(host="r", user="m")
    ok = [Channel("", True, 3)]
    assert problem_of(s, ok, 3) is None and "behind" in problem_of(s, ok, 2) and "behind" in problem_of(s, [Channel("", True, None)], 9)
    assert "unreachable" in problem_of(s, None, 1) and "not configured" in problem_of(s, [], 1) and "not running" in problem_of(s, [Channel("a", False, 0)], 1)
    s.channels = ["b"]
    assert "missing: b" in problem_of(s, ok, 1)
    s.channels, now, answers, held = [], [0.0], [OSError("down"), [Channel("", True, 99)], ok, ok, ok], []

    def read(server):
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    gate = HealthGate(ReplicationConfig(enabled=True, servers=[s], cache_ttl=15), read, lambda: now[0], lambda t: held.append(t))
    gate.wait()
    assert held == [5, 5] and len(answers) == 2
    now[0] = 14
    gate.wait()
    assert len(answers) == 2
    now[0] = 16
    gate.wait()
    assert len(answers) == 1
    stop = Stop()
    stop.signal()
    answers[:] = [[]]
    now[0] = 99
    with pytest.raises(StopRequested):
        gate.wait(stop)
