"""Whole commands on small stores, broken off between any two steps."""

import datetime as dt
import time

import pytest

from kinfold.config import parse
from kinfold.control import LockError
from kinfold.engine import Engine
from kinfold.operators.copy import DuplicateKeyError
from kinfold.operators.verify import VerificationError
from kinfold.plans.preflight import PreflightError
from kinfold.sources.store import Change, Store, StoreError
from kinfold.state import COPIED, FAILED, PENDING, ResumeError, Tracker, log_name

SCHEMAS = {
    "customers": "id long, name string, created_at timestamp_ntz", "orders": "id long, customer_id long, total decimal(10,2)",
    "items": "id long, order_id long, product string, weight double", "payments": "id long, order_id long, raw binary",
}


def data():
    old, new = dt.datetime(2022, 5, 1), dt.datetime(2025, 5, 1)
    out = {
        "customers": [(i, f"c{i}", old if i <= 5 else new) for i in range(1, 9)], "orders": [(i, (i - 1) // 3 + 1, None) for i in range(1, 25)],
        "items": [(i, (i - 1) // 2 + 1, f"p{i}", i / 7) for i in range(1, 49)], "payments": [(i, i * 2, bytes([i, 255])) for i in range(1, 13)],
    }
    out["orders"].append((99, None, None))
    return out


@pytest.fixture
def world(spark, tmp_path):
    src, dst = Store(spark, f"{tmp_path}/src"), Store(spark, f"{tmp_path}/dst")
    src.commit({t: Change(create=spark.createDataFrame(rows, SCHEMAS[t])) for t, rows in data().items()})
    dst.commit({t: Change(create=src.table(t).limit(0)) for t in SCHEMAS})

    def engine(method="sha256", **more):
        jobs = {"j": {
            "root_table": "customers", "primary_key": "id", "where": "created_at < DATE_SUB(TIMESTAMP_NTZ'2026-01-01 00:00:00', INTERVAL 2 YEAR)",
            "relations": [{"table": "orders", "primary_key": "id", "foreign_key": "customer_id", "relations": [{"table": "items", "primary_key": "id", "foreign_key": "order_id"}, {"table": "payments", "primary_key": None, "foreign_key": "order_id"}]}],
        }}
        c = {"source": {"path": src.root}, "destination": {"path": dst.root}, "processing": {"batch_size": 2, "sleep_seconds": 0}, "verification": {"method": method}, "jobs": jobs} | more
        return Engine(spark, parse(c), src, dst)

    return src, dst, engine


def ids(store, t):
    return sorted(r.id for r in store.table(t).collect())


ARCHIVED = {"customers": list(range(1, 6)), "orders": list(range(1, 16)), "items": list(range(1, 31)), "payments": list(range(1, 8))}


def rest(t):
    return sorted({r[0] for r in data()[t]} - set(ARCHIVED[t]))


def done(src, dst):
    for t in SCHEMAS:
        assert ids(src, t) == rest(t) and ids(dst, t) == ARCHIVED[t]


def test_archive(world):
    src, dst, engine = world
    seen = []
    e = engine()
    e.on_checkpoint = lambda key, what: seen.append(key)
    s = e.archive("j")
    done(src, dst)
    assert (s.roots, s.batches, s.copied, s.deleted) == (5, 3, 57, 57) and seen == [2, 4, 5]
    assert sorted(map(tuple, dst.table("items").collect())) == [r for r in data()["items"] if r[0] <= 30]
    t = Tracker(dst, "j")
    assert t.checkpoint == 5 and t.log().filter("status <> 2").isEmpty() and t.row["job_status"] == 0
    assert engine().archive("j").roots == 0
    with pytest.raises(ResumeError):
        engine().purge("j")
    assert t.should_resume()
    t.reset()
    assert t.checkpoint is None


@pytest.mark.parametrize("step", ["log pending", "copy", "mark copied", "delete", "complete"])
def test_archive_resumes_after_a_break(world, step):
    src, dst, engine = world
    e, calls = engine(), []

    def fail(name):
        calls.append(name)
        if name == step and calls.count(step) == 2:
            raise RuntimeError("lost")

    e.step = fail
    with pytest.raises(RuntimeError, match="lost"):
        e.archive("j")
    assert Tracker(dst, "j").row["job_status"] == 2
    s = engine().archive("j")
    done(src, dst)
    assert s.replayed == (0 if step == "log pending" else 2)


@pytest.mark.parametrize("step", ["copy", "mark copied"])
def test_copy_only_resumes_in_ascending_runs(world, step):
    src, dst, engine = world
    e, calls = engine(), []
    e.step = lambda name: (calls.append(name), (_ for _ in ()).throw(RuntimeError("lost")) if name == step and calls.count(step) == 2 else None)
    with pytest.raises(RuntimeError):
        e.copy_only("j")
    with pytest.raises(ResumeError, match="not empty"):
        engine().copy_only("j")
    engine().copy_only("j", force=True)
    for t in SCHEMAS:
        assert ids(dst, t) == ARCHIVED[t] and ids(src, t) == sorted(r[0] for r in data()[t])
    assert Tracker(dst, "j").checkpoint == 5


def test_purge(world):
    src, dst, engine = world
    e = engine()
    e.step = lambda name: (_ for _ in ()).throw(RuntimeError("lost")) if name == "complete" else None
    with pytest.raises(RuntimeError):
        e.purge("j")
    s = engine().purge("j")
    assert s.deleted > 0 and s.copied == 0
    for t in SCHEMAS:
        assert ids(src, t) == rest(t) and ids(dst, t) == []


def put(dst, status, keys):
    t = Tracker(dst, "j")
    t.mark(dst.spark.createDataFrame([(k,) for k in keys], "id long"), status)


def test_gates(world):
    src, dst, engine = world
    e = engine("count")
    e.step = lambda name: (_ for _ in ()).throw(RuntimeError("lost")) if name == "copy" else None
    with pytest.raises(RuntimeError):
        e.archive("j")
    with pytest.raises(ResumeError, match="sha256"):
        engine("count").archive("j")
    put(dst, FAILED, [1])
    with pytest.raises(ResumeError, match="failed"):
        engine().archive("j")
    put(dst, COPIED, [1, 2])
    with pytest.raises(ResumeError, match="sha256"):
        engine("count").archive("j")
    put(dst, PENDING, [2])
    unique = {"catalog": {"destination": {"tables": {"items": {"unique": [{"columns": ["product"]}]}}}, "source": {"tables": {"items": {"unique": [{"columns": ["product"]}]}}}}}
    with pytest.raises(ResumeError, match="strict"):
        engine(**unique).archive("j")
    put(dst, PENDING, [1])
    engine().archive("j")
    done(src, dst)


def test_strict_insert_and_ignore(world):
    src, dst, engine = world
    dst.commit({"orders": Change(add=src.table("orders").filter("id = 4"))})
    with pytest.raises(DuplicateKeyError, match="4"):
        engine("count").archive("j")
    put(dst, 2, [1, 2])
    e = engine(jobs={"k": engine().config.jobs["j"].__dict__ | {"relations": [{"table": "orders", "primary_key": "id", "foreign_key": "customer_id"}]}})
    s = e.archive("k", skip_preflight=True)
    assert s.per_table["orders"] == {"discovered": 15, "copied": 14, "deleted": 15}


def test_mismatch_keeps_the_source(world):
    src, dst, engine = world
    other = src.table("orders").filter("id = 2").selectExpr("id", "customer_id", "cast(7 as decimal(10,2)) as total")
    dst.commit({"orders": Change(add=other)})
    with pytest.raises(VerificationError, match="orders"):
        engine().archive("j")
    assert len(ids(src, "customers")) == 8 and not Tracker(dst, "j").log().filter("status = 0").isEmpty()


def test_locks_and_stops(world, tmp_path):
    src, dst, engine = world
    t = Tracker(dst, "other")
    t.open("customers", "purge")
    with pytest.raises(LockError, match="other"):
        engine().archive("j")
    t.finish(True)
    e = engine()
    e.stop.signal()
    s = e.archive("j")
    assert s.stopped and s.roots == 0
    engine().archive("j")
    done(src, dst)


def test_dry_run_validate_and_plan(world):
    src, dst, engine = world
    e = engine()
    rows = {r.table: (r.rows, r.batches) for r in e.dry_run("j").collect()}
    assert rows == {"customers": (5, 3), "orders": (15, 3), "items": (30, 3), "payments": (7, 3)}
    assert e.validate().filter("not ok").isEmpty() and "depth: 2" in e.plan("j") and e.list_jobs() == [("j", "customers", 3)]
    outside = {"catalog": {"source": {"foreign_keys": [{"child": "notes", "columns": "order_id", "parent": "orders", "ref": "id", "on_delete": "cascade"}]}}}
    bad = engine(**outside).validate().collect()
    assert [(r.ok, r.check, r.table) for r in bad] == [(False, "FK_COVERAGE_CHECK", "orders")]
    with pytest.raises(PreflightError):
        engine(**outside).archive("j")


def test_store(world, spark):
    src, dst, _ = world
    pinned, before = src.table("orders"), src.version()
    src.commit({"orders": Change(delete=spark.createDataFrame([(1,), (2,)], "id long"))})
    src.commit({"orders": Change(add=pinned.filter("id = 1"))})
    src.commit({"orders": Change(delete=spark.createDataFrame([(3,)], "id long"))})
    assert ids(src, "orders")[:3] == [1, 4, 5] and len(pinned.collect()) == 25 and src.version() == before + 3
    src.compact("orders")
    assert src.events("orders") == 1 and ids(src, "orders")[:3] == [1, 4, 5]
    with pytest.raises(StoreError):
        src.table("nothing")
    with pytest.raises(Exception):
        src.commit({"orders": Change(add=spark.createDataFrame([(1,)], "other long"))})
    assert src.version() == before + 4
    src._replace_file("manifest.json", '{"schema_version": "9", "tables": {}}')
    with pytest.raises(StoreError, match="schema version"):
        src.tables()


def test_commits_of_two_writers(world, spark):
    one = world[0]
    two, row = Store(spark, one.root), lambda n: spark.createDataFrame([(n, 1, None)], SCHEMAS["orders"])
    write = one._write

    def meanwhile(act):
        one._write = lambda *a: (act(), write(*a))[1]

    before = one.version()
    meanwhile(lambda: two.commit({"items": Change(delete=spark.createDataFrame([(1,)], "id long"))}, {"a": {"x": 1}}))
    one.commit({"orders": Change(add=row(200))}, {"a": {"y": 2}})
    assert one.version() == two.version() == before + 2 and two.job("a") == {"x": 1, "y": 2}
    assert 200 in ids(two, "orders") and 1 not in ids(one, "items")
    meanwhile(lambda: two.commit({"orders": Change(add=row(201))}))
    for act in (lambda: one.commit({"orders": Change(add=row(202))}), lambda: one.compact("orders")):
        with pytest.raises(StoreError, match="another writer"):
            act()
    assert 202 not in ids(one, "orders") and ids(one, "orders").count(201) == 2
    # a writer that died after its version was made, and one that was slow to copy it
    old, one._write = one._read_file("manifest.json"), write
    two.commit(jobs={"b": {"x": 1}})
    one._replace_file("manifest.json", old)
    assert one.job("b") == {"x": 1} and one.version() == before + 5
    assert not one._create_file(f"_versions/{one.version()}.json", "{}") and one.job("b") == {"x": 1}
    one.commit(jobs={"b": {"x": 2}})
    assert two.job("b") == {"x": 2} and two.version() == before + 6


def test_heartbeats_go_on_while_a_copy_is_written(world, monkeypatch):
    src, dst, engine = world
    monkeypatch.setattr("kinfold.engine.HEARTBEAT_SECONDS", 0.1)
    write, seen = dst._write, []

    def slow(name, df):
        if name == "orders":
            beat, end = dst.job("j")["last_heartbeat_at"], time.time() + 20
            while time.time() < end and dst.job("j")["last_heartbeat_at"] == beat:
                time.sleep(0.05)
            seen.append(dst.job("j")["last_heartbeat_at"] > beat)
        return write(name, df)

    dst._write = slow
    engine().archive("j")
    done(src, dst)
    assert seen and all(seen)


def test_follow(world, spark, tmp_path):
    from kinfold.graph import Graph
    from kinfold.streaming.follow import follow

    src, dst, _ = world
    g = Graph("customers")
    g.add_table("customers", "id")
    g.add_table("orders", "id")
    g.add_edge("customers", "orders", "customer_id")
    folder, customers = f"{tmp_path}/stream", src.table("customers")
    go = lambda: follow(spark, g, folder, lambda: {"orders": src.table("orders")}, dst, "created_at < '2024-01-01'", f"{tmp_path}/cp").awaitTermination()
    customers.filter("id <= 3").write.parquet(folder)
    go()
    assert ids(dst, "customers") == [1, 2, 3] and ids(dst, "orders") == list(range(1, 10))
    customers.filter("id > 3").write.mode("append").parquet(folder)
    go()
    assert ids(dst, "customers") == ARCHIVED["customers"] and ids(dst, "orders") == ARCHIVED["orders"]


def test_cli(world, tmp_path, capsys, spark):
    import yaml

    from kinfold import cli

    src, dst, engine = world
    conf = {"source": {"path": src.root}, "destination": {"path": dst.root}, "processing": {"batch_size": 3, "sleep_seconds": 0}, "logging": {"format": "text", "output": f"{tmp_path}/log", "file_only": True}, "jobs": {"j": {"root_table": "customers", "primary_key": "id", "where": "id <= 2"}}}
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(conf))
    run = lambda *a: cli.main(["--config", f"{tmp_path}/c.yaml", *a], spark)
    assert run("list-jobs") == run("plan", "-j", "j") == run("version") == run("dry-run", "-j", "j") == run("validate") == 0
    assert run("copy-only", "-j", "j") == 0 and ids(dst, "customers") == [1, 2]
    assert "done" in (tmp_path / "log").read_text() and "copy order" in capsys.readouterr().out
    assert log_name("a b") == "_log_a_b"


def test_replication_without_a_reader_is_refused(world):
    """A gate that cannot look holds the job; nothing is moved."""
    src, dst, engine = world
    e = engine(replication={"enabled": True, "servers": [{"host": "h", "user": "u"}]})
    with pytest.raises(PreflightError, match="REPLICATION_CHECK"):
        e.archive("j")
    assert dst.jobs() == {} and ids(src, "customers") == list(range(1, 9))


def test_a_server_is_no_store():
    from kinfold.config import errors_of

    found = errors_of(parse({"source": {"jdbc_host": "h", "user": "u", "database": "d"}, "destination": {"path": "x"}, "jobs": {}}))
    assert "source.path" in {where for where, _ in found}


def test_deletes_are_paced(world):
    src, dst, engine = world
    e, pauses = engine(processing={"batch_size": 5, "sleep_seconds": 0, "delete_sleep_seconds": 0.25}), []
    e.sleep = pauses.append
    e.archive("j")
    assert pauses == [0.25]


def test_unseen_foreign_keys_are_refused(world):
    """Where no foreign key is declared, a table outside of the job may refer to it: nothing is deleted."""
    src, dst, engine = world
    job = engine().config.jobs["j"].__dict__
    few = {"jobs": {"k": job | {"relations": []}}}
    for command in ("archive", "purge"):
        with pytest.raises(PreflightError, match="FK_COVERAGE_VISIBILITY_CHECK.*items, orders, payments"):
            getattr(engine(**few), command)("k")
    warned = engine(**few).validate().filter("check = 'FK_COVERAGE_VISIBILITY_CHECK'").collect()
    assert [r.ok for r in warned] == [True] and ids(src, "customers") == list(range(1, 9))
    declared = {"catalog": {"source": {"foreign_keys": []}}}
    assert engine(**few, **declared).archive("k").deleted == 5


def test_projected_payload_is_limited(world):
    src, dst, engine = world
    small = {"processing": {"batch_size": 5, "sleep_seconds": 0, "max_batch_bytes": 10}}
    with pytest.raises(PreflightError, match="PAYLOAD_CHECK.*lower batch_size"):
        engine(**small).copy_only("j")
    assert ids(dst, "customers") == []
    small["processing"]["max_batch_bytes"] = 1 << 20
    engine(**small).archive("j")
    done(src, dst)


def test_unreadable_root_keys_stop_a_resume(world):
    src, dst, engine = world
    t, bad = Tracker(dst, "j"), ["x7", "", "1.5", "99999999999999999999"]
    t.open("customers", "archive")
    t.mark(dst.spark.createDataFrame([(k,) for k in [*bad, "4"]], "id string"), PENDING)
    t.finish(False)
    with pytest.raises(ResumeError, match="no bigint") as e:
        engine().archive("j", skip_preflight=True)
    assert all(repr(k) in str(e.value) for k in bad) and "'4'" not in str(e.value) and ids(src, "customers") == list(range(1, 9))


def test_rows_that_come_while_a_job_runs_are_on_one_side(spark, tmp_path):
    """Others go on writing to a registered folder: what a delete has not seen stays."""
    src, dst = Store(spark, f"{tmp_path}/src"), Store(spark, f"{tmp_path}/dst")
    rows = {"parents": ("id long", [(1,), (2,), (3,)]), "children": ("id long, parent_id long, day string", [(i, i % 3 + 1, "a") for i in range(9)])}
    for t, (kind, data) in rows.items():
        df = spark.createDataFrame(data, kind)
        (df.write.partitionBy("day") if t == "children" else df.write).parquet(f"{tmp_path}/{t}")
        src.register(t, f"{tmp_path}/{t}")
        dst.commit({t: Change(create=src.table(t).limit(0))})
    job = {"root_table": "parents", "primary_key": "id", "where": "id <= 2", "relations": [{"table": "children", "primary_key": "id", "foreign_key": "parent_id"}]}
    config = parse({"source": {"path": src.root}, "destination": {"path": dst.root}, "processing": {"batch_size": 1, "sleep_seconds": 0}, "verification": {"method": "sha256"}, "jobs": {"j": job}, "catalog": {"source": {"foreign_keys": [{"child": "children", "columns": "parent_id", "parent": "parents", "ref": "id"}]}}})
    late = iter([(100, 1, "b"), (101, 2, "b")])

    def append(*_):  # after each batch: a child of a parent that is gone, and one of a parent that is still there
        if row := next(late, None):
            spark.createDataFrame([row], rows["children"][0]).write.mode("append").partitionBy("day").parquet(f"{tmp_path}/children")

    engine = Engine(spark, config, src, dst)
    engine.on_checkpoint = append
    engine.archive("j")
    src.refresh()
    here, there = ids(src, "children"), ids(dst, "children")
    assert sorted(here + there) == [*range(9), 100, 101] and ids(src, "parents") == [3]
    assert here == [2, 5, 8, 100, 101] and {r.id: r.day for r in src.table("children").collect()}[100] == "b"
    assert src.refresh() == []
