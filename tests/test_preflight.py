"""The ordered rules, one broken fact at a time."""

import pytest

from kinfold.graph import Graph
from kinfold.plans.catalog import Catalog
from kinfold.plans.preflight import FULL, NON_DESTRUCTIVE, SOURCE_ONLY, Preflight, PreflightError
from kinfold.sources.store import Change, Store


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("preflight")
    src, dst = Store(spark, f"{d}/src"), Store(spark, f"{d}/dst")
    made = {"orders": Change(create=spark.createDataFrame([(1, "a"), (2, "b")], "id long, email string")), "lines": Change(create=spark.createDataFrame([(1, 1)], "id long, order_id long"))}
    src.commit(made)
    dst.commit(made)
    return src, dst


def graph(key="id", fk="order_id"):
    g = Graph("orders")
    g.add_table("orders", key)
    g.add_table("lines", "id")
    g.add_edge("orders", "lines", fk)
    return g


def run(stores, source=None, destination=None, profile=FULL, g=None, **more):
    src, dst = stores
    fks = {"foreign_keys": [{"child": "lines", "columns": "order_id", "parent": "orders", "ref": "id"}]}
    return Preflight(g or graph(), Catalog(src, fks | (source or {})), Catalog(dst, destination or {}), profile, **more)


def fails(stores, check, *args, **more):
    with pytest.raises(PreflightError) as e:
        run(stores, *args, **more).run()
    assert e.value.check == check
    return e.value


def tables(**facts):
    return {"tables": facts}


def test_pass_and_profiles(stores):
    assert run(stores).run() == []
    assert run(stores).findings().isEmpty()
    trigger = tables(orders={"triggers": [{"name": "t", "event": "DELETE"}]})
    fails(stores, "DELETE_TRIGGER_CHECK", trigger)
    assert run(stores, trigger, profile=NON_DESTRUCTIVE).run() == [] and run(stores, trigger, force_triggers=True).run() == []
    insert = tables(orders={"triggers": [{"name": "t", "event": "INSERT"}]})
    fails(stores, "DEST_INSERT_TRIGGER_CHECK", None, insert)
    assert run(stores, None, insert, SOURCE_ONLY).run() == []


@pytest.mark.parametrize(
    ("check", "source", "destination"),
    [
        ("TABLE_EXISTENCE_CHECK", tables(orders={"type": "VIEW"}), None),
        ("COMPOSITE_PK_CHECK", tables(orders={"primary_key": ["id", "tenant"]}), None),
        ("PRIMARY_KEY_CHECK", tables(orders={"primary_key": ["ref_no"]}), None),
        ("PRIMARY_KEY_CHECK", tables(orders={"primary_key": []}), None),
        ("STORAGE_ENGINE_CHECK", tables(lines={"engine": "MyISAM"}), None),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", None, tables(orders={"unique": [{"columns": ["email"]}]})),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", tables(orders={"unique": [{"columns": ["a", "b"]}]}), tables(orders={"unique": [{"columns": ["a"]}]})),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", tables(orders={"unique": [{"columns": ["email"]}]}), tables(orders={"unique": [{"columns": [{"column": "email", "prefix": 10}]}]})),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", None, tables(orders={"unique": [{"columns": [{"expression": "lower(email)"}]}]})),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", None, tables(orders={"columns": [{"name": "email", "type": "varchar(9)"}]})),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", None, tables(orders={"columns": [{"name": "email", "nullable": False}]})),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", None, tables(orders={"columns": [{"name": "email", "generated": True}]})),
        ("DEST_SCHEMA_COMPATIBILITY_CHECK", None, tables(orders={"columns": [{"name": "email", "charset": "latin1"}]})),
        ("DEST_WRITE_PERMISSION_CHECK", None, tables(orders={"grants": ["SELECT"]})),
        ("FK_INDEX_CHECK", tables(lines={"indexes": [["id"]]}), None),
        ("FK_COVERAGE_VISIBILITY_CHECK", {"complete": False}, None),
        ("FK_COVERAGE_CHECK", {"foreign_keys": [{"child": "other", "columns": "o", "parent": "orders", "ref": "id"}]}, None),
        ("INTERNAL_FK_COVERAGE", {"foreign_keys": [{"child": "lines", "columns": "id", "parent": "orders", "ref": "id"}]}, None),
        ("SOURCE_SELECT_PERMISSION_CHECK", tables(lines={"grants": ["DELETE"]}), None),
        ("SOURCE_DELETE_PERMISSION_CHECK", tables(lines={"grants": ["SELECT"]}), None),
    ],
)
def test_each_rule(stores, check, source, destination):
    fails(stores, check, source, destination)


def test_allowed_differences(stores):
    assert run(stores, tables(orders={"unique": [{"columns": ["email"]}]})).run() == []
    charset = tables(orders={"columns": [{"name": "email", "charset": "latin1"}]})
    assert [w.severity for w in run(stores, None, charset, digest_verified=True).run()] == ["warning"]
    assert [w.check for w in run(stores, {"foreign_keys": [{"child": "lines", "columns": "order_id", "parent": "orders", "ref": "id", "on_delete": "cascade"}]}).run()] == ["CASCADE_RULE"]


def test_keys_and_tables(stores):
    fails(stores, "PK_COLUMN_CASE_CHECK", g=graph("ID"))
    fails(stores, "PK_COLUMN_CHECK", g=graph("nothing"))
    fails(stores, "ROOT_PK_TYPE_UNSUPPORTED", g=graph("email"))
    g = graph()
    g.add_table("absent", "id")
    g.add_edge("orders", "absent", "order_id")
    e = fails(stores, "TABLE_EXISTENCE_CHECK", g=g)
    assert [f.table for f in e.findings] == ["absent"]
    fails(stores, "JOB_SCHEMA_PERMISSION_CHECK", job_schema="state", writable=lambda side: side != "state")
    fails(stores, "SOURCE_DELETE_PERMISSION_CHECK", writable=lambda side: side != "source")
    fails(stores, "PRIMARY_KEY_CHECK", g=_twice(stores))


def _twice(stores):
    src, dst = stores
    rows = src.spark.createDataFrame([(1, 1), (1, 1)], "id long, order_id long")
    for s in (src, dst):
        s.commit({"twice": Change(create=rows)})
    g = graph()
    g.add_table("twice", "id")
    g.add_edge("orders", "twice", "order_id")
    return g
