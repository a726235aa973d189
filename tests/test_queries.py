"""Every registered query against its SQL."""

import duckdb
import pytest

from kinfold import catalogue

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = con.sql(catalogue.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = df.collect()
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
    assert got


def test_entry(spark):
    import __spark_entry__ as e

    assert [tuple(r) for r in e.entry(spark).orderBy("position").collect()][0][1] == "customer"
    assert set(e.oracle_sql()) <= set(e.queries())
