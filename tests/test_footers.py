"""Footers of Parquet files as rows, and drift between files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kinfold.sources import footers


def test_every_file_and_column_has_a_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(footers, "FILES", 2)
    t = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("s.t"), F.array("id").alias("list"), F.struct(F.col("id").alias("x"), F.col("id").alias("y")).alias("pair"))
    t.repartition(5).write.parquet(f"{tmp_path}/t/k=1")
    (tmp_path / "t" / "_hidden").mkdir()
    pq.write_table(pa.table({"z": [1]}), tmp_path / "t" / "_hidden" / "x.parquet")
    found = footers.footers(spark, f"{tmp_path}/t")
    assert found.count() == 20 and found.rdd.getNumPartitions() == 3
    got = {r.column: (r.rows, r.nulls) for r in footers.totals(found).collect()}
    assert got == {"id": (100, 0), "s.t": (100, 25), "list": (100, None), "pair": (100, None)}
    assert [c[1:3] for c in footers.usual(found)][:2] == [("id", "int64"), ("s.t", "string")]
    assert footers.footers(spark, f"file:{tmp_path}/t").count() == 20
    assert footers.drift(found, footers.usual(found)).count() == 0


def test_no_files_and_no_folder(spark, tmp_path):
    (tmp_path / "e").mkdir()
    found = footers.footers(spark, str(tmp_path / "e"))
    assert found.count() == 0 and footers.usual(found) == [] and footers.drift(found, []).count() == 0
    with pytest.raises(Exception, match="FileNotFound|nothere"):
        footers.footers(spark, f"{tmp_path}/nothere").count()


def test_each_kind_of_drift(spark, tmp_path):
    a = pa.schema([pa.field("k", pa.int64(), False), ("v", pa.string()), ("w", pa.float64()), ("x", pa.int32())])
    write = lambda n, schema, rows: pq.write_table(pa.table({f.name: pa.array([0] * rows).cast(f.type) for f in schema}, schema=schema), tmp_path / f"{n}.parquet")
    write("a", a, 5)
    write("b", pa.schema([("k", pa.int64()), ("v", pa.int64()), ("w", pa.float64()), ("x", pa.int32())]), 2)
    write("c", pa.schema([("w", pa.float64()), pa.field("k", pa.int64(), False), ("x", pa.int32()), ("V", pa.string())]), 3)
    write("d", a, 0)
    found = footers.footers(spark, str(tmp_path))
    got = {(r.file.split("/")[-1][0], r.file_rows, *r[2:]) for r in footers.drift(found, footers.usual(found)).collect()}
    assert got == {
        ("b", 2, "k", "nulls", "false", "true"), ("b", 2, "v", "type", "string", "int64"), ("c", 3, "v", "missing", "string", None), ("c", 3, "V", "extra", None, "string"),
        ("c", 3, "k", "moved", "0", "1"), ("c", 3, "w", "moved", "1", "0"),
    }
