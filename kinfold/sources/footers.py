"""What the footers of Parquet files say about their columns, as rows, and how files drift from a schema.

Spark takes one file's schema for a table and reads the others through it. This source opens the footer of every
file, in tasks of FILES files, and no data page: its cost is that of the number of files and columns, not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files whose footers one task reads.
FILES = 64

NAME = "parquet_footers"
SCHEMA = "file string, file_rows long, row_groups int, position int, column string, type string, nullable boolean, nulls long, bytes long"


def _source(files: int) -> type[DataSource]:
    """The source as a class of its own, that executors need no module of this package for."""
    name, schema = NAME, SCHEMA

    def opened(path: str):
        from pyarrow import fs

        # Hadoop writes local paths with one slash
        return fs.FileSystem.from_uri(path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)

    class Some(InputPartition):
        def __init__(self, paths: list[str]):
            self.paths = paths

    class Reader(DataSourceReader):
        def __init__(self, path: str):
            self.path = path

        def partitions(self):
            from pyarrow import fs

            system, path = opened(self.path)
            info = system.get_file_info(path)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            if info.type == fs.FileType.File:
                return [Some([path])]
            hidden = lambda p: any(x[:1] in ("_", ".") for x in p[len(path) :].split("/"))
            found = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f.path))
            return [Some(found[i : i + files]) for i in range(0, len(found), files)] or [Some([])]

        def read(self, partition):
            import pyarrow.parquet as pq

            system, _ = opened(self.path)
            for path in partition.paths:
                with system.open_input_file(path) as f:
                    meta = pq.read_metadata(f)
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                paths = [meta.schema.column(i).path for i in range(meta.num_columns)]
                for at, field in enumerate(meta.schema.to_arrow_schema()):
                    # the leaf of a plain column has its name, those of a nested one begin with it
                    own = [i for i, p in enumerate(paths) if p == field.name] or [i for i, p in enumerate(paths) if p.startswith(f"{field.name}.")]
                    size = sum(g.column(i).total_compressed_size for g in groups for i in own)
                    known = [g.column(own[0]).statistics for g in groups] if len(own) == 1 and not meta.schema.column(own[0]).max_repetition_level else [None]
                    nulls = sum(s.null_count for s in known) if all(s is not None and s.has_null_count for s in known) else None
                    yield path, meta.num_rows, len(groups), at, field.name, str(field.type), field.nullable, nulls, size

    class Footers(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options["path"])

    return Footers


def footers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each column of each Parquet file in a folder and its subfolders, or of one file.

    file (without the scheme), file_rows, row_groups, position (from 0), column, type (Arrow's name), nullable, nulls (null if the file
    does not count them, or the column is nested), bytes (compressed). Hidden files are left out, and columns that only
    folder names have are in no file. A file without row groups has no nulls.
    """
    spark.dataSource.register(_source(FILES))
    return spark.read.format(NAME).load(path)


def totals(found: DataFrame) -> DataFrame:
    """column, rows, nulls, bytes over all files of a table. nulls is null if one file does not know them."""
    nulls = F.when(F.count("nulls") == F.count("*"), F.sum("nulls"))
    return found.groupBy("column").agg(F.sum("file_rows").alias("rows"), nulls.alias("nulls"), F.sum("bytes").alias("bytes"))


def layouts(found: DataFrame) -> DataFrame:
    """file, file_rows, columns (array of structs position, column, type, nullable) of each file: as long as a table has columns."""
    return found.groupBy("file").agg(F.max("file_rows").alias("file_rows"), F.array_sort(F.collect_list(F.struct("position", "column", "type", "nullable"))).alias("columns"))


def usual(found: DataFrame) -> list[tuple]:
    """The columns (position, column, type, nullable) that most rows are stored with; ties go to the smaller one."""
    most = layouts(found).groupBy("columns").agg(F.sum("file_rows").alias("n"), F.count("*").alias("files")).orderBy(F.desc("n"), F.desc("files"), F.col("columns").cast("string")).first()
    return [tuple(c) for c in most.columns] if most else []


def drift(found: DataFrame, expected: list[tuple]) -> DataFrame:
    """file, file_rows, column, kind, expected, found of each difference between a file and the expected columns.

    kind: missing (the file lacks the column), extra, type, nulls (nulls are allowed on one side only), moved (the column stands
    elsewhere among those that both have). Files are grouped by their columns first: there are few
    different ones, and each is compared once. Names are compared as they are, with their case.
    """
    spark = found.sparkSession
    one = layouts(found)
    kinds = one.select("columns").distinct()
    schema = "position int, column string, type string, nullable boolean"
    # a schema: as many rows as a table has columns
    want = spark.createDataFrame(expected, schema)
    mine = kinds.select("columns", F.explode("columns").alias("c")).select("columns", F.col("c.column").alias("column"), F.struct("c.position", "c.type", "c.nullable").alias("f"))
    asked = kinds.select("columns", F.explode(F.array(*[F.lit(x[1]) for x in expected])).alias("column")) if expected else mine.select("columns", "column").limit(0)
    ours = asked.join(F.broadcast(want.select("column", F.struct("position", "type", "nullable").alias("e"))), "column")
    both = ours.join(mine, ["columns", "column"], "full")
    # places among the columns that both have
    shared = F.array_sort(F.collect_list(F.when(F.col("e").isNotNull() & F.col("f").isNotNull(), F.struct(F.col("e.position").alias("p"), "column"))))
    there = F.array_sort(F.collect_list(F.when(F.col("e").isNotNull() & F.col("f").isNotNull(), F.struct(F.col("f.position").alias("p"), "column"))))
    order = both.groupBy("columns").agg(F.transform(shared, lambda x: x["column"]).alias("a"), F.transform(there, lambda x: x["column"]).alias("b"))
    rows = both.join(order, "columns")
    place = lambda names: F.array_position(names, F.col("column"))
    case = lambda when, kind, a, b: F.when(when, F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("expected"), b.cast("string").alias("found")))
    e, f, none = F.col("e"), F.col("f"), F.lit(None)
    checks = F.array(
        case(f.isNull(), "missing", e["type"], none), case(e.isNull(), "extra", none, f["type"]), case(e["type"] != f["type"], "type", e["type"], f["type"]),
        case(e["nullable"] != f["nullable"], "nulls", e["nullable"], f["nullable"]), case(place("a") != place("b"), "moved", place("a") - 1, place("b") - 1),
    )
    found_ = rows.select("columns", "column", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("d")).select("columns", "column", "d.*")
    return one.join(found_, "columns").select("file", "file_rows", "column", "kind", "expected", "found")
