"""Shared pieces of the training-data operators: scratch tables and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled by one round of vectorised work inside a task.
CHUNK_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, a new local folder serves a driver that runs its own tasks, as in tests; on a cluster
    that is an error, since executors would not see each other's files.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="kinfold-"))
        path = sc.getCheckpointDir()
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, but for those staged with keep: these pass to the scope around it, if there is one."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def stage(df: DataFrame, name: str, path: str | None = None, keep: bool = False) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    for scope in _scopes[: -1 if keep else None][-1:]:
        scope.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_key(df: DataFrame, names: list[str] | None = None) -> list[Column]:
    """Two hashes, 96 bits in all, over the values of the named columns, or of all of them. Null differs from any value."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in (kind := f.dataType.simpleString()) or kind == "variant" else F.col(f"`{f.name}`")
    fields = [f for f in df.schema.fields if names is None or f.name in names]
    values = [x for f in fields for x in (F.isnull(F.col(f"`{f.name}`")), plain(f))]
    return [F.xxhash64(*values), F.hash(*values, F.lit(7))]


#: Keys that may each hold more than a task's fair share of the rows of a join.
HOT_KEYS, HOT_ROWS = 4096, 100


def hot_join(rows: DataFrame, table: DataFrame, key: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row a key, however many rows one key has. A null key meets nothing.

    Keys with more than 1 / HOT_KEYS of all rows are fewer than HOT_KEYS: their entries are broadcast, and
    their rows stay where they are. All others are joined by shuffling. The most frequent key counts as one
    of the first kind, so that tables of more than HOT_ROWS rows have one plan. counts (key, n) saves
    counting the keys of rows. Both tables should be written ones: they are read twice. how: inner or left.
    """
    if counts is None:
        counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    total, some = rows.count(), F.lit(True)
    bound = max(HOT_ROWS, total // HOT_KEYS)
    for k in key:
        some = some & F.col(k).isNotNull()
    hot = []
    if total > HOT_ROWS:
        # fewer than HOT_KEYS rows, or one
        hot = counts.where(some).where(F.col("n") > bound).select(*key).collect() or counts.where(some).orderBy(F.desc("n"), *key).select(*key).limit(1).collect()
    names, nulls = [*rows.columns, *[c for c in table.columns if c not in key]], rows.where(~some)
    if not hot:
        joined = rows.where(some).join(table, key, how).select(*names)
    else:
        keys = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*key).schema))
        entries = keys.join(table, key, how) if how == "left" else table.join(keys, key, "left_semi")
        spread = rows.join(F.broadcast(entries), key)
        joined = spread.select(*names).unionByName(rows.where(some).join(keys, key, "left_anti").join(table, key, how).select(*names))
    return joined if how == "inner" else joined.unionByName(nulls, allowMissingColumns=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, as spark-submit --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="kinfold-ship-")) / "kinfold-package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def python_ready(spark: SparkSession) -> None:
    """Ship the package, and keep the batches that go to Python workers small: texts can be long, and two workers share an executor's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0. Null ids count as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(rows: DataFrame, limit: int, *key: str) -> DataFrame:
    """At most limit rows, the first by a hash of their key. Rows are thinned out by the hash beforehand, so that tasks send the driver about limit rows in all, however many there are."""
    n, parts, key = rows.count(), 1 << 24, key or ("doc_id",)
    if n > 2 * limit:
        rows = rows.where(F.pmod(F.xxhash64(*key), F.lit(parts)) < int(1.2 * parts * limit / n) + 1)
    return rows.orderBy(F.pmod(F.xxhash64(*key), F.lit(parts)), *key).limit(limit)


def word_count(text: Column) -> Column:
    """How many words a text has. Where single spaces alone part them, as in most, their number tells; else the words are matched."""
    odd = F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" ")) | (text == "")
    for gap in ("  ", "\t", "\n", "\x0b", "\x0c", "\r"):
        odd = odd | F.contains(text, F.lit(gap))
    spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))
    return F.when(odd, F.regexp_count(text, F.lit(WORD))).otherwise(spaces + 1)


def text_chunks(column: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (UTF-8 bytes, document offsets) of runs of rows, each of about limit bytes or of one longer text. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (shift, multiply, shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    x = x ^ (x >> np.uint64(28))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_MULT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, as far as n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased, and where each document's words begin (one more entry than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * power, out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin]), np.searchsorted(begin, offsets).astype(np.int64)


def shingle_hashes(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all size-word shingles and where each document's begin; fewer words make one shingle, no words none."""
    count = np.diff(at)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(begin[-1], np.uint64)
    full = np.flatnonzero(count >= size)
    if len(full):
        where = np.repeat(at[:-1][full] - begin[:-1][full], made[full]) + (into := np.concatenate([np.arange(begin[d], begin[d + 1]) for d in full]))
        total = np.zeros(len(where), np.uint64)
        for j in range(size):
            total += words[where + j] * _MULT[j]
        out[into] = mix(total)
    for d in np.flatnonzero((count > 0) & (count < size)):
        w = words[at[d] : at[d + 1]]
        out[begin[d]] = mix(np.append(w * _MULT[: len(w)], _MULT[40 + len(w)]).sum(keepdims=True))[0]
    return out, begin
