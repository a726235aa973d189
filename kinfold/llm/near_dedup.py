"""MinHash near-duplicate groups by min-max hashing.

One pass hashes every text into its set of word shingles. Under each permutation both the smallest and
the largest value are kept, so P permutations give 2P signature values for half the hash evaluations.
Bands of those values give candidates; sets are then compared in full.

No bucket is ever expanded into its pairs. In each bucket all members are first compared with one
leader, the member that meets most others over all its buckets. Components of the confirmed links are
formed. Only members of buckets that still hold several components are compared further, within their
bucket, block against block inside a task, and only links between components leave it. Then components
are formed again. Equal sets are one node throughout, and joins keep the rows of a set or bucket of any
size where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import hot_join, mix, passing, python_ready, shingle_hashes, stage, text_chunks, word_hashes
from kinfold.llm.components import components
from kinfold.llm.running import running_sums

#: Shingles of the members that a task compares with those of as many others at once; a member counts as MEMBER of them at least.
BLOCK, MEMBER = 250_000, 500
_PART = 8192


def banding(threshold: float, miss: float = 5e-8) -> tuple[int, int]:
    """(rows, bands) so that a pair at the threshold shares no band with a probability of at most miss."""
    rows = 5 if threshold >= 0.84 else 4
    bands = int(np.ceil(np.log(miss) / np.log(1 - threshold**rows)))
    return rows, bands + (rows * bands) % 2


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(values: np.ndarray, permutations: int) -> np.ndarray:
    """Minima, then maxima, of a non-empty set of 64-bit hashes under each permutation of 32-bit values."""
    a, b = _constants(permutations)
    low, high = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), _PART):
        y = x[i : i + _PART, None] * a + b
        low, high = np.minimum(low, y.min(0)), np.maximum(high, y.max(0))
    return np.concatenate([low, high])


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for data, offsets in text_chunks(batch.column("text")):
        hashes, at = shingle_hashes(*word_hashes(data, offsets), size)
        for d in range(len(at) - 1):
            yield np.unique(hashes[at[d] : at[d + 1]])


def sketch(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, n_shingles, set_key, bands, sig), one byte a value in sig; the last three are null for empty sets."""
    half = rows * bands // 2
    mult = np.random.default_rng(78).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
    salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, band, sig = [], [], [], []
            for s in _sets(batch, size):
                n.append(len(s))
                if not len(s):
                    key.append(None), band.append(None), sig.append(None)
                    continue
                v = signature(s, half)
                key.append(blake2b(s.tobytes(), digest_size=16).digest())
                band.append(mix((v.reshape(bands, rows).astype(np.uint64) * mult).sum(1) + salt).view(np.int64))
                sig.append(((v * np.uint32(0x85EBCA6B)) >> np.uint32(24)).astype(np.uint8).tobytes())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "sig"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, bands array<long>, sig binary")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, text) -> (node, items), one row a node: the sorted shingle hashes as 8-byte integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("node"), pa.array([s.tobytes() for s in _sets(batch, size)], pa.binary())], names=["node", "items"])

    return docs.select("node", "text").mapInArrow(run, "node binary, items binary").dropDuplicates(["node"])


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) whose full sets have den * |intersection| >= num * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    return with_sets.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _agreement(threshold: float, values: int) -> int:
    """Signature values in which a pair at the threshold agrees but for a chance of about one in 10**9."""
    return int(values * threshold - 6 * np.sqrt(values * threshold * (1 - threshold)))


def near_components(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Group the documents whose shingle sets have a Jaccard similarity of at least threshold[0] / threshold[1].

    docs has doc_id, of any type that can be ordered, and text; other columns are ignored. Returns, for
    each row of docs, doc_id, n_shingles (the set's size) and component_id, the smallest doc_id that links
    lead to.

    Null or empty texts, and texts of white space, have an empty set and are linked with nothing.
    A null doc_id takes no part in links and gets a null component. Repeated rows are returned as often
    as they are given; rows that share a doc_id but not the text are grouped each by its own text.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_ready(spark)
    num, den = threshold
    rows, bands = banding(num / den)
    need = _agreement(num / den, rows * bands)
    with passing(spark):
        sketches = stage(sketch(docs, shingle, rows, bands), "sketch", keep=True)
        whole = sketches.where("set_key is not null and doc_id is not null")
        # one node for each distinct set, however many documents have it: it is told by its digest
        first = F.min(F.struct("doc_id", "text_hash")).alias("doc")
        node = whole.groupBy("set_key").agg(first, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sig")])
        node = stage(node.withColumnsRenamed({"set_key": "node", "n_shingles": "n"}), "nodes")
        keys = node.select("node", F.explode("bands").alias("band"))
        shared = stage(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared")
        members = stage(hot_join(keys, shared.withColumnRenamed("n", "members"), ["band"], shared), "members")
        degree = members.groupBy("node").agg(F.sum("members").alias("degree"))
        members = stage(members.join(degree, "node").join(node.select("node", "n", "sig"), "node"), "members")
        leaders = members.groupBy("band").agg(F.max_by(F.struct("node", "n", "sig"), F.struct("degree", "node")).alias("lead"))
        met = hot_join(members, stage(leaders, "leaders"), ["band"], shared).where(F.col("node") != F.col("lead.node"))
        close = F.least("n", "lead.n") * den >= F.greatest("n", "lead.n") * num
        stars = met.where(close).select(
            F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v"), F.col("sig").alias("a"), F.col("lead.sig").alias("b")
        )
        stars = stage(_similar(stars, need).distinct(), "stars")
        # candidates grow with the input: one plan at every size, whatever a broadcast threshold may say
        wanted = members.select("node").distinct().join(node.select("node", "doc.*"), "node").hint("merge")
        # a row is there once before it meets its node: however often it is repeated, tasks send one of it
        texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).dropDuplicates(["doc_id", "text_hash"]).join(wanted, ["doc_id", "text_hash"])
        sets = stage(full_sets(texts, shingle), "sets")
        links = stage(_confirm(stars, sets, num, den), "links")
        part = components(links)
        more = stage(_rest(met.where("members > 2").select("band", "node", "n"), shared, node, part, sets, need, num, den), "links")
        part = components(links.unionByName(more)) if not more.isEmpty() else part
        # components of nodes, by their smallest document
        named = stage(part.join(node.select("node", F.col("doc.doc_id").alias("doc_id")), "node"), "named")
        least = stage(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
        linked = hot_join(named, least, ["component"]).select("node", "component_id")
        of_set = node.select("node", F.col("doc.doc_id").alias("own"), "copies").join(linked, "node", "left")
        of_set = stage(of_set.select(F.col("node").alias("set_key"), F.coalesce("component_id", "own").alias("component_id"), "copies"), "components", keep=True)
    each = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    found = hot_join(each, of_set.drop("copies"), ["set_key"], of_set.select("set_key", F.col("copies").alias("n")), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _similar(pairs: DataFrame, need: int) -> DataFrame:
    """Pairs whose signatures a and b agree in at least need values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(np.frombuffer(x.as_buffer(), np.uint8) == np.frombuffer(y.as_buffer(), np.uint8)).sum() >= need for x, y in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "u binary, v binary")


def _rest(members: DataFrame, shared: DataFrame, node: DataFrame, part: DataFrame, sets: DataFrame, need: int, num: int, den: int) -> DataFrame:
    """Further confirmed links (u, v): enough of them to connect all components that a link connects.

    members (band, node, n) are those of buckets but for the leaders. In each bucket that holds several
    components, members outside its most frequent one are held against all its members: blocks of the one
    side meet blocks of the other. A pair is looked at in the first of the buckets that it shares, where the
    signatures agree, by full sets; if one of them leads there, the pair was compared before. Of a member's
    links one to each other component leaves the task.
    """
    m = stage(members.join(part, "node", "left").withColumn("component", F.coalesce("component", "node")), "mixed")
    sizes = m.groupBy("band", "component").agg(F.count("*").alias("k"))
    main = stage(sizes.groupBy("band").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts"), "main")
    m = stage(hot_join(m, main, ["band"], shared), "mixed")
    blocked = lambda df, name: running_sums(df, ["band"], [F.col("n"), F.col("node")], {"upto": F.greatest("n", F.lit(MEMBER))}, "blocks").select("band", "node", "n", "component", F.expr(f"cast((upto - 1) div {BLOCK} as int)").alias(name))
    every, odd = stage(blocked(m.drop("main"), "y"), "blocks"), stage(blocked(m.where("component <> main").drop("main"), "x"), "blocks")
    last = lambda df, b: df.groupBy("band").agg(F.max(b).alias("most"))
    met = lambda df, b, other: hot_join(df, last(other, b), ["band"], shared).withColumn(b, F.explode(F.sequence(F.lit(0), F.col("most")))).drop("most")
    rows = met(odd, "y", every).withColumn("side", F.lit(True)).unionByName(met(every, "x", odd).withColumn("side", F.lit(False)))
    columns = lambda t: (t.column(c).combine_chunks() for c in ("node", "n", "component", "items"))

    def run(g: pa.Table) -> pa.Table:
        us, vs, band = [], [], g.column("band")[0].as_py()
        side = g.column("side").to_numpy()
        p, q = g.filter(pa.array(side)), g.filter(pa.array(~side))
        if len(p) and len(q):
            bands, sigs = _matrix(q.column("bands"), np.int64), _matrix(q.column("sig"), np.uint8)
            node, n, component, items = columns(q)
            n, component = n.to_numpy(), np.array(component.to_pylist(), object)
            for own, k, c, x, b, s in zip(*columns(p), _matrix(p.column("bands"), np.int64), _matrix(p.column("sig"), np.uint8), strict=True):
                k, c, a = k.as_py(), c.as_py(), np.frombuffer(x.as_buffer(), np.uint64)
                first = (bands == b).argmax(1)
                near = np.flatnonzero((bands[np.arange(len(n)), first] == band) & (np.minimum(n, k) * den >= np.maximum(n, k) * num))
                agree = (sigs[near] == s).sum(1)
                met = {c}
                for j in near[np.argsort(-agree, kind="stable")][: int((agree >= need).sum())]:
                    if component[j] in met:
                        continue
                    common = len(np.intersect1d(a, np.frombuffer(items[j].as_buffer(), np.uint64), assume_unique=True))
                    if den * common >= num * (len(a) + int(n[j]) - common):
                        met.add(component[j])
                        u, v = sorted((own.as_py(), node[j].as_py()))
                        us.append(u), vs.append(v)
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    full = rows.join(sets.join(node.select("node", "bands", "sig"), "node"), "node")
    return full.groupBy("band", "x", "y").applyInArrow(run, "u binary, v binary").distinct()


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """Rows of lists or binary values of one length."""
    rows = column.combine_chunks()
    flat = rows.flatten().to_numpy() if pa.types.is_list(rows.type) else np.frombuffer(b"".join(rows.to_pylist()), kind)
    return flat.reshape(len(rows), -1)
