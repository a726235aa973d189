"""Jaccard join of word n-gram sets by parity sketches.

A token flips one bit of a sketch, so sketches that differ in H bits are of sets that differ in H tokens at least.
Sets with a Jaccard similarity of t differ in at most D = (a + b)(1 - t) / (1 + t) tokens. Two kinds of sketches of a
set are kept, both made of XORs alone:

The first is cut into blocks, more than D of them, of 2**16 bits each. By pigeonhole two linked sets agree in a block.
What a block holds is known by a 64-bit XOR hash of its bits, and that is a key to meet by. Sizes are dealt into
bands from L to 2 L, a factor of 2 t apart, so that two linked sets share a band; a set is sketched for each
of the one or two bands that it lies in, and a block holds three to six tokens at any size. There are some spare
blocks more: a set with no more empty blocks than these does without keys for them, and a linked set still agrees
with it in a block that both keep.

The second has about as many bits as the set has tokens, and can be folded to half its size. Its Hamming distance
tells most pairs apart that met by chance; the others are compared in full.

Equal sets are one. Keys are moved once, and those of very many sets, which a sample tells, are dealt into parts. No
bucket is expanded into its pairs: its members are compared with a few leaders of it, the same ones in all buckets
that have them, and components of the confirmed links are formed. Only in larger buckets that then still hold several
components are members compared further, sketch against sketch and block against block inside a task. Texts move for
the sets of pairs that their sketches leave open, and compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from math import floor, log
from zlib import compress, decompress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import bounded_sample, hot_join, mix, passing, python_ready, shingle_hashes, stage, text_chunks, word_hashes
from kinfold.llm.components import components
from kinfold.llm.running import running_sums

#: Leaders of a bucket.
LEADERS = 3
#: Tokens of the members on one side of a last comparison; a member counts as MEMBER of them at least. A task makes comparisons of about BIN tokens.
BLOCK, MEMBER, BIN = 1_000_000, 500, 4_000_000
#: Sets that are looked at for keys of very many sets, in how many of them a key is such a one, how many such keys there are at most, and how many parts each is dealt into. They change the plan only.
SAMPLE_ROWS, OFTEN, HOT_KEYS, SALTS = 20_000, 20, 16_384, 64
#: Digests that a task remembers, so as to sketch a set once.
SEEN = 200_000
_U = np.uint64


def most_difference(a, b, num: int, den: int):
    """The largest symmetric difference of sets of these sizes with a similarity of num / den or more."""
    return (a + b) * (den - num) // (den + num)


@cache
def layouts(n: int, num: int, den: int) -> tuple[int, ...]:
    """The bands of a size: those with L <= n <= 2 L, L being a power of 2 num / den."""
    top = floor(log(n) / log(2 * num / den) + 1e-9)
    return tuple(j for j in range(max(0, top - 2 - floor(log(2) / log(2 * num / den))), top + 1) if n <= 2 * (2 * num / den) ** j + 1e-6)


@cache
def layout(band: int, num: int, den: int) -> tuple[int, int]:
    """(blocks, how many of them pigeonhole does not need) of the sketches of a band."""
    largest = floor(2 * (2 * num / den) ** band + 1e-6)
    need = most_difference(largest, largest, num, den) + 1
    spare = max(1, need // 10) if need > 1 else 0
    return need + spare, spare


def block_keys(tokens: np.ndarray, band: int, num: int, den: int) -> np.ndarray:
    """A key for what each block of the parity sketch of distinct 64-bit tokens holds; 0 for an empty block that needs none."""
    blocks, spare = layout(band, num, den)
    x = mix(tokens + _U(2 * band + 1))
    block = (x >> _U(32)) % _U(blocks)
    held = np.zeros(blocks, _U)
    np.bitwise_xor.at(held, block.astype(np.int64), mix((block << _U(16)) + (x & _U(0xFFFF)) + _U(1)))
    empty = held == 0
    keys = mix(held ^ mix(np.arange(blocks, dtype=_U) + _U((band + 1) << 40))) | _U(1)
    return np.where(empty, _U(0), keys) if empty.sum() <= spare else keys


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """The sketch for Hamming distances: 256 bits or, up to a factor of two, one for each token."""
    bits = max(256, 1 << (len(tokens) - 1).bit_length())
    where = (mix(tokens) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(where, minlength=bits) & 1).astype(np.uint8)).view(_U)


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of as many 64-bit words that the same tokens have."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def near(a: np.ndarray, b: np.ndarray, m: int, n: int, num: int, den: int) -> bool:
    """Whether sketches a and b of sets of m and n tokens leave room for a similarity of num / den."""
    words = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()) <= most_difference(m, n, num, den)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether sorted sets x and y have a similarity of num / den or more."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return den * common >= num * (len(x) + len(y) - common)


def _sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for data, offsets in text_chunks(texts):
        hashes, at = shingle_hashes(*word_hashes(data, offsets), size)
        for d in range(len(at) - 1):
            yield np.unique(hashes[at[d] : at[d + 1]])


def sketches(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, n_shingles, set_key, sig, keys). set_key is null for empty sets; sig and keys, of all bands of the set, are null for those that no other set can be linked with or that have no doc_id, and where the task has given them before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            n, key, sig, keys = [], [], [], []
            for s, named in zip(_sets(batch.column("text"), size), batch.column("doc_id").is_valid().to_pylist(), strict=True):
                n.append(len(s))
                key.append(own := blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                skip = den * len(s) < num * (len(s) + 1) or own in seen or not named  # one token more is already too much
                sig.append(None if skip else parity_bits(s).tobytes())
                keys.append(None if skip else np.concatenate([block_keys(s, j, num, den) for j in layouts(len(s), num, den)]).view(np.int64))
                if len(seen) >= SEEN:
                    seen.clear()
                if named:
                    seen.add(own)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "sig", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, sig binary, keys array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pack): the compressed text, once for rows that are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack = [compress(t or b"", 1) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(pack, pa.binary())], names=["doc_id", "text_hash", "pack"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, pack binary")
    return rows.groupBy("doc_id", "text_hash").agg(F.first("pack").alias("pack"))


def unpacked(pack: pa.Scalar, size: int) -> np.ndarray:
    """The set of a packed text."""
    return next(_sets(pa.array([decompress(pack.as_buffer())], pa.binary()).cast(pa.string()), size))


def _where(pairs: DataFrame, columns: list[str], keep) -> DataFrame:
    """(u, v) of the rows that keep(a row of columns) is true of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [keep(*row) for row in zip(*[batch.column(c) for c in columns], strict=True)]
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(kept, pa.bool_()))

    kind = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in "uv")
    return pairs.select("u", "v", *columns).mapInArrow(run, kind)


def shared_keys(made: DataFrame) -> DataFrame:
    """(key, node): the keys that several sets have, and each of these sets, by a short name. The rows move once."""
    keys = made.where("doc_id is not null").select(F.xxhash64("set_key").alias("node"), F.explode("keys").alias("key")).where("key <> 0")
    sample = bounded_sample(made.where("doc_id is not null and keys is not null").select("set_key", "keys"), SAMPLE_ROWS, "set_key")
    often = sample.select(F.explode("keys").alias("key")).where("key <> 0").groupBy("key").count().where(F.col("count") >= OFTEN)
    hot = [(r.key, True) for r in often.orderBy(F.desc("count"), "key").limit(HOT_KEYS).collect()]
    listed = F.broadcast(made.sparkSession.createDataFrame(hot, "key long, hot boolean"))
    dealt = keys.join(listed, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("node", F.lit(SALTS))).otherwise(0))
    here = Window.partitionBy("key", "salt")
    met = dealt.withColumns({"low": F.min("node").over(here), "high": F.max("node").over(here)}).where("hot or low <> high")
    alone = keys.join(listed, "key", "left_semi").groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low = high").select("key")
    # no more than HOT_KEYS rows
    return met.join(F.broadcast(alone), "key", "left_anti").select("key", "node").distinct()


def jaccard_components(docs: DataFrame, shingle: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """Components of documents whose word shingle sets have a Jaccard similarity of at least threshold[0] / threshold[1].

    docs has doc_id, of any type that can be ordered, and text; other columns are ignored, whatever their names. Returns,
    for each row, doc_id, n_shingles (the size of its set) and component_id, the smallest doc_id that links lead to.
    The join is exact but for equal hashes of different things: 64 bits for a shingle, 128 for a set.

    Fewer words than a shingle has are one shingle. Null, empty and blank texts have an empty set and are linked with
    nothing. A null doc_id takes no part in links and gets a null component. Repeated rows are returned as often as
    they are given; rows that share a doc_id but not the text are grouped each by its own text. Whole texts are used,
    in memory proportional to a text's words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_ready(spark)
    num, den = threshold
    if not 0 < num <= den < 2 * num:
        raise ValueError("the threshold lies between a half and one")
    with passing(spark):
        made = stage(sketches(docs, shingle, num, den), "sketches", keep=True)
        whole = made.where("set_key is not null and doc_id is not null")
        first = F.min(F.struct("doc_id", "text_hash")).alias("doc")
        sets = whole.groupBy("set_key").agg(first, F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sig", True).alias("sig"))
        sets = stage(sets.withColumn("node", F.xxhash64("set_key")), "sets")
        members = stage(shared_keys(made), "members")
        # leaders are the first by a few orders that are the same in all buckets
        orders = [F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(LEADERS)]
        leaders = stage(members.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*orders)).alias("leads")), "leaders")
        counts = leaders.select("key", "n")
        met = hot_join(members, leaders.select("key", "leads"), ["key"], counts).select("node", F.explode("leads").alias("lead")).where("node <> lead")
        links = _confirmed(met.select(F.least("node", "lead").alias("u"), F.greatest("node", "lead").alias("v")), docs, sets, shingle, num, den)
        part = components(links)
        open_ = leaders.where(F.col("n") - 1 > F.size("leads")).select("key", "n")
        more = _confirmed(_rest(members, open_, sets, part, num, den), docs, sets, shingle, num, den)
        part = components(links.unionByName(more)) if not more.isEmpty() else part
        # components of sets, by their smallest document
        named = stage(part.join(sets.select(F.col("set_key").alias("node"), F.col("doc.doc_id").alias("doc_id")), "node"), "named")
        least = stage(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
        found = hot_join(named, least, ["component"]).select(F.col("node").alias("set_key"), "component_id")
        of_set = sets.select("set_key", F.col("doc.doc_id").alias("own"), "copies").join(found, "set_key", "left")
        of_set = stage(of_set.select("set_key", F.coalesce("component_id", "own").alias("component_id"), "copies"), "components", keep=True)
    each = made.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = hot_join(each, of_set.drop("copies"), ["set_key"], of_set.select("set_key", F.col("copies").alias("n")), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Links (u, v), by set_key, among pairs (u, v) of short names; repeated pairs are one. Written."""
    short = lambda end, names: sets.select(F.col("node").alias(end), *[F.col(c).alias(x) for c, x in names.items()]).hint("merge")
    met = pairs.distinct().join(short("u", {"set_key": "s", "sig": "a", "n": "m"}), "u").join(short("v", {"set_key": "t", "sig": "b", "n": "n"}), "v")
    met = met.where(F.least("m", "n") * den >= F.greatest("m", "n") * num).drop("u", "v").withColumnsRenamed({"s": "u", "t": "v"})
    bits = lambda x: np.frombuffer(x.as_buffer(), _U)
    left = stage(_where(met, ["a", "b", "m", "n"], lambda a, b, m, n: near(bits(a), bits(b), m.as_py(), n.as_py(), num, den)), "open")
    if left.isEmpty():
        return left
    wanted = left.select(F.col("u").alias("set_key")).union(left.select("v")).distinct().join(sets.select("set_key", "doc.*").hint("merge"), "set_key")
    texts = stage(wanted.hint("merge").join(packed(docs), ["doc_id", "text_hash"]).select("set_key", "pack"), "texts")
    of = lambda end, x: texts.select(F.col("set_key").alias(end), F.col("pack").alias(x)).hint("merge")
    both = left.join(of("u", "a"), "u").join(of("v", "b"), "v")
    return stage(_where(both, ["a", "b"], lambda a, b: linked(unpacked(a, shingle), unpacked(b, shingle), num, den)), "links")


def _rest(members: DataFrame, open_: DataFrame, sets: DataFrame, part: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) that sketches leave open, in the buckets open_ (key, n) that hold several components.

    Members outside a bucket's most frequent component are held against all its members of other components: blocks
    of the one side meet blocks of the other, many small buckets in one task. A pair comes from the first of
    these buckets that it shares.
    """
    m = members.join(open_.select("key"), "key", "left_semi").join(sets.select("node", "set_key", F.col("n").alias("size")), "node").join(part.withColumnRenamed("node", "set_key"), "set_key", "left")
    m = stage(m.select("key", "node", F.col("size").alias("n"), F.coalesce("component", "set_key").alias("component")), "mixed")
    sizes = m.groupBy("key", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts"))
    main = stage(main.where("parts > 1").drop("parts"), "main")
    m = stage(hot_join(m, main, ["key"], open_), "mixed")
    own = m.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("own"))  # no more than the set has keys
    blocked = lambda df, name: running_sums(df, ["key"], [F.col("n"), F.col("node")], {"upto": F.greatest("n", F.lit(MEMBER))}, "blocks").select("key", "node", "n", "component", F.expr(f"cast((upto - 1) div {BLOCK} as int)").alias(name))
    every, odd = stage(blocked(m.drop("main"), "y"), "blocks"), stage(blocked(m.where("component <> main").drop("main"), "x"), "blocks")
    last = lambda df, b: df.groupBy("key").agg(F.max(b).alias("most"))
    facing = lambda df, b, other: hot_join(df, stage(last(other, b), "most"), ["key"], open_).withColumn(b, F.explode(F.sequence(F.lit(0), F.col("most")))).drop("most")
    rows = facing(odd, "y", every).withColumn("side", F.lit(True)).unionByName(facing(every, "x", odd).withColumn("side", F.lit(False)))
    rows = stage(rows, "facing")
    weight = rows.agg(F.coalesce(F.sum(F.greatest("n", F.lit(MEMBER))), F.lit(0))).first()[0]
    rows = rows.withColumns({"task": F.xxhash64("key", "x", "y"), "bin": F.pmod(F.xxhash64("key", "x", "y"), F.lit(weight // BIN + 1))})

    def run(g: pa.Table) -> pa.Table:
        out: set[tuple[int, int]] = set()
        g = g.sort_by([("task", "ascending"), ("side", "ascending")])
        task, side, n, names, key = (g.column(c).to_numpy() for c in ("task", "side", "n", "node", "key"))
        own_keys = [x.values.to_numpy() for x in g.column("own")]
        component = np.unique(np.array(g.column("component").to_pylist(), object), return_inverse=True)[1]
        sigs = [np.frombuffer(x.as_buffer(), _U) for x in g.column("sig")]
        edges = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
        for at, to in zip(edges, edges[1:], strict=False):
            words = min(map(len, sigs[at:to]))
            sig = np.stack([fold(s, words) for s in sigs[at:to]])
            half = at + int(np.searchsorted(side[at:to], True))
            q = np.arange(at, half)
            for p in range(half, to):
                some = q[(np.minimum(n[q], n[p]) * den >= np.maximum(n[q], n[p]) * num) & (component[q] != component[p])]
                apart = np.bitwise_count(sig[some - at] ^ sig[p - at]).sum(1, dtype=np.int64)
                for j in some[apart <= most_difference(n[some], n[p], num, den)]:
                    if np.intersect1d(own_keys[p], own_keys[j])[0] == key[p]:
                        out.add((int(min(names[p], names[j])), int(max(names[p], names[j]))))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    full = rows.join(sets.select("node", "sig").hint("merge"), "node").join(own.hint("merge"), "node")
    return full.groupBy("bin").applyInArrow(run, "u long, v long")
