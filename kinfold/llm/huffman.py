"""Canonical length-limited Huffman coding of token ids, in independent blocks.

File format, a Parquet folder: one row a block, blocks in ascending document order.

- block, part: its number, and the range of doc_ids it belongs to
- doc_ids, lengths: its documents and how many ids each has
- checkpoints: the bit at which every LANE-th id of the block begins
- payload: the code words, first bit highest, padded to 32-bit words

Beside it a folder of (id, bits): the code lengths; canonical code words follow from them alone.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm.common import remove, ship, stage

#: Ids of a block, unless one document has more, and ids between two checkpoints.
BLOCK_IDS, LANE = 1 << 17, 128
#: Stands for a null doc_id in the order of ids.
FIRST_ID = -(1 << 63)
#: Longest code word; the decoding table has 2 to this power entries.
MAX_BITS = 18
#: Words that a worker remembers the ids of.
MEMORY = 800_000

# The normalizer and the pre-tokenizer that pieces are known to be encoded alike by.
_LOWER_CASE = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PIECES = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_encoders: dict[str, WordEncoder] = {}


def _letters(piece: str) -> bool:
    """Whether the piece is letters alone, once normalized and in lower case: some capitals then end in a mark, which belongs to what follows."""
    return piece.isalpha() and (piece.isascii() or unicodedata.normalize("NFC", piece).lower().isalpha())


class WordEncoder(dict):
    """Whole texts to ids through the tokenizers library, each distinct word once while it is remembered.

    Word by word only with the normalizer and pre-tokenizer named above, which drop white space, so that no
    token spans a space or a line feed: the ids of a text are then those of its pieces between them, which
    this dictionary holds. With any others, whole texts go through the library.
    A piece of letters is one pre-token, so the library's model can encode it at once; a stop or comma
    after letters is a second one. Lower-casing comes first where it is certain to be the tokenizer's own
    (texts within Latin-1).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        spec = json.loads(self.tokenizer.to_str())
        self.lower = spec["normalizer"] == _LOWER_CASE
        plain = self.lower and spec["pre_tokenizer"] == _PIECES and spec["post_processor"] is None
        self.by_word = plain and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"])
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        # byte-level alphabet: a printable Latin-1 byte is its own character, others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        shown = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
        self.bytes = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(128, 256)}

    def __missing__(self, word: str) -> bytes:
        if len(self) > MEMORY:
            self.clear()
            self[""] = b""
        plain = self.lower and word.isalpha() and word.islower() and (word.isascii() or max(word) < "\u0100")
        if plain:
            ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.bytes))]
        elif word[-1] in ".," and _letters(word[:-1]):
            found = self[word] = self[word[:-1]] + self[word[-1]]
            return found
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = self[word] = array(self.code, ids).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        if not self.by_word:
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        out = []
        for t in texts:
            t = t or ""
            if self.lower:
                try:
                    t.encode("latin-1")
                    low = t.lower()
                    t = t if any(s in low for s in self.special) else low
                except UnicodeEncodeError:
                    pass
            out.append(np.frombuffer(b"".join(map(self.__getitem__, t.replace("\n", " ").split(" "))), self.kind))
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits by package-merge; 0 for counts of 0."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        bits[used] = 1
        return bits
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit into code words of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    layers, weight = [], leaf
    for _ in range(limit - 1):
        pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaf, pairs])
        rank = np.argsort(merged, kind="stable")
        layers.append(rank < len(leaf))
        weight = merged[rank]
    take, depth = 2 * len(leaf) - 2, np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(layers):
        leaves = int(is_leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    depth[:take] += 1
    bits[order] = depth
    return bits


class Code:
    """Canonical code words: by length, then by id."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(np.int64)
        self.longest = max(1, int(bits.max(initial=0)))
        order = np.lexsort((np.arange(len(bits)), bits))
        order = order[bits[order] > 0]
        span = np.int64(1) << (self.longest - self.bits[order])
        begin = np.concatenate([[0], np.cumsum(span)])
        self.words = np.zeros(len(bits), np.uint64)
        self.words[order] = (begin[:-1] >> (self.longest - self.bits[order])).astype(np.uint64)
        size = 1 << self.longest
        self.table = np.zeros(size, np.uint32)
        self.table[: begin[-1]] = np.repeat(order, span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(payload, checkpoints) of one block."""
        length = self.bits[ids]
        end = np.cumsum(length)
        begin = end - length
        word = begin >> 5
        shifted = self.words[ids] << (64 - (begin & 31) - length).astype(np.uint64)
        n = int(end[-1] + 31 >> 5) + 1 if len(ids) else 1
        # code words never overlap, so that adding them up sets their bits; below 2**53 floats are exact
        out = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n + 1)
        out += np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
        return out[:n].astype(">u4").tobytes(), begin[::LANE].astype(np.uint32)

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of one block; all lanes between checkpoints advance together."""
        words = np.concatenate([np.frombuffer(payload, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((LANE, len(at)), np.uint32)
        top, mask = 64 - self.longest, np.uint64((1 << self.longest) - 1)
        last = n - (len(at) - 1) * LANE
        bits, table = self.bits, self.table
        for k in range(LANE):
            if k == last:  # the last lane is shorter
                at = at[:-1]
            if not len(at):
                break
            x = table[(pairs[at >> 5] >> (top - (at & 31)).astype(np.uint64)) & mask]
            out[k, : len(at)] = x
            at = at + bits[x]
        return out.T.reshape(-1)[:n]


def _encode(docs: DataFrame, tokenizer: str, end_id: int, cuts: list[int]) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, pack, bounds = encoder(tokenizer), zstandard.ZstdCompressor(level=1), np.array(cuts, np.int64)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                key = batch.column("doc_id").cast(pa.int64()).fill_null(FIRST_ID).to_numpy(zero_copy_only=False)
                part, last = np.searchsorted(bounds, key), np.searchsorted(bounds, key, "right")
                # an id at which several ranges end fills them all: its rows go to any of them
                width = np.where(last - part > 1, last - part + 1, 1)
                part = part + ((batch.column("hash").to_numpy().view(np.uint64) >> np.uint64(40)).astype(np.int64) * width >> 24)
                ids = [np.append(x, x.dtype.type(end_id)) for x in to_ids.encode(batch.column("text").to_pylist())]
                n, packed = [len(x) for x in ids], [bytes([x.itemsize]) + pack.compress(x.tobytes()) for x in ids]
                yield pa.record_batch([pa.array(part, pa.int32()), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], names=["part", "doc_id", "n", "ids"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, f"part int, doc_id {kind}, n long, ids binary")


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), f"<u{x[0]}").astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode every text of docs (doc_id, text) and write the ids to path, in ascending doc_id order.

    Documents are dealt out by ranges of doc_id, as many as the session has shuffle partitions, encoded
    once and kept compressed in the shared folder until the counts over all documents have given the
    code. doc_ids are whole numbers. Null texts are empty; null doc_ids come first; rows with equal doc_ids follow in the
    order of their ids. A doc_id, or null, that fills several ranges has its rows dealt out to them by a hash of their
    texts, and the order of ids holds within each. An empty table writes no block. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(int(c) for c in cuts or [])
    held = f"{path}/ids"
    ids = stage(_encode(docs, tokenizer, end_id, cuts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "ids"), "ids", held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(0, np.int64), [], 0

        def add() -> np.ndarray:
            got = np.bincount(np.concatenate(held), minlength=len(total))
            got[: len(total)] += total
            return got

        for batch in batches:
            for x in batch.column("ids"):
                held.append(_unpack(x.as_py()))
                size += len(held[-1])
                if size > BLOCK_IDS:
                    total, held, size = add(), [], 0
        total = add() if held else total
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # one row for each id of the vocabulary: bounded by the tokenizer
    counts = ids.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    table[counts["id"].to_numpy(np.int64)] = counts["n"]
    bits = code_lengths(table)
    spark.createDataFrame([(int(i), int(bits[i])) for i in np.flatnonzero(bits)] or [], "id int, bits int").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast(bits)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, size, number = Code(code.value), [], 0, TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            parts, doc_ids, ids = zip(*held, strict=True)
            payload, checkpoints = coder.encode(every := np.concatenate(ids))
            row = (number, parts[0], list(doc_ids), [len(x) for x in ids], len(every), checkpoints.tobytes(), payload)
            types = (pa.int64(), pa.int32(), pa.list_(kept.field("doc_id").type), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["block", "part", "doc_ids", "lengths", "n_ids", "checkpoints", "payload"])

        for batch in batches:
            kept = batch.schema
            for part, doc_id, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = _unpack(x.as_py())
                if held and (size + len(ids) > BLOCK_IDS or held[0][0] != part):
                    yield block()
                    held, size, number = [], 0, number + 1
                held.append((part, doc_id, ids))
                size += len(ids)
        if held:
            yield block()

    # rows keep their order within a task; blocks are ordered by their documents afterwards
    blocks = ids.select("part", "doc_id", "ids").mapInArrow(pack, f"block long, part int, doc_ids array<{kind}>, lengths array<long>, n_ids long, checkpoints binary, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    remove(spark, held)


def read(spark: SparkSession, path: str, digest: bool = True) -> DataFrame:
    """Decode the blocks: doc_id, start, n_tokens and either ids_crc32 or, without digest, the ids."""
    ship(spark)
    lengths = spark.read.parquet(f"{path}/code").toPandas()
    bits = np.zeros(int(lengths["id"].max()) + 1 if len(lengths) else 1, np.uint8)
    bits[lengths["id"].to_numpy(np.int64)] = lengths["bits"]
    code = spark.sparkContext.broadcast(bits)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Code(code.value)
        for batch in batches:
            for b in range(len(batch)):
                n = batch.column("lengths")[b].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = coder.decode(batch.column("payload")[b].as_py(), np.frombuffer(batch.column("checkpoints")[b].as_py(), np.uint32), batch.column("n_ids")[b].as_py())
                end = np.cumsum(n)
                each = [ids[e - k : e].astype("<u4") for e, k in zip(end, n, strict=True)]
                value = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digest else pa.array(each, pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(np.full(len(n), batch.column("block")[b].as_py())), batch.column("doc_ids")[b].values, pa.array(end - n), pa.array(n), value], names=["block", "doc_id", "within", "n_tokens", "value"])

    decoded = blocks.mapInArrow(run, f"block long, doc_id {kind}, within long, n_tokens long, value {'long' if digest else 'array<long>'}")
    return decoded.join(block_starts(blocks), "block").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", F.col("value").alias("ids_crc32" if digest else "ids"))


def block_starts(blocks: DataFrame) -> DataFrame:
    """(block, before): the ids of all blocks before it, from sums over the parts and prefix sums within each."""
    keys = blocks.select("block", "part", F.col("doc_ids")[0].alias("first"), F.element_at("doc_ids", -1).alias("last"), "n_ids")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as there are parts
    parts = keys.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.sum("n").over(earlier(Window.orderBy("part"))).alias("parts_before"))
    within = F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy(F.col("first").asc_nulls_first(), F.col("last").asc_nulls_first(), "block")))
    return keys.withColumn("within_part", within).join(parts, "part").select("block", (F.coalesce("parts_before", F.lit(0)) + F.coalesce("within_part", F.lit(0))).alias("before"))
