"""Token ids as canonical length-limited Huffman blocks.

The store is a folder with two Parquet tables. ``code`` has the length of every id's code word,
from which the canonical code follows. ``blocks`` has one row per block, in ascending order of
(shard, block): the documents in it, their numbers of ids, the code words as one string of bits
and, every ``STRIDE`` ids, the bit offset at which decoding can start. A block is decoded without
any other block; within it all strides are decoded side by side, one table look-up per id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.llm import vocab
from paceline.llm.common import bytes_of, scratch, small_batches, staged

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Ids in a block, unless a single document has more; ids between two checkpoints; longest code word.
BLOCK_IDS, STRIDE, LONGEST = 1 << 18, 256, 16
#: Most ids that a vocabulary may have: the code table goes to every executor.
LARGEST_VOCABULARY = 1 << 20


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Optimal code word lengths of at most ``longest`` bits (package-merge); 0 for a count of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << longest:
        raise ValueError(f"{n} ids don't fit in code words of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, is_leaf = leaves, []
    for _ in range(longest - 1):
        is_leaf.append(None)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        level, is_leaf[-1] = both[place], place < n
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(is_leaf):
        own = int(leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: ids by (length, id) get consecutive values."""
    ids = np.flatnonzero(lengths)
    order = ids[np.argsort(lengths[ids], kind="stable")]
    size = lengths[order].astype(np.int64)
    top = int(size[-1]) if len(size) else 1
    spans = np.int64(1) << (top - size)
    words = np.zeros(len(lengths), np.uint64)
    words[order] = ((np.cumsum(spans) - spans) >> (top - size)).astype(np.uint64)
    return words


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next ``top`` bits: the id and the length of its code word."""
    ids = np.flatnonzero(lengths)
    order = ids[np.argsort(lengths[ids], kind="stable")]
    top = int(lengths.max()) if len(ids) else 1
    spans = np.int64(1) << (top - lengths[order].astype(np.int64))
    symbol = np.zeros(1 << top, np.uint32)
    size = np.ones(1 << top, np.int64)
    filled = int(spans.sum())
    symbol[:filled] = np.repeat(order, spans)
    size[:filled] = np.repeat(lengths[order], spans)
    return symbol, size, top


def encode(ids: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes, int]:
    """The bits, the checkpoints (unsigned 64-bit offsets) and the number of bits."""
    size = lengths[ids].astype(np.uint64)
    ends = np.cumsum(size)
    begins = ends - size
    bits = int(ends[-1]) if len(ids) else 0
    cell = (begins >> np.uint64(5)).astype(np.int64)
    value = words[ids] << (np.uint64(64) - (begins & np.uint64(31)) - size)
    out = np.zeros(bits // 32 + 3, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        out[cell[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[cell[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (bits + 7) // 8], begins[::STRIDE].astype("<u8").tobytes(), bits


def decode(data: bytes, offsets: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """``n`` ids; lane k starts at checkpoint k, and all lanes step together."""
    symbol, size, top = table
    cells = np.frombuffer(data + bytes(12 - len(data) % 4), ">u4").astype(np.uint64)
    at = np.frombuffer(offsets, "<u8").astype(np.int64)
    out = np.zeros((len(at), STRIDE), np.uint32)
    tail = n - (len(at) - 1) * STRIDE
    for step in range(STRIDE if len(at) > 1 else tail):
        if step == tail and len(at) > 1:
            at = at[:-1]
        cell = at >> 5
        pair = (cells[cell] << np.uint64(32)) | cells[cell + 1]
        code = ((pair >> (64 - top - (at & 31)).astype(np.uint64)) & np.uint64((1 << top) - 1)).astype(np.int64)
        out[: len(at), step] = symbol[code]
        at = at + size[code]
    return out.reshape(-1)[:n]


class Remembered(dict):
    """Words to their packed ids; those of a new word are found when it is looked up."""

    def __init__(self, path: str, kind: str):
        super().__init__()
        self.path, self.kind = path, np.dtype(kind)

    def __missing__(self, word: str) -> bytes:
        self[word] = packed = np.array(vocab.merged(self.path, word), self.kind).tobytes()
        return packed


@cache
def remembered(path: str, kind: str) -> Remembered:
    """One memory for all tasks of a process."""
    return Remembered(path, kind)


class Encoder:
    """Texts to ids as packed integers; ids of words that were met lately are remembered."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind, self.seen = path, np.dtype(kind), remembered(path, kind)

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def stretch(self, text: str) -> bytes:
        if vocab.OUTSIDE.search(text):
            return self.pack(vocab.tokenizer(self.path).encode(text, add_special_tokens=False).ids)
        found = vocab.WORD_RULE.findall(text.lower())
        if len(self.seen) > vocab.REMEMBERED:
            self.seen.clear()
        return b"".join(map(self.seen.__getitem__, found))

    def encode(self, text: str) -> bytes:
        t = vocab.tokenizer(self.path)
        return b"".join(
            self.pack([t.token_to_id(x)]) if k % 2 else self.stretch(x) for k, x in enumerate(vocab.pieces(self.path, text)) if x
        )


def token_ids(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the ids of each text and ``end``, as little-endian integers of 2 or 4 bytes."""
    small_batches(docs.sparkSession)
    kind = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(path, kind), np.array([end], kind).tobytes()
        for b in batches:
            ids = [(encoder.encode(x.decode()) if x else b"") + last for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return bytes_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def id_type(path: str) -> str:
    n = vocab.tokenizer(path).get_vocab_size()
    if n > LARGEST_VOCABULARY:
        raise ValueError(f"{path}: {n} ids; at most {LARGEST_VOCABULARY} are taken")
    return "<u2" if n <= 1 << 16 else "<u4"


def id_counts(ids: DataFrame, kind: str, n: int) -> np.ndarray:
    """How often each id occurs in the whole corpus: at most ``n`` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind), minlength=n)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    counts = np.zeros(n, np.int64)
    for r in ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.id] = r.n
    return counts


def write_blocks(ids: DataFrame, path: str, to: str) -> None:
    """Write the store: global code, then the blocks in ascending ``doc_id`` order."""
    spark, kind = ids.sparkSession, id_type(path)
    n = vocab.tokenizer(path).get_vocab_size()
    lengths = code_lengths(id_counts(ids, kind, n), max(LONGEST, n.bit_length()))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{to}/code")
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, shard, block = sent.value, TaskContext.get().partitionId(), 0
        words, docs, parts, held = canonical(lengths), [], [], 0

        def flush():
            data, offsets, bits = encode(np.concatenate(parts), words, lengths)
            row = {
                "shard": shard, "block": block, "n_ids": held, "doc_ids": list(docs), "doc_sizes": [len(x) for x in parts],
                "bits": bits, "payload": data, "checkpoints": offsets,
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(x, kind))
                held += len(parts[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    block, docs, parts, held = block + 1, [], [], 0
        if parts:
            yield flush()

    ordered = ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(run, BLOCK_COLUMNS).write.option("compression", "zstd").parquet(f"{to}/blocks")


BLOCK_COLUMNS = (
    "shard int, block int, n_ids long, doc_ids array<long>, doc_sizes array<long>, bits long, payload binary, checkpoints binary"
)
BLOCK_SCHEMA = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_sizes", pa.list_(pa.int64())), ("bits", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.binary()),
    ]
)


def read_blocks(spark: SparkSession, at: str, with_ids: bool = False) -> DataFrame:
    """Decode a store: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    small_batches(spark)
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{at}/code").first().lengths), np.uint8)
    sent = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCK_COLUMNS).parquet(f"{at}/blocks")
    names = ["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            for r in b.to_pylist():
                table = table or decode_table(sent.value)
                ids = decode(r["payload"], r["checkpoints"], r["n_ids"], table).astype("<u4")
                sizes = np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                of = [ids[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                k = len(of)
                columns = [
                    pa.array([r["shard"]] * k, pa.int32()), pa.array([r["block"]] * k, pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                    pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in of], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in of], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    found = blocks.mapInArrow(run, kinds)
    # a shard is a task's output and a block some 2^18 ids, so both tables of sizes are small against the corpus
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("block_start"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("base"))
    out = found.join(starts, ["shard", "block"]).withColumn("start", F.col("base") + F.col("within"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def token_output(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all ids of ``docs`` to a new store and return what reading it back gives.

    Documents come in ascending ``doc_id`` order, null ids first; rows with equal ids are ordered by
    their token ids. A null or empty text has the end id only. A text that is longer than a block
    gets a block of its own. An empty table writes an empty store. Other columns are not read.
    """
    spark = docs.sparkSession
    at = scratch(spark)
    write_blocks(staged(token_ids(docs, path, end, id_col, text_col)), path, at)
    return read_blocks(spark, at)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
