"""SimHash near-duplicates by anchor-point covering.

Anchors are the codewords of a covering code. The code is the direct sum of two perfect binary
Golay codes of length 23 (covering radius 3 each), laid on bits 0-22 and 23-45 of a fingerprint;
the other bits are not looked at when anchors are chosen. Each 23-bit block has exactly one
codeword within 3 bits, so each fingerprint has one home anchor. If two fingerprints differ in at
most ``t`` bits, the second lies within covering radius plus ``t`` of the first one's home; its
excess over radius 3, summed over both blocks, is at most ``t``. So every fingerprint is sent to
all such anchors (61 on average for ``t`` = 2), and comparing homes with visitors per anchor
finds every pair. 2^24 anchors keep the groups small at any size of corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bytes_of, connected_components, small_batches, staged

#: Generator polynomial of the binary Golay code of length 23, dimension 12.
GOLAY = 0b110001110101
BLOCK, RADIUS = 23, 3
#: Home fingerprints of one anchor that one task compares; an anchor with more is split.
HOMES_PER_TASK = 20_000
#: Pairs compared at once.
PAIRS = 1 << 20


def fingerprint(data: bytes | None, words: int = 3, seed: int = 42) -> int:
    """64-bit majority of the XXH64 of all word shingles, repeats included; 0 if there is no word."""
    w = (data or b"").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles: Iterator[bytes] = iter([b" ".join(w)])
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    n, ones, h = 0, np.zeros(64, np.int64), map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    total = max(1, len(w) - words + 1)
    while n < total:
        part = np.fromiter(h, np.uint64, min(total - n, 1 << 16))
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    rows = bytes_of(docs, id_col, text_col).select("doc_id", F.xxhash64("data").alias("text_hash"), "data")

    def run(batches):
        for b in batches:
            fp = [fingerprint(x, words) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def remainder(x: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the rest of the division by the generator polynomial."""
    x = x.copy()
    for bit in range(BLOCK - 1, 10, -1):
        x ^= np.where((x >> bit) & 1, GOLAY << (bit - 11), 0)
    return x


@cache
def cosets(threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each excess 0..threshold: error patterns ordered by syndrome, and where each syndrome's begin."""
    out = []
    for excess in range(threshold + 1):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        e = np.array([sum(1 << i for i in c) for w in weights for c in combinations(range(BLOCK), w)], np.int64)
        s = remainder(e)
        order = np.argsort(s, kind="stable")
        out.append((e[order], np.searchsorted(s[order], np.arange(2049))))
    return out


def anchors_of(fp: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, anchor and whether it is the home, for every anchor that ``fp`` (int64) is sent to."""
    low, high = fp & ((1 << BLOCK) - 1), (fp >> BLOCK) & ((1 << BLOCK) - 1)
    s1, s2, tables = remainder(low), remainder(high), cosets(threshold)
    rows, anchors, homes = [], [], []
    for a in range(threshold + 1):
        for b in range(threshold + 1 - a):
            (e1, at1), (e2, at2) = tables[a], tables[b]
            n1, n2 = at1[s1 + 1] - at1[s1], at2[s2 + 1] - at2[s2]
            n = n1 * n2
            row = np.repeat(np.arange(len(fp)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            one = e1[at1[s1[row]] + k // n2[row]]
            two = e2[at2[s2[row]] + k % n2[row]]
            rows.append(row)
            anchors.append((low[row] ^ one) | ((high[row] ^ two) << BLOCK))
            homes.append(np.full(len(row), a + b == 0))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union of the classes of ``x`` and ``y``; the smaller index stays the root."""
    while True:
        parent = roots(parent)
        x, y = parent[x], parent[y]
        keep = x != y
        if not keep.any():
            return parent
        x, y = x[keep], y[keep]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each anchor's group; rows come ordered by anchor."""
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[begins, len(key)])
    group = np.repeat(np.arange(len(begins)), sizes)
    keep = (np.bincount(group, home) > 0)[group] & (sizes > 1)[group]
    if not keep.any():
        return fp[:0], fp[:0]
    key, fp, home = key[keep], fp[keep], home[keep]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[begins, len(key)])
    group = np.repeat(np.arange(len(begins)), sizes)
    at = np.flatnonzero(home)
    n = sizes[group[at]]
    parent, value = np.arange(len(key)), fp.view(np.uint64)
    ends = np.cumsum(n)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] - n[first] + PAIRS)))
        k, m = at[first:last], n[first:last]
        x = np.repeat(k, m)
        y = np.repeat(begins[group[k]], m) + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
        near = np.bitwise_count(value[x] ^ value[y]) <= threshold
        near &= x != y
        if near.any():
            parent = unite(parent, x[near], y[near])
        first = last
    parent = roots(parent)
    linked = parent != np.arange(len(parent))
    return fp[linked], fp[parent[linked]]


def compare(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links per anchor of a partition ordered by anchor; a group may go on over many batches."""
    held: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        now = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(now[0]):
            continue
        same = now[0][-1] == now[0][0] and (not held or held[-1][0][-1] == now[0][0])
        held.append(now)
        if same or sum(len(x[0]) for x in held) < 50_000:
            continue
        key, fp, home = (np.concatenate(c) for c in zip(*held, strict=True))
        cut = int(np.searchsorted(key, key[-1]))
        held = [(key[cut:], fp[cut:], home[cut:])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in links(key[:cut], fp[:cut], home[:cut], threshold)], ["src", "dst"])
    if held:
        key, fp, home = (np.concatenate(c) for c in zip(*held, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in links(key, fp, home, threshold)], ["src", "dst"])


def near_links(distinct: DataFrame, threshold: int = 2) -> DataFrame:
    """Links ``(src, dst)`` that span every component of the distinct fingerprints ``fp``."""
    spark = distinct.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            for k in range(0, len(fp), 2048):
                row, anchor, home = anchors_of(fp[k : k + 2048], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[k : k + 2048][row]), pa.array(home)], ["anchor", "fp", "home"])

    sent = distinct.select("fp").mapInArrow(spread, "anchor long, fp long, home boolean")

    def homes(batches):
        for b in batches:
            fp = b.column(0).to_numpy()
            low, high = fp & ((1 << BLOCK) - 1), (fp >> BLOCK) & ((1 << BLOCK) - 1)
            e, at = cosets(0)[0]
            yield pa.RecordBatch.from_arrays([pa.array((low ^ e[at[remainder(low)]]) | ((high ^ e[at[remainder(high)]]) << BLOCK))], ["anchor"])

    crowded = staged(
        distinct.select("fp").mapInArrow(homes, "anchor long").groupBy("anchor").count()
        .where(F.col("count") > HOMES_PER_TASK)
        .select("anchor", F.ceil(F.col("count") / HOMES_PER_TASK).alias("parts"))
    )
    if crowded.isEmpty():
        sent = sent.withColumn("part", F.lit(0))
    else:  # homes are dealt over the parts of a crowded anchor, visitors go to all of them
        sent = sent.join(crowded, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        sent = sent.withColumn("home", F.col("home") & (own == F.col("part"))).withColumn("anchor", F.xxhash64("anchor", "part"))
    return sent.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "fp", "home").mapInArrow(
        lambda batches: compare(batches, threshold), "src long, dst long"
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 2
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Rows link if their fingerprints differ in at most ``threshold`` bits. Equal fingerprints meet as
    one node, so copies cost a count, not pairs. A null or empty text, or one of white space, has
    fingerprint zero and links like any other. Repeated ids give repeated rows; a null id keeps its
    row and takes part in linking, but a component is named by its smallest id that is not null (null
    if it has none). An empty table gives an empty result. Other columns are not read.
    """
    of = staged(fingerprints(docs, id_col, text_col, words))
    named = grouped(of, threshold)
    ids = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = named.join(ids, "component").select("fp", "component_id")
    return of.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(of: DataFrame, threshold: int) -> DataFrame:
    """``(fp, first_id, component)`` of the distinct fingerprints; a component is named by one of them."""
    nodes = staged(of.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    part = connected_components(near_links(nodes, threshold))
    small_batches(of.sparkSession)  # near_links takes larger ones
    return nodes.join(part.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with its columns as they are.

    The row with the smallest id stays, one without an id only if no row of the group has one; of
    different texts with equal ids the one with the smaller hash, of wholly equal rows any one.
    """
    of = staged(fingerprints(docs, id_col, text_col, words))
    part = staged(grouped(of, threshold).select("fp", "component"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    stay = of.join(part, "fp").groupBy("component").agg(F.min(row).alias("r")).select("r.doc_id", "r.text_hash")
    stay = stay.withColumnsRenamed({"doc_id": "_stay_id", "text_hash": "_stay_hash"})
    text_hash = F.xxhash64(docs[text_col].cast("string").cast("binary"))
    kept = docs.join(stay, docs[id_col].cast("long").eqNullSafe(F.col("_stay_id")) & (text_hash == F.col("_stay_hash")), "left_semi")
    twice = of.groupBy("doc_id", "text_hash").count().where("count > 1")
    return kept if twice.isEmpty() else kept.dropDuplicates([id_col, text_col])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
