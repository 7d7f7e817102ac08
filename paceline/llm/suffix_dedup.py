"""Exact substring removal with suffix arrays.

Every byte that lies in a string of ``length`` bytes which also starts earlier goes.

1. Shards. A shard is about ``SHARD_BYTES`` of text, made where the documents are read. It gets a suffix array
   (Larsson-Sadakane rounds) and common prefixes (Kasai); windows that share ``length`` bytes stand
   together there, and all but the earliest are removed. What is left of a shard has each string once.
2. Anchors. To merge shards, strings that can match must meet without moving every suffix. Each window left is anchored at the smallest hash of a ``SEED_BYTES``-byte
   string in it. Equal windows have equal anchors at equal offsets, and the windows of an anchor
   are a run. A row per run (2.7 % of the bytes) goes to a shuffle on the anchor's hash; a passage that is everywhere leaves a row per shard.
   Runs with the same bytes form a class; all but the earliest are removed. An anchor
   with one class is done.
3. Merging. Of each class of the other anchors the earliest run's bytes (at most 168) are cut out
   and shuffled by anchor. They stand in the order of their places, in parts with a suffix array each, and a part's windows are
   looked up among the sorted windows of the parts before by binary search.
4. An anchor with very many classes would overfill a task: its windows are shuffled by a 128-bit
   digest instead, with the minimum taken before and after the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bytes_of, small_batches, staged
from paceline.llm.suffixes import common_prefixes, sorted_suffixes

LENGTH, SEED_BYTES = 100, 32
#: Bytes hashed at once; a window's anchor must lie in one such piece, so pieces overlap.
PIECE_BITS = 17
#: Bytes of a shard, bytes of runs that are merged at once (and of a part of them with its own suffix array), and classes beyond which an anchor's windows are shuffled by digest.
SHARD_BYTES, MERGE_BYTES, PART_BYTES, CLASSES = 1 << 18, 1 << 18, 1 << 16, 2000
NO_ID = -(1 << 63)

BASE = np.uint64(0x9E3779B97F4A7C15)


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random numbers for bytes, powers of BASE, and powers of its inverse modulo 2^64."""
    n = (1 << PIECE_BITS) + 1
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    powers = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (BASE, inverse)]
    return np.random.default_rng(11).integers(0, 1 << 63, 256, np.uint64), *powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    y = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    block = y.reshape(-1, width)
    upto = np.minimum.accumulate(block, axis=1).reshape(-1)
    onward = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


def window_hashes(data: np.ndarray, of: tuple, length: int) -> np.ndarray:
    table, power, inverse = of
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * inverse[: len(data) - length + 1])


def runs(data: np.ndarray, ends: np.ndarray, alive: np.ndarray, of: tuple, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchored runs of one piece: hash of the anchor, hash of the run's bytes, first window, windows less one.

    ``data`` holds whole strings one after the other and ``ends`` where they end; windows that
    would cross an end aren't there, nor those that aren't ``alive`` at their first byte.
    """
    table, power, inverse = of
    n, k = len(data), SEED_BYTES
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = np.r_[np.uint64(0), np.cumsum(table[data] * power[:n])]
    seed = mixed((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
    place = np.uint64((1 << PIECE_BITS) - 1)
    least = sliding_min((seed & ~place) | np.arange(len(seed), dtype=np.uint64), length - k + 1)
    whole = np.repeat(ends, np.diff(np.r_[0, ends]))[: len(least)] - np.arange(len(least)) >= length
    whole &= alive[: len(least)]
    first = whole & np.r_[True, (least[1:] != least[:-1]) | ~whole[:-1]]
    last = whole & np.r_[(least[1:] != least[:-1]) | ~whole[1:], True]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    anchor = (least[a] & place).astype(np.int64)
    bytes_hash = mixed((sums[b + length] - sums[a]) * inverse[a])
    run_hash = mixed(bytes_hash + (anchor - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (b - a).astype(np.uint64))
    return seed[anchor], run_hash, a, b - a


def anchored(docs: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """``(deal, gone, anchor, class, d, tie, span)``: what goes within a shard, and every run of what is left; ``span`` packs first window and windows less one."""
    piece = 1 << PIECE_BITS
    names = ["deal", "gone", "anchor", "class", "d", "tie", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tables()
        held: list[tuple[int, int, int, bytes]] = []

        def left(part: list[tuple[int, int, int, bytes]], later: np.ndarray) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(x[3] for x in part), np.uint8)
            ends = np.cumsum([len(x[3]) for x in part])
            alive = np.zeros(len(data), bool)
            at = 0
            for x, end in zip(part, ends.tolist(), strict=True):
                n = len(x[3]) - length + 1
                alive[end - len(x[3]) : end - length + 1] = ~later[at : at + n]
                at += n
            key, cls, a, more = runs(data, ends, alive, of, length)
            string = np.searchsorted(ends, a, side="right")
            begin = np.r_[0, ends[:-1]] - np.array([x[2] for x in part])
            d, tie = (np.array([x[i] for x in part], np.int64)[string] for i in (0, 1))
            span = ((a - begin[string]) << 8) | more
            key = key.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, np.zeros(len(a), bool), key, cls.view(np.int64), d, tie, span)], names)

        def shard() -> Iterator[pa.RecordBatch]:
            d, tie, start = (np.array([x[i] for x in held], np.int64) for i in range(3))
            later, _ = windows_of([x[3] for x in held], d, tie, start, length)
            gone = spans_of(later, d, tie, start, np.array([len(x[3]) - length + 1 for x in held]))
            n, d = gone.num_rows, gone.column(0).to_numpy()
            none = pa.array(np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(mixed(d.view(np.uint64)).view(np.int64)), pa.array(np.ones(n, bool)), none, none, *gone.columns], names)
            part, size, at, seen = [], 0, 0, 0
            for x in [*held, None]:
                if x is None or size + len(x[3]) > piece:
                    yield left(part, later[at:seen])
                    part, size, at = [], 0, seen
                if x is not None:
                    part.append(x)
                    size += len(x[3])
                    seen += len(x[3]) - length + 1

        size = 0
        for b in batches:
            for d, tie, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at = 0
                while data and len(data) - at >= length:
                    part = data[at : at + piece]
                    if held and size + len(part) > shard_bytes:
                        yield from shard()
                        held, size = [], 0
                    held.append((d, tie, at, part))
                    size += len(part)
                    at += piece - length + 1
        if held:
            yield from shard()

    return docs.select("d", "tie", "data").mapInArrow(run, "deal long, gone boolean, anchor long, class long, d long, tie long, span long")


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows ordered by anchor, class, id and span: which runs are removed, and first runs of classes that share their anchor.

    Rows of what is gone already are passed on. Goes through any number of rows of one anchor with the last row and one first run in memory.
    """
    names = ["first", "anchor", "d", "tie", "span"]
    before: list[int] | None = None  # the last row seen
    lead: list[int] | None = None  # first run of its class
    only: list[int] | None = None  # lead, while its class is the only one of its anchor
    for b in batches:
        gone = b.filter(b.column(1))
        if gone.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(gone.num_rows, bool)), *(gone.column(i) for i in (2, 4, 5, 6))], names)
            b = b.filter(pc.invert(b.column(1)))
        c = [x.to_numpy(zero_copy_only=False) for x in b.columns[2:]]
        if not len(c[0]):
            continue
        if before is not None:
            c = [np.r_[np.int64(x), y] for x, y in zip(before, c, strict=True)]
        key, cls, d, tie, span = c
        n, skip = len(key), int(before is not None)
        new_key = np.r_[True, key[1:] != key[:-1]]
        new_cls = new_key | np.r_[True, cls[1:] != cls[:-1]]
        lead_at = np.maximum.accumulate(np.where(new_cls, np.arange(n), 0))
        lead_d, lead_tie, lead_span = d[lead_at], tie[lead_at], span[lead_at]
        if skip:  # the group that goes on from the last batch has its first run there
            same = lead_at == 0
            lead_d[same], lead_tie[same], lead_span[same] = lead[2:]
        gone = ~new_cls & ~((d == lead_d) & (tie == lead_tie) & (span == lead_span))
        gone[:skip] = False
        starts = np.flatnonzero(new_cls)
        heads = [x[starts].copy() for x in c]
        heads[2][0], heads[3][0], heads[4][0] = lead_d[0], lead_tie[0], lead_span[0]
        alike = np.r_[heads[0][1:] == heads[0][:-1], False]
        shared = alike | np.r_[False, alike[:-1]]
        if skip and only is None:
            shared[0] = False  # told before
        # a first class whose anchor may go on in the next batch waits in ``only``
        rows = [np.concatenate([x[gone], h[shared]]) for x, h in zip((key, d, tie, span), (heads[0], *heads[2:]), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.zeros(int(gone.sum()), bool), np.ones(int(shared.sum()), bool)]), *map(pa.array, rows)], names
        )
        told = bool(shared[-1]) or (len(starts) == 1 and skip and only is None)
        if not told and len(starts) > 1 and heads[0][-1] == heads[0][-2]:
            told = True
        before = [int(x[-1]) for x in c]
        lead = [int(h[-1]) for h in heads]
        only = None if told else lead


def windows_of(contexts: list[bytes], d: np.ndarray, tie: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all strings, one string after the other: is the window's string also at an earlier place? And all windows, sorted.

    ``d, tie, start`` place the first window of each string in the corpus.
    """
    sizes = np.array([len(x) for x in contexts], np.int64)
    n = int(sizes.sum()) + len(contexts)
    s = np.zeros(n, np.int32)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    inside = np.ones(n, bool)
    inside[begin + sizes] = False
    s[inside] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int32) + 1
    order, same, known = sorted_suffixes(s, length)
    group = np.cumsum(common_prefixes(s, order, same, known, length) < length)
    count = sizes - length + 1
    string = np.repeat(np.arange(len(contexts)), count)
    within = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    of = np.zeros(n, np.int64)
    of[order] = group
    of = of[begin[string] + within]
    window = np.full(n, -1, np.int64)
    window[begin[string] + within] = np.arange(len(string))
    by_content = window[order]
    by_content = by_content[by_content >= 0]
    later = np.zeros(len(string), bool)
    again = np.flatnonzero(np.bincount(of, minlength=1)[of] > 1)
    string, at, of = string[again], start[string[again]] + within[again], of[again]
    place = np.lexsort((at, tie[string], d[string], of))
    head = np.diff(of[place], prepend=-1) != 0
    first = place[np.maximum.accumulate(np.where(head, np.arange(len(place)), 0))]
    same = (d[string][place] == d[string][first]) & (tie[string][place] == tie[string][first]) & (at[place] == at[first])
    later[again[place]] = ~same
    return later, by_content


def spans_of(later: np.ndarray, d: np.ndarray, tie: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """Runs of removed windows as ``(d, tie, span)``."""
    string = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)
    # a span holds at most 256 windows
    first = later & (np.r_[True, ~later[:-1] | (string[1:] != string[:-1])] | (within % 256 == 0))
    last = later & (np.r_[~later[1:] | (string[1:] != string[:-1]), True] | (within % 256 == 255))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    span = ((start[string[a]] + within[a]) << 8) | (b - a)
    return pa.RecordBatch.from_arrays([pa.array(d[string[a]]), pa.array(tie[string[a]]), pa.array(span)], ["d", "tie", "span"])


def merge(rows: list[tuple], of: tuple, length: int) -> pa.RecordBatch:
    """What goes among runs ``(anchor, d, tie, start, bytes)`` of whole anchors.

    The runs stand in the order of their places and are cut into parts; each part has its suffix array. The windows that a part keeps are looked up by
    binary search among the sorted windows of the parts before (sorted by hash, and compared byte by byte where one is found): what is there is at an
    earlier place, and the rest is put in.
    """
    rows = sorted(rows, key=lambda r: r[1:4])
    rows = [r for k, r in enumerate(rows) if not k or r[1:4] != rows[k - 1][1:4]]  # repeated rows
    _, d, tie, start, data = zip(*rows, strict=True)
    d, tie, start = (np.array(x, np.int64) for x in (d, tie, start))
    sizes = np.array([len(x) for x in data], np.int64)
    count, begin = sizes - length + 1, np.cumsum(sizes) - sizes
    cut = np.flatnonzero(np.diff((begin + sizes) // PART_BYTES)) + 1
    text = np.frombuffer(b"".join(data), np.uint8)
    known, place_of, gone = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(rows)], strict=True):
        later, by_content = windows_of(list(data[a:b]), d[a:b], tie[a:b], start[a:b], length)
        if len(cut):
            kept = by_content[~later[by_content]]
            at = np.repeat(begin[a:b] - np.cumsum(count[a:b]) + count[a:b], count[a:b])[kept] + kept
            key = window_hashes(text[begin[a] : begin[b - 1] + sizes[b - 1]], of, length)[at - begin[a]]
            order = np.argsort(key)
            kept, at, key = kept[order], at[order], key[order]
            place = np.searchsorted(known, key)
            maybe = np.flatnonzero(place < len(known))
            maybe = maybe[known[place[maybe]] == key[maybe]]
            views = np.lib.stride_tricks.sliding_window_view(text, length)
            maybe = maybe[(views[at[maybe]] == views[place_of[place[maybe]]]).all(axis=1)]
            later[kept[maybe]] = True
            new = np.ones(len(key), bool)
            new[maybe] = False
            known, place_of = np.insert(known, place[new], key[new]), np.insert(place_of, place[new], at[new])
        gone.append(later)
    return spans_of(np.concatenate(gone), d, tie, start, count)


def merges(batches: Iterator[pa.RecordBatch], length: int, merge_bytes: int) -> Iterator[pa.RecordBatch]:
    """Over rows (anchor, d, tie, start, bytes) ordered by anchor: whole anchors are merged, about ``merge_bytes`` at once."""
    held: list[tuple] = []
    size, of = 0, tables()
    for b in batches:
        for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if size >= merge_bytes and row[0] != held[-1][0]:
                yield merge(held, of, length)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield merge(held, of, length)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
    shard_bytes: int = SHARD_BYTES, merge_bytes: int = MERGE_BYTES, crowded: int = CLASSES,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (removed byte ranges ``[begin, end)``), ``kept`` (bytes) for every row of ``docs``.

    A null or shorter text loses nothing. Earlier means a smaller id, or an earlier start in the
    same document. A null id comes before all others. Rows with equal ids and texts are one document and get the same
    result each; different texts with equal ids are ordered by a hash of the text. An empty table
    gives an empty result. Other columns are not read.
    """
    if not SEED_BYTES < length < 256:
        raise ValueError(f"length must be between {SEED_BYTES + 1} and 255")
    spark = docs.sparkSession
    small_batches(spark)
    read = bytes_of(docs, id_col, text_col)
    repeated = not read.groupBy("doc_id").count().where("count > 1").isEmpty()
    keyed = read.select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), (F.xxhash64("data") if repeated else F.lit(0).cast("long")).alias("tie"), "data"
    )
    order = ["gone", "anchor", "class", "d", "tie", "span"]
    sorted_runs = anchored(keyed, length, shard_bytes).repartition("deal").sortWithinPartitions(*order)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    found = staged(sorted_runs.mapInArrow(classes, "first boolean, anchor long, d long, tie long, span long"))
    small_batches(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data = pa.array([z.compress(x or b"") for x in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), data], ["doc_id", "d", "tie", "packed"])

    packed = keyed.mapInArrow(pack, "doc_id long, d long, tie long, packed binary")
    gone = found.where("NOT first").select("d", "tie", "span").unionByName(between_classes(found.where("first"), packed, length, merge_bytes, crowded))
    gone = gone.groupBy("d", "tie").agg(F.collect_list("span").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            size, spans, kept = [], [], []
            for packed, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = z.decompress(packed)
                size.append(len(data))
                span = np.array(gone or [], np.int64)
                edge = np.bincount(span >> 8, minlength=len(data) + 1) - np.bincount((span >> 8) + (span & 255) + length, minlength=len(data) + 1)
                covered = np.cumsum(edge[: len(data)]) > 0
                turn = np.diff(np.r_[0, covered.astype(np.int8), 0])
                spans.append([{"begin": x, "end": y} for x, y in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)])
                kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    whole = packed.join(gone, ["d", "tie"], "left").select("doc_id", "packed", "gone")
    return whole.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def between_classes(first: DataFrame, packed: DataFrame, length: int, merge_bytes: int, classes: int) -> DataFrame:
    """``(d, tie, span)`` of windows that also occur in another class of their anchor, at an earlier place."""
    crowded = first.groupBy("anchor").count().where(F.col("count") > classes).select("anchor", F.lit(True).alias("crowded"))
    told = first.join(crowded, "anchor", "left")
    of = told.groupBy("d", "tie").agg(F.collect_list(F.struct("anchor", "span", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("runs"))
    # one copy of repeated rows is enough
    texts = packed.join(of, ["d", "tie"]).select("d", "tie", "packed", "runs")
    names = ["crowded", "anchor", "d", "tie", "start", "data"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows: list[tuple] = []
            for d, tie, data, found in zip(*(x.to_pylist() for x in b.columns), strict=True):
                data = z.decompress(data)
                for r in found:
                    a, more = r["span"] >> 8, r["span"] & 255
                    rows.append((r["crowded"], r["anchor"], d, tie, a, data[a : a + more + length]))
            kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    contexts = staged(texts.mapInArrow(cut, "crowded boolean, anchor long, d long, tie long, start long, data binary"), "lz4")
    normal = contexts.where("NOT crowded").drop("crowded").repartition("anchor").sortWithinPartitions("anchor")
    merged = normal.mapInArrow(lambda batches: merges(batches, length, merge_bytes), "d long, tie long, span long")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, tie, a, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                for k in range(len(data) - length + 1):
                    h = xxhash.xxh3_128_intdigest(data[k : k + length])
                    rows.append(((h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63), d, tie, a + k))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["h1", "h2", "d", "tie", "start"])

    windows = contexts.where("crowded").select("d", "tie", "start", "data").mapInArrow(digests, "h1 long, h2 long, d long, tie long, start long")
    place = F.struct("d", "tie", "start")
    least = windows.groupBy("h1", "h2").agg(F.min(place).alias("least"))
    by_digest = windows.join(least, ["h1", "h2"]).where(place > F.col("least")).select("d", "tie", F.shiftleft("start", 8).alias("span"))
    return merged.unionByName(by_digest)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
