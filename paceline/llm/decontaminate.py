"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents as one sequence of symbols: the words that occur in the test
phrases have a number each, and any stretch of other words (or the border of two documents) is one
separator. Its suffixes are sorted up to their separator, which no phrase can cross; the transform
of that order goes into a wavelet tree. Every test phrase is found by backward search: one rank
query for either end of its range per symbol. Rows of the ranges found are walked back to sampled
positions, which gives the places of all occurrences, and those merge into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paceline.llm.common import bytes_of, small_batches, staged
from paceline.llm.suffixes import suffix_order

WINDOW = 13
#: Symbols of a shard; a longer document is a shard of its own.
SHARD = 1 << 19
#: Every so many positions the place is kept with the index.
SAMPLED = 8
#: Bytes of test text that go to the executors at once; more are searched block by block, one broadcast after the other.
BLOCK_BYTES = 4 << 20
#: Lower-case letters and digits stay, bytes of other scripts stay, all else separates words.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(FOLD).split()


@dataclass
class Phrases:
    """Distinct windows as rows of word numbers, padded with 0 at the end, and the items of each."""

    numbers: dict[bytes, int]
    windows: np.ndarray
    sizes: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases(items: list[tuple[str, bytes | None]], window: int) -> Phrases:
    """Windows of ``window`` consecutive words of every item; a shorter item is one window."""
    numbers: dict[bytes, int] = {}
    names = sorted({name for name, _ in items})
    place = {x: k for k, x in enumerate(names)}
    ids = [np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(data)], np.int64) for _, data in items]
    count = np.array([max(1, len(x) - window + 1) if len(x) else 0 for x in ids], np.int64)
    begin = np.cumsum([0, *(len(x) + window for x in ids)])[:-1]  # each item is followed by zeros, which pad a short one
    text = np.concatenate([np.concatenate([x, np.zeros(window, np.int64)]) for x in ids] or [np.zeros(window, np.int64)])
    item = np.repeat(np.array([place[name] for name, _ in items], np.int64), count)
    at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(len(item))
    rows = np.lib.stride_tricks.sliding_window_view(text, window)[at]
    windows, of = np.unique(rows, axis=0, return_inverse=True)
    pair = np.unique(of.reshape(-1) * max(1, len(names)) + item)  # each window's items, once each
    sizes = np.bincount(pair // max(1, len(names)), minlength=len(windows))
    return Phrases(numbers, windows, (windows > 0).sum(axis=1), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), pair % max(1, len(names)), names)


class WaveletTree:
    """Rank queries over a sequence: level by level, zeros before ones, with running counts of ones."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)].astype(np.int32))
            up = bit.astype(bool)
            self.zeros.append(len(s) - int(self.ones[-1][-1]))
            s = np.concatenate([s[~up], s[up]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros(len(upto), np.int64), upto.astype(np.int64)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(up, zeros + a, low - a), np.where(up, zeros + b, high - b)
        return high - low


class FMIndex:
    """Backward search and locating over one shard's symbols; ``s`` ends with a separator."""

    def __init__(self, s: np.ndarray):
        order = suffix_order(s)
        self.last = s[order - 1]
        self.tree = WaveletTree(self.last)
        self.before = np.r_[0, np.cumsum(np.bincount(s))]
        # a place is kept for every SAMPLED-th position, and wherever walking back would meet a separator
        kept = (order % SAMPLED == 0) | (self.last == 0)
        self.kept = np.where(kept, order, -1)

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of rows whose suffixes start with each window; equal ends where there is none."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.last), np.int64)
        top = len(self.before) - 1
        for step in range(windows.shape[1]):
            go = np.flatnonzero((sizes > step) & (low < high))
            if not len(go):
                break
            c = windows[go, sizes[go] - 1 - step]
            known = c < top
            safe = np.where(known, c, 0)
            a = self.before[safe] + self.tree.rank(safe, low[go])
            b = self.before[safe] + self.tree.rank(safe, high[go])
            low[go], high[go] = np.where(known, a, 0), np.where(known, b, 0)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, by walking back to kept ones."""
        out, rows, walked = np.empty(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            place = self.kept[rows[left]]
            there = place >= 0
            out[left[there]] = place[there] + walked
            left = left[~there]
            c = self.last[rows[left]]
            rows[left] = self.before[c] + self.tree.rank(c, rows[left])
            walked += 1
        return out


def find(s: np.ndarray, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences in one shard: their positions in ``s`` and the windows found there."""
    if not len(p.windows) or not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = FMIndex(s)
    low, high = index.search(p.windows, p.sizes)
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low, n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return index.locate(rows), which


def shard_hits(texts: list[list[bytes]], p: Phrases) -> list[tuple[int, list[int], list[int], list[int]]]:
    """For each document of a shard: number of words, begins and ends of its merged spans, items found."""
    get, n_words = p.numbers.get, np.array([len(w) for w in texts], np.int64)
    ids = np.zeros(int(n_words.sum()) + len(texts), np.int32)
    begins = np.cumsum(n_words + 1) - (n_words + 1)  # each document ends with a separator
    for w, b in zip(texts, begins.tolist(), strict=True):
        ids[b : b + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int32, len(w))
    # the first separator of each run of them; the last symbol kept is one
    kept = np.flatnonzero((ids > 0) | np.r_[True, ids[:-1] > 0])
    at, which = find(ids[kept], p)
    start = kept[at]
    stop = start + p.sizes[which]
    doc = np.searchsorted(begins, start, side="right") - 1
    per = p.item_at[which + 1] - p.item_at[which]
    pair = np.repeat(doc, per) * max(1, len(p.names)) + p.items[
        np.repeat(p.item_at[which], per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    ]
    pair = np.unique(pair)
    items: dict[int, list[int]] = {}
    for x in pair.tolist():
        items.setdefault(x // len(p.names), []).append(x % len(p.names))
    spans: dict[int, tuple[list[int], list[int]]] = {}
    if len(start):
        edge = np.bincount(start, minlength=len(ids) + 1) - np.bincount(stop, minlength=len(ids) + 1)
        inside = np.r_[0, np.cumsum(edge) > 0].astype(np.int8)
        first, last = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
        for d, a, b in zip((np.searchsorted(begins, first, side="right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
            one = spans.setdefault(d, ([], []))
            one[0].append(a - int(begins[d]))
            one[1].append(b - int(begins[d]))
    return [(int(n), *spans.get(k, ([], [])), items.get(k, [])) for k, n in enumerate(n_words)]


HITS = "struct<n_words:long,begins:array<long>,ends:array<long>,items:array<string>>"
HIT_TYPE = pa.struct([("n_words", pa.int64()), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits_in(batches: Iterator[pa.RecordBatch], sent: Broadcast, text: int) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Rows with the hits of each, searched shard after shard; column ``text`` holds the texts."""
    held: list[tuple[pa.RecordBatch, list[list[bytes]]]] = []
    size = 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        p = sent.value
        found = iter(shard_hits([w for _, texts in held for w in texts], p))
        for rows, texts in held:
            out = []
            for _ in texts:
                n, begins, ends, items = next(found)
                out.append({"n_words": n, "begins": begins, "ends": ends, "items": sorted(p.names[x] for x in items)})
            yield rows, out

    for b in batches:
        texts, a = [words_of(x.encode() if isinstance(x, str) else x) for x in b.column(text).to_pylist()], 0
        for k, w in enumerate(texts):
            if size and size + len(w) > SHARD:  # the rows so far are a shard
                held.append((b.slice(a, k - a), texts[a:k]))
                yield from flush()
                held, size, a = [], 0, k
            size += len(w) + 1
        held.append((b.slice(a), texts[a:]))
    if held:
        yield from flush()


def both(old: dict, new: dict) -> dict:
    """Hits of two blocks in the same row."""
    spans = merged([*zip(old["begins"], old["ends"], strict=True), *zip(new["begins"], new["ends"], strict=True)])
    return new | {"begins": [a for a, _ in spans], "ends": [b for _, b in spans], "items": sorted({*old["items"], *new["items"]})}


def searched(docs: DataFrame, text_col: str, benchmark: DataFrame, window: int, id_col: str, item_text_col: str) -> tuple[DataFrame, str]:
    """``docs`` with one more column, of type HITS, and its name.

    The test items are dealt to as many blocks as their bytes ask for, which is all that the driver learns of them at first. Then one block
    after the other comes to it (4 MB, or one longer item), is broadcast and searched for; unless it is the last, its hits are written and it is released before the next.
    """
    small_batches(docs.sparkSession)
    name = "hits"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    items = benchmark.select(benchmark[id_col].cast("string").alias("id"), benchmark[item_text_col].cast("string").cast("binary").alias("data"))
    items = items.where("id IS NOT NULL AND data IS NOT NULL")
    n_bytes = items.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    blocks = -(-n_bytes // BLOCK_BYTES)
    if blocks > 1:
        items = staged(items.withColumn("block", F.pmod(F.xxhash64("id", "data"), F.lit(blocks))))
    kind = StructType([*docs.schema.fields, *StructType.fromDDL(f"{name} {HITS}").fields])
    text, found, names = docs.columns.index(text_col), docs, [*docs.columns, name]
    for k in range(max(1, blocks)):
        block = (items.where(F.col("block") == k) if blocks > 1 else items).select("id", "data")
        sent = docs.sparkSession.sparkContext.broadcast(phrases([(r.id, bytes(r.data)) for r in block.toLocalIterator()], window))

        def search(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent, again: bool = k > 0) -> Iterator[pa.RecordBatch]:
            for rows, hits in hits_in(batches, sent, text):
                columns = rows.columns
                if again:
                    hits = [both(old, new) for old, new in zip(columns.pop().to_pylist(), hits, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, HIT_TYPE)], names)

        found = found.mapInArrow(search, kind)
        if k + 1 < blocks:
            found = staged(found)
            sent.destroy()
    return found, name


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_words``, ``spans`` (merged word ranges ``[begin, end)``) and ``items`` (ids as strings, sorted) per row.

    A null text has no words; so has one of separators only. An item without words or with a null
    id has no windows; repeated item ids are one item. Ids of documents may be null or repeat: each row is
    judged by itself. Either table may be empty. Other columns are not read.
    """
    found, hits = searched(bytes_of(docs, id_col, text_col), "data", benchmark, window, item_col, item_text_col)
    spans = F.transform(F.arrays_zip(f"{hits}.begins", f"{hits}.ends"), lambda s: F.struct(s["begins"].alias("begin"), s["ends"].alias("end")))
    return found.select("doc_id", f"{hits}.n_words", spans.alias("spans"), f"{hits}.items")


def report(found: DataFrame) -> DataFrame:
    """``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and the spans of ``contamination``'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def removed(text: str | None, begins: list[int], ends: list[int]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None or not begins:
        return text
    data = text.encode()
    kept = np.frombuffer(data.translate(FOLD), np.uint8) != 32
    edge = np.diff(np.r_[0, kept.astype(np.int8), 0])
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for a, b in zip(begins, ends, strict=True):
        out.append(data[at : first[a]])
        at = int(last[b - 1])
    return b"".join([*out, data[at:]]).decode()


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns as they are, whatever their names.

    Contaminated: some word is hit, and hit words are a twentieth of all words or more. Each row is
    judged where it is and nothing is joined, so null and repeated ids don't matter. A row without
    words stays, and so do all rows if ``benchmark`` is empty. An empty table stays empty.
    """
    found, hits = searched(docs, text_col, benchmark, window, item_col, item_text_col)
    pairs = F.arrays_zip(f"{hits}.begins", f"{hits}.ends")
    n_hit = F.aggregate(pairs, F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["begins"])
    return found.where((n_hit == 0) | (20 * n_hit < F.col(f"{hits}.n_words"))).drop(hits)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return report(found).drop("spans")


WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS words FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 11))) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM i),
p AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS words FROM (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN s ON len(w) >= n)),
h AS (SELECT DISTINCT r, k, p.n, item_id FROM p JOIN i ON p.n = i.n AND p.words = i.words),
x AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + n)) AS at FROM h) GROUP BY r),
y AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT r, item_id::VARCHAR AS item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x ON d.r = x.r LEFT JOIN y ON d.r = y.r
"""
