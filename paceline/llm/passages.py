"""Near-duplicate passages by compact windows.

A text is a sequence of hashed word shingles. For one hash function, all subsequences that share
their minimum at place ``c`` are given by a compact window (l, c, r): those that start in l..c and end in
c..r. The windows are the nodes of the Cartesian tree over the hashes, and only those that
are wide enough for a passage are made: about 2 n / t for n shingles and passages of t. Two
passages whose similarity is J have the same minimum under a hash function with probability J, so over
several functions their windows meet under a common key. Windows with equal keys are joined where
their intervals, aligned at the shared shingle, leave room for a passage. What the join proposes is
verified on the shingles themselves.

Windows of one key whose surrounding shingles are equal form a class; its members are linked to one of
them, first within a batch of a task, so that a passage that is everywhere leaves a row per batch. What is left
of a key is compared pair by pair. Where that would be more than ``PAIRS`` windows, as with a line that many texts have,
the key is too common to tell who belongs together, and other keys around it do. Two runs of t shingles are
similar if they share at least need = 2 s t / (1 + s) of them; of the shingles that they share, call those popular that more than ``PAIRS`` such texts have.

- All are shared: whoever repeats a passage word for word has a run of t shingles in common, and is of one class.
- One that isn't popular is shared: both runs have a window under it, at most ``PAIRS`` texts do, and all of these are compared pair by pair.
- All of those shared are popular, but not all shingles are shared: at t - need places at most the runs differ, which at a similarity of 0.8 is one word that was changed, added
  or left out. Both then have the same shingles before and after a gap of ``SHINGLE`` places (or one less), or one stretch of need shingles. Either is a key;
  whatever has it in common is similar, so that all of a key are one class and links to one of them lose nothing.
  Of equal runs without other than popular shingles one has such keys, and gaps begin where a shingle is followed by different ones in different places.

At similarities so low that a run may differ by two words in its inside, gaps of two words aren't looked for; nor are runs that share popular shingles only and have them in another order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import bytes_of, connected_components, small_batches, staged
from paceline.llm.decontaminate import merged, words_of
from paceline.llm.suffix_dedup import BASE, mixed, sliding_min

SHINGLE, PASSAGE_WORDS, SIMILARITY, HASHES = 5, 50, 0.8, 4
#: Bits that hold a place among the words hashed at once.
PLACE_BITS = 24
#: Words hashed at once; a longer text by itself.
WORDS = 1 << 17
#: Windows of a task that are linked to each other before any shuffle.
LOCAL = 1 << 18
#: Windows of a key, of different surroundings, that are compared pair by pair.
PAIRS = 16
#: Bits of the table of popular shingles, and of each of the parts that it is put together from.
TABLE_BITS, PART_BITS = 24, 18
#: Runs whose rarest shingles are found at once, and shingles taken beyond the number that is needed where both runs have the same length.
RUNS, SPARE = 4096, 2
#: Alignments of two texts that are verified one by one; with more of them (texts that repeat themselves), the texts are compared at once.
ALIGNMENTS = 64
#: Runs of matches up to which stretches are looked for run by run.
FEW = 24
#: Bytes of texts whose crowded keys are looked at together.
TEXTS = 1 << 19
#: Bytes of text compared at once with the other sides.
CHECKED = 1 << 19
#: Reach of a window to either side that is kept; wider windows are cut to it, their passages are found in several.
REACH = (1 << 16) - 1


class Shingles:
    """64-bit hashes of word shingles by prefix sums; tables grow with the longest text met."""

    def __init__(self) -> None:
        self.table = np.random.default_rng(23).integers(0, 1 << 63, 256, np.uint64)
        self.power = self.inverse = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n >= len(self.power):
            other = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(2 * n, x, np.uint64)]) for x in (BASE, other))

    def of(self, words: list[bytes]) -> np.ndarray:
        """One hash for each run of SHINGLE consecutive words."""
        return self.joined(b" ".join(words)) if len(words) >= SHINGLE else np.zeros(0, np.uint64)

    def joined(self, text: bytes) -> np.ndarray:
        """The same of words that single spaces join."""
        data = np.frombuffer(text, np.uint8)
        n = len(data)
        gaps = np.flatnonzero(data == 32)
        if not n or len(gaps) < SHINGLE - 1:
            return np.zeros(0, np.uint64)
        self.grow(n)
        sums = np.r_[np.uint64(0), np.cumsum(self.table[data] * self.power[:n])]
        begin, end = np.r_[0, gaps + 1], np.r_[gaps, n]
        a, b = begin[: len(begin) - SHINGLE + 1], end[SHINGLE - 1 :]
        return mixed((sums[b] - sums[a]) * self.inverse[a])

    def sums(self, shingles: np.ndarray) -> np.ndarray:
        """What ``between`` needs of them."""
        self.grow(len(shingles))
        return np.r_[np.uint64(0), np.cumsum(mixed(shingles) * self.power[: len(shingles)])]

    def between(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each run ``[begin, end)`` of shingles."""
        return mixed((sums[end] - sums[begin]) * self.inverse[begin])

    def runs(self, shingles: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.between(self.sums(shingles), begin, end)


def smaller(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; ``first`` marks where strings begin, beyond which nothing is looked for.

    Whatever stands between a place and the one it points to is larger, so that a pointer can be followed by that of its place, finished or not.
    """
    at = np.arange(len(value))
    out = np.where(first, -1, at - 1)
    at = at[~first]
    while len(at):
        at = at[value[out[at]] > value[at]]
        out[at] = out[out[at]]
        at = at[out[at] >= 0]
    return out


def compact_windows(shingles: np.ndarray, ends: np.ndarray, hashes: int, words: int) -> list[tuple[np.ndarray, ...]]:
    """For every hash function: keys, string number, places, reaches to the left and to the right; one window per occurrence.

    ``shingles`` runs over strings that end at ``ends`` (in words); ``words`` is the shortest passage.
    """
    t = words - SHINGLE + 1
    n = len(shingles)
    if n < t:
        return []
    begins = np.r_[0, ends[:-1]]
    string = np.repeat(np.arange(len(ends)), ends - begins)[:n]
    room = ends[string] - np.arange(n) >= words
    place = np.uint64((1 << PLACE_BITS) - 1)
    out = []
    for k in range(hashes):
        h = mixed(shingles + np.uint64((k + 1) * int(BASE) % (1 << 64)))
        rank = (h & ~place) | np.arange(n, dtype=np.uint64)
        least = sliding_min(rank, t)
        chosen = np.zeros(n, bool)
        chosen[(least[room[: len(least)]] & place).astype(np.int64)] = True
        c = np.flatnonzero(chosen)
        if not len(c):
            continue
        of = string[c]
        value, one = rank[c], np.diff(of, prepend=-1) != 0
        lower, upper = smaller(value, one), len(c) - 1 - smaller(value[::-1], np.append(one[1:], True)[::-1])[::-1]
        lo = np.where(lower >= 0, c[lower] + 1, begins[of])
        hi = np.where(upper < len(c), c[np.minimum(upper, len(c) - 1)] - 1, ends[of] - SHINGLE)
        left, right = c - lo, hi - c
        key = (h[c] & ~np.uint64(7)) | np.uint64(k)
        wide = left + right + 1 >= t
        out.append(tuple(x[wide] for x in (key, of, c - begins[of], left, right)))
    return out


def packed(c: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (c << 32) | (np.minimum(left, REACH) << 16) | np.minimum(right, REACH)


def classed(key: np.ndarray, around: np.ndarray, doc: np.ndarray, pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows in the order of (key, around, doc); for each of them the place of the first of its class, or -1; texts that hold windows of a class again.

    Of a text's windows of one class only the widest counts: whatever shortest passage it is in, the others are in the same.
    """
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    some = order[again]
    p = pack[some]
    order[again] = some[np.lexsort((p, -((p >> 16) & REACH) - (p & REACH), doc[some], around[some], key[some]))]
    k, a, d = key[order], around[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (a[1:] != a[:-1])
    one = new.copy()
    one[1:] |= d[1:] != d[:-1]
    new = new[one]
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return order[one], np.where(new, -1, head), np.unique(d[~one])


def stretches(bits: np.ndarray, doc: np.ndarray, pack: np.ndarray, to_doc: np.ndarray, to_pack: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """Links ``(doc, to_doc, shift, first, last, bits)``, one for each alignment of two texts: where both windows reach, if that is ``t`` shingles or more."""
    left = np.minimum((pack >> 16) & REACH, (to_pack >> 16) & REACH)
    right = np.minimum(pack & REACH, to_pack & REACH)
    c = pack >> 32
    room = left + right + 1 >= t
    columns = doc, to_doc, c - (to_pack >> 32), c - left, c + right, bits
    doc, to_doc, shift, first, last, bits = (x[room] for x in columns)
    order = np.lexsort((shift, to_doc, doc))
    doc, to_doc, shift = doc[order], to_doc[order], shift[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (to_doc[1:] != to_doc[:-1]) | (shift[1:] != shift[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    return doc[at], to_doc[at], shift[at], np.minimum.reduceat(first[order], at), np.maximum.reduceat(last[order], at), np.bitwise_or.reduceat(bits[order], at)


def bits_of(key: np.ndarray, every: int) -> np.ndarray:
    """The hash function of each key as a bit; or ``every`` bit, for keys of another kind."""
    return np.full(len(key), every, np.int64) if every else np.left_shift(1, key & 7)


ROW = "deal long, key long, around long, doc long, pack long, to_doc long, last long"
NAMES = ["deal", "key", "around", "doc", "pack", "to_doc", "last"]
LINK, LINKS = ["doc", "to_doc", "shift", "first", "last", "hash"], "doc long, to_doc long, shift long, first long, last long, hash long"


def local(held: list[tuple[np.ndarray, ...]], words: int, every: int) -> pa.RecordBatch:
    """Windows ``(key, around, doc, pack)``, one for each class met in this batch, and links of the others to it.

    A row with ``to_doc`` is a link: ``key`` has its bits, ``around`` its shift, ``pack`` and ``last`` its ends. A text that holds windows of a class again is
    linked to itself.
    """
    key, around, doc, pack = (np.concatenate(c) for c in zip(*held, strict=True))
    order, to, again = classed(key, around, doc, pack)
    key, around, doc, pack = key[order], around[order], doc[order], pack[order]
    x = np.flatnonzero(to >= 0)
    y = to[x]
    link = stretches(bits_of(key[x], every), doc[x], pack[x], doc[y], pack[y], words - SHINGLE + 1)
    zero = np.zeros(len(again), np.int64)
    link = [np.concatenate(z) for z in zip(link, (again, again, zero, zero, zero, zero + 255), strict=True)]
    own = np.flatnonzero(to < 0)
    none = np.zeros(len(own), bool)
    there = np.concatenate([none, np.ones(len(link[0]), bool)])
    # links are dealt by document, windows by key
    columns = zip((key[own], key[own], around[own], doc[own], pack[own], doc[own], pack[own]), (mixed(link[0].view(np.uint64)).view(np.int64), link[5], link[2], link[0], link[3], link[1], link[4]), strict=True)
    made = [np.concatenate(z) for z in columns]
    return pa.RecordBatch.from_arrays([*map(pa.array, made[:5]), *(pa.array(z, mask=~there) for z in made[5:])], NAMES)


def rows_of(batches: Iterator[pa.RecordBatch], hashes: int, words: int) -> Iterator[pa.RecordBatch]:
    """Windows ``(key, around, doc, pack)`` and links; ``around`` is a hash of the shingles of the window that a shortest passage reaches."""
    hasher, reach = Shingles(), words - SHINGLE
    held: list[tuple[np.ndarray, ...]] = []

    def windows(ids: list[int], texts: list[list[bytes]]) -> None:
        shingles = hasher.of([w for x in texts for w in x])
        doc, ends = np.array(ids, np.int64), np.cumsum([len(x) for x in texts])
        begins = np.r_[0, ends[:-1]]
        for key, of, c, left, right in compact_windows(shingles, ends, hashes, words):
            at, low, high = c + begins[of], np.minimum(left, reach), np.minimum(right, reach)
            around = mixed(hasher.runs(shingles, at - low, at + high + 1) + low.astype(np.uint64))
            held.append((key.view(np.int64), around.view(np.int64), doc[of], packed(c, left, right)))

    ids: list[int] = []
    texts: list[list[bytes]] = []
    for b in batches:
        for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = words_of(data)
            if len(w) < words:
                continue
            if texts and sum(map(len, texts)) + len(w) > WORDS:
                windows(ids, texts)
                ids, texts = [], []
            if len(w) >> PLACE_BITS:
                raise ValueError(f"document {doc} has {len(w)} words, more than 2^{PLACE_BITS}")
            ids.append(doc)
            texts.append(w)
        if sum(len(x[0]) for x in held) >= LOCAL:
            yield local(held, words, 0)
            held = []
    if texts:
        windows(ids, texts)
    if held:
        yield local(held, words, 0)


def places_of(hasher: Shingles, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts of words that single spaces join, hashed at once; where those of each text begin and end among them."""
    count = np.array([x.count(b" ") + 1 for x in texts], np.int64)
    begin = np.cumsum(count) - count
    return hasher.joined(b" ".join(texts)), begin, begin + np.maximum(count - SHINGLE + 1, 0)


def ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges ``[begin, end)``, one after the other, and which range each is of."""
    count = np.maximum(end - begin, 0)
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(len(of)) + (begin - np.cumsum(count) + count)[of], of


class Texts:
    """Some texts whose shingles are hashed at once: places run over all of them, ``begin`` and ``end`` are those of each text."""

    def __init__(self, hasher: Shingles, doc: np.ndarray, data: list[bytes], found: pa.Array) -> None:
        self.hasher, self.doc = hasher, doc
        self.shingles, self.begin, self.end = places_of(hasher, [b" ".join(words_of(x)) for x in data])
        fields = found.flatten()
        of = np.repeat(np.arange(len(doc)), found.value_lengths().to_numpy())
        self.found = {fields.type.field(i).name: fields.field(i).to_numpy() for i in range(fields.type.num_fields)}
        self.of, self.first = of, self.begin[of]
        self.sums = hasher.sums(self.shingles)

    def text(self, at: np.ndarray) -> np.ndarray:
        """Which text each place is in."""
        return np.searchsorted(self.begin, at, "right") - 1

    def runs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.hasher.between(self.sums, begin, end)

    def rows(self, key: np.ndarray, around: np.ndarray | None, at: np.ndarray, low: np.ndarray, high: np.ndarray, slack: int = 0) -> tuple[np.ndarray, ...]:
        """Windows ``(key, around, doc, pack)`` at places whose text has them from ``low`` to ``high``, and ``slack`` more."""
        of = self.text(at)
        around = np.zeros(len(at), np.int64) if around is None else around.view(np.int64)
        return key.view(np.int64), around, self.doc[of], packed(at - self.begin[of], at - low + slack, high - at + slack)

    def around_keys(self, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the runs of ``reach`` + 1 shingles that hold a crowded key, in order, and how far the windows of such keys reach together."""
        pack = self.found["pack"]
        c, left, right = (pack >> 32) + self.first, (pack >> 16) & REACH, pack & REACH
        before = np.minimum(left, reach)
        count = np.maximum(before + np.minimum(0, right - reach) + 1, 0)
        at, of = ranges(c - before, c - before + count)
        if not len(at):
            return at, at, at
        order = np.argsort(at, kind="stable")
        at, of = at[order], of[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return at[first], np.minimum.reduceat((c - left)[of], first), np.maximum.reduceat((c + right)[of], first)


def some_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """Batches ``(doc_id, data, found)`` as texts of ``TEXTS`` bytes or, where one is longer, by themselves."""
    hasher = Shingles()
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(1)).to_numpy())
        i = 0
        while i < b.num_rows:
            stop = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + TEXTS, "right")))
            part = b.slice(i, stop - i)
            yield Texts(hasher, part.column(0).to_numpy(), part.column(1).to_pylist(), part.column(2))
            i = stop


def popular(texts: DataFrame, words: int) -> np.ndarray:
    """Two tables of 2^TABLE_BITS bits: set for shingles that more than ``PAIRS`` texts have near crowded keys, and for those of them that different shingles follow.

    Shingles that share a bit cost comparisons, not links: one that counts as popular in error is looked for as one. So the size is fixed, and nothing else comes to the driver.
    """
    reach = words - SHINGLE

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in some_texts(batches):
            at, _, _ = x.around_keys(reach)
            n = len(x.shingles)
            cover = np.bincount(at, minlength=n + 1) - np.bincount(at + reach + 1, minlength=n + 1)
            place = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
            follow = np.append(x.shingles[1:], np.uint64(0))
            follow[x.end[x.end > x.begin] - 1] = 0  # the end of a text is another that follows
            own, then, of = x.shingles[place], follow[place], x.text(place)
            order = np.lexsort((then, own, of))
            own, then, of = own[order], then[order], of[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(new)
            columns = [own[first], then[first], then[np.append(first[1:], len(own)) - 1] if len(own) else own]
            yield pa.RecordBatch.from_arrays([pa.array(y.view(np.int64)) for y in columns], ["shingle", "low", "high"])

    def table(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros((2, 1 << PART_BITS), np.uint8)
        at = rows["bit"].to_numpy() & ((1 << PART_BITS) - 1)
        bits[0, at], bits[1, at] = 1, rows["parts"].to_numpy()
        return pd.DataFrame({"part": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    often = texts.mapInArrow(near, "shingle long, low long, high long").groupBy("shingle")
    often = often.agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where(F.col("n") > PAIRS)
    bit = F.col("shingle").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).alias("bit")
    bit = often.groupBy(bit).agg(F.max((F.col("low") != F.col("high")).cast("int")).alias("parts"))
    parts = bit.groupBy(F.shiftright("bit", PART_BITS).alias("part")).applyInPandas(table, "part long, bits binary").collect()
    out = np.zeros((2, 1 << (TABLE_BITS - PART_BITS), 1 << (PART_BITS - 3)), np.uint8)
    for r in parts:
        out[:, r.part] = np.frombuffer(r.bits, np.uint8).reshape(2, -1)
    return out.reshape(2, -1)


def flagged(bits: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    bit = (shingles & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)
    return (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1


def need_of(words: int, similarity: float) -> tuple[int, int]:
    """Shingles of a run of the shortest passage's length, and how many of them a similar one has."""
    t = words - SHINGLE + 1
    return t, int(np.ceil(2 * similarity * t / (1 + similarity) - 1e-9))


def gap_rows(x: Texts, at: np.ndarray, before: np.ndarray, gap: int, need: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows under keys with a gap: one hash of the ``before`` shingles from ``at`` and of the rest of ``need`` after the gap; without ``before``, of ``need`` shingles in a row.

    They are aligned at the longer side of the gap, and wider by one place, as after a word that was added or left out the two sides are one place apart.
    """
    head, tail = x.runs(at, at + before), x.runs(at + before + gap, at + gap + need)
    keys = mixed(tail + np.where(before > 0, mixed(head + before.astype(np.uint64)), np.uint64(0)))
    return x.rows(keys, None, np.where(2 * before >= need, at, at + before + gap), low, high, 1)


def by_size(made: Iterator[tuple[np.ndarray, ...]], words: int, every: int) -> Iterator[pa.RecordBatch]:
    """Windows, linked to each other where many have been made."""
    held: list[tuple[np.ndarray, ...]] = []
    for x in made:
        held.append(x)
        if sum(len(y[0]) for y in held) >= LOCAL:
            yield local(held, words, every)
            held = []
    if sum(len(y[0]) for y in held):
        yield local(held, words, every)


def runs_of(x: Texts, at: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """A window for each run of the shortest passage's length that holds a crowded key, under the run as key: who shares a run is of one class.

    A run that holds several keys has one window, as wide as theirs together.
    """
    return x.rows(x.runs(at, at + reach + 1), None, at, begin, end)


def rarest_of(x: Texts, at: np.ndarray, begin: np.ndarray, end: np.ndarray, words: int, similarity: float, bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows under shingles that aren't popular, of each run that holds a crowded key.

    Of a run with as many of them as a similar one can't lack together, some are enough. A run with fewer has all of them, and keys with a gap that holds them all;
    a stretch of popular ones that is shorter than a run, but not by more than may be missing, is a key.
    """
    reach = words - SHINGLE
    t, need = need_of(words, similarity)
    enough = t - need + 1
    taken = min(t, enough + SPARE)
    common = flagged(bits[0], x.shingles)
    common[ranges(x.end, np.append(x.begin[1:], len(common)))[0]] = 0  # between two texts
    rank = (x.shingles >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63))
    rare = np.r_[0, np.cumsum(1 - common.astype(np.int64))]
    n_rare = rare[at + t] - rare[at]
    places, runs = [], []
    some = np.flatnonzero(n_rare)
    for i in range(0, len(some), RUNS):
        part = some[i : i + RUNS]
        in_run = np.lib.stride_tricks.sliding_window_view(rank, t)[at[part]]
        least = np.argpartition(in_run, taken - 1, axis=1)[:, :taken]
        take = np.take_along_axis(in_run, least, axis=1) >> np.uint64(63) == 0
        places.append((at[part][:, None] + least)[take])
        runs.append(np.broadcast_to(part[:, None], least.shape)[take])
    if places:
        place, run = np.concatenate(places), np.concatenate(runs)
        order = np.argsort(place, kind="stable")
        place, run = place[order], run[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        low, high = np.minimum.reduceat(begin[run], first), np.maximum.reduceat(end[run], first)
        place = place[first]
        left, right = np.minimum(place - low, reach), np.minimum(high - place, reach)
        yield x.rows(x.shingles[place], mixed(x.runs(place - left, place + right + 1) + left.astype(np.uint64)), place, low, high)
    # the first and the last rare shingle of runs with few of them
    where = np.flatnonzero(common == 0)
    few = np.flatnonzero((n_rare > 0) & (n_rare < enough))
    i, j = where[rare[at[few]]] - at[few], where[rare[at[few] + t] - 1] - at[few]
    for gap in range(max(1, SHINGLE - 1), min(SHINGLE, t - need) + 1):
        before, of = ranges(np.maximum(j - gap + 1, 1), np.minimum(i, need - 1) + 1)
        run = few[of]
        yield gap_rows(x, at[run], before, gap, need, begin[run], end[run])
    edge = np.diff(np.r_[0, common.astype(np.int8), 0])
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    short = (stop - start >= need) & (stop - start < t)
    s, _ = ranges(start[short], stop[short] - need + 1)
    if len(at):
        k = np.searchsorted(at, s, "right") - 1  # a run that holds the stretch, if there is one
        ok = (k >= 0) & (at[np.maximum(k, 0)] + t >= s + need)
        s, k = s[ok], k[ok]
        yield gap_rows(x, s, np.zeros(len(s), np.int64), 0, need, begin[k], end[k])


def keys_of(batches: Iterator[pa.RecordBatch], words: int, every: int, similarity: float, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts with ``pack`` of windows of crowded keys: windows under the runs of such keys, and under rare shingles of these."""

    def made() -> Iterator[tuple[np.ndarray, ...]]:
        for x in some_texts(batches):
            at, begin, end = x.around_keys(words - SHINGLE)
            if len(at):
                yield runs_of(x, at, begin, end, words - SHINGLE)
                yield from rarest_of(x, at, begin, end, words, similarity, bits)

    return by_size(made(), words, every)


def popular_runs(batches: Iterator[pa.RecordBatch], words: int, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of popular shingles only, some of which are followed by different ones: ``run``, ``doc``, where it begins, and the window around it."""
    t = words - SHINGLE + 1
    for x in some_texts(batches):
        at, begin, end = x.around_keys(t - 1)
        common, parts = (np.r_[0, np.cumsum(flagged(y, x.shingles), dtype=np.int64)] for y in bits)
        k = np.flatnonzero((common[at + t] - common[at] == t) & (parts[at + t] > parts[at]))
        run, of = x.runs(at[k], at[k] + t).view(np.int64), x.text(at[k])
        order = np.lexsort((at[k], run, of))
        run, of, k = run[order], of[order], k[order]
        new = np.ones(len(k), bool)
        new[1:] = (run[1:] != run[:-1]) | (of[1:] != of[:-1])  # the first of a text
        run, of, k = run[new], of[new], k[new]
        columns = run, x.doc[of], *(y[k] - x.begin[of] for y in (at, begin, end))
        yield pa.RecordBatch.from_arrays([pa.array(y) for y in columns], ["run", "doc", "at", "begin", "end"])


def gaps_of(batches: Iterator[pa.RecordBatch], words: int, every: int, similarity: float, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts with their runs of popular shingles that no text before has: windows under keys with a gap, and under the first ``need`` shingles."""
    t, need = need_of(words, similarity)

    def made() -> Iterator[tuple[np.ndarray, ...]]:
        for x in some_texts(batches):
            at, begin, end = (x.found[y] + x.first for y in ("at", "begin", "end"))
            parts = flagged(bits[1], x.shingles)
            for i in range(0, len(at), RUNS):
                of, before = np.nonzero(parts[at[i : i + RUNS, None] + np.arange(need - 1)])
                of, before = of + i, before + 1
                for gap in range(max(1, SHINGLE - 1), min(SHINGLE, t - need) + 1):
                    yield gap_rows(x, at[of], before, gap, need, begin[of], end[of])
            if need < t:  # what two runs have at their ends, or at their beginnings, and nothing else
                s = at[:, None] + np.arange(t - need + 1)
                of, off = np.nonzero(parts[s + need - 1])
                s = s[of, off]
                yield gap_rows(x, s, np.zeros(len(s), np.int64), 0, need, begin[of], end[of])

    return by_size(made(), words, every)


def linked(batches: Iterator[pa.RecordBatch], words: int, every: int) -> Iterator[pa.RecordBatch]:
    """Over rows ordered by key, links among them: links, as they are and made here.

    Of compact windows, those of crowded keys are given as ``doc`` and ``first`` without a partner. Keys of other kinds (``every``) are never too crowded: few texts have them,
    or all their windows are of one class.
    """
    t = words - SHINGLE + 1

    def made(key: np.ndarray, around: np.ndarray, doc: np.ndarray, pack: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, to, _ = classed(key, around, doc, pack)
        key, doc, pack = key[order], doc[order], pack[order]

        def links(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(x), LOCAL):
                a, e = x[i : i + LOCAL], y[i : i + LOCAL]
                yield pa.RecordBatch.from_arrays([*map(pa.array, stretches(bits_of(key[a], every), doc[a], pack[a], doc[e], pack[e], t))], LINK)

        own = np.flatnonzero(to >= 0)
        out = [(own, to[own])]
        rest = np.flatnonzero(to < 0)
        k, d = key[rest], doc[rest]
        first = np.flatnonzero(np.diff(k, prepend=~k[:1]))
        count = np.diff(np.append(first, len(k)))
        shared = (np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)) if len(k) else np.zeros(0, bool)
        few = shared & (count <= PAIRS) if not every else shared
        at = np.flatnonzero(np.repeat(few, count))  # places in ``rest`` whose key goes on for another ``gap`` places
        gap = 0
        while len(at):
            gap += 1
            at = at[at + gap < len(rest)]
            at = at[k[at] == k[at + gap]]
            fit = at[d[at] != d[at + gap]]
            out.append((rest[fit + gap], rest[fit]))
            if sum(len(x) for x, _ in out) > LOCAL:
                yield from links(*(np.concatenate(z) for z in zip(*out, strict=True)))
                out = []
        if out:
            yield from links(*(np.concatenate(z) for z in zip(*out, strict=True)))
        many = rest[np.repeat(shared & (count > PAIRS), count)] if not every else rest[:0]
        if len(many):
            none = pa.nulls(len(many), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(doc[many]), none, none, pa.array(pack[many]), none, none], LINK)

    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        link = b.column(5).is_valid().to_numpy(zero_copy_only=False)
        out = b.filter(pa.array(link))
        if out.num_rows:
            yield pa.RecordBatch.from_arrays([out.column(n) for n in ("doc", "to_doc", "around", "pack", "last", "key")], LINK)
        held.append(tuple(b.column(i).to_numpy()[~link] for i in (1, 2, 3, 4)))
        size += len(held[-1][0])
        if size < LOCAL:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        stop = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on
        if stop:
            yield from made(*(c[:stop] for c in columns))
        held = [tuple(c[stop:] for c in columns)]
        size = len(held[0][0]) if stop else 0
    if held and sum(len(x[0]) for x in held):
        yield from made(*(np.concatenate(c) for c in zip(*held, strict=True)))


def candidates(docs: DataFrame, hashes: int, words: int, similarity: float) -> DataFrame:
    """``(doc, to_doc, shift, first, last, hashes)``: aligned stretches, in shingles of ``doc``, and under how many functions they met.

    A text that holds a window of a class again has a row with itself.
    """
    every = (1 << hashes) - 1  # whoever has a run or a rare shingle in common counts as met under every function

    def links(rows: DataFrame, every: int) -> DataFrame:
        met = rows.repartition("deal").sortWithinPartitions("key")  # one whole number: the sort needs no comparisons of rows
        return met.mapInArrow(lambda batches: linked(batches, words, every), LINKS)

    met = staged(links(docs.select("doc_id", "data").mapInArrow(lambda batches: rows_of(batches, hashes, words), ROW), 0), tidy=True)
    crowded = met.where("to_doc IS NULL").groupBy("doc").agg(F.collect_list(F.struct(F.col("first").alias("pack"))).alias("found"))
    texts = staged(docs.join(crowded, docs.doc_id == crowded.doc).select("doc_id", "data", "found"), tidy=True)
    bits = docs.sparkSession.sparkContext.broadcast(popular(texts, words))
    run = texts.mapInArrow(lambda batches: popular_runs(batches, words, bits.value), "run long, doc long, at long, begin long, end long")
    run = run.groupBy("run").agg(F.min(F.struct("doc", "at", "begin", "end")).alias("r")).groupBy("r.doc").agg(F.collect_list(F.struct("r.at", "r.begin", "r.end")).alias("found"))
    having = texts.drop("found").join(run, texts.doc_id == run.doc).select("doc_id", "data", "found")
    rows = [
        texts.mapInArrow(lambda batches: keys_of(batches, words, every, similarity, bits.value), ROW),
        having.mapInArrow(lambda batches: gaps_of(batches, words, every, similarity, bits.value), ROW),
    ]
    met = met.unionByName(links(rows[0].unionByName(rows[1]), every))
    met = met.where(F.col("to_doc").isNotNull()).groupBy("doc", "to_doc", "shift")
    return met.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.bit_count(F.bit_or("hash").bitwiseAND(every)).alias("hashes"))


def spread_by_arrays(starts: np.ndarray, stops: np.ndarray, n: int, rate: float, least: int) -> list[tuple[int, int]]:
    """The same as ``spread`` of many runs of matches."""
    total = np.cumsum(stops - starts)
    before, after = total - (stops - starts) - rate * starts, total - rate * stops
    new = before < np.minimum.accumulate(np.append(0.0, before))[:-1] - 1e-9
    new[0] |= starts[0] == 0
    begin, value = starts[new], before[new] - 1e-9
    ahead = np.maximum.accumulate(after[::-1])
    to = len(after) - 1 - np.searchsorted(ahead, value)
    end = np.minimum(n, stops[to] + ((after[to] - value) / rate).astype(np.int64))
    keep = (end - begin >= least) & (stops[to] - begin >= least)
    keep[1:] &= end[1:] > end[:-1]
    return list(zip(begin[keep].tolist(), stops[to][keep].tolist(), strict=True))


def spread(flags: np.ndarray, similarity: float, least: int) -> list[tuple[int, int]]:
    """Longest stretches, which may overlap, of ``least`` places or more whose matches make up for their misses.

    Misses may outweigh what came before them, if a later part makes up for it.
    """
    n, rate = len(flags), 2 * similarity / (1 + similarity)
    marks = np.empty(n + 2, bool)
    marks[0] = marks[-1] = False
    marks[1:-1] = flags
    edge = np.flatnonzero(marks[1:] != marks[:-1])  # runs of matches: a stretch begins with one and ends with one
    if len(edge) > 2 * FEW:
        return spread_by_arrays(edge[::2], edge[1::2], n, rate, least)
    starts, stops = edge[::2].tolist(), edge[1::2].tolist()
    before, after, total = [], [], 0
    for a, e in zip(starts, stops, strict=True):
        before.append(total - rate * a)
        total += e - a
        after.append(total - rate * e)
    ahead = after[:]  # the most that any end from here on reaches
    for i in range(len(ahead) - 2, -1, -1):
        ahead[i] = max(ahead[i], ahead[i + 1])
    out, lowest, furthest, to = [], 0.0, -1, 0
    for i, a in enumerate(starts):
        value = before[i]
        if a and value >= lowest - 1e-9:
            continue
        lowest = value
        to = max(to, i)
        while to + 1 < len(ahead) and ahead[to + 1] >= value - 1e-9:
            to += 1
        end = min(n, stops[to] + int((after[to] - value + 1e-9) / rate))  # misses that it can still make up for
        if end - a >= least and end > furthest and stops[to] - a >= least:
            out.append((a, stops[to]))
        furthest = end
    return out


def bands(one: np.ndarray, other: np.ndarray, place: np.ndarray, open_: np.ndarray, t: int, need: int) -> list[tuple[int, int, int, int]]:
    """Runs of ``t`` places of either side, at one distance from each other, that have ``need`` values in common; neighbouring ones as one.

    ``place`` tells where each value of ``one`` is in ``other``, or -1. Distances are those of half of the values needed,
    as a run in which one word was changed has them at least, some of which are ``open_``: in no passage found before.
    """
    k = np.flatnonzero(place >= 0)
    low = len(other)
    size = len(one) + low + 1
    far = (np.bincount(k - place[k] + low, minlength=size) >= need // 2) & (np.bincount(k - place[k] + low, open_[k], minlength=size) > 0)
    out = []
    for d in (np.flatnonzero(far) - low).tolist():
        begin, end = max(0, d), min(len(one), len(other) + d)  # of one, where other has a place at this distance
        if end - begin < t:
            continue
        at = place.copy()
        same = one[begin:end] == other[begin - d : end - d]
        at[begin:end][same] = np.arange(begin - d, end - d)[same]
        i = np.flatnonzero(at >= 0)
        first, last = np.maximum(i, at[i] + d) - t + 1, np.minimum(i, at[i] + d)
        first, last = np.maximum(first, begin), np.minimum(last, end - t)
        fit = first <= last
        edge = np.bincount(first[fit], minlength=len(one) + 2) - np.bincount(last[fit] + 1, minlength=len(one) + 2)
        good = np.zeros(len(one) + 3, np.int8)
        good[1:] = np.cumsum(edge) >= need
        turn = np.diff(good)
        for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
            b += t - 1
            inside = i[(i >= a) & (i < b)]
            c, e = int(inside[0]), int(inside[-1]) + 1
            if e - c >= t:  # what a run has at its ends and the other side hasn't is left out
                a, b = c, e
            out.append((a, b, a - d, b - d))
    return out


def verify(one: np.ndarray, other: np.ndarray, words: int, similarity: float) -> list[tuple[int, int, int, int]]:
    """Passages ``(begin, end)`` of either side, in words, whose shingle sets are similar enough.

    First the longest stretches of both sides are compared: of those in which ``similarity`` of the shingles are shared, as any passage has it,
    then of those with as many as a passage has that is as long on both sides. Where these are all similar nothing is left to find. Otherwise
    all runs of the shortest passage's length are compared that stand at a distance from each other at which the texts agree.
    """
    least, found = words - SHINGLE + 1, []
    names, ids = np.unique(np.concatenate([one, other]), return_inverse=True)
    one, other = ids[: len(one)], ids[len(one) :]

    def among(x: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(names), bool)
        mark[x] = True
        return mark

    theirs = among(other)
    shared = theirs[one]
    size = np.count_nonzero(shared)
    if size < least * similarity - 1e-9:
        return []  # any passage has as many matches
    back = among(one)[other]
    if size >= least and size == np.count_nonzero(back):
        p, u = int(np.argmax(shared)), int(np.argmax(back))
        if shared[p : p + size].all() and np.array_equal(one[p : p + size], other[u : u + size]):  # one stretch, word for word, is all that they share
            return [(p, p + size + SHINGLE - 1, u, u + size + SHINGLE - 1)]
    missed = False
    for rate in (similarity / (2 - similarity), similarity):
        for p, q in spread(shared, rate, least) or [(0, 0)]:
            mine = len(found)
            own = among(one[p:q])
            n_own = np.count_nonzero(own)
            for u, v in spread(own[other], rate, least) if q else []:
                both = among(other[u:v])
                n = np.count_nonzero(both)
                both &= own
                n_both = np.count_nonzero(both)
                if n_both >= (similarity - 1e-9) * (n_own + n - n_both):
                    found.append((p, q + SHINGLE - 1, u, v + SHINGLE - 1))
                else:
                    missed = True
            missed |= mine == len(found)
        if not missed:
            break
    need = int(np.ceil(2 * similarity * least / (1 + similarity) - 1e-9))
    if missed and len(one) >= least:
        sums = np.concatenate([[0], np.cumsum(shared)])
        missed = (sums[least:] - sums[:-least]).max() >= need  # a run with as many matches
    if missed:
        where = np.full(len(names), -1, np.int64)
        where[other[::-1]] = np.arange(len(other))[::-1]
        left = np.ones(len(one), bool)
        for a, b, _, _ in found:
            left[a : b - SHINGLE + 1] = False
        found += [(a, b + SHINGLE - 1, x, y + SHINGLE - 1) for a, b, x, y in bands(one, other, where[one], left, least, need)]
    if len(found) < 2:
        return found
    longest = np.array(sorted(set(found), key=lambda f: f[0] - f[1]))
    kept, n = np.empty_like(longest), 0
    for f in longest:  # a passage within a longer one says nothing new
        begin, end, x, y = kept[:n].T
        if not ((begin <= f[0]) & (f[1] <= end) & (x <= f[2]) & (f[3] <= y)).any():
            kept[n] = f
            n += 1
    return [tuple(f) for f in kept[:n].tolist()]


def plausible(key: np.ndarray, there: np.ndarray, row: np.ndarray, rows: int, least: int, similarity: float) -> np.ndarray:
    """For each of ``rows`` whether ``verify`` may find something: ``key`` has the shingles of all first sides, each with its row mixed in, ``there`` those of the other sides.

    A passage has ``least`` places or more, of whose different shingles the other side has ``similarity``. Places whose shingle may occur again count as shared, and
    so do those that meet another one's bit: a row is left out only if even then no stretch is long and similar enough.
    """
    bits = max(12, int(2 * len(key) + len(there)).bit_length() + 4)
    low = np.uint64((1 << bits) - 1)
    slot, number = (key & low).astype(np.int64), np.arange(len(key))
    last = np.empty(1 << bits, np.int32)
    last[slot] = number
    shared = last[slot] != number  # overwritten by a later one
    again = np.zeros(1 << bits, bool)
    again[slot[shared]] = True
    shared |= again[slot]
    held = np.zeros(1 << bits, bool)
    held[(there & low).astype(np.int64)] = True
    member = held[slot]
    out = np.bincount(row[member], minlength=rows) >= least * similarity - 1e-9
    shared |= member
    sums = np.r_[0.0, np.cumsum(shared - similarity)]
    ends = np.cumsum(np.bincount(row, minlength=rows))
    for r in np.flatnonzero(out).tolist():
        own = sums[ends[r - 1] if r else 0 : ends[r] + 1]
        out[r] = len(own) > least and (own[least:] - np.minimum.accumulate(own[:-least]) >= -1e-6).any()
    return out


def checked(held: list[tuple], hasher: Shingles, words: int, similarity: float) -> list[tuple]:
    """Passages of rows ``(doc, to_doc, first, to_first, part, shingles of the other side)``."""
    if not held:
        return []
    mine, begin, end = places_of(hasher, [h[4] for h in held])
    salt = np.arange(len(held), dtype=np.uint64) * BASE
    at, row = ranges(begin, end)
    there = np.concatenate([h[5] for h in held]) ^ np.repeat(salt, [len(h[5]) for h in held])
    fit = plausible(mine[at] ^ salt[row], there, row, len(held), words - SHINGLE + 1, similarity)
    out = []
    for r in np.flatnonzero(fit).tolist():
        doc, to_doc, first, to_first, _, other = held[r]
        for p, q, u, v in verify(mine[begin[r] : end[r]], other, words, similarity):
            out.append((doc, to_doc, first + p, first + q, to_first + u, to_first + v))
    return out


def near_passages(
    docs: DataFrame, words: int = PASSAGE_WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, enough: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``component_id``, ``n_passages``, ``n_words`` and ``passages``.

    ``passages`` are the word ranges ``[begin, end)`` of at least ``words`` words that another document has
    with a shingle similarity of ``similarity`` or more; ``n_words`` counts their words. ``component_id`` is the smallest id that can be
    reached over such passages, itself included. Candidates must meet under ``enough`` of the ``hashes`` functions.
    Texts that are copies are one node. A null or shorter text has no passage. Rows with equal ids are one
    document. A row with a null id can't be named as a partner: it isn't compared and its component is null.
    An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    if not 1 <= hashes <= 8:
        raise ValueError("1 to 8 hash functions")
    small_batches(spark)
    read = bytes_of(docs, id_col, text_col)
    named = read.where("doc_id IS NOT NULL AND data IS NOT NULL")
    ids = named.select("doc_id", F.md5("data").alias("digest"))
    first = ids.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"))
    copies = staged(ids.join(first.where("n > 1"), "digest").where("doc_id <> node").select("doc_id", "node").distinct(), tidy=True)

    met = staged(candidates(named, hashes, words, similarity).where(F.col("hashes") >= enough), tidy=True)

    def renamed(df: DataFrame, column: str) -> DataFrame:
        of = copies.groupBy(F.col("doc_id").alias(column)).agg(F.min("node").alias("_node"))
        return df.join(of, column, "left").withColumn(column, F.coalesce("_node", column)).drop("_node")

    pairs = renamed(renamed(met.where("doc <> to_doc"), "doc"), "to_doc").where("doc <> to_doc")
    # one direction, and one row for each alignment of two nodes
    turned = F.col("doc") < F.col("to_doc")
    pairs = pairs.select(
        F.greatest("doc", "to_doc").alias("doc"), F.least("doc", "to_doc").alias("to_doc"),
        F.when(turned, -F.col("shift")).otherwise(F.col("shift")).alias("shift"),
        *(F.when(turned, F.col(x) - F.col("shift")).otherwise(F.col(x)).alias(x) for x in ("first", "last")),
    )
    pairs = pairs.groupBy("doc", "to_doc", "shift").agg(F.min("first").alias("first"), F.max("last").alias("last"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data = [z.compress(b" ".join(words_of(x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "words"])

    texts = named.mapInArrow(squeeze, "doc_id long, words binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            rows: list[tuple] = []
            for doc, data, found in zip(*(x.to_pylist() for x in b.columns), strict=True):
                text = z.decompress(data)
                space = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                begin, end = [0, *(space + 1).tolist()], [*space.tolist(), len(text)]
                met: dict[int, list[tuple[int, int, int, int]]] = {}
                for r in found:
                    a, e = max(0, r["first"]), r["last"] + SHINGLE
                    met.setdefault(r["to_doc"], []).append((a, e, a - r["shift"], e - r["shift"]))
                for to_doc, ranges in met.items():
                    if len(ranges) > ALIGNMENTS:
                        low, high = np.min(ranges, axis=0).tolist(), np.max(ranges, axis=0).tolist()
                        ranges = [(low[0], high[1], low[2], high[3])]
                    rows += [(doc, to_doc, a, x, y, text[begin[a] : end[min(e, len(end)) - 1]]) for a, e, x, y in ranges]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            names = ["doc", "to_doc", "first", "to_first", "to_end", "part"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    of = pairs.groupBy("doc").agg(F.collect_list(F.struct("to_doc", "shift", "first", "last")).alias("found"))
    parts = texts.join(of, texts.doc_id == of.doc).select("doc", "words", "found").mapInArrow(
        cut, "doc long, to_doc long, first long, to_first long, to_end long, part binary"
    )
    both = staged(parts, tidy=True).join(texts, F.col("to_doc") == texts.doc_id).select("doc", "to_doc", "first", "to_first", "to_end", "part", "words")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, hasher = zstandard.ZstdDecompressor(), Shingles()
        last, shingles = None, np.zeros(0, np.uint64)
        for b in batches:
            rows: list[tuple] = []
            held: list[tuple] = []
            size = 0
            for doc, to_doc, first, to_first, to_end, part, data in zip(*(x.to_pylist() for x in b.columns), strict=True):
                at = max(0, to_first)
                if data != last:  # rows of a text come one after the other
                    last, shingles = data, hasher.joined(z.decompress(data))
                held.append((doc, to_doc, first, at, part, shingles[at : max(at, to_end - SHINGLE + 1)]))
                size += len(part)
                if size > CHECKED:
                    rows += checked(held, hasher, words, similarity)
                    held, size = [], 0
            rows += checked(held, hasher, words, similarity)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], ["doc", "to_doc", "begin", "end", "to_begin", "to_end"]
            )

    true = staged(both.mapInArrow(check, "doc long, to_doc long, begin long, end long, to_begin long, to_end long"), tidy=True)

    span = F.struct(F.col("begin").alias("begin"), F.col("end").alias("end"))
    other = F.struct(F.col("to_begin").alias("begin"), F.col("to_end").alias("end"))
    sides = true.select(F.col("doc").alias("node"), span.alias("s")).unionByName(true.select(F.col("to_doc").alias("node"), other.alias("s")))
    spans = sides.distinct().groupBy("node").agg(F.collect_list("s").alias("spans"))
    again = met.where("doc = to_doc").select(F.col("doc").alias("doc_id")).distinct()

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, t = Shingles(), words - SHINGLE + 1
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for data, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                shingles = hasher.of(words_of(data))
                at = np.arange(max(0, len(shingles) - t + 1))
                run, known = hasher.runs(shingles, at, at + t), np.zeros(len(shingles) + words, bool)
                for s in found:  # runs of the shortest passage that are found ones
                    known[s["begin"] : s["end"] - words + 1] = True
                same = np.flatnonzero(np.isin(run, run[known[: len(run)]]) & ~known[: len(run)])
                out.append([*found, *({"begin": x, "end": x + words} for x in same.tolist())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["node", "spans"])

    # texts that repeat themselves were compared at one place of each class only
    repeated = named.dropDuplicates(["doc_id"]).join(again, "doc_id").join(spans, F.col("doc_id") == F.col("node")).select("node", "data", "spans")
    repeated = staged(repeated.mapInArrow(repeat, "node long, spans array<struct<begin:long,end:long>>"), tidy=True)
    spans = spans.join(repeated.select("node"), "node", "left_anti").unionByName(repeated)
    component = connected_components(true.select(F.col("doc").alias("src"), F.col("to_doc").alias("dst")))

    # copies of at least so many words are passages as a whole; their node counts as one of them
    is_copy = copies.groupBy("doc_id").agg(F.min("node").alias("node"))
    copied = is_copy.unionByName(copies.select(F.col("node").alias("doc_id"), "node").distinct()).groupBy("doc_id").agg(F.min("node").alias("node"))
    return finish(read, copied, spans, component, words)


def finish(read: DataFrame, copied: DataFrame, spans: DataFrame, component: DataFrame, words: int) -> DataFrame:
    """Bring nodes, components and spans back to all rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(words_of(x)) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n], ["doc_id", "length"])

    sized = read.mapInArrow(measure, "doc_id long, length long")
    rows = sized.join(copied, "doc_id", "left").withColumn("whole", F.col("node").isNotNull() & (F.col("length") >= words))
    rows = rows.withColumn("node", F.when(F.col("whole") | F.col("node").isNull(), F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")))
    rows = rows.join(spans, "node", "left").join(component, "node", "left")

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for length, whole, found in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                own = [(0, length)] if whole else merged([(s["begin"], s["end"]) for s in found or []])
                out.append([{"begin": x, "end": y} for x, y in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, kind)], ["doc_id", "component_id", "passages"])

    final = rows.select("doc_id", F.coalesce("component", "node").alias("component_id"), "length", "whole", "spans").mapInArrow(
        union, "doc_id long, component_id long, passages array<struct<begin:long,end:long>>"
    )
    n = F.aggregate("passages", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    return final.select("doc_id", "component_id", F.size("passages").cast("long").alias("n_passages"), n.alias("n_words"), "passages")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
