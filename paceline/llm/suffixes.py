"""Suffix arrays and common prefixes of sequences of many strings, in numpy.

A sequence holds strings of positive numbers, each followed by a separator 0.
"""

from __future__ import annotations

import numpy as np

#: Length of the stretches of a sequence whose common prefixes are found side by side.
LANE = 64


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Positions of ``s`` in the order of their suffixes.

    A suffix ends at its first separator (0); the separator that comes earlier in ``s`` is the
    smaller one. The first sort is by as many symbols as a 64-bit number holds. Then come
    Larsson-Sadakane rounds: a rank is the place where its group begins, groups of one are done, and
    the others are sorted by the rank of the suffix that starts where the compared symbols end, so
    that the number of symbols compared doubles.
    """
    return sorted_suffixes(s, 0)[0]


def sorted_suffixes(s: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``suffix_order``; which places have the same first symbols as the place before; how many symbols these are, at most ``limit`` (or 0)."""
    n = len(s)
    ends = np.flatnonzero(s == 0)
    # small alphabets get small numbers, so that a key holds more symbols
    used = np.flatnonzero(np.bincount(s)[1:]) + 1
    number = np.zeros(int(s.max(initial=0)) + 1, np.uint64)
    number[used] = np.arange(1, len(used) + 1, dtype=np.uint64)
    bits = np.uint64(max(1, len(used).bit_length()))
    first = max(1, min(62 // int(bits), 12))
    symbols = np.concatenate([number[s], np.zeros(first, np.uint64)])
    key = symbols[:n].copy()
    live = key > 0
    for k in range(1, first):
        key <<= bits
        live &= symbols[k : n + k] > 0
        key |= np.where(live, symbols[k : n + k], np.uint64(0))
    order = np.argsort(key)
    key = key[order]
    start = np.empty(n, bool)
    start[:1] = True
    np.not_equal(key[1:], key[:-1], out=start[1:])
    places = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(start, places, 0))
    rank[ends] = np.arange(len(ends))
    order[: len(ends)] = ends
    start[: len(ends)] = True
    # suffixes that ended within the symbols compared so far tie by their separator's place
    upto = np.full(n, n, np.int64)
    upto[ends] = ends
    upto = np.minimum.accumulate(upto[::-1])[::-1]
    depth, known, same = first, 0, np.zeros(n, bool)
    group = ~start
    group[:-1] |= ~start[1:]
    at = np.flatnonzero(group)
    start = start[at]
    while True:
        if depth <= limit:
            known, same = depth, np.zeros(n, bool)
            same[at] = ~start & (upto[order[at]] - order[at] >= depth)
        if not len(at):
            return order, same, known
        p = order[at]
        last = upto[p]
        nxt = rank[np.where(last - p < depth, last, np.minimum(p + depth, n - 1))]
        head = rank[p]
        pair = (head << 32) | nxt  # ranks are places, far below 2^31
        again = np.argsort(pair)
        pair, p = pair[again], p[again]
        order[at] = p
        start = np.empty(len(at), bool)
        start[0] = True
        np.not_equal(pair[1:], pair[:-1], out=start[1:])
        rank[p] = np.maximum.accumulate(np.where(start, at, 0))
        left = ~start
        left[:-1] |= ~start[1:]
        at, start = at[left], start[left]
        depth *= 2


def common_prefixes(s: np.ndarray, order: np.ndarray, same: np.ndarray, known: int, limit: int) -> np.ndarray:
    """For every place of ``order``: symbols that its suffix shares with the one before it, up to a separator and to ``limit``; 0 where not ``same``.

    Kasai's rule: a suffix shares at least one symbol less with its neighbour than the suffix that starts one
    symbol earlier does. Positions that share ``known`` symbols with their neighbour are taken in lanes of
    consecutive ones, which walk side by side, each by that rule.
    """
    out = np.zeros(len(s), np.int64)
    places = np.flatnonzero(same)
    if not len(places):
        return out
    before = np.empty(len(s), np.int64)
    before[order[places]] = order[places - 1]
    here = np.zeros(len(s), bool)
    here[order[places]] = True
    at = np.flatnonzero(here)
    run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    lane = np.flatnonzero(within % LANE == 0)
    size = np.diff(np.append(lane, len(at)))
    padded = np.concatenate([s, np.zeros(limit + 1, s.dtype)])
    shared = np.zeros(len(s), np.int64)
    lane, size = lane[np.argsort(-size)], -np.sort(-size)
    h = np.full(len(lane), known, np.int64)
    for k in range(int(size[0])):
        going = int(np.searchsorted(-size, -k))  # lanes of more than k positions
        i = at[lane[:going] + k]
        j, h = before[i], np.maximum(h[:going] - 1, known)
        left = np.arange(going)
        x, y = i + h, j + h
        while len(left):
            one = padded[x]
            equal = (one == padded[y]) & (one != 0)
            h[left] += equal
            equal &= h[left] < limit
            left, x, y = left[equal], x[equal] + 1, y[equal] + 1
        shared[i] = h
    out[places] = np.minimum(shared[order[places]], limit)
    return out
