"""Suffix arrays of a shard by induced sorting, in array operations."""

from __future__ import annotations

import numpy as np


def suffix_types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one after them (S-type); the last
    symbol is a sentinel, smaller than all."""
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    after = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the symbol changes
    return np.r_[np.r_[step, -1][after] > 0, True]


def leftmost(s_type: np.ndarray) -> np.ndarray:
    """Places of the leftmost S-type suffixes: S-type after an L-type one."""
    return np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1


def _deal(sa: np.ndarray, at: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, way: int) -> None:
    """Append suffixes, in this order, to the fronts (way 1) or backs (-1) of their buckets."""
    if not len(suffixes):
        return
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    counts = np.bincount(symbols, minlength=len(at))
    rank = np.arange(len(order)) - (np.cumsum(counts) - counts)[sorted_symbols]
    sa[at[sorted_symbols] + way * rank] = suffixes[order]
    at += way * counts


def induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost S-type suffixes.

    Buckets are swept upwards to place the L-type suffixes and downwards for the
    S-type ones. A suffix places the one before it, so what a bucket has gained
    is dealt on as one batch, again while it gains from itself.
    """
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(len(t), -1, np.int64)
    back = ends - 1
    _deal(sa, back, seeds[::-1], t[seeds[::-1]], -1)
    seeded = ends - 1 - back  # the seeds at the back of each bucket
    front = starts.copy()
    for c in range(size):
        done = starts[c]
        while done < front[c]:
            batch, done = sa[done : front[c]], front[c]
            before = batch[batch > 0] - 1
            before = before[~s_type[before]]
            _deal(sa, front, before, t[before], 1)
        if seeded[c]:
            before = sa[ends[c] - seeded[c] : ends[c]] - 1
            before = before[before >= 0]
            before = before[~s_type[before]]
            _deal(sa, front, before, t[before], 1)
    back = ends - 1
    for c in range(size - 1, -1, -1):
        done = ends[c] - 1
        while done > back[c]:
            batch, done = sa[back[c] + 1 : done + 1][::-1], back[c]
            before = batch[batch > 0] - 1
            before = before[s_type[before]]
            _deal(sa, back, before, t[before], -1)
        batch = sa[starts[c] : front[c]][::-1]
        before = batch[batch > 0] - 1
        before = before[s_type[before]]
        _deal(sa, back, before, t[before], -1)
    sa[0] = len(t) - 1  # the sentinel
    return sa


def name_pieces(t: np.ndarray, sorted_places: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in text order, of the pieces between leftmost S-type places: the rank
    of the piece among the sorted ones, equal for equal pieces."""
    size = np.zeros(len(t) + 1, np.int64)
    size[places] = np.r_[np.diff(places), 0] + 1
    a, b = sorted_places[:-1], sorted_places[1:]
    same = (size[a] == size[b]) & (size[a] > 1)
    live, step = np.flatnonzero(same), 0
    while len(live):
        live = live[size[a[live]] > step]
        equal = t[a[live] + step] == t[b[live] + step]
        same[live[~equal]] = False
        live, step = live[equal], step + 1
    ranks = np.r_[0, np.cumsum(~same)]
    of = np.empty(len(t), np.int64)
    of[sorted_places] = ranks
    return of[places], int(ranks[-1]) + 1


#: suffixes a bucket holds on average at least where a sweep by buckets, in batches, is worth it
PER_BUCKET = 64


def induce_singly(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """What `induce` gives, place by place: one step a suffix in each direction, however many
    buckets there are. For reduced texts, whose symbols are names."""
    ends = np.cumsum(np.bincount(t, minlength=size))
    front, back = np.r_[0, ends[:-1]].tolist(), ends.tolist()
    sa = [-1] * len(t)
    for i, c in zip(seeds[::-1].tolist(), t[seeds[::-1]].tolist(), strict=True):
        back[c] -= 1
        sa[back[c]] = i
    # the symbol before each place where it starts an L-type, or S-type, suffix; -1 where not, and of no place
    before, small = np.r_[-1, t[:-1]], np.r_[False, s_type[:-1]]
    large = np.r_[np.where(small, -1, before), -1].tolist()
    small = np.r_[np.where(small, before, -1), -1].tolist()
    for i in sa:  # grows ahead of the place it is read at
        c = large[i]
        if c >= 0:
            at = front[c]
            sa[at] = i - 1
            front[c] = at + 1
    back = ends.tolist()
    for at in range(len(sa) - 1, -1, -1):
        i = sa[at]
        c = small[i]
        if c >= 0:
            back[c] = at = back[c] - 1
            sa[at] = i - 1
    sa[0] = len(t) - 1  # the sentinel
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes of t, symbols below `size`, whose last symbol is 0 and the only 0.

    Suffixes are classified; the leftmost S-type ones are sorted by their pieces,
    by inducing from any order; equal pieces get equal names; the text of
    names, at most half as long, is sorted by recursion unless all differ; and its
    order induces the order of all suffixes. A text of few symbols is swept by buckets,
    in array operations, and one of many, as names are, place by place.
    """
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    s_type = suffix_types(t)
    places = leftmost(s_type)
    if not len(places):
        places = np.array([len(t) - 1])
    is_place = np.zeros(len(t), bool)
    is_place[places] = True
    sweep = induce if len(t) >= PER_BUCKET * size else induce_singly
    rough = sweep(t, s_type, places, size)
    names, distinct = name_pieces(t, rough[is_place[rough]], places)
    if distinct < len(places):
        order = suffix_array(names, distinct)
    else:
        order = np.empty(len(places), np.int64)
        order[names] = np.arange(len(places))
    return sweep(t, s_type, places[order], size)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place in `order` (sorted suffixes), by
    place in the text, how many bytes it shares with the suffix sorted before
    it, up to `most`; 0 for the first one. Eight bytes are compared at a time.
    """
    shared = np.zeros(len(data), np.int64)
    before = np.full(len(data), -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.r_[data, np.zeros(most + 16, np.uint8)]
    words = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))
    at = np.flatnonzero(before >= 0)
    other = before[at]
    for step in range(0, most, 8):
        differ = words[at + step] ^ words[other + step]
        equal = differ == 0
        low = differ[~equal]
        # the lowest byte that differs, as the words are little-endian
        low &= np.uint64(0) - low
        shared[at[~equal]] = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        at, other = at[equal], other[equal]
    shared[at] = most
    return np.minimum(shared, most)
