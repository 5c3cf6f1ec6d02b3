"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is S if it is smaller than the one that begins a symbol later, else L; an S suffix
that follows an L suffix is leftmost-smaller.  The leftmost-smaller substrings are sorted and
named, the string of their names is sorted by the same function, and every other suffix gets
its order from the neighbour to its right: L suffixes from leftmost-smaller ones, then S
suffixes from L ones.  Induction goes by the place in a run of one type, so that each step is
a few array operations over all runs.
"""

from __future__ import annotations

import numpy as np

#: Runs of one type up to this length are induced symbol by symbol, longer ones by doubling.
LONG_RUN = 48


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0; equal keys share a rank."""
    order = np.argsort(keys)
    keys = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
    return rank


def induce(t: np.ndarray, value: np.ndarray, of: np.ndarray, larger: int) -> None:
    """Sets value for the suffixes in of, from those that end their runs.

    value orders suffixes: first symbol, then type (larger: 0 for L, 1 for S), then rank.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([0], of.view(np.int8), [0]))))
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return
    scale = len(t) + 1
    if length.max() > LONG_RUN:
        return induce_long(t, value, of, edge[1::2], length, larger)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    for k in range(int(length[0]) - 1, -1, -1):
        have = np.searchsorted(-length, -k)  # runs longer than k
        at = np.repeat(start[:have] + k, length[:have] - k) + ramp(length[:have] - k) if k else np.flatnonzero(of)
        right = value[at + 1]
        if len(t) > 1 << 21:
            right = dense(right)
        rank = dense(t[at] * (int(right.max()) + 1) + right)
        value[at] = (2 * t[at] + larger) * scale + rank


def induce_long(t: np.ndarray, value: np.ndarray, of: np.ndarray, ends: np.ndarray, length: np.ndarray, larger: int) -> None:
    """The same by doubling: each round orders by twice as many symbols, up to the run's end."""
    scale = len(t) + 1
    at = np.flatnonzero(of)
    left = np.repeat(ends, length) - at
    value[at] = (2 * t[at] + larger) * scale
    both = np.unique(np.concatenate((at, ends)))
    now = np.zeros(len(t), np.int64)
    now[both] = dense(value[both]) + 1
    step = 1
    while step <= int(left.max()):
        more = left >= step
        key = now[both] * scale
        place = np.searchsorted(both, at[more])
        key[place] += now[at[more] + step]
        now[both] = dense(key) + 1
        step *= 2
    value[at] += dense(now[at])


def ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def suffix_ranks(t: np.ndarray) -> np.ndarray:
    """The rank of each suffix; t's last symbol must be smaller than any other."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    differs = np.where(t[:-1] != t[1:], np.arange(n - 1), n - 1)
    differs = np.minimum.accumulate(differs[::-1])[::-1]
    small = np.append((t[:-1] < t[1:])[np.minimum(differs, n - 2)], True)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    scale = n + 1
    value = np.zeros(n, np.int64)
    inner = small.copy()
    inner[-1] = False

    def all_from(rank: np.ndarray | int) -> None:
        value[leftmost] = (2 * t[leftmost] + 1) * scale + rank
        induce(t, value, ~small, 0)
        induce(t, value, inner, 1)

    all_from(0)
    names = dense(value[leftmost])
    all_from(suffix_ranks(names) if int(names.max()) + 1 < len(names) else names)
    rank = np.empty(n, np.int64)
    rank[np.argsort(value)] = np.arange(n)
    return rank


def common_prefixes(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix before it in order (-1: none).

    A position whose preceding byte equals that of its predecessor has one less than the
    position before; only the others are compared, eight bytes at a time.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.zeros(n + 1, np.uint64)
    for j in range(8):
        word[:n] = (word[:n] << np.uint64(8)) | padded[j : j + n]
    at = np.arange(n)
    own = (before < 0) | (at == 0) | (before == 0)
    own[~own] = data[at[~own] - 1] != data[before[~own] - 1]
    head = at[own & (before >= 0)]
    length = np.zeros(n, np.int64)
    active, other, done = head, before[head], 0
    while len(active):
        inside = np.maximum(active, other) + done < n
        same = inside.copy()
        same[inside] = word[active[inside] + done] == word[other[inside] + done]
        stop = active[~same]
        if len(stop):
            i, j = stop + done, other[~same] + done
            tail = np.zeros(len(stop), np.int64)
            going = np.ones(len(stop), bool)
            for b in range(8):
                going &= np.maximum(i, j) + b < n
                going &= padded[np.minimum(i + b, n)] == padded[np.minimum(j + b, n)]
                tail += going
            length[stop] = done + tail
        active, other, done = active[same], other[same], done + 8
    from_head = np.maximum.accumulate(np.where(own, at, 0))
    return np.where(before < 0, 0, np.maximum(length[from_head] - (at - from_head), 0))
