"""Common prefixes by threshold-bounded interval expansion on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by prefix doubling.  The last symbol is the unique least."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank, step = rank.astype(np.uint64), 1

    def ahead(by: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        out[:max(n - by, 0)] = rank[by:] + np.uint64(1)
        return out

    # The first key takes three symbols where their numbers fit.
    first = n < 1 << 21
    while True:
        if first:
            key = (rank << np.uint64(42)) | (ahead(1) << np.uint64(21)) | ahead(2)
        else:
            key = (rank << np.uint64(32)) | ahead(step)
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.empty(n, bool)
        fresh[0] = True
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        rank[order] = (np.cumsum(fresh) - 1).astype(np.uint64)
        if fresh.all():
            return order, rank.astype(np.int64)
        step, first = 3 if first else 2 * step, False


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of closed ranges, and the range that each belongs to."""
    sizes = high - low + 1
    owner = np.repeat(np.arange(len(low)), sizes)
    start = np.cumsum(sizes) - sizes
    return low[owner] + np.arange(len(owner)) - start[owner], owner


def repeated_starts(text: np.ndarray, least: int) -> np.ndarray:
    """Positions whose next ``least`` symbols also start somewhere else.

    Suffix intervals are extended backward, breadth first: level ``l`` holds the
    intervals of strings of ``l`` symbols, and the first interval to end before a
    boundary fixes the common prefix there at ``l``.  Values come out in
    increasing order, so the search stops at ``least``; boundaries without a
    value by then join suffixes with a common prefix of ``least`` or more.
    """
    n = len(text)
    if n < 2:
        return np.empty(0, np.int64)
    order, inverse = suffix_order(text)
    to = inverse[order - 1]                      # last-to-first mapping
    back = np.empty(n, np.int64)
    back[to] = np.arange(n)
    first = text[order]                          # first column
    same = np.empty(n + 1, bool)                 # neighbours in the first column agree
    same[0] = same[n] = False
    np.equal(first[1:], first[:-1], out=same[1:n])
    before = np.where(same[to], back[np.maximum(to - 1, 0)], -1)
    after = np.where(same[to + 1], back[np.minimum(to + 1, n - 1)], n)
    open_ = np.ones(n + 1, bool)                 # boundaries without a value
    open_[0] = open_[n] = False
    # Level 1: one interval for each symbol.
    low = np.flatnonzero(~same[:n])
    high = np.append(low[1:] - 1, n - 1)
    # A symbol's interval is fixed at value 0; all of them are expanded once.
    open_[high + 1] = False
    for _ in range(1, least):
        if not len(low):
            break
        single = low == high
        lows, highs = [to[low[single]]], [to[low[single]]]
        at, owner = _ranges(low[~single], high[~single])
        if len(at):
            starts, ends = low[~single][owner], high[~single][owner]
            lows.append(np.sort(to[at[before[at] < starts]]))
            highs.append(np.sort(to[at[after[at] > ends]]))
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = open_[high + 1]
        low, high = low[fresh], high[fresh]
        open_[high + 1] = False
    return np.sort(order[open_[:n] | open_[1:]])
