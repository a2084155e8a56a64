"""Enhanced suffix arrays in numpy: prefix doubling, common prefixes, their intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of integer symbols and, at i, the common prefix of its entries i - 1 and i.

    Prefix doubling that sorts only what is not yet told apart, so text
    without long repeats costs a few sorts.  The first common prefix is 0.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    key = symbols[order]
    first = np.r_[True, key[1:] != key[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels = [rank.astype(np.int32)]
    alone = first & np.r_[first[1:], True]
    open_ = order[~alone]
    k = 1
    while len(open_):
        ahead = open_ + k
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        key = rank[open_] * (n + 1) + after + 1
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = rank[open_]
        m = len(open_)
        at = np.arange(m)
        class_start = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        first = np.r_[True, key[1:] != key[:-1]]
        group_start = np.maximum.accumulate(np.where(first, at, 0))
        rank[open_] = old + group_start - class_start
        levels.append(rank.astype(np.int32))
        open_ = open_[~(first & np.r_[first[1:], True])]
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]])
    a, b = sa[pair], sa[pair + 1]
    length = np.zeros(len(pair), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        inside = (x < n) & (y < n)
        same = inside & (levels[t][np.minimum(x, n - 1)] == levels[t][np.minimum(y, n - 1)])
        length += same.astype(np.int64) << t
    common[pair + 1] = length
    return sa, common


def maximal_repeats(sa: np.ndarray, common: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, from, to) of the maximal repeats: slices of `sa` that hold all occurrences.

    Scans the common prefixes of `least` or more with a stack, which visits
    the intervals of the common-prefix tree bottom up.  An interval is a
    maximal repeat if its occurrences are preceded by different symbols
    (`before`, by position); otherwise the repeat that is one symbol longer
    to the left has the same occurrences.  Intervals are longest on the right
    by construction.
    """
    long_ = common >= least
    edges = np.flatnonzero(np.diff(np.r_[False, long_, False].astype(np.int8)))
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        left = before[sa[begin - 1 : end]].tolist()
        values = common[begin:end].tolist()
        stack: list[list] = []  # length, first entry, the one symbol before all, or None if they differ
        for i, value in enumerate([*values, 0]):
            first, symbol = i, left[i]
            while stack and stack[-1][0] > value:
                length, first, last_symbol = stack.pop()
                last_symbol = last_symbol if last_symbol == symbol else None
                if last_symbol is None:
                    yield length, begin - 1 + first, begin + i
                symbol = last_symbol
            if value:
                if stack and stack[-1][0] == value:
                    if stack[-1][2] != symbol:
                        stack[-1][2] = None
                else:
                    stack.append([value, first, symbol])


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the half-open spans."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0
