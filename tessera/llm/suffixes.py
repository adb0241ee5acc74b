"""Suffix order of a sequence of symbols by prefix doubling, in numpy."""

from __future__ import annotations

import numpy as np


def ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Levels of ranks, and the positions whose symbol occurs more than once.

    Level i ranks positions by the 2**i symbols from there on; equal ranks mean equal runs. In the last level all
    ranks differ: it is the inverse of the suffix array. Only positions that aren't settled yet are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    active = order[~(new & np.concatenate([new[1:], [True]]))]
    levels, k, repeated = [rank], 1, np.sort(active)
    while active.size:
        after = np.where(active + k < n, rank[np.minimum(active + k, n - 1)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + after
        o = np.argsort(key, kind="stable")
        active, key = active[o], key[o]
        base, at = rank[active], np.arange(len(active))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        outer = np.concatenate([[True], base[1:] != base[:-1]])
        rank = rank.copy()
        rank[active] = base + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
        levels.append(rank)
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    return levels, repeated


def longest_repeats(symbols: np.ndarray) -> np.ndarray:
    """For each position, how many symbols from there on occur elsewhere too (overlaps count)."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    levels, repeated = ranks(symbols)
    if not repeated.size:
        return out
    final = levels[-1]
    suffixes = np.empty(n, np.int64)
    suffixes[final] = np.arange(n)
    places = np.sort(final[repeated].astype(np.int64))
    places = places[places > 0]
    p, q = suffixes[places - 1], suffixes[places]
    same = levels[0][p] == levels[0][q]
    p, q = p[same], q[same]
    common = np.zeros(len(p), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = p + common, q + common
        fits = (a < n) & (b < n)
        equal = fits & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        common += equal.astype(np.int64) << level
    np.maximum.at(out, p, common)
    np.maximum.at(out, q, common)
    return out
