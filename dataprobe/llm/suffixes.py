"""Suffix arrays by difference covers, to a bounded depth, over bytes held in numpy arrays.

The cover is {1, 2} modulo 3.  ``order`` names the triples at covered positions by sorting them, recurses on the names
(positions 1 mod 3, then 2 mod 3), orders the uncovered suffixes by (first symbol, rank of the next suffix), and
merges the two lists.  A level's symbols stand for three of the level below, so after four levels a name stands for 81
bytes; recursion ends there, or as soon as names are distinct, since no comparison asks for more than ``depth`` bytes.
"""

from __future__ import annotations

import numpy as np


def _names(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """(order, names, number of names): rows sorted by columns, equal rows share a name from 1."""
    top = [int(c.max()) + 1 if len(c) else 1 for c in columns]
    packed, size = columns[0].astype(np.int64), top[0]
    keys = []
    for c, t in zip(columns[1:], top[1:], strict=True):
        if size * t < 1 << 62:
            packed, size = packed * t + c, size * t
        else:
            keys.append(packed)
            packed, size = c.astype(np.int64), t
    keys.append(packed)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(packed, kind="stable")
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return order, names, int(new.sum())


def ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Ranks from 1 of all suffixes of ``symbols`` (positive integers), equal where they agree in ``depth`` symbols.

    Suffixes that differ later may share a rank or not; shorter ones come before longer ones they begin.
    """
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    if depth <= 1 or n < 3:
        columns = [np.concatenate([symbols[k:], np.zeros(min(k, n), symbols.dtype)])[:n] for k in range(max(1, min(depth, n)))]
        return _names(columns)[1]
    padded = np.concatenate([symbols, np.zeros(3, symbols.dtype)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    covered = np.concatenate([one, two])
    _, names, count = _names([padded[covered], padded[covered + 1], padded[covered + 2]])
    if count < len(covered) and depth > 3:
        # the recursion's string: names at 1 mod 3, then a separator below all names, then those at 2 mod 3
        text = np.concatenate([names[: len(one)] + 1, np.ones(1, np.int64), names[len(one) :] + 1])
        deep = ranks(text, -(-depth // 3) + 1)
        names = np.concatenate([deep[: len(one)], deep[len(one) + 1 :]])
    rank = np.zeros(n + 3, np.int64)
    rank[covered] = names
    zero = np.arange(0, n, 3)
    # merge: a suffix is compared with one at 1 mod 3 by (symbol, rank), with one at 2 mod 3 by (symbol, symbol, rank)
    wide = int(rank.max()) + 1
    first = lambda at: padded[at].astype(np.int64) * wide + rank[at + 1]
    _, pair_names, _ = _names([np.concatenate([padded[zero], padded[two]]).astype(np.int64), np.concatenate([padded[zero + 1], padded[two + 1]]).astype(np.int64), np.concatenate([rank[zero + 2], rank[two + 2]])])
    zero_order = np.argsort(first(zero), kind="stable")
    sorted_zero = zero[zero_order]
    real_one = one[one < n]
    one_sorted = real_one[np.argsort(rank[real_one], kind="stable")]
    two_sorted = two[np.argsort(rank[two], kind="stable")]
    zero_key, one_key = first(sorted_zero), first(one_sorted)
    zero_deep, two_deep = pair_names[: len(zero)][zero_order], pair_names[len(zero) :][np.argsort(rank[two], kind="stable")]
    return _merged(n, rank, sorted_zero, one_sorted, two_sorted, zero_key, one_key, zero_deep, two_deep)


def _merged(n, rank, zero, one, two, zero_key, one_key, zero_deep, two_deep) -> np.ndarray:
    """Dense ranks of all suffixes from the three sorted lists; ties between lists stay ties."""
    covered = np.concatenate([one, two])
    covered = covered[np.argsort(rank[covered], kind="stable")]
    group = np.empty(len(covered), np.int64)
    values = rank[covered]
    if len(covered):
        group[0] = 0
        np.cumsum(values[1:] != values[:-1], out=group[1:])
    # a place for every suffix at 0 mod 3: how many covered suffixes are smaller, and whether one is equal
    low = np.searchsorted(one_key, zero_key, side="left") + np.searchsorted(two_deep, zero_deep, side="left")
    high = np.searchsorted(one_key, zero_key, side="right") + np.searchsorted(two_deep, zero_deep, side="right")
    equal = high > low
    # sort by (covered suffixes before, equal ones first to the class of the covered, then own key)
    before = np.where(equal, group[np.minimum(low, max(len(group) - 1, 0))] if len(group) else 0, -1)
    classes = group[-1] + 1 if len(group) else 0
    behind = np.where(low < len(group), group[np.minimum(low, max(len(group) - 1, 0))], classes) if len(group) else np.zeros(len(zero), np.int64)
    # covered class g sits at 2 g + 1; a suffix strictly between classes g - 1 and g sits at 2 g
    seat_zero = np.where(equal, 2 * before + 1, 2 * behind)
    seat = np.concatenate([seat_zero, 2 * group + 1])
    inner = np.concatenate([np.where(equal, 0, zero_key), np.zeros(len(covered), np.int64)])
    _, names, _ = _names([seat, _names([inner])[1]])
    out = np.zeros(n, np.int64)
    out[np.concatenate([zero, covered])] = names
    return out
