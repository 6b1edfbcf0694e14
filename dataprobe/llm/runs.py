"""Content-defined runs of fixed-length byte strings.

Every ``LENGTH``-byte string of a text is named by the smallest hash among the ``GRAM``-byte strings inside it
(winnowing).  Equal strings have equal names, so a string that occurs twice has a name that occurs twice: names
that do not repeat rule a string out without a comparison.  Neighbouring strings mostly share a name, and a text
is kept as runs (name, first start, number of starts), about one run for every 14 bytes.
"""

from __future__ import annotations

import numpy as np

LENGTH = 50
GRAM = 24
_SPAN = LENGTH - GRAM + 1
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 24-byte string of ``data`` (uint8)."""
    cur, width, factor, half = data.astype(np.uint64) + np.uint64(1), 1, _BASE, None
    while width < 16:
        if width == 8:
            half = cur
        cur = cur[:-width] * np.uint64(factor) + cur[width:]
        width, factor = width * 2, factor * factor & _MASK
    eight = pow(_BASE, 8, 1 << 64)
    out = cur[: len(data) - GRAM + 1] * np.uint64(eight) + half[16 : 16 + len(data) - GRAM + 1]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start in ``data``, starts in the run, index of its text) of the texts ``data[starts:ends]``.

    Texts lie one after the other in ``data``; no string crosses two of them, shorter texts have no run.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none
    low = gram_hashes(data)
    for step in (1, 2, 4, 8, _SPAN - 16):
        low = np.minimum(low[:-step], low[step:])
    count = np.maximum(ends - starts - LENGTH + 1, 0)
    at = np.flatnonzero(count)
    if not len(at):
        return none
    begin = starts[at]
    # +1 where the valid starts of a text begin, -1 where they end
    edge = np.zeros(len(low) + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + count[at], -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[begin] = True
    new &= valid
    first = np.flatnonzero(new)
    owner = at[np.searchsorted(begin, first, side="right") - 1]
    last = np.append(first[1:], len(low))
    size = np.minimum(last, starts[owner] + count[owner]) - first
    return low[first], first, size, owner
