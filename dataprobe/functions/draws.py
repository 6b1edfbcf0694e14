"""Random numbers that are a pure function of (seed, row key).

``rand()`` depends on the partition a row sits in, so a retried task or another partitioning gives
another answer.  These draws hash the row's own key: the same row always gets the same number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_32 = 4294967296.0


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def draw_digest(seed: int, *parts: Column) -> Column:
    """32 hex digits for one key; holds four independent 32-bit draws."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform_from_digest(digest: Column, slot: int = 0) -> Column:
    """Uniform double in [0, 1) from eight of the digest's hex digits (slot 0..3)."""
    if not 0 <= slot <= 3:
        raise ValueError("slot must be 0..3")
    return F.conv(F.substring(digest, 1 + 8 * slot, 8), 16, 10).cast("long") / F.lit(_TWO_32)


def digest_above(digest: Column, rate: float) -> Column:
    """``uniform_from_digest(digest) > rate``, read off the hex digits: these sort as the numbers do."""
    border = math.floor(rate * _TWO_32)
    if not 0 <= border < _TWO_32:
        return uniform_from_digest(digest) > rate
    return digest > f"{border:08x}" + "f" * 24


def seeded_uniform(seed: int, *parts, slot: int = 0) -> Column:
    """Uniform double in [0, 1) keyed by ``seed`` and the given columns."""
    return uniform_from_digest(draw_digest(seed, *[as_column(p) for p in parts]), slot)
