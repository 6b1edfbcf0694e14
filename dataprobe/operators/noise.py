"""Seeded text damage, to see how much a prediction depends on clean spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.text import apply_noise, noise_kind
from dataprobe.operators.keyed import patch_rows
from dataprobe.operators.ordering import sample_exact


def corrupted_sample(df: DataFrame, key: str, text: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """The drawn rows only: (key, before, kind, text).

    The per-character work sits in a generator, so that no later filter on the new text is pushed below
    the draw and no expression is evaluated twice.
    """
    picked = sample_exact(df.select(key, text), key, fraction, seed)
    kinds = picked.select(key, F.col(text).alias("before"), noise_kind(seed, key).alias("kind"))
    damaged = apply_noise("before", "kind", seed, key)
    return kinds.select(key, "before", "kind", F.explode(F.array(damaged)).alias(text))


def corrupt_text(df: DataFrame, key: str, text: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """The whole table with exactly floor(n * fraction) texts damaged; repeatable by (seed, key)."""
    return patch_rows(df, corrupted_sample(df, key, text, fraction, seed), key, text)


def corruption_diff(df: DataFrame, key: str, text: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, text) of the rows whose text really changed; old and new text meet in one row, so no join."""
    drawn = corrupted_sample(df, key, text, fraction, seed)
    return drawn.filter(~F.col(text).eqNullSafe(F.col("before"))).select(key, text)
