"""Joining a stream of rows to a keyed table when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.draws import seeded_uniform

# At most this many keys can be called hot, whatever the data (each holds at least that share of the sample).
HOT_KEYS = 4096
SAMPLE_RATE = 1.0 / 64


def hot_keys(rows: DataFrame, key: str, pieces: int) -> DataFrame:
    """(key, copies) of the keys that hold at least 1/HOT_KEYS of ``rows``: no more than HOT_KEYS rows.

    ``copies`` is a key's share of ``pieces``, so all copies together are at most pieces + HOT_KEYS.  Give a
    sample: which keys are listed never changes a result, only how work is spread.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col(key).isNotNull())
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.col("_rows") / total
    return counts.filter(share * HOT_KEYS >= 1).select(key, F.ceil(share * pieces).cast("int").alias("_copies"))


def sampled(df: DataFrame, row_key: str) -> DataFrame:
    return df.filter(seeded_uniform(53, row_key) < SAMPLE_RATE)


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, row_key: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique ``key``), hot keys cut into pieces.

    Rows of a hot key are dealt over its copies by a hash of ``row_key``, and its table row is repeated once
    per copy.  Only the list of hot keys (see ``hot_keys``) is broadcast.
    """
    listed = F.broadcast(hot)
    dealt = rows.join(listed, key, "left").withColumn(
        "_piece", F.coalesce(F.pmod(F.xxhash64(*row_key), F.col("_copies")), F.lit(0)).cast("int")
    )
    copied = table.join(listed, key, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_copies"), F.lit(1)) - 1))
    )
    return dealt.drop("_copies").join(copied.drop("_copies"), [key, "_piece"], "left").drop("_piece")


# A membership filter has at most this many 64-bit slots (2 MB), whatever the number of keys: more keys only pass more often.
FILTER_SLOTS = 1 << 18
_HASHES = 3


def _bit(key: Column, i: int, slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(i), key), F.lit(slots * 64))


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def membership(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true for every key of the stored table ``keys`` and for few others (a Bloom filter).

    It is one bounded array, made by the cluster and used inside generated code, so rows without a match are dropped
    where they are read.
    """
    rows = keys.count()
    slots = 1
    while slots < FILTER_SLOTS and slots * 64 < 12 * rows:
        slots *= 2
    bits = keys.select(F.explode(F.array(*[_bit(F.col(key), i, slots) for i in range(_HASHES)])).alias("bit"))
    filled = bits.groupBy((F.col("bit") / 64).cast("long").alias("slot")).agg(F.bit_or(_one(F.col("bit"))).alias("bits"))
    every = keys.sparkSession.range(slots).withColumnRenamed("id", "slot").join(filled, "slot", "left")
    listed = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    shown = every.agg(F.transform(listed, lambda x: x["bits"]).alias("bits")).scalar()

    def may_hold(value: Column) -> Column:
        out = value.isNotNull()
        for i in range(_HASHES):
            bit = _bit(value, i, slots)
            out = out & (F.get(shown, (bit / 64).cast("int")).bitwiseAND(_one(bit)) != 0)
        return out

    return may_hold
