"""Ranks, neighbours and sums in the order of a group, for groups of any size.

A group that is small enough is one window.  Larger ones are cut into ranges of the order by Spark's range partitioner
(ties and repeated values are cut too, since the order ends with the row's id); a range is ranked and summed on its own,
and what lies before or after it in its group is carried as one number a range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dataprobe.session import written

ROWS_PER_RANGE = 250_000


def ranged(df: DataFrame, group: str, order: list[str], rows_per_range: int = ROWS_PER_RANGE, largest: int | None = None) -> DataFrame:
    """``df`` with ``_range``: rows of a group in ascending ranges of ``order``, each of about ``rows_per_range`` rows.

    Without a larger group nothing is cut, and there is no such column.
    ``largest`` is the size of the largest group, counted if it is not given.  ``df`` should be a stored table: it is
    read to count, to sample the cuts, and to deal the rows.
    """
    if largest is None:
        largest = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if largest <= rows_per_range:
        return df
    ranges = -(-df.count() // rows_per_range)
    return written(df.repartitionByRange(ranges, group, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def _parts(df: DataFrame, group: str) -> list[str]:
    return [group, "_range"] if "_range" in df.columns else [group]


def _beside(df: DataFrame, group: str, value: Column, name: str, of_ranges: Callable[[WindowSpec], Column]) -> DataFrame:
    """``name``: ``value`` of every range of a group (an aggregate), folded over the other ranges; null without ranges."""
    if "_range" not in df.columns:
        return df.withColumn(name, F.lit(None))
    each = df.groupBy(group, "_range").agg(value.alias("_value"))  # one row a range and group
    folded = each.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), of_ranges(Window.partitionBy(group).orderBy("_range")).alias(name))
    return df.join(folded, df[group].eqNullSafe(folded["_g"]) & (df["_range"] == folded["_r"])).drop("_g", "_r")


def with_rank(df: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """Rank from 1 in each group of a ``ranged`` table."""
    before = lambda w: F.sum("_value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = _beside(df, group, F.count(F.lit(1)), "_before", before)
    here = F.row_number().over(Window.partitionBy(*_parts(df, group)).orderBy(*order))
    return placed.withColumn(name, here + F.coalesce("_before", F.lit(0))).drop("_before")


def with_next(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """The value of the next row of the group; null on its last."""
    placed = _beside(df, group, F.min_by(value, F.struct(*order)), "_later", lambda w: F.lead("_value").over(w))
    w = Window.partitionBy(*_parts(df, group)).orderBy(*order)
    here = placed.withColumns({name: F.lead(value).over(w), "_last": F.lead(F.lit(True)).over(w).isNull()})
    return here.withColumn(name, F.when(F.col("_last"), F.col("_later")).otherwise(F.col(name))).drop("_last", "_later")


def with_suffix(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` (not null) from this row to the last one of the group.

    Inside a range it is the total less the running sum: both grow row by row.
    """
    after = lambda w: F.sum("_value").over(w.rowsBetween(1, Window.unboundedFollowing))
    placed = _beside(df, group, F.sum(value), "_after", after)
    whole = Window.partitionBy(*_parts(df, group))
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.sum(value).over(whole) - F.sum(value).over(running) + F.col(value)
    return placed.withColumn(name, here + F.coalesce("_after", F.lit(0))).drop("_after")
