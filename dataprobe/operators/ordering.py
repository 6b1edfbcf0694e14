"""Ranks, exact samples and top-n without ever sorting a whole table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.functions.draws import seeded_uniform
from dataprobe.operators import scan
from dataprobe.schemas import require
from dataprobe.session import written

_SAMPLE_BUCKETS = 65536


def topk_smallest(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n rows with the lowest value, ties by key; partial top-n per task, merged once."""
    require(df, "topk_smallest", value, key)
    return df.orderBy(F.col(value).asc_nulls_last(), F.col(key).asc()).limit(n)


def sample_exact(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Exactly floor(n * fraction) rows: those with the smallest keyed draws.

    The draw range is cut into fixed buckets.  Counting them (at most 65536 numbers) tells in which bucket
    the last chosen row lies; ranking that one bucket gives its (draw, key).  Both passes read the key
    column only.  The sample itself is then a filter, without a shuffle.  ``key`` must be unique.
    """
    require(df, "sample_exact", key)
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    draw = seeded_uniform(seed, key)
    drawn = df.select(key, draw.alias("_draw")).withColumn("_bucket", F.floor(F.col("_draw") * _SAMPLE_BUCKETS))
    counts = drawn.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    # Windows over the bucket counts only: their number is fixed, whatever the size of the table.
    upto = F.sum("_rows").over(Window.orderBy("_bucket"))
    target = F.floor(F.sum("_rows").over(Window.partitionBy()) * F.lit(float(fraction)))
    placed = counts.select("_bucket", (upto - F.col("_rows")).alias("_before"), upto.alias("_upto"), target.alias("_target"))
    last = placed.filter((F.col("_before") < F.col("_target")) & (F.col("_target") <= F.col("_upto")))
    # One row: the bucket of the last chosen draw.
    border = F.broadcast(last.select("_bucket", (F.col("_target") - F.col("_before")).alias("_take")))
    nth = F.row_number().over(Window.partitionBy("_bucket").orderBy("_draw", key))
    cut = drawn.join(border, "_bucket").withColumn("_nth", nth).filter(F.col("_nth") == F.col("_take"))
    # No cut (nothing to choose) makes the comparison null and the sample empty.
    return df.filter(F.struct(draw.alias("_draw"), F.col(key)) <= cut.select(F.struct("_draw", key)).scalar())


def sample_bernoulli(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """About n * fraction rows by a keyed draw: a plain filter, no second pass."""
    return df.filter(seeded_uniform(seed, key) < float(fraction))


def assign_row_id(df: DataFrame, key: str, name: str = "row_id", rows_per_bucket: int = 100_000) -> DataFrame:
    """0..n-1 in the order of a unique, non-null key.

    Spark cuts the key range into partitions of about ``rows_per_bucket`` rows, which are written once; each range is
    ranked on its own and shifted by the number of rows in the ranges before it.  Any cuts give the same ids.
    """
    require(df, "assign_row_id", key)
    ranges = max(1, -(-df.count() // rows_per_bucket))
    ranged = written(df.repartitionByRange(ranges, key).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per range goes through this window
    offsets = sizes.select("_range", (F.sum("_rows").over(Window.orderBy("_range")) - F.col("_rows")).alias("_offset"))
    ranked = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(key)))
    return ranked.join(offsets, "_range").select(*df.columns, (F.col("_offset") + F.col("_nth") - 1).cast("long").alias(name))


def rank_by_distance(index: DataFrame, query: str, distance: str, row: str, rows_per_range: int = scan.ROWS_PER_RANGE, in_order: bool = False) -> DataFrame:
    """Rank rows per query by (distance, row id), starting at 1; the rows of one query may be any number.

    ``in_order``: the rows of a query follow each other in one task in this order and know their ``place``
    (``vectors.distances_in_order``), which is their rank; they stay as they are.
    """
    if in_order:
        return index.withColumnRenamed("place", "rank")
    order = [distance, row]
    return scan.with_rank(scan.ranged(written(index, "index"), query, order, rows_per_range), query, order).drop("_range")


def adjacent_diff(ranked: DataFrame, query: str, value: str, rows_per_range: int = scan.ROWS_PER_RANGE, later: str | None = None) -> DataFrame:
    """value[i] - value[i+1] in rank order; null on the last rank.

    ``later`` names the column that holds value[i+1] if rows know it (``vectors.distances_in_order`` tells them the next
    one); then no row moves.
    """
    if later is not None:
        return ranked.withColumn("diff", F.col(value) - F.col(later)).drop(later)
    cut = scan.ranged(written(ranked, "ranked"), query, ["rank"], rows_per_range)
    return scan.with_next(cut, query, ["rank"], value, "_next").withColumn("diff", F.col(value) - F.col("_next")).drop("_next", "_range")


def sum_after(value: str, partition: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the rows after this one.

    Total minus running sum: both frames grow row by row, while a frame that ends at the last row is added
    up anew for every row and costs the square of the group.
    """
    whole = Window.partitionBy(*partition)
    running = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(value).over(whole) - F.sum(value).over(running)


def suffix_sum(ranked: DataFrame, query: str, value: str, rows_per_range: int = scan.ROWS_PER_RANGE) -> DataFrame:
    """Sum of ``value`` (not null) from this rank to the last one."""
    cut = scan.ranged(written(ranked, "ranked"), query, ["rank"], rows_per_range)
    return scan.with_suffix(cut, query, ["rank"], value, "suffix").drop("_range")


def ordered_string_agg(df: DataFrame, group: str, order: str, value: str, name: str = "text", rows_per_range: int = scan.ROWS_PER_RANGE) -> DataFrame:
    """(group, name): the strings of each group joined in their order.

    A group of any size: large ones are joined range by range, then the ranges' strings.  Null strings are left out;
    rows of equal order are taken by value; a group of nulls alone gives an empty string.
    """
    require(df, "ordered_string_agg", group, order, value)
    joined = lambda what, by: F.coalesce(F.expr(f"listagg({what}, '') within group (order by {by})"), F.lit(""))
    narrow = df.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col(value).cast("string").alias("_value"))
    cut = scan.ranged(written(narrow, "strings"), "_group", ["_order", "_value"], rows_per_range)
    if "_range" not in cut.columns:
        return cut.groupBy(F.col("_group").alias(group)).agg(joined("_value", "_order, _value").alias(name))
    pieces = cut.groupBy("_group", "_range").agg(joined("_value", "_order, _value").alias("_piece"))
    return pieces.groupBy(F.col("_group").alias(group)).agg(joined("_piece", "_range").alias(name))
