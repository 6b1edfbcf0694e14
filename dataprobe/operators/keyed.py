"""Row sets and row edits addressed by id; never by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.schemas import require


def gather_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose id is listed; each row once however often the id is listed."""
    require(df, "gather_rows", key)
    return df.join(require(ids, "gather_rows", key).select(key), key, "left_semi")


def drop_rows(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose id is not listed."""
    return df.join(require(ids, "drop_rows", key).select(key), key, "left_anti")


def patch_rows(base: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """Overwrite ``column`` for the ids in ``updates`` (one row per id); other rows keep their value.

    An update may carry null.  Ids the base does not hold are ignored.
    """
    require(base, "patch_rows", key, column)
    require(updates, "patch_rows", key, column)
    change = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    joined = base.join(change, key, "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).select(base.columns)


def flip_labels(df: DataFrame, ids: DataFrame, key: str, label: str) -> DataFrame:
    """Negate the label (0/1 or boolean) of the listed ids."""
    require(df, "flip_labels", key, label)
    boolean = df.schema[label].dataType.simpleString() == "boolean"
    flipped = ~F.col(label) if boolean else (F.lit(1) - F.col(label))
    hits = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    out = F.when(F.col("_hit"), flipped).otherwise(F.col(label)).cast(df.schema[label].dataType)
    return df.join(hits, key, "left").withColumn(label, out).select(df.columns)


def changed_rows(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of ``after`` whose value differs from ``before`` (nulls compare as values)."""
    old = before.select(key, F.col(column).alias("_before"))
    joined = after.join(old, key, "inner")
    return joined.filter(~F.col(column).eqNullSafe(F.col("_before"))).select(after.columns)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_ragged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack tables whose columns differ; a column one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def label_symdiff(df: DataFrame, old, new) -> DataFrame:
    """Rows on which two boolean columns disagree."""
    old = F.col(old) if isinstance(old, str) else old
    new = F.col(new) if isinstance(new, str) else new
    return df.filter(~old.eqNullSafe(new))


def equality_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct-row surplus on either side, and whether both tables hold the same rows.

    Counts every row value with a sign, so both directions share one shuffle and equal rows collapse
    before it.  Array columns compare as values; map columns are not supported.
    """
    columns = a.columns
    signed = a.withColumn("_sign", F.lit(1)).unionByName(b.select(columns).withColumn("_sign", F.lit(-1)))
    net = signed.groupBy(columns).agg(F.sum("_sign").alias("_net"))
    only_a = F.coalesce(F.sum(F.when(F.col("_net") > 0, F.col("_net"))), F.lit(0))
    only_b = F.coalesce(F.sum(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0))
    return net.agg(only_a.alias("only_left"), only_b.alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


def accuracy(df: DataFrame, prediction: str, truth: str, mask: Column | None = None) -> DataFrame:
    """Share of equal labels over all rows, and inside ``mask`` in the same pass when one is given."""
    same = (F.col(prediction) == F.col(truth)).cast("double")
    measures = [F.avg(same).alias("accuracy")]
    if mask is not None:
        measures.append(F.avg(F.when(mask, same)).alias("slice_accuracy"))
    return df.agg(*measures)
