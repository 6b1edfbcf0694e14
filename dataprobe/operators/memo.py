"""Remembered results of an expensive text function, as a keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.functions.text import to_key
from dataprobe.operators.lookup import hot_keys, sampled, spread_lookup
from dataprobe.schemas import MEMO, require
from dataprobe.session import written


def empty_memo(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MEMO)


def cache_table_read(spark: SparkSession, path: str) -> DataFrame:
    """(input_hash, input, output, version) as written by ``cache_table_write``."""
    return spark.read.schema(MEMO).parquet(path)


def cache_table_write(memo: DataFrame, path: str) -> None:
    memo.select([f.name for f in MEMO.fields]).write.mode("append").parquet(path)


def memo_rows(pairs: DataFrame, version: int) -> DataFrame:
    """(input, output) rows in memo form."""
    return pairs.select(
        to_key("input").alias("input_hash"), "input", "output", F.lit(version).cast("long").alias("version")
    )


def latest_version(memo: DataFrame) -> DataFrame:
    """Per input the row of the highest version.

    ``max_by`` folds versions per task first, so an input written again and again never piles up in one.
    """
    columns = [f.name for f in MEMO.fields]
    newest = F.max_by(F.struct(*columns), F.struct("version", "output")).alias("row")
    return memo.groupBy("input_hash").agg(newest).select("row.*")


def cache_table_upsert(memo: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert or replace: ``fresh`` rows supersede stored rows of a lower version."""
    columns = [f.name for f in MEMO.fields]
    return latest_version(memo.select(columns).unionByName(fresh.select(columns)))


def cached_transform(
    df: DataFrame, row_key: str, text: str, memo: DataFrame, fn: Callable[[DataFrame], DataFrame], version: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(table with ``text`` replaced by fn's output, memo with the new entries).

    ``fn`` maps (input_hash, input) to (input_hash, output) and sees each missing distinct input once.  The memo may
    hold several versions of an input: the latest answers.  Which hashes are missing is asked before any text is
    moved; only texts of misses are, and they are written before ``fn`` and its result use them.
    """
    require(df, "cached_transform", row_key, text)
    memo = latest_version(memo)
    asked = df.withColumn("_hash", to_key(text))
    unknown = asked.select(F.col("_hash").alias("input_hash")).distinct().join(memo.select("input_hash"), "input_hash", "left_anti")
    texts = asked.select(F.col("_hash").alias("input_hash"), F.col(text).alias("input")).join(written(unknown, "unknown"), "input_hash", "left_semi")
    missing = written(texts.groupBy("input_hash").agg(F.first("input").alias("input")), "missing")
    outputs = fn(missing).select("input_hash", "output")
    fresh = missing.join(outputs, "input_hash").withColumn("version", F.lit(version).cast("long"))
    fresh = written(fresh.select([f.name for f in MEMO.fields]), "memo")
    updated = cache_table_upsert(memo, fresh)
    known = memo.join(fresh.select("input_hash"), "input_hash", "left_anti").select("input_hash", "output").unionByName(fresh.select("input_hash", "output"))
    answer = known.select(F.col("input_hash").alias("_hash"), "output")
    # One text may make up a third of all rows: its rows are dealt over several tasks.
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(sampled(asked, row_key).select("_hash"), "_hash", pieces)
    out = spread_lookup(asked, answer, "_hash", [row_key], hot).withColumn(text, F.col("output")).select(df.columns)
    return out, updated


def enrich_incremental(
    wanted: DataFrame, source: DataFrame, done: DataFrame, fn: Callable[[DataFrame], DataFrame], key: str, text: str
) -> DataFrame:
    """(key, before, after) for the wanted ids: earlier results are reused, only new ids go through ``fn``.

    ``done`` is (key, before, after) of an earlier round; ``fn`` maps (key, text) to (key, text).
    """
    require(done, "enrich_incremental", key, "before", "after")
    wanted = wanted.select(key).distinct()
    todo = wanted.join(done.select(key), key, "left_anti")
    inputs = source.select(key, text).join(todo, key, "left_semi")
    outputs = fn(inputs).select(key, F.col(text).alias("after"))
    fresh = inputs.select(key, F.col(text).alias("before")).join(outputs, key)
    reused = done.join(wanted, key, "left_semi").select(key, "before", "after")
    return fresh.unionByName(reused)


def first_round(wanted: DataFrame, source: DataFrame, fn: Callable[[DataFrame], DataFrame], key: str, text: str) -> DataFrame:
    """(key, before, after) with nothing to reuse."""
    inputs = source.select(key, text).join(wanted.select(key).distinct(), key, "left_semi")
    outputs = fn(inputs).select(key, F.col(text).alias("after"))
    return inputs.select(key, F.col(text).alias("before")).join(outputs, key)
