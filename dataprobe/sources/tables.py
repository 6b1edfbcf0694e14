"""Parquet and CSV tables, literal records, and run ledgers from CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.schemas import ledger_schema

# The name of a run ledger, <experiment>_<scenario>_<variant>_<opt>.csv (a file or a folder of parts)
_LEDGER_NAME = r"([^/_=]+)_([^/_]+)_([^/_]+)_([^/]+)\.csv(?:/[^/]*)?$"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, spread_by: str | None = None) -> DataFrame:
    """A Parquet table.

    ``spread_by`` redistributes rows by a key, but only when the scan has fewer tasks than the session has
    cores: a small file with heavy per-row work behind it.  A large table is left where it is.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by is not None and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores, spread_by)
    return table


def sink_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def records_to_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def scan_run_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Ledger files with the configuration taken from their names; an empty field is null."""
    rows = spark.read.schema(ledger_schema(tuple(columns))).option("header", True).csv(path)
    tagged = rows.withColumn("_file", F.col("_metadata.file_path"))
    part = lambda i: F.regexp_extract("_file", _LEDGER_NAME, i)
    return tagged.select(
        part(1).alias("experiment"), part(2).alias("scenario"), part(3).alias("variant"), part(4).alias("opt"), *columns
    )
