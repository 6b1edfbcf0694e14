"""Keyed tables that are updated in place: partitioned by a hash of the key, one version seen at a time.

``<path>/data/v=<version>/part=<n>`` holds rows, ``<path>/pointer/n=<version>`` says which version of each part is
current.  A writer adds the parts it touched under a new version and then the pointer, one small file that appears at
once or not at all; a reader takes the newest pointer, or the one it is told, and sees that version whole.  One writer
at a time.  What old pointers name stays readable; nothing here deletes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = 64


def part_of(key: str, parts: int) -> Column:
    """The part of a key; null keys share one."""
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(parts)).cast("int")


def _pointers(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """(part, v) of a version: one row per part, so at most as many as there are parts."""
    every = spark.read.schema("part int, v bigint, n bigint").parquet(f"{path}/pointer")
    if version is None:
        version = every.agg(F.max("n")).first()[0]
    return every.filter(F.col("n") == F.lit(version))


def _commit(rows: DataFrame, pointers: DataFrame | None, path: str, version: int, parts: int, dealt: bool = False) -> None:
    """Write ``rows(part, ..)`` as a version and point their parts to it; other parts keep theirs."""
    spark = rows.sparkSession
    (rows if dealt else rows.repartition("part")).write.partitionBy("part").parquet(f"{path}/data/v={version}")
    new = spark.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(version).cast("long").alias("v"))
    if pointers is not None:
        # a part that was touched is there: an upsert never empties one
        touched = spark.read.schema("v bigint, part int").parquet(f"{path}/data").filter(F.col("v") == F.lit(version)).select("part").distinct()
        new = pointers.select("part", "v").join(touched, "part", "left_anti").unionByName(touched.withColumn("v", F.lit(version).cast("long")))
    new.coalesce(1).write.parquet(f"{path}/pointer/n={version}")


def create(df: DataFrame, path: str, key: str, parts: int = PARTS) -> int:
    """Store ``df`` as version 0; the number of parts is fixed from here on.  An empty table may be stored, too."""
    _commit(df.withColumn("part", part_of(key, parts)), None, path, 0, parts)
    return 0


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(n, parts, rewritten): every version with how many parts it has and how many were written for it."""
    every = spark.read.schema("part int, v bigint, n bigint").parquet(f"{path}/pointer")
    return every.groupBy("n").agg(F.count(F.lit(1)).alias("parts"), F.sum((F.col("v") == F.col("n")).cast("long")).alias("rewritten"))


def _rows(spark: SparkSession, path: str, pointers: DataFrame, schema: str) -> DataFrame:
    # dynamic partition pruning: v and part are folders, so only current ones of the asked parts are read
    data = spark.read.schema(f"{schema}, v bigint, part int").parquet(f"{path}/data")
    return data.join(F.broadcast(pointers.select("part", "v")), ["part", "v"]).drop("v")  # one row per part


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest.  ``schema`` as in ``spark.read.schema``."""
    return _rows(spark, path, _pointers(spark, path, version), schema).drop("part")


def upsert(fresh: DataFrame, path: str, key: str, schema: str) -> int:
    """Rows of ``fresh`` replace stored rows of the same key (null equals null); returns the new version.

    Only parts that hold a key of ``fresh`` are read and written.  Repeated keys in ``fresh`` are all stored.
    """
    spark = fresh.sparkSession
    pointers = _pointers(spark, path, None)
    parts, last = pointers.agg(F.count(F.lit(1)), F.max("n")).first()
    fresh = fresh.withColumn("part", part_of(key, parts))
    touched = pointers.join(fresh.select("part").distinct(), "part", "left_semi")
    old = _rows(spark, path, touched, schema)
    # one shuffle: a part's rows are together for the comparison and for the write
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))).repartition("part")
    newest = F.max("_new").over(Window.partitionBy("part", F.col(f"`{key}`")))
    _commit(both.withColumn("_top", newest).filter("_new = _top").drop("_new", "_top"), pointers, path, last + 1, parts, dealt=True)
    return last + 1


def compact(spark: SparkSession, path: str, schema: str) -> int:
    """The current rows as one new version: every part in the folder of one version again."""
    pointers = _pointers(spark, path, None)
    parts, last = pointers.agg(F.count(F.lit(1)), F.max("n")).first()
    _commit(_rows(spark, path, pointers, schema), None, path, last + 1, parts)
    return last + 1
