"""A collection of texts with vectors, labels and free-form metadata, as one keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.operators.keyed import gather_rows
from dataprobe.schemas import require
from dataprobe.session import scratch_path


def vector_table_load(texts: DataFrame, vectors: DataFrame, key: str, text: str, vector: str, metadata: list[str]) -> DataFrame:
    """(id, text, embedding, metadata): texts and their vectors by id, chosen columns as a string map."""
    require(texts, "vector_table_load", key, text, *metadata)
    require(vectors, "vector_table_load", key, vector)
    entries = [x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]
    joined = texts.join(vectors.select(key, vector), key)
    return joined.select(
        F.col(key).cast("string").alias("id"),
        F.col(text).alias("text"),
        F.col(vector).alias("embedding"),
        F.create_map(*entries).alias("metadata"),
    )


def vector_table_get(collection: DataFrame, ids: DataFrame, include: list[str]) -> DataFrame:
    """The listed entries with the chosen fields; the id stays on the row, so order carries no meaning."""
    return gather_rows(collection, ids, "id").select("id", *include)


def vector_table_update(collection: DataFrame, updates: DataFrame) -> DataFrame:
    """A new table with the metadata keys of ``updates`` (id, metadata) overwritten; other keys survive.

    The input table is not touched: dropping the result is the way back from a what-if.
    """
    require(updates, "vector_table_update", "id", "metadata")
    change = updates.select("id", F.col("metadata").alias("_new"))
    kept = F.map_filter("metadata", lambda k, _: ~F.array_contains(F.map_keys("_new"), k))
    merged = F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(F.map_concat(kept, F.col("_new")))
    return collection.join(change, "id", "left").withColumn("metadata", merged).select(collection.columns)


def save_collection(collection: DataFrame, name: str = "collection") -> str:
    """Write to a path of its own; entries of an earlier run can never be met again."""
    path = scratch_path(collection.sparkSession, name)
    collection.write.parquet(path)
    return path
