"""Texts to vectors, as corpus jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.schemas import require
from dataprobe.session import written


def token_bucket(token, dims: int) -> F.Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")


def bag_features(
    df: DataFrame, key: str, text: str, dims: int = 32, vector: str = "embedding", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(key, vector, kept columns): lower-cased words counted in ``dims`` hash buckets, scaled to length 1.

    Row by row, so nothing is shuffled: words are hashed in the JVM, the bucket numbers of a whole Arrow
    batch are counted at once.  A text without a word (or null) gets the zero vector.
    """
    require(df, "bag_features", key, text)
    tokens = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    buckets = F.coalesce(F.transform(tokens, lambda w: token_bucket(w, dims)), F.array().cast("array<int>"))
    narrow = df.select(F.col(key).cast("long").alias(key), buckets.alias(vector), *keep)
    passed = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.num_rows, batch.column(1)
            if not rows:
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            cells = np.repeat(np.arange(rows, dtype=np.int64), sizes) * dims + flat
            counts = np.bincount(cells, minlength=rows * dims).reshape(rows, dims).astype(np.float64)
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            scaled = counts / np.where(norms > 0, norms, 1.0)
            values = pa.array(scaled.ravel())
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * dims)
            columns = [batch.column(0), pa.ListArray.from_arrays(offsets, values), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=[key, vector, *keep])

    return narrow.mapInArrow(count, f"{key} long, {vector} array<double>{passed}")


# ---- weighted words: document frequencies as a table that edits update ---------------------------------------------


def _tokens(text: str) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")


def document_frequencies(df: DataFrame, text: str) -> DataFrame:
    """(token, docs): in how many texts each word stands; the row without a token counts the texts.

    A sum, so tables of parts add up to that of the whole (``merged_frequencies``).
    """
    require(df, "document_frequencies", text)
    each = df.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(_tokens(text)))).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


def merged_frequencies(known: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``known`` after texts with the frequencies ``added`` came and those with ``removed`` went; reads no text again."""
    parts = known.select("token", "docs")
    if added is not None:
        parts = parts.unionByName(added.select("token", "docs"))
    if removed is not None:
        parts = parts.unionByName(removed.select("token", (-F.col("docs")).alias("docs")))
    return parts.groupBy("token").agg(F.sum("docs").alias("docs")).filter(F.col("docs") != 0)


def weighted_words(df: DataFrame, key: str, text: str, frequencies: DataFrame) -> DataFrame:
    """(key, token, weight): count in the text times ln((1 + texts) / (1 + texts with the word)) + 1, scaled to length 1.

    Words the corpus does not have weigh as if in no text.  Texts without a word (or null) have no row.  Words are
    counted inside their row; a common word's rows meet its one frequency by a join that may be split where it is skewed.
    """
    require(df, "weighted_words", key, text)
    counted = df.select(key, _tokens(text).alias("_words")).select(key, F.explode("_words").alias("token"))
    counts = counted.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    total = frequencies.filter(F.col("token").isNull()).agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).scalar()
    seen = counts.join(frequencies.filter(F.col("token").isNotNull()), "token", "left")
    raw = F.col("n") * (F.log((1.0 + total) / (1.0 + F.coalesce("docs", F.lit(0)))) + 1.0)
    weighed = written(seen.select(key, "token", raw.alias("weight")), "weights")
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    return weighed.join(norms, key).select(key, "token", (F.col("weight") / F.col("_norm")).alias("weight"))
