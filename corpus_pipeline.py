"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup, decontamination, mixing.

Each stage reads what its predecessor wrote.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.llm.base import masked, table
from dataprobe.llm.decontaminate import decontaminate
from dataprobe.llm.mixing import mix
from dataprobe.llm.quality import quality_filter
from dataprobe.llm.simhash import simhash_dedup
from dataprobe.llm.suffix_dedup import suffix_dedup
from dataprobe.session import scratch_path


def _retold(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars`` counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that with the smallest id."""
    return simhash_dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes that repeat an earlier document; documents of which nothing is left go.

    A cut may fall inside a character: what it leaves of that character is left out.
    """
    own, names = masked(docs)
    found = suffix_dedup(own, names["doc_id"], names["text"], keep=own.columns, characters=True).filter(F.col("removed").isNull() | (F.octet_length("kept") > 0))
    text = F.when(F.col("removed").isNull(), F.col(names["text"])).otherwise(F.col("kept").cast("string"))
    return _retold(found.select(*[text.alias(c) if c == "text" else F.col(n).alias(c) for c, n in names.items()]), docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly benchmark go."""
    return _retold(decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their time in the mixture."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_free),
    ("source_mixing", mixed_sources),
]

# suffix arrays and components are not SQL; tests/llm compares run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
