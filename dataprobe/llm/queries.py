"""The operators as queries over their whole tables, each with the columns that its result is compared by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.llm import chains, chat, decontaminate, licenses, mixing, quality, repair, simhash, suffix_dedup, toxicity, urls, variants, warc
from dataprobe.llm.base import table
from dataprobe.session import scratch_path


def op1_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    ledger = quality.rule_ledger(table(spark, d, "documents").select("doc_id", "text"))
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.BASE).cast("long")) != 0
    return ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~quality.rejected()).alias("kept"), "failed_bits")


def op2_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = suffix_dedup.suffix_dedup(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")), keep=["doc_id", "n_bytes"])
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_chat_rotation(spark: SparkSession, d: str) -> DataFrame:
    return chat.rotate(table(spark, d, "conversations"))


def op5_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urls.judge(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, d, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, d, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_fuzzy_substrings(spark: SparkSession, d: str) -> DataFrame:
    return chains.document_passages(table(spark, d, "documents"))


def op9_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), keep=["doc_id", "source"])


def op10_licenses(spark: SparkSession, d: str) -> DataFrame:
    found = licenses.license_scan(table(spark, d, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op11_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    return variants.spelling_variants(table(spark, d, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_conversation_repair(spark: SparkSession, d: str) -> DataFrame:
    return repair.conversation_audits(repair.damaged(table(spark, d, "conversations")))


def op13_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, d, "labels").select("doc_id", "toxic"))
    found = toxicity.toxic_passages(docs, model, keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_suffix_dedup, op3_decontaminate, op4_chat_rotation, op5_url_filter, op6_simhash, op7_warc, op8_fuzzy_substrings, op9_mixing, op10_licenses,
              op11_spelling_variants, op12_conversation_repair, op13_toxicity)
}
