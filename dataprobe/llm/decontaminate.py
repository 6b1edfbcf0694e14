"""Benchmark decontamination: hashed n-gram windows of the test items are met by every window of the documents.

Built-in functions only.  Windows of the items are a table (length, hash, words, items).  As a counted, bounded
table it is broadcast and every document window is looked up where the document is read; a larger benchmark takes
a shuffled join.  A met hash is verified on the words themselves.  What is shuffled is one short row per document and
the hits.

Null and empty texts have no words and no hits; null and empty items have no window.  A row is known by id and
text: repeated rows are counted and returned as often as they came, null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.base import NON_WORD, ascii_lower, masked, split_words
from dataprobe.session import written

NGRAM = 10
# window tables up to this many rows (about 100 bytes each) are broadcast
BROADCAST_WINDOWS = 500_000
# documents of which a larger share is benchmark text are dropped, from others the passages are cut
DROP_SHARE = 0.5


def _hashes(words: Column, length: int) -> Column:
    """A hash of every window of ``length`` words."""
    count = F.size(words) - (length - 1)
    # read by position: inside a lambda, slice() copies the whole array each time
    every = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(length)]))
    return F.when(count > 0, every).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(length, hash, words, items): each distinct window and the items that contain it."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), split_words(ascii_lower(F.col(f"`{text}`")), NON_WORD).alias("w")).filter(F.size("w") > 0)
    sized = items.withColumn("length", F.least(F.size("w"), F.lit(ngram)))
    each = sized.select("item", "length", F.posexplode("w").alias("at", "_"), "w").filter(F.col("at") <= F.size("w") - F.col("length")).select("item", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("words"))
    grouped = each.groupBy("length", "words").agg(F.collect_set("item").alias("items"))
    return grouped.select("length", F.xxhash64(*[F.get("words", F.lit(k)) for k in range(ngram)]).alias("hash"), "words", "items")


def _covered(spans: Column) -> Column:
    """Positions inside any of the (at, length) spans, which may overlap."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["length"]
        more = F.greatest(end - F.greatest(s["at"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["total"] + more).alias("total"))

    return F.aggregate(F.array_sort(spans), start, add, lambda acc: acc["total"])


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(id, text_key, copies, n_words, spans, items): per distinct (id, text), the verified hits.

    ``spans`` holds (at, length) with word positions from 1, sorted and without repeats; ``items`` the item ids.
    """
    windows = written(item_windows(benchmark, ngram=ngram), "windows")
    rows = windows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``ngram`` rows
    lengths, total = sorted(r["length"] for r in rows), sum(r["n"] for r in rows)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), split_words(ascii_lower(F.col(f"`{text}`")), NON_WORD).alias("w"))
    hashed = [_hashes(F.col("w"), n) for n in lengths]
    # element 0 stands for the document itself, the windows of each length follow one after the other
    each = source.select("id", "text_key", "w", F.posexplode(F.concat(F.array(F.lit(None).cast("bigint")), *hashed)).alias("at", "hash"))
    at, before = F.col("at"), F.lit(0)
    length = skipped = F.when(at == 0, F.lit(None).cast("int"))
    for n in lengths:
        after = before + F.greatest(F.size("w") - (n - 1), F.lit(0))
        length, skipped, before = length.when(at <= after, n), skipped.when(at <= after, before), after
    placed = each.select("id", "text_key", "w", "hash", at.alias("element"), length.alias("length"), (at - skipped).alias("at"))
    listed = windows.select(F.col("hash").alias("item_hash"), F.col("length").alias("item_length"), F.col("words").alias("item_words"), "items")
    on = (F.col("hash") == F.col("item_hash")) & (F.col("length") == F.col("item_length"))
    if total <= BROADCAST_WINDOWS:
        met = placed.join(F.broadcast(listed), on, "left").withColumn("words", F.slice("w", F.coalesce("at", F.lit(1)), F.coalesce("length", F.lit(0))))
    else:
        # the words of a window travel instead of the document's
        slim = placed.select("id", "text_key", "hash", "element", "length", "at", F.when(F.col("element") == 0, F.array().cast("array<string>")).otherwise(F.slice("w", F.col("at"), F.col("length"))).alias("words"), F.when(F.col("element") == 0, F.size("w")).alias("size"))
        met = slim.hint("merge").join(listed, on, "left")
    size = F.size("w") if total <= BROADCAST_WINDOWS else F.col("size")
    hit = F.col("item_hash").isNotNull() & (F.col("words") == F.col("item_words"))
    kept = met.filter((F.col("element") == 0) | hit).select(
        "id", "text_key", F.when(F.col("element") == 0, size).alias("size"), F.when(hit, F.struct("at", "length")).alias("span"), F.when(hit, F.col("items")).alias("found"),
    )
    grouped = kept.groupBy("id", "text_key").agg(
        F.count("size").alias("copies"), F.max("size").cast("long").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("found").alias("found"),
    )
    return grouped.select("id", "text_key", "copies", "n_words", F.array_sort("spans").alias("spans"), F.array_distinct(F.flatten("found")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(id, n_words, n_hit, items, spans), one row per row of ``docs``."""
    found = hits(docs, benchmark, id_col, text, ngram).withColumn("n_hit", _covered(F.col("spans")).cast("long"))
    return found.select("id", "n_words", "n_hit", "items", "spans", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", ngram: int = NGRAM, drop_share: float = DROP_SHARE) -> DataFrame:
    """``docs`` without benchmark passages: cut out of the text, or with the document where they are most of it.

    A cut removes the words of the passage and what separates each from the next word.  Texts without a hit are
    returned as they are, null texts and repeated rows too; columns may have any names; an empty table gives an empty one.
    """
    columns = docs.columns
    docs, names = masked(docs)
    id_col, text = names[id_col], names[text]
    found = hits(docs, benchmark, id_col, text, ngram).filter(F.size("spans") > 0).withColumn("share", _covered(F.col("spans")) / F.col("n_words"))
    hit = written(found.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"), F.col("share").alias("_share")), "hits")
    own = F.col(f"`{text}`")
    pieces = F.regexp_extract_all(own, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(own, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    outside = F.filter(pieces, lambda p, i: ~F.exists("_spans", lambda s: (i + 1 >= s["at"]) & (i + 1 < s["at"] + s["length"])))
    cut = F.when(F.col("_share").isNull(), own).otherwise(F.concat(lead, F.array_join(outside, "")))
    marked = docs.withColumn("_text_key", F.xxhash64(own)).join(hit, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    return marked.filter(F.coalesce(F.col("_share") <= drop_share, F.lit(True))).select(*[(cut if names[c] == text else F.col(names[c])).alias(c) for c in columns])
