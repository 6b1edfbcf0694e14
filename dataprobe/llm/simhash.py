"""SimHash near-duplicates by anchor-point covering.

A fingerprint has two halves.  Two fingerprints that differ in at most 3 bits have a half that differs in at most
one bit.  The anchors of a half are the words of a covering code of radius 1: the perfect [31, 26] Hamming code on
31 bits, times the free 32nd bit.  Every half has exactly one anchor within the covering radius (its home) and 17
or 2 anchors within covering radius plus threshold; a fingerprint waits at its home and is replicated to all of
those, and per anchor replicas are compared with residents over all 64 bits.  So every linked pair meets.

Equal fingerprints are one row before anything is replicated: work follows distinct fingerprints, and a group of
copies, however large, is a single row with its smallest id.

Null and empty texts have no words: fingerprint zero, linked like any other.  A null id gets a component as any
document does but never names one, unless its whole component has none.  Repeated rows are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.base import BLANK, ascii_lower, masked, split_words
from dataprobe.llm.components import components
from dataprobe.session import written

SHINGLE = 3
MAX_BITS = 3
_PIECE = 1 << 18


def shingle_hashes(words: Column, shingle: int) -> Column:
    """XXH64 (seed 42) of every word shingle, repeats included; one shorter shingle where words are too few.

    ``words`` must be a column (an expression would be computed again for every shingle) and is read by position
    (inside a lambda, slice() copies the whole array each time).  Words behind the end are null and left out.
    """
    hashes = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0))),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(shingle)])),
    )
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(hashes)


def _fingerprints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Majority bits of ``values[offsets[i]:offsets[i + 1]]``; zero for empty ranges."""
    n = len(offsets) - 1
    votes = np.zeros((n, 64), np.int64)
    first = 0
    while first < n:  # pieces of rows whose bits fit into memory; one long row is summed in pieces itself
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _PIECE, side="right")) - 1)
        at = offsets[first : last + 1]
        for lo in range(int(at[0]), int(at[-1]), _PIECE):
            hi = min(lo + _PIECE, int(at[-1]))
            bits = np.unpackbits(values[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cut = np.clip(at, lo, hi) - lo
            full = np.flatnonzero(cut[1:] > cut[:-1])
            votes[first + full] += np.add.reduceat(bits, cut[full], axis=0, dtype=np.int64)
        first = last
    set_bits = (2 * votes > (offsets[1:] - offsets[:-1])[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (long).  Hashes are made by built-in functions, bits are counted by numpy."""
    keep = docs.columns if keep is None else keep
    cut = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], split_words(ascii_lower(F.col(f"`{text}`")), BLANK).alias("_words"))
    hashed = cut.select(*[f"_c{i}" for i in range(len(keep))], shingle_hashes(F.col("_words"), shingle).alias("_hashes"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("long").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            found = _fingerprints(lists.values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False), offsets)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(found)], names=keep + ["fingerprint"])

    return hashed.mapInArrow(run, schema)


# positions 1..31 label the bits of a half; a word's syndrome is the exclusive or of the labels of its set bits
_CHECKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]


def _syndrome(half: Column) -> Column:
    out = F.lit(0)
    for k, mask in enumerate(_CHECKS):
        out = out.bitwiseOR(F.shiftleft(F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).bitwiseAND(F.lit(1)), k))
    return out


def _bit(position: Column) -> Column:
    """The bit labelled ``position``; none for position zero."""
    return F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int"))).otherwise(F.lit(0).cast("long"))


def _half(k: int) -> Column:
    return F.shiftrightunsigned(F.col("fingerprint"), 32 * k).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _anchor(k: int, word: Column) -> Column:
    return word.bitwiseOR(F.lit(k << 32).cast("long"))


def residents(prints: DataFrame) -> DataFrame:
    """(anchor, fingerprint): each half at the one anchor within the covering radius."""
    return _decoded(prints).select(F.explode(F.array(_anchor(0, F.col("home0")), _anchor(1, F.col("home1")))).alias("anchor"), F.col("fingerprint").alias("x"))


def _decoded(prints: DataFrame) -> DataFrame:
    """Both halves with syndrome and home as columns, so that no expression is computed twice."""
    named = prints.select("fingerprint", *[_half(k).alias(f"half{k}") for k in (0, 1)])
    checked = named.select("*", *[_syndrome(F.col(f"half{k}")).alias(f"syndrome{k}") for k in (0, 1)])
    return checked.select("*", *[F.col(f"half{k}").bitwiseXOR(_bit(F.col(f"syndrome{k}"))).alias(f"home{k}") for k in (0, 1)])


def _around(k: int) -> Column:
    """The anchors of half ``k`` within covering radius plus one: home, home with the free bit turned, and the
    words of the code at distance two, one for each pair of labels whose exclusive or is the syndrome."""
    half, syndrome, home = F.col(f"half{k}"), F.col(f"syndrome{k}"), F.col(f"home{k}")
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (syndrome > 0) & (i < i.bitwiseXOR(syndrome)))
    apart = F.transform(pairs, lambda i: half.bitwiseXOR(_bit(i)).bitwiseXOR(_bit(i.bitwiseXOR(syndrome))))
    near = F.concat(F.array(home, home.bitwiseXOR(F.lit(1 << 31).cast("long"))), apart)
    return F.transform(near, lambda w: _anchor(k, w))


def replicas(prints: DataFrame) -> DataFrame:
    """(anchor, fingerprint): each half at every anchor within covering radius plus one."""
    return _decoded(prints).select(F.explode(F.concat(_around(0), _around(1))).alias("anchor"), F.col("fingerprint").alias("y"))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints that differ in at most ``max_bits`` (at most 3) bits."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("two halves and a threshold of one bit cover at most 3 differing bits")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    # replicas are many times the rows the planner expects: never broadcast
    met = residents(prints).hint("merge").join(replicas(prints), "anchor").filter((F.col("x") != F.col("y")) & (near <= max_bits))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the id), ``fingerprint`` (long) and ``component_id``, one row per document."""
    keep = [id_col] if keep is None else keep
    printed = written(fingerprints(docs, text, shingle, keep), "fingerprints")
    nodes = written(printed.groupBy("fingerprint").agg(F.min(f"`{id_col}`").alias("label")), "nodes")
    # a node without any id comes last: structs order nulls first, so the label carries a flag
    flagged = nodes.select(F.col("fingerprint").alias("node"), F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("id")).alias("label"))
    found = components(flagged, links(nodes.select("fingerprint"), max_bits))
    ids = written(found.select(F.col("node").alias("fingerprint"), F.col("label.id").alias("component_id")), "components")
    return printed.join(ids, "fingerprint").select(*[F.col(f"`{c}`") for c in keep], "fingerprint", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: that with the smallest id; rows without an id come last.

    Rows that share the smallest id, or have none, are told apart by a hash of the row.
    """
    own, names = masked(docs)
    # numbers are given once, as the rows are stored: they tell repeated rows apart
    printed = written(fingerprints(own, names[text], shingle, own.columns).withColumn("_row", F.monotonically_increasing_id()), "fingerprints")
    key = F.col(names[id_col])
    hashed = F.xxhash64(*[F.col(f.name) for f in own.schema.fields if "map<" not in f.dataType.simpleString()])
    first = F.min(F.struct(key.isNull().alias("none"), key.alias("id"), hashed.alias("hash"), F.col("_row").alias("row")))
    nodes = written(printed.groupBy("fingerprint").agg(first.alias("label")), "nodes")
    found = components(nodes.select(F.col("fingerprint").alias("node"), "label"), links(nodes.select("fingerprint"), max_bits))
    # one row per component: its first row lies in the fingerprint whose own label is the component's
    best = found.select(F.col("label.row").alias("_row")).distinct()
    return printed.join(best, "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in names.items()])


def hex16(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
