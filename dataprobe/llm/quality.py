"""Quality rules: every rule is evaluated once and its outcome kept as a bit beside the measurements.

``rule_ledger`` is the expensive step and knows no policy.  A policy is a versioned set of bits; applying one, or
asking what each rule alone removes, reads only the ledger.

Null and empty texts have no words and measure zero; they fail ``few_words``.  Repeated rows are judged row by row.
No joins and no shuffles: columns of the input are kept as they are, a clash of names is an error of the caller
only for the ledger's own names (``LEDGER``), which replace input columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.llm.base import BLANKS, SpanHash, masked, mixed, slabs, text_bytes, windows, words_at

WINDOW = 8
_SLAB = 2 << 20
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts"]
LEDGER = [*MEASURES, "failed_bits"]

# rule name -> condition of failing; the position in this list is the rule's bit and never changes
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 24 * n_words)"),
    ("shouting", "100 * n_shouts > 60 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
# policy version -> bits that reject a document
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["word_length"],
    "v2": BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["word_length"] | BIT["shouting"],
}
CURRENT = "v2"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where a text has the same key more than once."""
    joint = keys ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(joint, kind="stable")
    ranked = joint[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def measure(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of the texts ``body[starts:ends]``."""
    n = len(starts)
    first, last, owner = words_at(body, starts, ends, BLANKS)
    spans = SpanHash(body)
    out = {"n_words": np.bincount(owner, minlength=n)}
    out["word_chars"] = _sums(BLANKS[body] & ((body & 0xC0) != 0x80), starts, ends)
    out["n_symbols"] = _sums(_IS_SYMBOL[body], starts, ends)
    cuts = np.zeros(len(first) + 1, np.int32)
    if len(first) >= WINDOW:
        key = windows(spans.of(first, last), WINDOW)
        at = np.flatnonzero(owner[: len(key)] == owner[WINDOW - 1 :])
        at = at[_repeats(key[at], owner[at])]
        np.add.at(cuts, at, 1)
        np.add.at(cuts, at + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(cuts[:-1]) > 0], minlength=n)
    breaks = np.flatnonzero(body == 0x0A)
    line_first = np.sort(np.concatenate([starts[ends > starts], breaks + 1]))
    line_first = np.unique(line_first[line_first < len(body)])
    line_last = np.append(line_first[1:], len(body))
    line_last = np.where((line_last > line_first) & (body[line_last - 1] == 0x0A), line_last - 1, line_last)
    some = np.flatnonzero(ends > starts)
    line_owner = some[np.searchsorted(starts[some], line_first, side="right") - 1] if len(some) else np.zeros(0, np.int64)
    if len(line_first):
        wordy = np.searchsorted(first, line_last) > np.searchsorted(first, line_first)
        line_first, line_last, line_owner = line_first[wordy], line_last[wordy], line_owner[wordy]
    key = spans.of(line_first, line_last) ^ mixed(line_owner.astype(np.uint64) + np.uint64(1))
    _, once = np.unique(key, return_index=True)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_owner[once], minlength=n)
    out["n_shouts"] = np.bincount(owner[(body[last - 1] == 0x21) & (last - first > 1)], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def rule_ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed_bits`` (bit i: rule i of RULES failed), one pass, no shuffle."""
    keep = [f for f in docs.schema.fields if f.name not in LEDGER]
    schema = T.StructType(keep + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, text, _SLAB):
            found = measure(*text_bytes(batch.column(batch.schema.get_field_index(text))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(f.name)) for f in keep] + [pa.array(found[m]) for m in MEASURES],
                names=[f.name for f in keep] + MEASURES,
            )

    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits + F.when(F.expr(fails), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long"))
    return docs.select(*[F.col(f"`{f.name}`") for f in keep]).mapInArrow(run, schema).withColumn("failed_bits", bits)


def rejected(policy: str = CURRENT) -> Column:
    """True where the ledger's bits meet the policy's."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) != 0


def ablations(ledger: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, only, kept_without): documents that fail a rule of the policy, those that fail nothing else
    of it, and how many would be kept without the rule.  Reads bit patterns, of which there are few, not documents.
    """
    mask = POLICIES[policy]
    patterns = ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("docs"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & mask])
    each = patterns.select("bits", "docs", F.explode(rules).alias("r"))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("docs"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("failed"),
        count(F.col("bits") == F.col("r.bit")).alias("only"),
        count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("kept_without"),
    )


def quality_filter(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The documents that the policy keeps, with their columns."""
    own, names = masked(docs)
    return rule_ledger(own, names[text]).filter(~rejected(policy)).select(*[F.col(n).alias(c) for c, n in names.items()])
