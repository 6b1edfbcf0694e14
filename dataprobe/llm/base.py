"""Shared pieces of the text operators: tables, tokenisers, numpy views of Arrow text, counted sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def masked(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with neutral column names and the names by the original ones, so that no result's name clashes."""
    names = {c: f"_own{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names  # by place: a column may itself have such a name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the faster built-in."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def split_words(text: Column, separators: str) -> Column:
    """The words between runs of ``separators``; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of a string or binary column without a copy per value; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    starts, ends = at[:-1] - at[0], at[1:] - at[0]
    if column.null_count:
        ends = np.where(column.is_null().to_numpy(zero_copy_only=False), starts, ends)
    return body, starts, ends


def slabs(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in groups of at most ``size`` bytes of text, or of one row that is longer."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        _, starts, ends = text_bytes(column)
        total, first = np.cumsum(ends - starts), 0
        while first < batch.num_rows:
            done = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, done + size, side="right")))
            yield batch.slice(first, last - first)
            first = last


def word_table(separators: bytes) -> np.ndarray:
    """table[byte] is True where the byte belongs to a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


BLANKS = word_table(bytes([0x20, *range(0x09, 0x0E)]))
MARKS = word_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def words_at(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, index of its text) of every word of the texts ``body[starts:ends]``."""
    inside = np.zeros(len(body) + 1, bool)
    inside[:-1] = is_word[body]
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    some = ends > starts
    begin[starts[some]] = inside[:-1][starts[some]]
    first = np.flatnonzero(begin)
    owner = np.flatnonzero(some)[np.searchsorted(starts[some], first, side="right") - 1] if some.any() else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    last = stop[np.searchsorted(stop, first, side="right")] if len(first) else first
    return first, np.minimum(last, ends[owner]), owner


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from one running sum."""

    def __init__(self, body: np.ndarray):
        n = len(body)
        power = np.full(n + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((mixed(body.astype(np.uint64) + np.uint64(1)) * power[:-1]), out=self.sums[1:])
        power[:] = _BACK
        power[0] = 1
        self.back = np.multiply.accumulate(power)

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        value = (self.sums[last] - self.sums[first]) * self.back[first]
        return mixed(value + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - width + 1, np.uint64)
    for i in range(width):
        out = out * _BASE + values[i : len(values) - width + 1 + i]
    return mixed(out)


def text_size(docs: DataFrame, text: str) -> int:
    """Bytes of text in the whole table: what bucket counts follow."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
