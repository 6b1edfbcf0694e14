"""Text expressions: splitting, keyboard slips, per-character noise, word counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dataprobe.functions.draws import as_column, digest_above, draw_digest, uniform_from_digest

# Letters (with their combining marks) are words; everything between them is kept as is.
WORD_CLASS = r"[\p{L}\p{M}]"
PIECE_PATTERN = r"[\p{L}\p{M}]+[^\p{L}\p{M}]*|[^\p{L}\p{M}]+"

# Neighbouring keys, and the per-character error rates of each error kind.
KEY_SLIPS = (("n", "m"), ("b", "v"), ("t", "r"), ("o", "p"))
KIND_RATE = 0.3
SUBSTITUTE_RATE = 0.03
INSERT_RATE = 0.02
DELETE_RATE = 0.02
KIND_NAMES = ("keyboard", "substitute", "insert", "delete")


def split_chars(text) -> Column:
    return F.split(as_column(text), "")


def split_join_chars(text) -> Column:
    return F.array_join(split_chars(text), "")


def text_pieces(text) -> Column:
    """Words, each with the separator after it; joining them with '' gives the text back unchanged."""
    return F.regexp_extract_all(as_column(text), F.lit(PIECE_PATTERN), F.lit(0))


def words(text) -> Column:
    """Whitespace-separated tokens; a blank text has none."""
    trimmed = F.regexp_replace(as_column(text), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def word_count(text) -> Column:
    return F.size(words(text))


def to_key(value) -> Column:
    """Fixed-width join key for a value of any length."""
    return F.md5(as_column(value).cast("string"))


def keyboard_substitute(text) -> Column:
    source = "".join(a for a, _ in KEY_SLIPS)
    target = "".join(b for _, b in KEY_SLIPS)
    return F.translate(as_column(text), source, target)


def _random_letter(char: Column, digest: Column) -> Column:
    # 25 values on purpose: the last offset of the alphabet is never drawn.
    offset = F.floor(uniform_from_digest(digest, 1) * F.lit(25.0)).cast("int")
    return F.char(F.lit(65) + (F.abs(F.ascii(char)) + offset) % F.lit(26))


def char_substitute(text, seed: int, key, rate: float = SUBSTITUTE_RATE) -> Column:
    """Each character is replaced by a random upper-case letter with probability ``rate``."""
    key = as_column(key)

    def edit(c, i):
        digest = draw_digest(seed, key, F.lit("sub"), i)
        return F.when(uniform_from_digest(digest) < rate, _random_letter(c, digest)).otherwise(c)

    return F.array_join(F.transform(split_chars(text), edit), "")


def char_insert(text, seed: int, key, rate: float = INSERT_RATE) -> Column:
    """A random upper-case letter follows each character with probability ``rate``."""
    key = as_column(key)

    def edit(c, i):
        digest = draw_digest(seed, key, F.lit("ins"), i)
        return F.when(uniform_from_digest(digest) < rate, F.concat(c, _random_letter(c, digest))).otherwise(c)

    return F.array_join(F.transform(split_chars(text), edit), "")


def char_delete(text, seed: int, key, rate: float = DELETE_RATE) -> Column:
    """Each character is dropped with probability ``rate``; a text that loses everything becomes null."""
    key = as_column(key)
    kept = F.filter(split_chars(text), lambda c, i: digest_above(draw_digest(seed, key, F.lit("del"), i), rate))
    # through an array of one, so that the draws are made once
    return F.get(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, F.array_join(k, ""))), F.lit(0))


def noise_kind(seed: int, key) -> Column:
    """One of the four error kinds, with a fresh draw per branch (0.30 / 0.21 / 0.147 / 0.343)."""
    digest = draw_digest(seed, as_column(key), F.lit("kind"))
    choice = F.when(uniform_from_digest(digest, 0) < KIND_RATE, KIND_NAMES[0])
    choice = choice.when(uniform_from_digest(digest, 1) < KIND_RATE, KIND_NAMES[1])
    choice = choice.when(uniform_from_digest(digest, 2) < KIND_RATE, KIND_NAMES[2])
    return choice.otherwise(KIND_NAMES[3])


def apply_noise(text, kind, seed: int, key) -> Column:
    """Damage the text with the error kind named in ``kind``."""
    kind = as_column(kind)
    return (
        F.when(kind == KIND_NAMES[0], keyboard_substitute(text))
        .when(kind == KIND_NAMES[1], char_substitute(text, seed, key))
        .when(kind == KIND_NAMES[2], char_insert(text, seed, key))
        .otherwise(char_delete(text, seed, key))
    )
