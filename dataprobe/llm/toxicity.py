"""Toxic passages as maximum-scoring segments of token log-odds.

* **Token scores.**  How much likelier a token stands in a toxic text, as log-odds with Dirichlet priors in a chain:
  the prior of a word is what its first 5 code points say, theirs what the first 4 say, and so on up to the share of
  all tokens.  A word never seen so far thus scores as its stem does.  What is counted are different contexts (a word
  with both neighbours), so that a passage that is copied a thousand times counts once.  ``DRIFT`` is subtracted: a
  token counts for toxicity only if its odds are that much higher, and every other token counts against it.
* **Passages.**  One linear scan finds all maximal segments: those no extension or cut of which scores higher, and
  which lie in no higher one (Ruzzo and Tompa, ISMB 1999).  Tokens between two positive ones are one step.
* **Calibration.**  A segment of score S is met by chance in E = K n exp(-lambda S) places of a text of n words
  (Karlin and Altschul, PNAS 1990); lambda solves sum p(s) exp(lambda s) = 1 over the token scores of harmless texts, K
  makes the expected number of their segments the number counted.  A passage is significant if E < 1; a text's
  evidence is the sum of -ln E over its significant passages, and a two-parameter logistic curve over evidence gives its
  score.

Learning reads a bounded sample of the labelled rows; scoring reads every text whole, and shuffles nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.base import NON_WORD, ascii_lower, masked, split_words
from dataprobe.session import written

# The bound of the sample that is learned from: labelled rows, those of the smallest hashes.
SAMPLE_ROWS = 20_000
# Stems of so many code points stand between a word and the share of all tokens; each prior weighs as many contexts.
STEMS = (3, 4, 5)
PRIOR = 10.0
DRIFT = 1.5
_WORD = re.compile(NON_WORD.replace("[", "[^", 1))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MOST_EVIDENCE = 50.0


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id reads as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


@dataclass(frozen=True)
class ToxicModel:
    """Positive scores of words and stems (and 0 for words under such a stem that are harmless), and the calibration."""

    words: dict[str, float]
    stems: dict[str, float]
    rate: float = 1.0  # lambda
    places: float = 1.0  # K
    slope: float = 1.0
    level: float = 0.0

    def tokens(self, text: str) -> list[str]:
        return _WORD.findall(text.encode().translate(_LOWER).decode())

    def positive(self, tokens: list[str]) -> list[tuple[int, float]]:
        """(place, score) of the tokens that count for toxicity."""
        words, stems, out, known = self.words, self.stems, [], {}
        for i, w in enumerate(tokens):
            s = known.get(w)
            if s is None:
                s = words.get(w)
                for k in reversed(STEMS):
                    if s is None and len(w) > k:
                        s = stems.get(w[:k])
                s = known[w] = s or 0.0
            if s > 0:
                out.append((i, s))
        return out

    def evidence(self, found: list[tuple[int, int, float]], n_words: int) -> tuple[int, float]:
        """(significant passages, sum of their -ln E)."""
        each = [self.rate * s - math.log(self.places * n_words) for _, _, s in found]
        return sum(x > 0 for x in each), min(math.fsum(x for x in each if x > 0), _MOST_EVIDENCE)

    def score(self, evidence: float) -> float:
        return 1.0 / (1.0 + math.exp(-(self.slope * evidence + self.level)))


def maximal_segments(positive: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal segments of a sequence in which what is not listed scores ``-drift``."""
    kept: list[list] = []  # [sum before, sum after, first, last, index of the last one kept with a lower sum before]
    total, at = 0.0, 0
    for i, s in positive:
        total -= drift * (i - at)
        new = [total, total + s, i, i, -1]
        total, at = total + s, i + 1
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0]:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= new[1]:
                new[4] = j
                kept.append(new)
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, after - before) for before, after, a, b, _ in kept]


def _log_odds(p: Column, share: float) -> Column:
    return F.log(p / (1 - p)) - math.log(share / (1 - share))


def token_scores(texts: DataFrame, text: str = "text", label: str = "toxic") -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their scores where these, or the stem above, count for toxicity.

    ``texts`` is the stored sample.  What comes to the driver are positive words and stems and the exceptions below
    them, out of a sample of bounded rows.
    """
    w = split_words(ascii_lower(F.coalesce(F.col(text), F.lit(""))), NON_WORD)
    near = F.arrays_zip(
        F.col("_w").alias("w"), F.concat(F.array(F.lit("")), F.slice("_w", 1, F.size("_w") - 1)).alias("before"), F.slice("_w", 2, F.size("_w")).alias("after")
    )
    worded = texts.select(F.col(label).cast("int").alias("_y"), w.alias("_w")).filter(F.size("_w") > 0)
    each = worded.select("_y", F.inline(near)).select("_y", "w", F.xxhash64("before", "w", F.coalesce("after", F.lit(""))).alias("_c"))
    seen = each.groupBy("_y", "w", "_c").agg(F.lit(1).alias("_one"))
    toxic = lambda c: F.sum(F.when(F.col("_y") == 1, F.lit(1)).otherwise(0)).alias(c)
    words = written(seen.groupBy("w").agg(toxic("y"), F.count(F.lit(1)).alias("n")), "tokens")
    total = words.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = (total[0] + 1.0) / (total[1] + 2.0)
    # the chain of priors: p of a stem from its counts and the p of the shorter stem
    out, above = words, F.lit(share)
    stems = None
    for k in STEMS:
        stem = F.when(F.length("w") > k, F.substr("w", F.lit(1), F.lit(k)))
        counts = words.filter(F.length("w") > k).groupBy(stem.alias(f"s{k}")).agg(F.sum("y").alias(f"y{k}"), F.sum("n").alias(f"n{k}"))
        if stems is None:
            level = counts.withColumn(f"p{k}", (F.col(f"y{k}") + PRIOR * share) / (F.col(f"n{k}") + PRIOR)).select(f"s{k}", f"p{k}")
        else:
            last = STEMS[STEMS.index(k) - 1]
            level = counts.withColumn(f"s{last}", F.substr(f"s{k}", F.lit(1), F.lit(last))).join(stems, f"s{last}")
            level = level.withColumn(f"p{k}", (F.col(f"y{k}") + PRIOR * F.col(f"p{last}")) / (F.col(f"n{k}") + PRIOR))
            level = level.select(*[c for q in STEMS[: STEMS.index(k) + 1] for c in (f"s{q}", f"p{q}")])
        stems = written(level, f"stems{k}")
        if k == STEMS[0]:
            ways = {k: stems}
        else:
            ways[k] = stems
    score = lambda p: _log_odds(p, share) - DRIFT
    found: dict[str, float] = {}
    for k in STEMS:
        shown = score(F.col(f"p{k}"))
        shorter = [score(F.col(f"p{q}")) > 0 for q in STEMS if q < k]
        wanted = shown > 0
        for c in shorter:
            wanted = wanted | c
        found.update({r[0]: max(r[1], 0.0) for r in ways[k].filter(wanted).select(f"s{k}", shown).collect()})
    out = words
    for k in STEMS:
        out = out.withColumn(f"s{k}", F.when(F.length("w") > k, F.substr("w", F.lit(1), F.lit(k)))).join(ways[k].select(f"s{k}", f"p{k}"), f"s{k}", "left")
    prior = F.coalesce(*[F.col(f"p{k}") for k in reversed(STEMS)], above)
    shown = score((F.col("y") + PRIOR * prior) / (F.col("n") + PRIOR))
    wanted = (shown > 0) | (score(prior) > 0)
    return {r[0]: max(r[1], 0.0) for r in out.filter(wanted).select("w", shown).collect()}, found


def _scanned(texts: DataFrame, model: ToxicModel, text: str, label: str) -> DataFrame:
    """(toxic, n_words, tokens array<double>, segments array<double>) of the sample."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, scores, segments = [], [], []
            for t in batch.column(1).to_pylist():
                tokens = model.tokens(t or "")
                positive = model.positive(tokens)
                n_words.append(len(tokens))
                scores.append([s for _, s in positive])
                segments.append([s for _, _, s in maximal_segments(positive)])
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(scores, kind), pa.array(segments, kind)], names=["toxic", "n_words", "tokens", "segments"])

    return texts.select(F.col(label).cast("int").alias("toxic"), F.col(text)).mapInArrow(scan, "toxic int, n_words long, tokens array<double>, segments array<double>")


def _chance_rate(counts: dict[float, float]) -> float:
    """lambda > 0 with sum p(s) exp(lambda s) = 1; the mean score must be negative."""
    total = sum(counts.values())
    excess = lambda x: sum(n / total * math.exp(min(x * s, 700.0)) for s, n in counts.items()) - 1.0
    low, high = 0.0, 1e-3
    while excess(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve, with a slight pull towards 0 that keeps separated classes finite."""
    beta, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        pull = np.array([1e-2, 1e-4]) * weight.sum() / 100
        grad = design.T @ (weight * (y - p)) - pull * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(pull + 1e-9)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """A model from labelled rows that are not held out.

    At most ``sample_rows`` labelled ids are read, those of the smallest hashes; several labels of one id count as the
    highest.  Rows without a label and labels without a row say nothing; without any labelled row nothing is toxic.
    """
    known = labels.filter(~held_out(F.col(doc_id)) & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_toxic"))
    chosen = written(known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows), "labelled")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = written(texts.select("_text", "_toxic"), "sample")
    words, stems = token_scores(sample, "_text", "_toxic")
    seen = written(_scanned(sample, ToxicModel(words, stems), "_text", "_toxic"), "scanned")
    harmless = seen.filter(F.col("toxic") == 0)
    tokens = harmless.select(F.explode("tokens").alias("s")).groupBy(F.round("s", 1).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()
    sums = harmless.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("segments")), F.lit(0)).alias("k")).first()
    counts = {float(r["s"]): float(r["n"]) for r in tokens}
    top = max([*words.values(), *stems.values(), 1.0])
    counts[round(top, 1)] = counts.get(round(top, 1), 0.0) + 0.5  # what has not been met by chance yet may be
    counts[-DRIFT] = counts.get(-DRIFT, 0.0) + max(float(sums["n"]) - sum(counts.values()), 1.0)
    rate = _chance_rate(counts)
    # K: the segments counted in harmless texts are as many as expected at the scores they have at least
    places = (float(sums["k"]) + 1.0) / (float(sums["n"]) + 1.0)
    model = ToxicModel(words, stems, rate, places)
    shown = F.udf(lambda s, n: model.evidence([(0, 0, x) for x in s], n)[1] if n else 0.0, "double")
    binned = seen.groupBy(F.round(shown("segments", "n_words"), 1).alias("x"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    if not binned:
        return ToxicModel({}, {}, rate, places, 1.0, -5.0)
    x, y, n = (np.array([float(r[c]) for r in binned]) for c in ("x", "toxic", "n"))
    slope, level = _logistic(x, y, n)
    return ToxicModel(words, stems, rate, places, slope, level)


def toxic_passages(docs: DataFrame, model: ToxicModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), then n_words, passages (first word, last word, score, e_value), evidence, toxicity.

    One row per row, repeated ones too; null and empty texts have no words and the score of no evidence.  A text is the
    largest thing a task holds.  A kept column with the name of a result is replaced by the result.
    """
    own, names = masked(docs.select(*(keep if keep is not None else docs.columns), F.col(text).alias("_scored_text_")))
    source = names.pop("_scored_text_")
    model_at = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model_at.value
        for batch in batches:
            n_words, passages, evidence, scores = [], [], [], []
            for t in batch.column(batch.schema.get_field_index(source)):
                tokens = known.tokens(t.as_py() or "")
                n = len(tokens)
                found = maximal_segments(known.positive(tokens))
                e = known.evidence(found, n)[1] if n else 0.0
                rows = [{"first": a, "last": b, "score": s, "e_value": known.places * n * math.exp(-min(known.rate * s, 700.0))} for a, b, s in found]
                passages.append([r for r in rows if r["e_value"] < 1])
                n_words.append(n)
                evidence.append(e)
                scores.append(known.score(e))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names.values()]
            made = [pa.array(n_words, pa.int64()), pa.array(passages, passage), pa.array(evidence, pa.float64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*names.values(), "n_words", "passages", "evidence", "toxicity"])

    kinds = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names.values())
    made = ["n_words", "passages", "evidence", "toxicity"]
    schema = kinds + "n_words long, passages array<struct<first:long,last:long,score:double,e_value:double>>, evidence double, toxicity double"
    out = own.select(*names.values(), source).mapInArrow(scan, schema)
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in made], *made)
