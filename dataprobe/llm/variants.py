"""Spelling variants by an index of variable-length grams.

Words within one edit of each other are found without comparing all of them:

* A dictionary of grams of ``Q_MIN`` to ``Q_MAX`` code points holds what extends a *frequent* gram, so that common
  character runs are told apart by longer grams and rare ones keep short grams.  Pruning by frequency bounds it:
  a gram that holds more than ``FREQUENT`` of all words has at most (mean word length / FREQUENT) fellows of its
  length, each extended by one code point.
* A word, between two end marks, is decomposed into grams: at each place the longest gram of the dictionary (else the
  shortest length), unless an earlier one covers it.
* An edit at a place can affect only some of a word's grams: those that cross it, those that the dictionary could
  stretch over it, those that a stretched one could cover.  The others stand in every word that the edit leads to.
  These bounds, taken for every place of a word, say which posting lists have to be merged: all lists of the
  unaffected grams, each at its distance from the end it lies at.  A merged list is named by the grams in it.
* Two words of a merged list are near at the place if what is left of them there is equal.  Lists are dealt over tasks
  by list, place and remainder, so a long list is no long group: a group holds the words that differ in one code point
  at one place (at most one a code point of the alphabet) and the word without it.  Names are hashes; the words of a
  pair are compared again before it counts.

A near pair meets exactly once: a replaced code point has one place, and a deleted one is taken at the last of equal
neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.base import ascii_lower
from dataprobe.session import written

LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT = 5, 3
Q_MIN, Q_MAX = 2, 4
# A gram in more than this share of the words is frequent: it is extended.
FREQUENT = 0.05
_START, _END = "\x01", "\x02"
_POSTINGS_PER_TASK = 150_000


def slipped_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word): every run of letters, A-Z lower-cased, one in 97 without one of its code points."""
    runs = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(LETTERS), F.lit(0))
    one = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("_doc"), F.explode(runs).alias("_run"))
    hashed = one.withColumn("_h", F.crc32(F.concat_ws(":", "_doc", "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    cut = F.concat(F.substr("_run", F.lit(1), at), F.substr("_run", at + 2))
    return hashed.select(F.when(F.col("_h") % 97 == 0, cut).otherwise(F.col("_run")).alias("word"))


def word_counts(runs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words long and frequent enough."""
    counts = runs.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= min_count)


class GramDictionary:
    """The grams that extend frequent ones, their prefixes, and the strings that lie inside them behind their start."""

    def __init__(self, grams: set[str], shortest: int = Q_MIN, longest: int = Q_MAX):
        self.grams, self.shortest, self.longest = grams, shortest, longest
        self.prefixes = {g[:k] for g in grams for k in range(1, len(g))}
        self.inner = {g[a:b] for g in grams for a in range(1, len(g)) for b in range(a + 1, len(g) + 1)}

    def decompose(self, s: str) -> list[tuple[int, str]]:
        """(place, gram) of a word with its end marks; places and ends both grow."""
        out, end, n = [], 0, len(s)
        for p in range(n - self.shortest + 1):
            q = min(self.longest, n - p)
            while q > self.shortest and s[p : p + q] not in self.grams:
                q -= 1
            if p + q > end:
                out.append((p, s[p : p + q]))
                end = p + q
        return out

    def unaffected(self, s: str, grams: list[tuple[int, str]], left: int, right: int) -> tuple[int, int]:
        """(a, b): grams[:a] and grams[b:] stand in every word that keeps s[:left] and s[right:] and differs between."""
        reach = left
        for p in range(max(0, left - self.longest + 1), left):
            if s[p:left] in self.prefixes:
                reach = p
                break
        a = 0
        while a < len(grams) and grams[a][0] < reach and grams[a][0] + len(grams[a][1]) <= left:
            a += 1
        b = a
        while b < len(grams):
            p, end = grams[b][0], grams[b][0] + len(grams[b][1])
            if p >= right and (end - right >= self.longest or s[right:end] not in self.inner):
                break
            b += 1
        return a, b

    def postings(self, word: str) -> Iterator[tuple[int, int, bool, bool]]:
        """(name, place, is a gap, may lose its code point) for every place where one edit can be.

        The name stands for the merged list of the unaffected grams, the place, and the remainder.
        """
        s = _START + word + _END
        n, grams = len(s), self.decompose(s)
        # unaffected grams are a head and a tail of the decomposition
        heads, tails = [""], [""]
        for p, t in grams:
            heads.append(f"{heads[-1]}{p}{t}")
        for p, t in reversed(grams):
            tails.append(f"{n - p}{t}{tails[-1]}")
        for place in range(1, n):
            for right in (place + 1, place) if place < n - 1 else (place,):
                a, b = self.unaffected(s, grams, place, right)
                name = f"{heads[a]}\x00{tails[len(grams) - b]}\x00{place}\x00{s[:place]}{s[right:]}"
                yield xxhash.xxh64_intdigest(name) - (1 << 63), place, right == place, s[place] != s[right] if right > place else False


def gram_dictionary(words: DataFrame, frequent: float = FREQUENT) -> set[str]:
    """The pruned dictionary, counted over all words: at most (mean length / frequent) * alphabet grams a length.

    ``words`` is a stored table (word, n).
    """
    total = words.count()
    s = F.concat(F.lit(_START), F.col("word"), F.lit(_END))
    at = F.explode(F.sequence(F.lit(1), F.length("_s") - Q_MIN + 1))
    sizes = F.explode(F.array(*[F.lit(q) for q in range(Q_MIN, Q_MAX + 1)]))
    places = words.select(s.alias("_s")).select("_s", at.alias("_p")).select("_s", "_p", sizes.alias("_q"))
    cut = places.filter(F.col("_p") + F.col("_q") - 1 <= F.length("_s")).select(F.substr("_s", F.col("_p"), F.col("_q")).alias("gram"))
    counted = written(cut.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")), "grams")
    common = counted.filter((F.col("rows") > frequent * total) & (F.length("gram") < Q_MAX)).select(F.col("gram").alias("_parent"))
    longer = counted.filter(F.length("gram") > Q_MIN).withColumn("_parent", F.expr("substr(gram, 1, length(gram) - 1)"))
    # a few hundred rows: the frequent grams
    return {r["gram"] for r in longer.join(F.broadcast(common), "_parent", "left_semi").select("gram").collect()}


def near_words(words: DataFrame, grams: set[str]) -> DataFrame:
    """(word, near, near_n): every ordered pair of words that differ by exactly one code point, once.

    ``words`` is (word, n) with unique words.
    """
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = GramDictionary(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                rows, names, places, gaps, drops = [], [], [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    for name, place, gap, drop in book.postings(word):
                        rows.append(i)
                        names.append(name)
                        places.append(place)
                        gaps.append(gap)
                        drops.append(drop)
                taken = part.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(places, pa.int32()), pa.array(gaps), pa.array(drops), taken.column(0), taken.column(1)], names=["name", "place", "gap", "drop", "word", "n"])

    listed = words.select("word", "n").mapInArrow(index, "name long, place int, gap boolean, drop boolean, word string, n long")
    members = F.collect_list(F.struct("word", "n", "gap", "drop", "place"))  # one a code point that can stand at the place, and one gap
    groups = listed.groupBy("name").agg(members.alias("m")).filter(F.size("m") > 1)
    one = groups.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b"))
    return one.filter(_differ(F.col("a"), F.col("b"))).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def _differ(a: Column, b: Column) -> Column:
    """Whether the members differ by one code point at their common place; a member's place counts the start mark."""
    without = lambda x: F.concat(F.substr(x["word"], F.lit(1), x["place"] - 1), F.substr(x["word"], x["place"] + 1))
    replaced = ~a["gap"] & ~b["gap"] & (a["word"] != b["word"]) & (without(a) == without(b))
    shorter = lambda x, y: x["gap"] & ~y["gap"] & y["drop"] & (x["word"] == without(y))
    return (a["place"] == b["place"]) & (replaced | shorter(a, b) | shorter(b, a))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms lead to, for every row of ``forms`` (word, form).

    A form counts at least twice its word, so ways are no longer than the logarithm of the largest count; each round
    doubles the step.
    """
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = state.join(after, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        joined = written(joined, "roots")
        state = joined.drop("_moved")
        if not joined.filter("_moved").limit(1).count():
            return state


def variant_groups(words: DataFrame, frequent: float = FREQUENT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``words`` (word, n).

    A word's form is its near word of largest count (ties: first in code-point order) if that is at least twice its
    own.  Repeated words count once, with their largest n; null words are left out; other columns are ignored; an
    empty table gives an empty one.
    """
    words = words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.max("n").cast("long").alias("n"))
    stored = written(words, "words")
    # as many tasks as postings need: about two for every code point of a word
    size = stored.agg(F.coalesce(F.sum(2 * F.length("word") + 3), F.lit(0))).first()[0]
    tasks = max(1, -(-size // _POSTINGS_PER_TASK))
    pairs = near_words(stored.repartition(tasks, "word"), gram_dictionary(stored, frequent))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("near")))
    found = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = stored.join(found, "word", "left")
    accepted = -F.col("best.rank") >= 2 * F.col("n")
    named = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(accepted, F.col("best.near")).alias("form"), F.when(accepted, -F.col("best.rank")).cast("long").alias("form_n"),
    )
    named = written(named, "forms")
    ends = roots(named.filter(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``variant_groups`` of the words of whole texts, after the slips of ``slipped_runs``.

    Null and empty texts have no words, a null id reads as empty, repeated rows count again, texts of any length are
    cut into runs in their own task, other columns are ignored.
    """
    return variant_groups(word_counts(slipped_runs(docs, doc_id, text)))
