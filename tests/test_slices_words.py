import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from dataprobe.operators import slices, wordfix


def judged(spark, data):
    return spark.createDataFrame(data, "lang string, country string, err int")


def test_planted_slice_is_found_and_masked(spark):
    data = [("bengali", c, 1) for c in ("NL", "IN") * 10] + [("en", c, 0) for c in ("NL", "IN") * 40] + [("en", "NL", 1)]
    df = judged(spark, data)
    found = slices.slice_find(df, ["lang", "country"], "err")
    top = found.first()
    assert (top["lang"], top["lang_any"], top["country_any"], top["slice_rows"], top["slice_err"]) == ("bengali", False, True, 20, 20.0)
    marked = slices.slice_mask(df, found, ["lang", "country"])
    assert marked.filter("in_slice").count() == 20


def test_wildcard_first_feature(spark):
    data = [(f"l{i % 5}", "XX", 1) for i in range(25)] + [(f"l{i % 5}", "YY", 0) for i in range(75)]
    top = slices.slice_find(judged(spark, data), ["lang", "country"], "err").first()
    assert top["lang_any"] and top["country"] == "XX"


def test_null_value_is_not_a_wildcard(spark):
    data = [(None, "A", 1)] * 10 + [("en", "A", 0)] * 30
    df = judged(spark, data)
    found = slices.slice_find(df, ["lang", "country"], "err")
    top = found.first()
    assert top["lang"] is None and not top["lang_any"]
    assert slices.slice_mask(df, found, ["lang", "country"]).filter("in_slice").count() == 10


def test_no_error_no_slice(spark):
    df = judged(spark, [("en", "A", 0)] * 5)
    found = slices.slice_find(df, ["lang", "country"], "err")
    assert found.count() == 0
    assert slices.slice_mask(df, found, ["lang", "country"]).filter("in_slice").count() == 0


def all_slices(data, features, max_l, alpha, min_sup):
    """Every slice and its score, in the order of the report."""
    import itertools

    n, whole, out = len(data), sum(r[-1] for r in data), []
    for level in range(1, max_l + 1):
        for chosen in itertools.combinations(range(features), level):
            groups = {}
            for r in data:
                groups.setdefault(tuple(r[i] for i in chosen), []).append(r[-1])
            for values, errors in groups.items():
                size, error = len(errors), sum(errors)
                score = alpha * (n / size * error / whole - 1) - (1 - alpha) * (n / size - 1)
                if size >= min_sup and error > 0 and score > 0:
                    row = [(i not in chosen, "" if i not in chosen or values[chosen.index(i)] is None else values[chosen.index(i)]) for i in range(features)]
                    out.append((-round(score, 9), row, size, error))
    return sorted(out)


@pytest.mark.parametrize("k,min_sup", [(1, 1), (5, 20), (8, 60)])
def test_pruned_search_equals_all_slices(spark, k, min_sup):
    rng = random.Random(k)
    names = [f"f{i}" for i in range(10)]
    data = []
    for _ in range(1500):
        row = [rng.choice("abc") if i % 2 else rng.choice(["x", "y", None]) for i in range(10)]
        bad = row[1] == "a" and row[4] == "x" and row[7] == "b"
        data.append((*row, int(rng.random() < (0.9 if bad else 0.05))))
    df = spark.createDataFrame(data, ", ".join(f"{c} string" for c in names) + ", err int")
    found, counted = slices.slice_search(df, names, "err", k, 3, 0.95, min_sup)
    got = [(-round(r["score"], 9), [(r[f"{c}_any"], r[c] or "") for c in names], r["slice_rows"], r["slice_err"]) for r in found.collect()]
    assert got == all_slices(data, 10, 3, 0.95, min_sup)[:k]
    whole, every = slices.slice_search(df, names, "err", k, 3, 0.95, min_sup, prune=False)
    assert rows(whole) == rows(found)
    assert counted[0] == every[0] == 30 and counted[1] <= every[1] and counted[2] < every[2]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("max_dist", [1, 2])
def test_candidates_equal_brute_force(spark, max_dist):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    vocab = sorted({word(rng.choice([1, 2, 3, 5, 8, 14, 15, 16, 17, 18, 19, 24, 40])) for _ in range(260)})

    def damaged(w):
        w = list(w)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            kind = rng.choice("sid")
            if kind == "i":
                w.insert(at, rng.choice("abcé"))
            elif w and kind == "d":
                w.pop(min(at, len(w) - 1))
            elif w:
                w[min(at, len(w) - 1)] = rng.choice("abcé")
        return "".join(w)

    unknown = sorted({damaged(w) for w in vocab} - {""})
    v = spark.createDataFrame([(w, 1) for w in vocab], "token string, n long")
    u = spark.createDataFrame([(w,) for w in unknown], "token string")
    got = set(map(tuple, wordfix.spelling_candidates(u, v, max_dist).select("token", "candidate", "dist").distinct().collect()))
    assert got == {(a, b, distance(a, b)) for a in unknown for b in vocab if distance(a, b) <= max_dist}


def test_repair_prefers_near_then_frequent_then_first(spark):
    vocab = spark.createDataFrame([("north", 9), ("forth", 50), ("worth", 50), ("lost", 7), ("last", 7)], "token string, n long")
    texts = [(1, "nortg, LOST lost\n"), (2, "xorth zzzzzz"), (3, "lqst"), (4, ""), (5, None), (6, "...")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = dict(rows(wordfix.repair_text(df, "id", "text", vocab)))
    # 'nortg': north at 1 edit; 'xorth': three at 1 edit, forth before worth; 'lqst': last before lost
    assert got == {1: "north, LOST lost\n", 2: "forth zzzzzz", 3: "last", 4: "", 5: None, 6: "..."}


def test_translation_keeps_unknown_words_and_spacing(spark):
    lexicon = spark.createDataFrame([("bonjour", "hello"), ("monde", "world")], "token string, target string")
    df = spark.createDataFrame([(1, "bonjour,  le monde!"), (2, "rien")], "id long, text string")
    assert rows(wordfix.lexicon_translate(df, "id", "text", lexicon)) == [(1, "hello,  le world!"), (2, "rien")]


def test_vocab_counts(spark):
    df = spark.createDataFrame([("a b a",), ("a, b-c",), (None,)], "text string")
    assert rows(wordfix.vocab_counts(df, "text")) == [("a", 3), ("b", 2), ("c", 1)]
    assert rows(wordfix.vocab_counts(df, "text", 2)) == [("a", 3), ("b", 2)]
