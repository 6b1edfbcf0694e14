"""Spelling variants, conversation repair and toxic passages against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from dataprobe.llm import queries, repair, toxicity, variants

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


# ---- 11 -----------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def words_of(rng, count, alphabet="abcé", most=9):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most))) for _ in range(count)]


@pytest.mark.parametrize("frequent", [0.5, 0.05, 0.001])
def test_variants_are_all_near_words(spark, frequent):
    rng = random.Random(11)
    counts = {w: rng.randrange(1, 40) for w in words_of(rng, 260)}
    counts.update({"aaaa": 9, "aaa": 9, "aaaaa": 4, "": 3, "\U0001f600\U0001f600a": 5, "\U0001f600a": 50, "x" * 400: 3, "x" * 401: 7})
    df = spark.createDataFrame([*counts.items(), ("aaaa", 2), (None, 5)], "word string, n long").withColumn("near", F.lit("mine"))
    got = {r["word"]: r for r in variants.variant_groups(df, frequent).collect()}
    assert set(got) == set(counts)
    forms = {}
    for w, n in counts.items():
        others = [v for v in counts if v != w and near(v, w)]
        best = min(((-counts[v], v) for v in others), default=(0, None))
        forms[w] = best[1] if -best[0] >= 2 * n else None
        assert (got[w]["n"], got[w]["n_near"], got[w]["form"], got[w]["form_n"]) == (n, len(others), forms[w], counts.get(forms[w]) if forms[w] is not None else None), w
    for w in counts:
        root = w
        while forms[root] is not None:
            root = forms[root]
        assert got[w]["root"] == root


def test_unaffected_grams_stand_in_every_neighbour():
    rng = random.Random(3)
    words = words_of(rng, 400, "ab")
    grams = {w[i : i + q] for w in words[:40] for q in (3, 4) for i in range(len(w) - q + 1)}
    book = variants.GramDictionary(grams)
    for w in words:
        s = "\x01" + w + "\x02"
        for place in range(1, len(s) - 1):
            for edited in (s[:place] + s[place + 1 :], s[:place] + "b" + s[place + 1 :], s[:place] + "a" + s[place:]):
                right = place if len(edited) > len(s) else place + 1
                a, b = book.unaffected(s, book.decompose(s), place, right)
                there, shift = book.decompose(edited), len(edited) - len(s)
                assert set(book.decompose(s)[:a]) <= set(there)
                assert {(p + shift, t) for p, t in book.decompose(s)[b:]} <= set(there)


def test_slipped_runs(spark):
    import zlib

    texts = [(1, "Grün÷GRÜN the Straße_x"), (2, None), (3, ""), (None, "word word"), (4, "longword " * 300)]
    want = []
    for i, t in texts:
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c < "\x80" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                want.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run)
                run = ""
    got = [r[0] for r in variants.slipped_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want)
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# ---- 12 -----------------------------------------------------------------------------------------------------------


def cheapest(rows):
    """(cost, edits, repaired) by complete strings for every state."""
    state = {0: (0, "", ())}

    def take(into, s, value):
        into[s] = min(into.get(s, value), value)

    def inserted(state):
        out = dict(state)
        for _ in range(3):
            for s, (cost, edits, told) in list(out.items()):
                take(out, NEXT[s], (cost + 5, edits + "I", told + (("user" if NEXT[s] == 2 else "assistant", ""),)))
        return out

    for role, text, must_go, truncated in rows:
        after = {}
        for s, (cost, edits, told) in inserted(state).items():
            take(after, s, (cost + 2, edits + "D", told))
            if not must_go:
                late = 5 * truncated
                take(after, NEXT[s], (cost + 1 + late, edits + "R", told + (("user" if NEXT[s] == 2 else "assistant", text),)))
                if (s, role[:1]) in KEPT:
                    take(after, KEPT[s, role[:1]], (cost + late, edits + "K", told + ((role, text),)))
        state = after
    return min(v for s, v in inserted(state).items() if s in (0, 3))


@pytest.mark.parametrize("seed", range(12))
def test_survivors(seed):
    rng = random.Random(seed)
    gone, late = rng.choice([(0.1, 0.1), (0.4, 0.3), (0.9, 0.05), (0.0, 0.9), (0.0, 0.0)])
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "tool", "u", ""]), f"t{i}", rng.random() < gone, rng.random() < late) for i in range(rng.randrange(30))]
        search = repair.Survivors()
        for r in rows:
            search.add(*r)
        cost = search.finish()
        letters, out = search.emitted()
        assert (cost, letters.decode(), tuple(out)) == cheapest(rows), rows


def test_survivors_hold_little():
    rng, search, most = random.Random(1), repair.Survivors(), 0
    for i in range(20000):
        search.add("user" if i % 2 == 0 else "assistant", "x", rng.random() < 0.05, rng.random() < 0.05)
        search.emitted()
        most = max(most, search.undecided())
    assert most < 100


def test_conversations(spark):
    import hashlib

    rng = random.Random(7)
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 12)):
            turn = rng.choice([turn, turn, turn, None, 3])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None, ""]), rng.choice(["Yes.", "No!", "well", "", " \t", None, "é?\n", "x" * 50 + "."])))
    rows += rows[:15]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mark", F.lit("mine")).withColumn("dropped", F.lit(True))
    hurt = repair.damaged(df)
    groups = {c: [] for c, *_ in rows}
    for r in hurt.collect():
        if not r["dropped"]:
            groups[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"], r["text"]))
    turns = {}
    for r in repair.repaired_turns(hurt).orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = {r["conv_id"]: r for r in repair.conversation_audits(hurt).collect()}
    assert set(got) == set(groups)
    for conv, found in groups.items():
        found.sort()
        seen, faults, marked = set(), [0, 0, 0], []
        for _, _, role, text in found:
            kind = 0 if not text.strip(" \t\n\x0b\x0c\r") else 1 if (role, text) in seen else 2 if text.strip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else None
            seen.add((role, text))
            if kind is not None:
                faults[kind] += 1
            marked.append((role, text, kind in (0, 1), kind == 2))
        cost, edits, told = cheapest(marked)
        initials = [r[:1] for _, _, r, _ in found]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [t for k, t, _, _ in found if k]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest()
        assert tuple(got[conv])[1:] == (gaps, *faults, illegal, cost, edits, digest), conv
        assert tuple(turns.get(conv, [])) == told
    empty = df.limit(0)
    assert repair.conversation_audits(repair.damaged(empty)).count() == 0


def test_a_long_conversation(spark):
    """One conversation with most rows, the same content again and again."""
    rows = spark.range(30000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("say "), (F.col("id") % 5000).cast("string"), F.lit(".")).alias("text"))
    (r,) = repair.conversation_audits(rows.withColumn("dropped", F.lit(False))).collect()
    assert r["duplicate"] == 25000 and r["cost"] == 50000 and r["audit"] == "K" * 5000 + "D" * 25000


# ---- 13 -----------------------------------------------------------------------------------------------------------


def segments_by_brute_force(scores):
    """Maximal segments: no part and no extension within the rest scores higher; found by taking the best again and again."""
    found = []

    def cut(lo, hi):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0, 0))
        if best[0] > 1e-9:
            _, _, i, j = best
            found.append((i, j - 1, best[0]))
            cut(lo, i)
            cut(j, hi)

    cut(0, len(scores))
    return sorted(found)


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.choice([-1.5, -1.5, -1.5, 0.7, 2.3, 4.1, 5.9]) + rng.random() * 1e-3 for _ in range(rng.randrange(25))]
        scores = [s if s > 0 else -1.5 for s in scores]
        got = toxicity.maximal_segments([(i, s) for i, s in enumerate(scores) if s > 0], 1.5)
        want = segments_by_brute_force(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want], scores
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(4)
    plain = [f"wort{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        words, toxic = [rng.choice(plain) for _ in range(rng.randrange(5, 80))], i % 5 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [f"nasty{rng.randrange(60)}", "vile" + rng.choice("abc")]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, None), (1000, ""), (1001, "!!! ..."), (1002, "nasty999 " * 3 + "wort1 " * 20000), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("mine")).withColumn("toxicity", F.lit("mine")).withColumn("other", F.lit("mine"))
    return docs, spark.createDataFrame([*labels, (1, 0), (7777, 1), (5, None)], "doc_id long, toxic int")


def test_toxic_passages(insults):
    docs, labels = insults
    model = toxicity.learn(docs, labels)
    out = toxicity.toxic_passages(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["toxicity"] <= 1 and r["other"] == "mine" for r in out)
    known = {r[0]: r[1] for r in labels.filter("toxic is not null").collect()}
    judged = [(known[r["doc_id"]], r["toxicity"] >= 0.5) for r in out if r["doc_id"] in known and r["doc_id"] != 0]
    assert sum(a == b for a, b in judged) >= 0.98 * len(judged)
    for r in out:
        words = (r["text"] or "").split()
        for p in r["passages"]:
            assert any(w.startswith(("nasty", "vile")) for w in words[p["first"] : p["last"] + 1]) and p["e_value"] < 1
    by_id = {r["doc_id"]: r["toxicity"] for r in out}
    assert by_id[None] < 0.5 and by_id[1000] < 0.5 and by_id[1001] < 0.5 and by_id[1002] > 0.5  # never seen, but its stem was
    assert model == toxicity.learn(docs.repartition(7), labels)


def test_without_labels_nothing_is_toxic(insults):
    docs, labels = insults
    model = toxicity.learn(docs, labels.limit(0))
    assert all(r["toxicity"] < 0.5 for r in toxicity.toxic_passages(docs, model).collect())
    assert toxicity.toxic_passages(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark, folder):
    found = {r["doc_id"]: r for r in queries.op13_toxicity(spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r["doc_id"] in found]
    right = [found[r["doc_id"]]["predicted"] == r["toxic"] for r in labels if found[r["doc_id"]]["held_out"]]
    assert sum(right) >= 0.9 * len(right)


# ---- columns with the names of what operators make -----------------------------------------------------------------


@pytest.mark.parametrize("name", ["_id", "_key", "_share", "_spans", "_text_key", "_slot", "_source", "_bucket", "_rank", "_draw", "_turn", "_s", "_b", "_own1", "share", "hash"])
def test_clashing_columns(spark, folder, name):
    from dataprobe.llm import decontaminate, mixing

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    more = docs.withColumn(name, F.concat(F.lit("mine "), "doc_id"))
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    for run in (lambda d: decontaminate.decontaminate(d, benchmark), mixing.mix):
        plain, clash = run(docs), run(more)
        assert set(clash.columns) == {*plain.columns, name}
        assert {r["doc_id"]: r[name] for r in clash.collect()} == {r["doc_id"]: f"mine {r['doc_id']}" for r in plain.collect()}
        assert sorted(map(str, clash.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
