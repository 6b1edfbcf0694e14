"""The whole pipeline against its stages in plain Python, on rows whose outcome depends on every stage."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from dataprobe.llm import mixing, quality
from tests.llm import brute

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(rng):
    vocabulary = [f"tok{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, item = say(70), say(16)
    docs = []
    for i in range(60):
        words = say(rng.randint(30, 200))
        if i % 6 == 1:
            at = rng.randrange(len(words))
            words[at:at] = passage
        if i % 9 == 2:
            at = rng.randrange(len(words))
            words[at:at] = item
        docs.append((i, " ".join(words)))
    docs += [(100 + i, docs[i][1]) for i in range(5)]  # copies
    docs += [(110 + i, docs[10 + i][1] + " tail") for i in range(5)]  # near copies
    docs += [(120, "word " * 200), (121, "too short"), (122, " ".join(w + "$$$" for w in say(60))), (123, None), (124, ""), (125, " ".join(item) + " " + " ".join(say(5)))]
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in docs], [(1, " ".join(item)), (2, "unrelated question about nothing at all in these rows")]


def plain(docs, items):
    """{doc_id: text} after the first four stages."""
    kept = []
    for d, t in docs:
        n, _, symbols, _, _, failed = brute.quality(t)
        if not failed and not 10 * symbols > 3 * n:
            kept.append((d, t))
    group = brute.linked(sorted((d, brute.fingerprint(t)) for d, t in kept))
    kept = sorted((d, t) for d, t in kept if group[d] == d)
    seen, cut = set(), []
    for d, t in kept:
        b = t.encode()
        gone, own = bytearray(len(b)), []
        for i in range(len(b) - 49):
            own.append(b[i : i + 50])
            if own[-1] in seen:
                gone[i : i + 50] = b"\1" * 50
        seen.update(own)
        left = bytes(c for c, g in zip(b, gone) if not g).decode(errors="ignore")
        if left:
            cut.append((d, left))
    out = {}
    for d, t in cut:
        own = brute.words(t)
        hit = set()
        for _, said in items:
            w = brute.words(said)
            k = min(10, len(w))
            windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            for i in range(len(own) - k + 1):
                if tuple(own[i : i + k]) in windows:
                    hit.update(range(i, i + k))
        if len(hit) <= 0.5 * len(own):
            left = [w for i, w in enumerate(t.split(" ")) if i not in hit] if hit else None
            out[d] = t if left is None else " ".join(left)
    return out


def test_pipeline(spark, tmp_path):
    docs, items = rows_of(random.Random(8))
    spark.createDataFrame(docs, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = plain([r[:2] for r in docs], items)
    assert {r["doc_id"]: r["text"].rstrip() for r in got} == {d: t.rstrip() for d, t in want.items()}
    assert len(got) == len(want) and all(r["n_chars"] == len(r["text"]) for r in got)
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + 1
    slots = {s: round(n**0.5 * mixing.UNIT) for s, n in sizes.items()}
    order = brute.schedule(slots, {s: -(-n // mixing.BLOCK_DOCS) for s, n in sizes.items()})
    assert all(r["mix_slot"] == order[r["source"], r["mix_block"]] for r in got)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40).cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    assert corpus_pipeline.ORACLE_SQL is None and quality.CURRENT in quality.POLICIES


def test_stages_keep_columns_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(30)
    for name in ("n_words", "fingerprint", "component_id", "removed", "kept", "id", "failed_bits"):
        docs = docs.withColumn(name, F.lit("mine"))
    docs = docs.cache()
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns
        assert {r[c] for r in out.collect() for c in ("n_words", "fingerprint", "removed", "kept", "id")} <= {"mine"}


def test_stages_take_empty_tables(spark, folder):
    empty = spark.createDataFrame([], DOC)
    assert all(stage(spark, empty, folder).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_one_row_of_a_group_stays(spark, tmp_path):
    """Repeated rows of one id and copies without an id through run()."""
    rng = random.Random(4)
    one, two, three = (" ".join(f"x{rng.getrandbits(40)}" for _ in range(60)) for _ in range(3))
    rows = [(5, one), (5, one), (5, one), (None, one), (9, one), (None, two), (None, two), (None, two), (7, three), (None, three)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of this is here")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([(5, one), (None, two), (7, three)], key=repr)


def test_cuts_keep_replacement_characters(spark, folder):
    """Only what a cut leaves of a character goes; characters that were there before stay."""
    shared = "".join(chr(0x4E00 + i) for i in range(40))
    # "\u4e2d" and "\u4e2e" share their first two bytes, "\u5128" and "\u4e28" their last
    docs = [(1, "\u4e2dxx" + "a" * 60 + "\u4e28" + shared + "\u4e2d"), (2, "one \ufffd two \u5128" + shared + "\u4e2e tail \ufffd")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOC)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.substring_dedup(spark, frame, folder).collect()}
    assert got == {1: (docs[0][1], len(docs[0][1])), 2: ("one \ufffd two  tail \ufffd", 17)}
