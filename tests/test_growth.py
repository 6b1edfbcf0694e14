"""What keeps disk and memory in proportion to the tables: no query and no text is copied for what it meets."""

import hashlib

import numpy as np
import pytest
from conftest import rows
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F
from test_neighbours import brute, vectors

from dataprobe.catalog import registry
from dataprobe.functions.draws import digest_above, uniform_from_digest
from dataprobe.functions.text import char_delete
from dataprobe.operators import models, ordering, pivots, predict, shapley
from dataprobe.operators.vectors import distances_in_order, every_distance, nearer_than, order_of, pair_distances
from dataprobe.plans import mislabel
from dataprobe.session import written


@pytest.fixture(scope="module")
def crowded(spark):
    """700 rows without clusters, 200 copies of one row among them, and 60 queries, one of them that row."""
    rng = np.random.default_rng(12)
    train, test = rng.normal(size=(700, 12)), rng.normal(size=(60, 12))
    train[100:300] = train[0]
    test[0] = train[0]
    return train, test, written(vectors(spark, train, "train_id").select("train_id", "embedding"), "t"), written(vectors(spark, test, "prediction_id").select("prediction_id", "embedding"), "q")


@pytest.mark.parametrize("k,portion", [(4, 1200), (4, 10**6), (300, 1200)])
def test_a_search_keeps_k_rows_a_query_and_portion(crowded, k, portion):
    train, test, t, q = crowded
    index = pivots.pivot_index(t, block_rows=64, portion=portion)
    assert index.portions == (1 if portion > 10**5 else index.portions) and (portion > 10**5 or index.portions > 6)
    assert index.rows.count() == 700 and index.rows.groupBy("portion").count().agg({"count": "max"}).first()[0] <= max(700 if portion > 10**5 else 0, 200)
    hits = pivots.pivot_hits(index, q, k).collect()
    assert len(hits) <= len(test) * k * index.portions  # not k rows for every cell
    found = {}
    for h in hits:
        found.setdefault(h["prediction_id"], []).append((h["distance"], h["train_id"]))
    want = {}
    for p, _, i, d in brute(test, train, k):
        want.setdefault(p, []).append((d, i))
    assert {p: sorted(x)[:k] for p, x in found.items()} == {p: sorted(x) for p, x in want.items()}


@pytest.mark.parametrize("scale", [1e-14, 1e-7, 1.0, 1e12])
def test_single_precision_rules_out_nothing_that_counts(scale):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 20)) * scale, rng.normal(size=(300, 20)) * scale
    b[50:60] = b[0]
    dist = pair_distances(a, b)
    for limit in (np.full(40, np.inf), np.sort(dist, axis=1)[:, 20] * (1 + 1e-6) + 1e-6):
        rows, cols, found = nearer_than(a, b, limit, 5)
        got = set(zip(rows.tolist(), cols.tolist()))
        for i in range(40):
            assert {(i, int(j)) for j in np.flatnonzero(dist[i] <= np.sort(dist[i])[4])} <= got
        assert np.allclose(found, dist[rows, cols], rtol=1e-6, atol=1e-9)


def test_texts_stay_where_they_are_read(spark, folder):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        for rows in (registry.doc_train(spark, folder), registry.doc_test(spark, folder)):
            assert "SortMergeJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("k", [1, 5])
def test_exact_values_store_no_pairs(spark, k):
    """Values in place are those of stored pairs, with copies, ids that come twice, and missing labels and vectors."""
    rng = np.random.default_rng(5)
    train, test = rng.normal(size=(150, 4)), rng.normal(size=(40, 4))
    train[20:60] = train[0]
    y, z = rng.integers(0, 2, 150), rng.integers(0, 2, 40)
    known = [(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(zip(train, y))]
    asked = [(i, [float(x) for x in v], int(l)) for i, (v, l) in enumerate(zip(test, z))]
    known += known[5:8] + [(500, None, 1), (501, known[3][1], None)]
    asked += asked[:2] + [(600, asked[4][1], None), (601, None, 0)]
    t = spark.createDataFrame(known, "train_id long, embedding array<double>, label int").repartition(3)
    q = spark.createDataFrame(asked, "test_id long, embedding array<double>, label int").repartition(3)
    want = shapley.values_of_all_ranks(every_distance(q, t, "test_id"), t, q, k).collect()
    got = shapley.values_of_vectors(t, q, t, q, k).collect()
    assert [i for i, _ in sorted(map(tuple, got))] == [i for i, _ in sorted(map(tuple, want))]
    assert np.allclose([v for _, v in sorted(map(tuple, got))], [v for _, v in sorted(map(tuple, want))], atol=1e-12)
    stored = shapley.values_of_vectors(t, q, t, q, k, max_bytes=0).collect()  # too many to send
    assert np.allclose([v for _, v in sorted(map(tuple, stored))], [v for _, v in sorted(map(tuple, want))], atol=1e-12)


def test_a_value_index_follows_its_vectors_and_not_their_pairs(spark):
    rng = np.random.default_rng(6)
    t, q = vectors(spark, rng.normal(size=(200, 4)), "train_id"), vectors(spark, rng.normal(size=(50, 4)), "prediction_id")
    index = mislabel.value_index(t, q)
    assert index.rows.count() + index.points.count() == 250


def test_order_of_distances_keeps_ties_in_place():
    rng = np.random.default_rng(7)
    for dist in (np.round(rng.random(500), 1), np.round(rng.random(500), 1) * 1e9, np.array([0.5, np.nan, 0.25]), np.zeros(3)):
        assert order_of(dist).tolist() == np.argsort(dist, kind="stable").tolist()


def test_ranks_and_differences_of_rows_in_order_need_no_exchange(spark):
    rng = np.random.default_rng(9)
    train, test = rng.integers(0, 3, (130, 3)).astype(float), rng.integers(0, 3, (25, 3)).astype(float)
    t, q = vectors(spark, train, "train_id", rng.integers(0, 2, 130)), vectors(spark, test, "prediction_id")
    pairs, in_order = distances_in_order(q, t)
    ranked = ordering.rank_by_distance(pairs, "prediction_id", "distance", "train_id", in_order=in_order)
    value = lambda c: F.when(F.col(c) % 5 != 2, (F.col(c) % 5).cast("double"))
    got = ordering.adjacent_diff(ranked.withColumns({"v": value("train_id"), "later": value("next_id")}), "prediction_id", "v", later="later")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert in_order and "Window" not in plan and "hashpartitioning" not in plan
    found = got.collect()
    assert sorted((r["prediction_id"], r["rank"], r["train_id"], r["distance"]) for r in found) == sorted((p, r, i, d) for p, r, i, d in brute(test, train, 130))
    by = {(r["prediction_id"], r["rank"]): r["v"] for r in found}
    for r in found:
        a, b = r["v"], by.get((r["prediction_id"], r["rank"] + 1))
        assert r["diff"] == (None if a is None or b is None else a - b)
    many, in_order = distances_in_order(q, t, max_bytes=0)
    assert not in_order and many.count() == 130 * 25
    for ids in (q.limit(1), q.limit(1).withColumn("prediction_id", F.lit(None).cast("long"))):  # an id that comes twice, or is missing
        assert not distances_in_order(q.unionByName(ids), t)[1]


def test_draws_of_deleted_characters_are_made_once(spark):
    texts = [(1, "some words to lose letters from " * 8), (2, ""), (3, None), (4, "x"), (5, "ab")]
    df = spark.createDataFrame(texts, "i long, t string")
    made = df.select("i", char_delete("t", 42, "i", 0.3).alias("t"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("filter(") == 1
    got = dict(map(tuple, made.collect()))
    for i, t in texts:
        draw = lambda at: int(hashlib.md5(f"42:{i}:del:{at}".encode()).hexdigest()[:8], 16) / 2**32
        kept = None if t is None else [c for at, c in enumerate(t or [""]) if draw(at) > 0.3]
        assert got[i] == ("".join(kept) if kept else None), i
    for rate in (0.0, 0.02, 0.5, 1.0, -0.1):
        same = df.select(F.md5(F.col("i").cast("string")).alias("h")).filter(digest_above(F.col("h"), rate) != (uniform_from_digest(F.col("h")) > rate))
        assert same.count() == 0


def test_word_vectors_train_on_as_many_partitions_as_run_at_a_time(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "Word2Vec", lambda **options: seen.append(options) or Word2Vec(**options))
    docs = spark.createDataFrame([("one two three " * 5,)] * 8, "text string")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        found = models.word_vectors(spark.createDataFrame([("one",), ("four",)], "token string"), docs, "text", size=4).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0]["numPartitions"] == spark.sparkContext.defaultParallelism
    assert {r["token"]: any(r["vector"]) for r in found} == {"one": True, "four": False}


def test_training_texts_move_once_to_their_questions(spark, monkeypatch):
    train = spark.createDataFrame([(i, f"text {i}", "ab"[i % 2]) for i in range(6)], "train_id long, text string, class_name string")
    asked = spark.createDataFrame([(10, "which"), (11, "what")], "prediction_id long, text string")
    index = spark.createDataFrame([(10, 1, 3), (10, 2, 0), (11, 1, 3), (11, 2, 5)], "prediction_id long, rank int, train_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        got = predict.prompts(index, asked, train, ("a", "b"))
        assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(train_id") == 0
        monkeypatch.setattr(predict, "SENT_INDEX", 0)
        assert rows(got) == rows(predict.prompts(index, asked, train, ("a", "b")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shown = dict(map(tuple, got.collect()))
    assert shown[10].index("text 3") < shown[10].index("text 0") < shown[10].index("```which```") and "text 5" in shown[11]
