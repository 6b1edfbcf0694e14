import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from dataprobe.operators import impact, predict, shapley
from dataprobe.operators.vectors import knn_retrieve, pair_distances, retrieval_index_long, retrieval_index_wide


def vectors(spark, matrix, key, labels=None):
    data = [(i, [float(x) for x in row], int(labels[i]) if labels is not None else 0) for i, row in enumerate(matrix)]
    return spark.createDataFrame(data, f"{key} long, embedding array<double>, label int").repartition(3)


def brute(queries, train, k):
    out = []
    for q, row in enumerate(queries):
        dist = np.round(np.sqrt(((train - row) ** 2).sum(axis=1)), 9)
        order = np.lexsort((np.arange(len(train)), dist))[:k]
        out += [(q, r + 1, int(i), float(dist[i])) for r, i in enumerate(order)]
    return sorted(out, key=repr)


def sample_points(seed=1, n=300, m=60, dims=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims)) * 5
    train = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dims))
    train[: n // 3] = train[0]  # a third of the rows are copies of one
    test = centres[rng.integers(0, 6, m)] + rng.normal(size=(m, dims))
    test[0] = train[0]
    return train, test


def test_copies_are_at_distance_zero():
    a = np.random.default_rng(0).normal(size=(50, 64))
    d = pair_distances(a, a)
    assert np.all(np.diag(d) == 0) and np.allclose(d, np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1)), atol=1e-8)


@pytest.mark.parametrize("k", [1, 4, 400])
def test_both_ways_equal_brute_force(spark, k):
    train, test = sample_points()
    q, t = vectors(spark, test, "prediction_id"), vectors(spark, train, "train_id")
    expected = brute(test, train, k)
    got = sorted(((r[0], r[1], r[2], r[3]) for r in knn_retrieve(q, t, k).collect()), key=repr)
    assert got == expected
    got = sorted(((r[0], r[1], r[2], r[3]) for r in knn_retrieve(q, t, k, broadcast_numbers=0, block_rows=16).collect()), key=repr)
    assert got == expected


def test_no_training_rows(spark):
    train, test = sample_points(n=3, m=4)
    q, t = vectors(spark, test, "prediction_id"), vectors(spark, train, "train_id").limit(0)
    assert knn_retrieve(q, t).count() == 0 and knn_retrieve(q, t, broadcast_numbers=0).count() == 0
    assert knn_retrieve(q.limit(0), t).count() == 0


def test_vectors_of_different_length_are_refused(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "train_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 2.0])], "prediction_id long, embedding array<double>")
    with pytest.raises(Exception, match="differ in length"):
        knn_retrieve(q, t).collect()


def test_index_forms_and_impact(spark):
    train, test = sample_points()
    q, t = vectors(spark, test, "prediction_id"), vectors(spark, train, "train_id")
    index = knn_retrieve(q, t)
    wide = retrieval_index_wide(index)
    assert rows(retrieval_index_long(wide)) == rows(index.select("prediction_id", "rank", "train_id"))
    changed = spark.createDataFrame([(0,), (1,), (299,), (5000,)], "train_id long")
    a = rows(impact.impact_set(index, changed))
    assert a == rows(impact.impact_set_by_rank(wide, changed))
    assert a == sorted({(r["prediction_id"],) for r in index.collect() if r["train_id"] in (0, 1, 299)}, key=repr)
    assert impact.impact_set(index, changed.limit(0)).count() == 0


def test_votes_and_ties(spark):
    labelled = spark.createDataFrame(
        [(1, 1, 1), (1, 2, 0), (1, 3, 0), (1, 4, 1), (2, 1, 0), (2, 2, 1), (2, 3, 1)], "prediction_id long, rank int, label int"
    )
    assert rows(predict.vote(labelled)) == [(1, 1), (2, 1)]
    assert rows(predict.vote(labelled, tie="lowest")) == [(1, 0), (2, 1)]


def test_rerun_and_patch_equals_full(spark):
    train, test = sample_points(seed=4)
    labels = np.random.default_rng(2).integers(0, 2, len(train))
    q, t = vectors(spark, test, "prediction_id"), vectors(spark, train, "train_id", labels)
    index = knn_retrieve(q, t)
    before = predict.vote_from_index(index, t)
    changed = spark.createDataFrame([(i,) for i in range(90, 160)], "train_id long")
    new = t.withColumn("label", F.when(F.col("train_id").between(90, 159), 1 - F.col("label")).otherwise(F.col("label")))
    patched, impacted = impact.rerun_and_patch(before, index, changed, new)
    assert rows(patched) == rows(predict.vote_from_index(index, new))
    assert 0 < impacted.count() < len(test)


# ---- values of training rows -----------------------------------------------------------------------


def direct_values(train, y, test, yt, k):
    """The recurrence from the last rank to the first, one test point at a time."""
    n = len(train)
    total = np.zeros(n)
    for row, label in zip(test, yt):
        dist = np.round(np.sqrt(((train - row) ** 2).sum(axis=1)), 9)
        order = np.lexsort((np.arange(n), dist))
        eq = (y[order] == label).astype(float)
        s = np.zeros(n)
        s[-1] = eq[-1] / n
        for i in range(n - 2, -1, -1):
            s[i] = s[i + 1] + (eq[i] - eq[i + 1]) / k * min(k, i + 1) / (i + 1)
        total[order] += s
    return total / len(test)


def values(spark, train, y, test, yt, **options):
    t, q = vectors(spark, train, "train_id", y), vectors(spark, test, "test_id", yt)
    got = dict((r["train_id"], r["shapley_value"]) for r in shapley.knn_shapley(t, q, **options).collect())
    assert len(got) == len(train)
    return np.array([got[i] for i in range(len(train))])


@pytest.mark.parametrize("k", [1, 2, 5])
def test_exact_values(spark, k):
    train, test = sample_points()
    rng = np.random.default_rng(3)
    y, yt = rng.integers(0, 2, len(train)), rng.integers(0, 2, len(test))
    expected = direct_values(train, y, test, yt, k)
    assert np.allclose(values(spark, train, y, test, yt, k=k, epsilon=0), expected, atol=1e-12)
    # A bound below one over the number of rows asks for every rank.
    assert np.allclose(values(spark, train, y, test, yt, k=k, epsilon=0.5 / len(train)), expected, atol=1e-12)


def test_exact_values_of_fewer_rows_than_neighbours(spark):
    train, test, y, yt = np.array([[1.0], [2.0], [3.0]]), np.array([[0.0], [2.1]]), np.array([1, 0, 1]), np.array([1, 0])
    assert np.allclose(values(spark, train, y, test, yt, k=5, epsilon=0), direct_values(train, y, test, yt, 5))


def test_hand_computed_values(spark):
    # One test point at 0 with label 1; ranks 1..4 have labels 1, 0, 0, 1.
    train, y = np.array([[1.0], [2.0], [3.0], [4.0]]), np.array([1, 0, 0, 1])
    got = values(spark, train, y, np.array([[0.0]]), np.array([1]), epsilon=0)
    assert np.allclose(got, [1 - 1 / 3 + 1 / 4, -1 / 3 + 1 / 4, -1 / 3 + 1 / 4, 1 / 4])
    assert np.allclose(values(spark, train[:1], y[:1], np.array([[0.0]]), np.array([1])), [1.0])


@pytest.mark.parametrize("epsilon", [0.2, 0.05])
def test_truncation_stays_within_epsilon(spark, epsilon):
    train, test = sample_points()
    rng = np.random.default_rng(3)
    y, yt = rng.integers(0, 2, len(train)), rng.integers(0, 2, len(test))
    gap = np.abs(values(spark, train, y, test, yt, epsilon=epsilon) - direct_values(train, y, test, yt, 1))
    assert gap.max() <= epsilon
