"""The incremental plans against computing everything again, on the test tables."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from dataprobe.catalog import analyses as A
from dataprobe.catalog.registry import VOCAB_MIN, doc_features, vec_split
from dataprobe.operators import wordfix
from dataprobe.operators.models import fit, fit_predict, predict
from dataprobe.plans import fairness, full, mislabel, robustness, trained
from dataprobe.plans.retrieval import extend, relabel
from dataprobe.session import written


@pytest.fixture(scope="module")
def prepared(spark, folder):
    train, vectors, test, base = A._prepared(spark, folder)
    train, test = written(train, "train"), written(test, "test")
    # Relabel a fifth of the rows, so that the edit reaches many predictions.
    changed = train.filter(F.pmod(F.xxhash64("train_id"), F.lit(5)) == 0).select("train_id")
    hit = changed.withColumn("hit", F.lit(True))
    new = train.select("train_id", "label").join(hit, "train_id", "left").select(
        "train_id", F.when(F.col("hit"), 1 - F.col("label")).otherwise(F.col("label")).cast("int").alias("label")
    )
    return train, vectors, test, base, written(changed, "changed"), written(new, "new")


def featurize_train(rows_):
    return doc_features(rows_, "train_id")


def test_relabel_equals_full(prepared):
    train, _, test, base, changed, new = prepared
    again = full.predict_all(test.select("prediction_id", "text"), train, new, A.features_of, featurize_train)
    patched = relabel(base, changed, new).predictions
    assert rows(patched) == rows(again) and rows(patched) != rows(base.predictions)


def test_robustness_rounds_equal_full(prepared):
    train, vectors, test, base, changed, new = prepared
    vocab = written(wordfix.vocab_counts(train, "text", VOCAB_MIN), "vocab")
    state = robustness.robustness_round(test, vocab, A._by_vote(vectors))
    one = full.robustness_full(test, train, train.select("train_id", "label"), vocab, A.features_of, featurize_train)
    assert rows(robustness.robustness_predictions(state, base.predictions)) == rows(one)
    again = robustness.robustness_recheck(state, lambda diffs: relabel(diffs, changed, new))
    two = full.robustness_full(test, train, new, vocab, A.features_of, featurize_train)
    assert rows(robustness.robustness_predictions(again, relabel(base, changed, new).predictions)) == rows(two)


def test_fairness_rounds_equal_full(prepared):
    train, vectors, test, base, changed, new = prepared
    enrich = lambda r: r.select("prediction_id", F.translate("text", "e", "a").alias("text"))
    names = ["accuracy", "accuracy_enriched", "slice_accuracy", "slice_accuracy_enriched"]
    state = fairness.fairness_round(test, base.predictions, A.FEATURES, enrich, A._by_vote(vectors))
    one = full.fairness_full(test, train, train.select("train_id", "label"), A.FEATURES, enrich, A.features_of, featurize_train)
    assert rows(fairness.fairness_report(state, base.predictions, test).select(names)) == rows(one.select(names))
    rebased = relabel(base, changed, new).predictions
    again = fairness.fairness_recheck(state, test, rebased, enrich, lambda diffs, needed: extend(diffs, needed, changed, vectors, new, A.features_of))
    two = full.fairness_full(test, train, new, A.FEATURES, enrich, A.features_of, featurize_train)
    assert rows(fairness.fairness_report(again, rebased, test).select(names)) == rows(two.select(names))


def test_mislabel_round_equals_full(spark, folder):
    train, test = vec_split(spark, folder)
    test = test.withColumnRenamed("label", "truth")
    state = mislabel.mislabel_round(train, test)
    assert state.candidates.count() == 20
    retrieval = A.classify_vectors(test, train)
    report = mislabel.mislabel_report(state, retrieval, train.select("train_id", "label"), test).first()
    whole = full.mislabel_full(test, train, state, test.select("prediction_id", "truth")).first()
    assert (report["accuracy_before"], report["accuracy_after"]) == tuple(whole)
    assert report["rerun_rows"] < report["total_rows"]


def test_trained_rounds_equal_full(spark, prepared):
    train, vectors, test, _, _, new = prepared
    enrich = lambda r: r.select("prediction_id", F.translate("text", "e", "a").alias("text"))
    model, newer = fit(vectors), fit(vectors.drop("label").join(new, "train_id"))
    base = trained.classify(test.select("prediction_id", "text"), model, A.features_of)
    state = fairness.fairness_round(test, base.predictions, A.FEATURES, enrich, lambda t: trained.classify(t, model, A.features_of))
    for current, which in ((state, model), (fairness.fairness_recheck(
        state, test, trained.repredict(base, newer).predictions, enrich, lambda d, n: trained.extend(d, n, newer, A.features_of)
    ), newer)):
        texts = current.enriched.select("prediction_id", F.col("after").alias("text")).join(current.diffs.predictions.select("prediction_id"), "prediction_id")
        assert rows(current.diffs.predictions) == rows(predict(which, A.features_of(texts)))


def test_values_from_a_stored_index_follow_a_label_edit(spark, folder):
    train, test = vec_split(spark, folder)
    test = test.withColumnRenamed("label", "truth")
    index = mislabel.value_index(train, test)
    edited = train.withColumn("label", F.when(F.col("train_id") % 7 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    again = mislabel.mislabel_round_from_index(index, edited, test).candidates.select("train_id")
    assert rows(again) == rows(mislabel.mislabel_round(edited, test).candidates.select("train_id"))


def test_truncated_values_find_the_same_rows(spark, folder):
    train, test = vec_split(spark, folder)
    test = test.withColumnRenamed("label", "truth")
    exact = {r["train_id"] for r in mislabel.mislabel_round(train, test).candidates.collect()}
    short = {r["train_id"] for r in mislabel.mislabel_round(train, test, epsilon=0.02).candidates.collect()}
    assert len(exact & short) >= 15


@pytest.mark.parametrize("kind", ["logistic", "mlp", "gbt"])
def test_learners_learn(spark, kind):
    import numpy as np

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 4)) + y[:, None] * 4
    data = spark.createDataFrame([(i, [float(v) for v in r], int(l)) for i, (r, l) in enumerate(zip(x, y))], "prediction_id long, embedding array<double>, label int")
    got = fit_predict(data, data, kind).join(data, "prediction_id")
    assert got.filter("prediction = label").count() > 180
