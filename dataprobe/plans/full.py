"""The same three questions with everything computed again.

This is what the incremental plans must agree with, and what ``bench.py`` measures them against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.operators.keyed import flip_labels, patch_rows
from dataprobe.operators.noise import corrupt_text
from dataprobe.operators.predict import vote_from_index
from dataprobe.operators.slices import slice_condition
from dataprobe.operators.vectors import knn_retrieve
from dataprobe.operators.wordfix import repair_text
from dataprobe.plans.fairness import Enrich, worst_slices
from dataprobe.plans.mislabel import MislabelState
from dataprobe.plans.retrieval import Featurize, share_right


def predict_all(texts: DataFrame, train: DataFrame, labels: DataFrame, featurize: Featurize, featurize_train: Featurize, k: int = 4) -> DataFrame:
    """Features of both sides, neighbours and votes for every text."""
    return vote_from_index(knn_retrieve(featurize(texts), featurize_train(train), k), labels)


def robustness_full(
    test: DataFrame, train: DataFrame, labels: DataFrame, vocab: DataFrame, featurize: Featurize, featurize_train: Featurize,
    fraction: float = 0.1, seed: int = 42,
) -> DataFrame:
    """(prediction_id and three labels) with all three versions of the whole test set predicted anew."""
    texts = test.select("prediction_id", "text")
    hurt = corrupt_text(texts, "prediction_id", "text", fraction, seed)
    moved = hurt.join(texts.withColumnRenamed("text", "_was"), "prediction_id").filter(~F.col("text").eqNullSafe(F.col("_was")))
    healed = patch_rows(hurt, repair_text(moved.drop("_was"), "prediction_id", "text", vocab), "prediction_id", "text")
    out = None
    for name, rows in (("predicted_label", texts), ("predicted_corrupt_label", hurt), ("predicted_fix_corrupt_label", healed)):
        part = predict_all(rows, train, labels, featurize, featurize_train).withColumnRenamed("prediction", name)
        out = part if out is None else out.join(part, "prediction_id")
    return out


def robustness_full_report(wide: DataFrame, truth: DataFrame) -> DataFrame:
    return wide.join(truth.select("prediction_id", "truth"), "prediction_id").agg(
        share_right("predicted_label").alias("accuracy"),
        share_right("predicted_corrupt_label").alias("accuracy_corrupt"),
        share_right("predicted_fix_corrupt_label").alias("accuracy_fix_corrupt"),
    )


def fairness_full(
    test: DataFrame, train: DataFrame, labels: DataFrame, features: list[str], enrich: Enrich, featurize: Featurize, featurize_train: Featurize,
) -> DataFrame:
    """One row of accuracies with the whole test set enriched and predicted anew."""
    base = predict_all(test.select("prediction_id", "text"), train, labels, featurize, featurize_train)
    inside = slice_condition(worst_slices(test, base, features), features)
    enriched = enrich(test.select("prediction_id", "text"))
    texts = patch_rows(
        test.select("prediction_id", "text"), enriched.join(test.filter(inside).select("prediction_id"), "prediction_id"), "prediction_id", "text"
    )
    after = predict_all(texts, train, labels, featurize, featurize_train)
    rows = (
        test.select("prediction_id", "truth", inside.alias("in_slice"))
        .join(base.withColumnRenamed("prediction", "before"), "prediction_id")
        .join(after.withColumnRenamed("prediction", "after"), "prediction_id")
    )
    share = lambda c: F.avg(F.when(F.col("in_slice"), (F.col(c) == F.col("truth")).cast("double")))
    return rows.agg(
        share_right("before").alias("accuracy"),
        share_right("after").alias("accuracy_enriched"),
        share("before").alias("slice_accuracy"),
        share("after").alias("slice_accuracy_enriched"),
    )


def mislabel_full(test: DataFrame, train: DataFrame, state: MislabelState, truth: DataFrame, k: int = 4) -> DataFrame:
    """Accuracy before and after the flip, every prediction retrieved and voted anew both times."""
    before = vote_from_index(knn_retrieve(test, train, k), train.select("train_id", "label"))
    flipped = flip_labels(train.select("train_id", "label"), state.candidates, "train_id", "label")
    after = vote_from_index(knn_retrieve(test, train, k), flipped)
    rows = truth.join(before.withColumnRenamed("prediction", "before"), "prediction_id").join(
        after.withColumnRenamed("prediction", "after"), "prediction_id"
    )
    return rows.agg(share_right("before").alias("accuracy_before"), share_right("after").alias("accuracy_after"))
