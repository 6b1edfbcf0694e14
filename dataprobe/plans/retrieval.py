"""The stored state of a retrieval classifier, and its upkeep under label edits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.labels import RuleSet, binarize
from dataprobe.operators.impact import impact_set, rerun_and_patch
from dataprobe.operators.keyed import drop_rows, gather_rows, patch_rows
from dataprobe.operators.labels import label_diff, weak_label
from dataprobe.operators.predict import vote_from_index
from dataprobe.operators.vectors import knn_retrieve
from dataprobe.session import written

Featurize = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Retrieval:
    """Who used which training row, and what came out."""

    index: DataFrame
    predictions: DataFrame


def classify(texts: DataFrame, train_vectors: DataFrame, labels: DataFrame, featurize: Featurize, k: int = 4) -> Retrieval:
    """Predict (prediction_id, text) rows.  Index and predictions are narrow and are written for reuse."""
    index = written(knn_retrieve(featurize(texts), train_vectors, k), "index")
    return Retrieval(index, written(vote_from_index(index, labels), "predictions"))


def edited_labels(texts: DataFrame, rules: RuleSet, edited: int, pattern: str) -> DataFrame:
    """(train_id, old_label, label) after one rule of the weak labelling was edited; 1 = not positive.

    One pass over (train_id, text); the changed rows and the new labels are both read from its result.
    """
    labelled = weak_label(texts.select("train_id", "text"), "text", rules, "weak")
    _, patched = label_diff(labelled.withColumn("old", F.col("weak")), "train_id", "text", rules, edited, pattern, "weak")
    encoded = lambda c: binarize(c, (True, False))
    return written(patched.select("train_id", encoded("old").alias("old_label"), encoded("weak").alias("label")), "labels")


def changed_labels(edited: DataFrame) -> DataFrame:
    return edited.filter(F.col("label") != F.col("old_label")).select("train_id")


def relabel(state: Retrieval, changed: DataFrame, labels: DataFrame) -> Retrieval:
    """The same queries after the labels of ``changed`` rows became ``labels``: impacted ones only."""
    patched, _ = rerun_and_patch(state.predictions, state.index, changed, labels)
    return Retrieval(state.index, written(patched, "predictions"))


def extend(
    state: Retrieval, needed: DataFrame, changed: DataFrame, train_vectors: DataFrame, labels: DataFrame, featurize: Featurize, k: int = 4
) -> Retrieval:
    """The state for the texts in ``needed`` (prediction_id, text) after a label edit.

    Texts seen before keep their neighbours and, unless they retrieved an edited row, their prediction; only
    the others are encoded and searched.
    """
    kept = gather_rows(state.index, needed, "prediction_id")
    fresh = drop_rows(needed, state.index.select("prediction_id"), "prediction_id")
    index = written(kept.unionByName(knn_retrieve(featurize(fresh), train_vectors, k)), "index")
    todo = impact_set(state.index, changed).unionByName(fresh.select("prediction_id"))
    votes = vote_from_index(gather_rows(index, todo, "prediction_id"), labels)
    reused = drop_rows(gather_rows(state.predictions, needed, "prediction_id"), todo, "prediction_id")
    return Retrieval(index, written(reused.unionByName(votes), "predictions"))


def patched_predictions(base: DataFrame, *diffs: DataFrame) -> DataFrame:
    out = base
    for diff in diffs:
        out = patch_rows(out, diff, "prediction_id", "prediction")
    return out


def share_right(column: str) -> F.Column:
    return F.avg((F.col(column) == F.col("truth")).cast("double"))
