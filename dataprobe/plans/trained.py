"""The stored state of a trained classifier over one set of texts: vectors outlive the model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from dataprobe.operators.keyed import drop_rows, gather_rows
from dataprobe.operators.models import predict
from dataprobe.plans.retrieval import Featurize
from dataprobe.session import written


@dataclass(frozen=True)
class Trained:
    """Encoded texts (prediction_id, embedding), and what the model says about them."""

    vectors: DataFrame
    predictions: DataFrame


def repredict(state: Trained, model: PipelineModel) -> Trained:
    """Another model (after a label edit, or a proxy) on the same texts: nothing is encoded again."""
    return Trained(state.vectors, written(predict(model, state.vectors), "predictions"))


def classify(texts: DataFrame, model: PipelineModel, featurize: Featurize) -> Trained:
    vectors = written(featurize(texts), "vectors")
    return Trained(vectors, written(predict(model, vectors), "predictions"))


def extend(state: Trained, needed: DataFrame, model: PipelineModel, featurize: Featurize) -> Trained:
    """The state for the texts in ``needed``: only texts without a vector are encoded."""
    kept = gather_rows(state.vectors, needed, "prediction_id")
    fresh = drop_rows(needed, state.vectors.select("prediction_id"), "prediction_id")
    vectors = written(kept.unionByName(featurize(fresh)), "vectors")
    return Trained(vectors, written(predict(model, vectors), "predictions"))
