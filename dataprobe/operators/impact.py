"""Which predictions a change of training rows can reach, and rerunning only those.

A label edit moves no neighbour, so the stored retrieval index stays right and only predictions that
retrieved an edited row can change.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.operators.keyed import patch_rows
from dataprobe.operators.predict import vote_from_index
from dataprobe.schemas import require


def impact_set(index: DataFrame, changed: DataFrame, query_id: str = "prediction_id", train_id: str = "train_id") -> DataFrame:
    """Distinct predictions that retrieved a changed training row: one equi join on the long index."""
    require(index, "impact_set", query_id, train_id)
    return index.join(changed.select(train_id), train_id, "left_semi").select(query_id).distinct()


def impact_set_by_rank(wide: DataFrame, changed: DataFrame, k: int = 4, query_id: str = "prediction_id", train_id: str = "train_id") -> DataFrame:
    """The same answer from the wide index, as one equi join per rank; kept as a cross-check."""
    parts = [
        wide.select(query_id, F.col(f"train_retrieved_{i}").alias(train_id)).join(changed.select(train_id), train_id, "left_semi").select(query_id)
        for i in range(1, k + 1)
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


def impacted_enriched(index: DataFrame, changed: DataFrame, reused: DataFrame, fresh: DataFrame, key: str = "prediction_id") -> DataFrame:
    """(key, text) to predict again: reused texts that retrieved a changed row, and newly changed texts."""
    touched = reused.join(impact_set(index, changed, key), key, "left_semi").select(key, F.col("after").alias("text"))
    first_time = fresh.filter(~F.col("after").eqNullSafe(F.col("before"))).select(key, F.col("after").alias("text"))
    return touched.unionByName(first_time).distinct()


def rerun_and_patch(
    predictions: DataFrame,
    index: DataFrame,
    changed: DataFrame,
    labels: DataFrame,
    predictor: Callable[[DataFrame, DataFrame], DataFrame] = vote_from_index,
) -> tuple[DataFrame, DataFrame]:
    """(patched predictions, ids rerun) after the labels of ``changed`` rows became ``labels``."""
    impacted = impact_set(index, changed)
    part = index.join(impacted, "prediction_id", "left_semi")
    fresh = predictor(part, labels)
    return patch_rows(predictions, fresh, "prediction_id", "prediction"), impacted


def flip_what_if(
    index: DataFrame, predictions: DataFrame, labels: DataFrame, candidates: DataFrame, truth: DataFrame
) -> DataFrame:
    """One row: accuracy before and after flipping the candidates' labels, and how many were rerun.

    ``labels`` itself is not changed; the flipped table exists only inside this plan.
    """
    from dataprobe.operators.keyed import flip_labels

    flipped = flip_labels(labels, candidates, "train_id", "label")
    after, impacted = rerun_and_patch(predictions, index, candidates, flipped)
    both = (
        truth.select("prediction_id", "truth")
        .join(predictions.select("prediction_id", F.col("prediction").alias("before")), "prediction_id")
        .join(after.select("prediction_id", F.col("prediction").alias("after")), "prediction_id")
        .join(impacted.withColumn("rerun", F.lit(1)), "prediction_id", "left")
    )
    share = lambda c: F.avg((F.col(c) == F.col("truth")).cast("double"))
    return both.agg(
        share("before").alias("accuracy_before"),
        share("after").alias("accuracy_after"),
        F.count("rerun").alias("rerun_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )
