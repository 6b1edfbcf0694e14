"""Which slice does worst, and does enriching its texts help?"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from dataprobe.operators.explain import explain_enrichment
from dataprobe.operators.memo import enrich_incremental, first_round
from dataprobe.operators.slices import slice_condition, slice_find
from dataprobe.plans.retrieval import Featurize, Retrieval, patched_predictions, share_right
from dataprobe.plans.trained import Trained
from dataprobe.session import written

Enrich = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FairnessState:
    """The slice, its enriched texts (prediction_id, before, after), and a classifier state over those that changed."""

    slices: list[Row]
    features: list[str]
    enriched: DataFrame
    diffs: Retrieval | Trained


def worst_slices(test: DataFrame, predictions: DataFrame, features: list[str], k: int = 1) -> list[Row]:
    """The k worst slices of the test set, as rows of the report."""
    rows = test.select("prediction_id", "truth", *features).join(predictions, "prediction_id")
    return slice_find(rows.withColumn("err", (F.col("prediction") != F.col("truth")).cast("int")), features, "err", k).collect()


def _changed(enriched: DataFrame) -> DataFrame:
    moved = enriched.filter(~F.col("after").eqNullSafe(F.col("before")))
    return moved.select("prediction_id", F.col("after").alias("text"))


def fairness_round(
    test: DataFrame, base: DataFrame, features: list[str], enrich: Enrich, classifier: Callable[[DataFrame], Retrieval | Trained]
) -> FairnessState:
    """Find the worst slice, enrich its texts only, and predict the texts that changed."""
    slices = worst_slices(test, base, features)
    wanted = test.filter(slice_condition(slices, features))
    enriched = written(first_round(wanted, test, enrich, "prediction_id", "text"), "enriched")
    return FairnessState(slices, features, enriched, classifier(_changed(enriched)))


def fairness_recheck(
    state: FairnessState,
    test: DataFrame,
    base: DataFrame,
    enrich: Enrich,
    update: Callable[[Retrieval | Trained, DataFrame], Retrieval | Trained],
) -> FairnessState:
    """After a label edit: search the slice again and enrich only rows not enriched before.

    ``update`` extends the stored classifier state to the texts that are needed now.
    """
    slices = worst_slices(test, base, state.features)
    wanted = test.filter(slice_condition(slices, state.features)).select("prediction_id")
    enriched = written(enrich_incremental(wanted, test, state.enriched, enrich, "prediction_id", "text"), "enriched")
    return FairnessState(slices, state.features, enriched, update(state.diffs, _changed(enriched)))


def fairness_report(state: FairnessState, base: DataFrame, test: DataFrame) -> DataFrame:
    """One row: accuracy overall and inside the slice, before and after; rows enriched and changed."""
    after = patched_predictions(base, state.diffs.predictions)
    rows = (
        test.select("prediction_id", "truth", slice_condition(state.slices, state.features).alias("in_slice"))
        .join(base.select("prediction_id", F.col("prediction").alias("before")), "prediction_id")
        .join(after.select("prediction_id", F.col("prediction").alias("after")), "prediction_id")
    )
    inside = lambda c: F.avg(F.when(F.col("in_slice"), (F.col(c) == F.col("truth")).cast("double")))
    return rows.agg(
        share_right("before").alias("accuracy"),
        share_right("after").alias("accuracy_enriched"),
        inside("before").alias("slice_accuracy"),
        inside("after").alias("slice_accuracy_enriched"),
        F.count(F.when(F.col("in_slice"), 1)).alias("slice_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def fairness_explanation(state: FairnessState, base: DataFrame, test: DataFrame, context: list[str], featurize: Featurize) -> DataFrame:
    """The slice's rows: texts, vectors and predictions before and after, with the outcome."""
    after = patched_predictions(base, state.diffs.predictions)
    rows = test.filter(slice_condition(state.slices, state.features)).select("prediction_id", *context, "truth")
    texts = written(rows.join(state.enriched, "prediction_id"), "texts")  # encoded twice and reported once
    encoded = lambda c, name: featurize(texts.select("prediction_id", F.col(c).alias("text"))).select("prediction_id", F.col("embedding").alias(name))
    wide = encoded("before", "features").join(encoded("after", "features_enriched"), "prediction_id")
    out = (
        texts.withColumnsRenamed({"before": "text", "after": "enriched_text"})
        .join(wide, "prediction_id")
        .join(base.select("prediction_id", F.col("prediction").alias("predicted_label")), "prediction_id")
        .join(after.select("prediction_id", F.col("prediction").alias("predicted_enriched_label")), "prediction_id")
    )
    return explain_enrichment(out, "prediction_id", "predicted_label", "predicted_enriched_label", "truth")
