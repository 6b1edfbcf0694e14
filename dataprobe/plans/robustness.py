"""How much do typos hurt, and does spelling repair win it back?"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.operators.explain import explain_corruption
from dataprobe.operators.keyed import changed_rows
from dataprobe.operators.noise import corruption_diff
from dataprobe.operators.wordfix import repair_text
from dataprobe.plans.retrieval import Featurize, Retrieval, patched_predictions, share_right
from dataprobe.plans.trained import Trained
from dataprobe.session import written


@dataclass(frozen=True)
class RobustnessState:
    """Texts that changed, and a classifier state over either kind of changed text.

    Damaged and repaired versions of a row share its id, so each kind has a state of its own.
    """

    corrupted: DataFrame
    repaired: DataFrame
    hurt: Retrieval | Trained
    healed: Retrieval | Trained


def robustness_round(
    test: DataFrame,
    vocab: DataFrame,
    classifier: Callable[[DataFrame], Retrieval | Trained],
    fraction: float = 0.1,
    seed: int = 42,
) -> RobustnessState:
    """Damage a tenth of the texts, repair those only, and predict the texts that changed.

    ``classifier`` gets (prediction_id, text), first of the damaged versions and then of the repaired ones.
    """
    texts = test.select("prediction_id", "text")
    corrupted = written(corruption_diff(texts, "prediction_id", "text", fraction, seed), "corrupted")
    fixed = repair_text(corrupted, "prediction_id", "text", vocab)
    repaired = written(changed_rows(corrupted, fixed, "prediction_id", "text"), "repaired")
    text = lambda df: df.select("prediction_id", "text")
    return RobustnessState(corrupted, repaired, classifier(text(corrupted)), classifier(text(repaired)))


def robustness_recheck(state: RobustnessState, update: Callable[[Retrieval | Trained], Retrieval | Trained]) -> RobustnessState:
    """After a label edit: texts and vectors stand; ``update`` brings the stored predictions up to date."""
    return RobustnessState(state.corrupted, state.repaired, update(state.hurt), update(state.healed))


def robustness_predictions(state: RobustnessState, base: DataFrame) -> DataFrame:
    """(prediction_id, predicted_label, predicted_corrupt_label, predicted_fix_corrupt_label) for all rows."""
    hurt = patched_predictions(base, state.hurt.predictions)
    healed = patched_predictions(hurt, state.healed.predictions)
    named = lambda df, name: df.select("prediction_id", F.col("prediction").alias(name))
    return (
        named(base, "predicted_label")
        .join(named(hurt, "predicted_corrupt_label"), "prediction_id")
        .join(named(healed, "predicted_fix_corrupt_label"), "prediction_id")
    )


def robustness_report(state: RobustnessState, base: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the three accuracies, and how many rows were touched."""
    rows = robustness_predictions(state, base).join(truth.select("prediction_id", "truth"), "prediction_id")
    touched = state.corrupted.select("prediction_id", F.lit(1).alias("_c"))
    mended = state.repaired.select("prediction_id", F.lit(1).alias("_r"))
    return rows.join(touched, "prediction_id", "left").join(mended, "prediction_id", "left").agg(
        share_right("predicted_label").alias("accuracy"),
        share_right("predicted_corrupt_label").alias("accuracy_corrupt"),
        share_right("predicted_fix_corrupt_label").alias("accuracy_fix_corrupt"),
        F.count("_c").alias("corrupted_rows"),
        F.count("_r").alias("repaired_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def robustness_explanation(state: RobustnessState, base: DataFrame, test: DataFrame, context: list[str], featurize: Featurize) -> DataFrame:
    """The damaged rows: texts, vectors and predictions of all three versions, with the four marks."""
    ids = state.corrupted.select("prediction_id")
    texts = (
        test.select("prediction_id", *context, "text", "truth")
        .join(state.corrupted.select("prediction_id", F.col("text").alias("corrupted_text")), "prediction_id")
        .join(state.repaired.select("prediction_id", F.col("text").alias("_fixed")), "prediction_id", "left")
        .withColumn("fix_corrupted_text", F.coalesce("_fixed", "corrupted_text"))
        .drop("_fixed")
    )
    texts = written(texts, "texts")  # encoded three times and reported once
    wide = None
    for column, name in (("text", "features"), ("corrupted_text", "features_corrupted"), ("fix_corrupted_text", "features_fix_corrupted")):
        part = featurize(texts.select("prediction_id", F.col(column).alias("text"))).select("prediction_id", F.col("embedding").alias(name))
        wide = part if wide is None else wide.join(part, "prediction_id")
    labels = robustness_predictions(state, base).join(ids, "prediction_id", "left_semi")
    rows = texts.join(wide, "prediction_id").join(labels, "prediction_id")
    return explain_corruption(rows, "predicted_label", "predicted_corrupt_label", "predicted_fix_corrupt_label", "truth")
