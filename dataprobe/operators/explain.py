"""Explanation tables: what changed for which row, and whether that helped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.labels import binarize
from dataprobe.operators.keyed import gather_rows
from dataprobe.schemas import require


def _beside(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key), others, base)


def explain_enrichment(rows: DataFrame, key: str, before: str, after: str, truth: str) -> DataFrame:
    """Add ``category`` to a table holding predictions before and after enrichment.

    broken: right, then wrong; successfully_fixed: wrong, then right; nothing_changed: wrong both times.
    Rows that were right both times have no category.
    """
    require(rows, "explain_enrichment", key, before, after, truth)
    b, a, t = F.col(before), F.col(after), F.col(truth)
    category = (
        F.when((b == t) & (b != a), "broken")
        .when((b != t) & (a == t), "successfully_fixed")
        .when((b != t) & (a != t), "nothing_changed")
    )
    return rows.withColumn("category", category)


def explain_corruption(rows: DataFrame, original: str, corrupted: str, repaired: str, truth: str) -> DataFrame:
    """Add the four overlapping marks of a damage-and-repair round as boolean columns."""
    require(rows, "explain_corruption", original, corrupted, repaired, truth)
    o, c, r, t = F.col(original), F.col(corrupted), F.col(repaired), F.col(truth)
    return rows.withColumns(
        {
            "corruption_effect": (o == t) & (o != c),
            "successfully_fixed": (o == t) & (o != c) & (o == r),
            "worsened": (o == t) & (o != r),
            "otherwise_fixed": (o != t) & (r == t),
        }
    )


def explain_flip_train(
    train: DataFrame, candidates: DataFrame, rules: list[str], context: list[str], feature: str, label: str = "label"
) -> DataFrame:
    """The flipped training rows: context, features, rule results, labels before and after, value.

    ``label`` is boolean; the encoded form is 1 for false, as the class listed last is 1.
    """
    require(train, "explain_flip_train", "train_id", label, feature, *rules, *context)
    hit = gather_rows(train, candidates, "train_id").join(candidates.select("train_id", "shapley_value"), "train_id")
    return hit.select(
        "train_id",
        *context,
        F.col(feature).alias("features"),
        *rules,
        F.col(label).alias("original_label"),
        (~F.col(label)).alias("modified_label"),
        binarize(label, (True, False)).alias("encoded_original_label"),
        binarize(~F.col(label), (True, False)).alias("encoded_modified_label"),
        "shapley_value",
    )


def explain_flip_test(
    test: DataFrame, original: DataFrame, modified: DataFrame, context: list[str], feature: str, truth: str, proxy: DataFrame | None = None
) -> DataFrame:
    """Test rows whose prediction the flip moved, marked ``broken`` / ``successfully_fixed``.

    ``truth`` is a boolean column; predictions are 0/1 with 1 for false.  With ``proxy`` (the surrogate's
    predictions on the unflipped labels) the marks compare surrogate with surrogate, and the predictions of
    the real model stand beside them.
    """
    require(test, "explain_flip_test", "prediction_id", truth, feature, *context)
    first = original.select("prediction_id", F.col("prediction").alias("encoded_original_predicted_label"))
    last = modified.select("prediction_id", F.col("prediction").alias("encoded_modified_predicted_label"))
    sides, before = [first, last], "encoded_original_predicted_label"
    if proxy is not None:
        sides.append(proxy.select("prediction_id", F.col("prediction").alias("encoded_proxy_original_predicted_label")))
        before = "encoded_proxy_original_predicted_label"
    # Narrow predictions first; the wide test rows join only where something moved.
    moved = _beside(sides[0], sides[1:], "prediction_id").filter(
        F.col("encoded_original_predicted_label") != F.col("encoded_modified_predicted_label")
    )
    rows = test.select(
        "prediction_id",
        *context,
        F.col(feature).alias("features"),
        F.col(truth).alias("true_label"),
        binarize(truth, (True, False)).alias("encoded_true_label"),
    ).join(moved, "prediction_id")
    b, a, t = F.col(before), F.col("encoded_modified_predicted_label"), F.col("encoded_true_label")
    out = rows.withColumns({"broken": (b == t) & (b != a), "successfully_fixed": (b != t) & (a == t)})
    if proxy is not None:
        out = out.withColumnRenamed("encoded_modified_predicted_label", "encoded_proxy_modified_predicted_label")
    return out
