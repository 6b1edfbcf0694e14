"""Predictors: tables of queries in, (prediction_id, prediction) out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.prompts import example_block, parse_response, prompt
from dataprobe.operators.vectors import knn_retrieve
from dataprobe.schemas import require
from dataprobe.session import written

# Rows of a retrieval index that are sent to every task (about 60 bytes each).
SENT_INDEX = 1_000_000

Predictor = Callable[[DataFrame], DataFrame]


def with_labels(index: DataFrame, labels: DataFrame, train_id: str = "train_id", label: str = "label") -> DataFrame:
    """The retrieval index with each retrieved row's current label; labels live apart from vectors."""
    return index.join(labels.select(train_id, F.col(label).cast("int").alias("label")), train_id)


def vote(labelled: DataFrame, query: str = "prediction_id", tie: str = "nearest") -> DataFrame:
    """(query, prediction): most frequent retrieved label.

    Ties go to the label of the nearest row, or to the lowest label with ``tie='lowest'``.
    """
    counts = labelled.groupBy(query, "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("nearest"))
    second = F.col("nearest") if tie == "nearest" else F.col("label")
    best = F.min(F.struct((-F.col("votes")).alias("votes"), second.alias("second"), F.col("label").alias("label")))
    return counts.groupBy(query).agg(best.alias("best")).select(query, F.col("best.label").alias("prediction"))


def knn_vote(
    queries: DataFrame, train: DataFrame, k: int = 5, query_id: str = "prediction_id", train_id: str = "train_id", vector: str = "embedding"
) -> DataFrame:
    """Majority label of the k nearest training rows; ties to the lowest label."""
    index = knn_retrieve(queries, train, k, query_id, train_id, vector)
    return vote(with_labels(index, train, train_id), query_id, tie="lowest")


def vote_from_index(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions of the retrieval classifier, from its stored index and the labels as they are now."""
    return vote(with_labels(index, labels))


def rag_classify(
    queries: DataFrame,
    train: DataFrame,
    k: int = 4,
    predictor: Callable[[DataFrame], DataFrame] | None = None,
    vector: str = "embedding",
) -> tuple[DataFrame, DataFrame]:
    """(predictions, retrieval index): retrieve k labelled rows per query and classify.

    The default predictor lets the retrieved labels vote; another one gets the labelled index.
    """
    index = knn_retrieve(queries, train, k, vector=vector)
    labelled = with_labels(index, train)
    return (predictor or vote)(labelled), index


def prompts(index: DataFrame, queries: DataFrame, train: DataFrame, classes: Sequence[str], text: str = "text") -> DataFrame:
    """(prediction_id, prompt) for an external model: examples in rank order, then the question.

    An index of up to ``SENT_INDEX`` rows is sent to the training texts, so that these move once, to their questions.
    """
    require(train, "prompts", "train_id", text, "class_name")
    index = written(index.select("train_id", "prediction_id", "rank"), "index")
    used = F.broadcast(index) if index.count() <= SENT_INDEX else index
    examples = train.select("train_id", example_block(text, "class_name").alias("example")).join(used, "train_id")
    ordered = F.sort_array(F.collect_list(F.struct("rank", "example")))  # k entries per query
    context = examples.groupBy("prediction_id").agg(
        F.array_join(F.transform(ordered, lambda e: e["example"]), "\n\n").alias("context")
    )
    return queries.select("prediction_id", text).join(context, "prediction_id").select(
        "prediction_id", prompt(text, "context", classes).alias("prompt")
    )


def parse_responses(responses: DataFrame, classes: Sequence[str], seed: int = 42) -> DataFrame:
    return responses.select("prediction_id", parse_response("response", classes, seed, "prediction_id").alias("prediction"))


def _known(fn: Callable[[list], list], values: pd.Series) -> pd.Series:
    """``fn`` of what is not null, null for the rest."""
    known, out = values.notna().to_numpy(), pd.Series([None] * len(values), index=values.index, dtype=object)
    if known.any():
        out.loc[known] = list(fn(values[known].tolist()))
    return out


def udf_text_transform(df: DataFrame, key: str, text: str, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """(key, text) through a plain batch function on lists of texts, one Arrow batch at a time; ``fn`` sees no nulls."""
    narrow = df.select(key, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], text: _known(fn, batch[text])})

    return narrow.mapInPandas(run, narrow.schema)


def udf_predictor(df: DataFrame, fn: Callable[[list], list[int]], feature: str, key: str = "prediction_id") -> DataFrame:
    """(key, prediction) from a plain batch function on a feature or prompt column; null features have null predictions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "prediction": _known(fn, batch[feature])})

    return df.select(key, feature).mapInPandas(run, f"{key} long, prediction int")


# Tokens per word and tokens per second of the estimated model and translation service.
MODEL_TOKENS_PER_WORD, MODEL_TOKENS_PER_SECOND = 3, 500
TRANSLATION_TOKENS_PER_WORD, TRANSLATION_TOKENS_PER_SECOND = 4, 6000


def service_seconds(words: Column, translation: bool = False) -> Column:
    """Estimated service time for a number of words."""
    per_word, rate = (
        (TRANSLATION_TOKENS_PER_WORD, TRANSLATION_TOKENS_PER_SECOND) if translation else (MODEL_TOKENS_PER_WORD, MODEL_TOKENS_PER_SECOND)
    )
    return words.cast("double") * F.lit(per_word) / F.lit(rate)
