"""Value of every training row for a nearest-neighbour classifier.

For one test point, rank the N training rows by distance and let eq_j be 1 when the label at rank j is
the test label.  With w_j = min(K, j) / (K j) for j < N and w_N = 1 / N, the value at rank i is

    s_i = sum_{j >= i} (eq_j - eq_{j+1}) w_j  (eq_{N+1} = 0)

and a row's value is the mean over all test points.  Ranks from max(K, ceil(1 / epsilon)) on may count 0: no
value is then off by more than epsilon (Jia et al., PVLDB 2019), and the nearest rows of each test point are
enough.  Exact values read every rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.operators.ordering import sum_after, topk_smallest
from dataprobe.operators.scan import ROWS_PER_RANGE, ranged, with_next, with_rank, with_suffix
from dataprobe.operators.vectors import RANKED_BYTES, _ids, _prepared, column_matrix, distances_to_all, every_distance, knn_retrieve, order_of, queries_at_once, sent_vectors
from dataprobe.schemas import require
from dataprobe.session import written

def knn_shapley(
    train: DataFrame,
    test: DataFrame,
    k: int = 1,
    epsilon: float = 0.0,
    train_id: str = "train_id",
    test_id: str = "test_id",
    label: str = "label",
    vector: str = "embedding",
) -> DataFrame:
    """(train_id, shapley_value) for every training row: exact, or off by at most a given ``epsilon``.

    Exact values look at every pair of a test point and a training row once, because every rank counts.  An error bound
    of 1 / N or more needs the ``last_rank`` nearest rows of each test point only.
    """
    for df, key in ((train, train_id), (test, test_id)):
        require(df, "knn_shapley", key, label, vector)
    train = train.select(F.col(train_id).cast("long").alias("train_id"), vector, F.col(label).cast("int").alias("label"))
    test = test.select(F.col(test_id).cast("long").alias("test_id"), vector, F.col(label).cast("int").alias("label"))
    if epsilon <= 0:
        return values_of_vectors(train, test, train, test, k, vector)
    last = last_rank(k, epsilon)
    return values_from_index(knn_retrieve(test, train, last, "test_id", "train_id", vector), train, test, k, last)


def values_of_vectors(
    train: DataFrame, test: DataFrame, train_labels: DataFrame, test_labels: DataFrame, k: int, vector: str = "embedding", max_bytes: int = RANKED_BYTES
) -> DataFrame:
    """Exact values from (train_id, vector) and (test_id, vector) and the labels as they are now.

    The training side is sent to every task, which ranks all rows for one test point at a time and keeps a sum a row: pairs
    are neither stored nor shuffled.  A training side of more than ``max_bytes`` goes through stored pairs (``values_of_all_ranks``).
    """
    labelled = train_labels.select("train_id", F.col("label").cast("double").alias("known"))
    asked = test_labels.select("test_id", F.col("label").cast("double").alias("asked"))
    rows, points = written(_prepared(train, "train_id", vector).join(labelled, "train_id"), "rows"), _prepared(test, "test_id", vector).join(asked, "test_id")
    local = sent_vectors(rows, "train_id", vector, max_bytes, "known")
    if local is None:
        return values_of_all_ranks(every_distance(test, train, "test_id", "train_id", vector), train_labels, test_labels, k)
    spark, last = train.sparkSession, train_labels.count()
    shared = spark.sparkContext.broadcast(local)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        sums, step = np.zeros(len(held["ids"])), queries_at_once(len(held["ids"]))
        for ids, vectors, labels in _whole_points(batches):
            groups = np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1)
            for start in range(0, len(ids), step):
                dist = distances_to_all(vectors[start : start + step], held["vectors"]) if len(sums) else None
                while dist is not None and groups and groups[0][0] < start + step:
                    at = groups.pop(0)
                    apart = dist[at[0] - start] if len(at) == 1 else distances_to_all(vectors[at], held["vectors"]).ravel()
                    _add_scores(sums, apart, held["known"], labels[at], k, last)
        if len(sums):
            yield pa.RecordBatch.from_arrays([pa.array(held["ids"]), pa.array(sums)], names=["train_id", "score"])

    points = written(points, "points")
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, points.count() // 16))
    scores = points.repartition(tasks, "test_id").sortWithinPartitions("test_id").mapInArrow(add_up, "train_id long, score double")
    return _mean_scores(written(scores, "scores"), train_labels, test_labels)


def _whole_points(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, labels) of batches ordered by id, cut so that no id is in two of them; a null label is NaN."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = _ids(batch.column(0)), column_matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        held = part if held is None else tuple(np.concatenate(x) for x in zip(held, part))
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield tuple(x[:cut] for x in held)
        held = tuple(x[cut:] for x in held)
    if held is not None:
        yield held


def _add_scores(sums: np.ndarray, dist: np.ndarray, known: np.ndarray, asked: np.ndarray, k: int, last: int) -> None:
    """Add one test point's scores to ``sums``; a row or point without a label counts as no neighbour and gets nothing.

    ``dist`` and ``asked`` hold as many stretches of all rows as the point's id has rows.
    """
    place = np.tile(np.arange(len(known)), len(asked))
    if len(asked) > 1:  # equal distances go by the row, whichever stretch it is in
        by_row = np.argsort(place, kind="stable")
        place, dist, eq = place[by_row], dist[by_row], np.where(np.isnan(np.repeat(asked, len(known))), np.nan, np.tile(known, len(asked)) - np.repeat(asked, len(known)))[by_row]
    else:
        eq = known - asked[0]
    order = order_of(dist)
    place, eq = place[order], np.where(np.isnan(eq), np.nan, eq == 0)[order]
    rank = np.arange(1, len(eq) + 1)
    weight = np.minimum(k, rank) / (k * rank)
    if last <= len(weight):
        weight[last - 1] = 1.0 / last
    own = np.nan_to_num(eq)
    steps = np.where(np.isnan(eq), 0.0, (own - np.append(own[1:], 0.0)) * weight)
    scores = np.where(np.isnan(eq), 0.0, np.cumsum(steps[::-1])[::-1])
    if len(asked) > 1:
        np.add.at(sums, place, scores)
    else:
        sums[place] += scores


def values_of_all_ranks(pairs: DataFrame, train_labels: DataFrame, test_labels: DataFrame, k: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact values from (test_id, train_id, distance) of every pair.

    The ranks of a test point are cut into ranges.  Counts of earlier ranges give a row its rank, the first row of the
    next range the neighbour of the last, sums of later ranges what is added to every score.  No window and no task
    holds more than a range, and pairs are dealt once more than they are computed.
    """
    train_labels, test_labels = train_labels.select("train_id", F.col("label").alias("_known")), test_labels.select("test_id", F.col("label").alias("_asked"))
    eq = (F.col("_known") == F.col("_asked")).cast("double")
    known = pairs.join(train_labels, "train_id").join(test_labels, "test_id").select("test_id", "train_id", "distance", eq.alias("eq"))
    known = written(known, "pairs")
    rows = train_labels.count()
    order = ["distance", "train_id"]
    cut = ranged(known, "test_id", order, rows_per_range, rows)
    ranked = with_next(with_rank(cut, "test_id", order), "test_id", order, "eq", "next_eq")
    weight = F.when(F.col("rank") == rows, 1.0 / max(rows, 1)).otherwise(F.least(F.lit(float(k)), F.col("rank").cast("double")) / (F.lit(float(k)) * F.col("rank")))
    parts = [c for c in ranked.columns if c == "_range"]
    stepped = ranked.select("test_id", "train_id", "rank", *parts, ((F.col("eq") - F.coalesce("next_eq", F.lit(0.0))) * weight).alias("step"))
    return _mean_scores(with_suffix(written(stepped, "steps") if parts else stepped, "test_id", ["rank"], "step", "score"), train_labels, test_labels)


def _mean_scores(scores: DataFrame, train_labels: DataFrame, test_labels: DataFrame) -> DataFrame:
    points = test_labels.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n")).scalar()
    sums = scores.groupBy("train_id").agg(F.sum("score").alias("_sum"))
    return train_labels.select("train_id").join(sums, "train_id", "left").select(
        "train_id", (F.coalesce(F.col("_sum"), F.lit(0.0)) / points).alias("shapley_value")
    )


def last_rank(k: int, epsilon: float) -> int:
    """The rank from which on a row's value counts 0."""
    return max(k, int(np.ceil(1.0 / epsilon)))


def values_from_index(index: DataFrame, train_labels: DataFrame, test_labels: DataFrame, k: int, last: int) -> DataFrame:
    """Values from a stored neighbour index (test_id, rank, train_id) of ``last`` ranks, truncated there.

    A label edit moves no neighbour: valuing the rows again after one reads this index and no vector.
    ``train_labels`` is (train_id, label), ``test_labels`` (test_id, label).
    """
    labelled = index.join(train_labels.select("train_id", F.col("label").alias("_known")), "train_id").join(
        test_labels.select("test_id", F.col("label").alias("_asked")), "test_id"
    )
    eq = (F.col("_known") == F.col("_asked")).cast("double")
    order = Window.partitionBy("test_id").orderBy("rank")  # at most ``last`` rows per test point
    stepped = labelled.select("test_id", "train_id", "rank", eq.alias("eq")).withColumn("next_eq", F.lead("eq").over(order))
    weight = F.least(F.lit(float(k)), F.col("rank").cast("double")) / (F.lit(float(k)) * F.col("rank"))
    step = F.when(F.col("rank") < last, (F.col("eq") - F.coalesce(F.col("next_eq"), F.lit(0.0))) * weight).otherwise(0.0)
    scores = stepped.withColumn("step", step).withColumn("score", F.col("step") + sum_after("step", ["test_id"], ["rank"]))
    return _mean_scores(scores, train_labels, test_labels)


def mislabel_candidates(values: DataFrame, n: int = 20) -> DataFrame:
    """The n training rows of lowest value, ties by id.

    Values are compared at nine decimals: the order in which a sum was added up decides nothing.
    """
    return topk_smallest(values.withColumn("shapley_value", F.round("shapley_value", 9)), "shapley_value", "train_id", n)
