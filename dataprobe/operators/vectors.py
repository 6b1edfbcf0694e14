"""Nearest neighbours by exact Euclidean distance, in blocks.

Vectors stay in Arrow record batches and are compared block against block with numpy, inside tasks that
Spark partitions.  A task keeps the k best rows per query and never emits the pairs it compared.

* Query side small (its size is counted first): one broadcast, the training table is read once where it
  lies and is not shuffled.
* Otherwise: two levels of cells around pivots (``operators/pivots.py``).  The triangle inequality tells which
  cells can hold a neighbour of a query; cells are sent to the queries in portions of bounded size.
Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataprobe.functions.vectors import DISTANCE_DIGITS, array_distance
from dataprobe.schemas import require, require_type
from dataprobe.session import written

# Largest query side (in numbers) that is sent to every executor: 4M doubles = 32 MB.
BROADCAST_NUMBERS = 4_000_000
# Largest training side (in bytes) that is sent to every executor when every rank of every query is asked for.
RANKED_BYTES = 128 << 20
_TILE = 2048


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of every row of a to every row of b, rounded for ranking.

    One matrix product; near-zero results, where it loses digits, are computed again from differences,
    so that exact copies are at distance 0.
    """
    norms = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :]
    squares = norms - 2.0 * (a @ b.T)
    rows, cols = np.nonzero(squares <= 1e-4 * norms)
    for start in range(0, len(rows), 65536):
        r, c = rows[start : start + 65536], cols[start : start + 65536]
        gap = a[r] - b[c]
        squares[r, c] = np.einsum("ij,ij->i", gap, gap)
    return np.round(np.sqrt(np.maximum(squares, 0.0)), DISTANCE_DIGITS)


def column_matrix(column, kind=np.float64) -> np.ndarray:
    """An Arrow list column as a matrix, of float64 unless said otherwise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return np.zeros((0, 0), kind)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind)
    if len(flat) % rows or not np.all(np.diff(column.offsets.to_numpy()) == len(flat) // rows):
        raise ValueError("vectors differ in length")
    return flat.reshape(rows, -1)


def _ids(column) -> np.ndarray:
    return np.asarray(column.to_numpy(zero_copy_only=False), dtype=np.int64)


def _keep_best(query: np.ndarray, ids: np.ndarray, dist: np.ndarray, k: int):
    """The k smallest (distance, id) per query position."""
    order = np.lexsort((ids, dist, query))
    query, ids, dist = query[order], ids[order], dist[order]
    first = np.searchsorted(query, query, side="left")
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], dist[keep]


def _block_best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """Best k rows of one training block for every query, tile by tile."""
    found = []
    for q0 in range(0, len(queries), _TILE):
        part = queries[q0 : q0 + _TILE]
        for t0 in range(0, len(ids), _TILE):
            dist = pair_distances(part, vectors[t0 : t0 + _TILE])
            width = dist.shape[1]
            if width > k:
                limit = np.partition(dist, k - 1, axis=1)[:, k - 1 : k]
                rows, cols = np.nonzero(dist <= limit)
            else:
                rows, cols = (x.ravel() for x in np.indices(dist.shape))
            found.append(_keep_best(rows + q0, ids[t0 + cols], dist[rows, cols], k))
    return _keep_best(*(np.concatenate(x) for x in zip(*found)), k)


def nearer_than(queries: np.ndarray, vectors: np.ndarray, limit: np.ndarray, k: int):
    """(query position, row position, distance) of every pair within its query's ``limit``; of many, those up to the k-th.

    Pairs are ruled out in single precision, with room for its error, by one matrix product and one comparison; what is
    left is measured from differences.
    """
    asked, known = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", vectors, vectors)
    total = asked + np.fmax.reduce(known, initial=0.0)
    # NaN, and what single precision cannot hold, goes the slower way
    kind, error = (np.float32, 2.4e-7) if 1e-20 < total.max(initial=0.0) < 1e20 else (np.float64, 1e-15)
    room = error * (queries.shape[1] + 8) * total
    left = np.concatenate([queries, np.ones((len(queries), 1))], axis=1).astype(kind)
    right = np.concatenate([-2.0 * vectors, known[:, None]], axis=1).astype(kind)
    apart = left @ right.T  # squared distance less the query's own square

    def within(distance: np.ndarray) -> np.ndarray:
        return np.flatnonzero(apart <= (distance * distance - asked + room).astype(kind)[:, None])

    found = within(limit) if np.isfinite(limit).all() else None
    if len(vectors) > k and (found is None or len(found) > 16 * k * len(queries)):
        kth = np.sqrt(np.maximum(np.partition(apart, k - 1, axis=1)[:, k - 1] + asked + room, 0.0)) + 2.0 * 10.0**-DISTANCE_DIGITS
        found = within(np.fmin(limit, kth))
    elif found is None:
        found = within(limit)
    rows, cols = np.divmod(found, max(1, len(vectors)))
    dist = np.empty(len(rows))
    for start in range(0, len(rows), 65536):
        gap = queries[rows[start : start + 65536]] - vectors[cols[start : start + 65536]]
        dist[start : start + 65536] = np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), DISTANCE_DIGITS)
    return rows, cols, dist


def _hits(query_ids: np.ndarray, best, names: tuple[str, str]) -> pa.RecordBatch:
    query, ids, dist = best
    return pa.RecordBatch.from_pydict(
        {names[0]: pa.array(query_ids[query]), names[1]: pa.array(ids), "distance": pa.array(dist)}
    )


def _prepared(df: DataFrame, key: str, vector: str) -> DataFrame:
    require(df, "knn_retrieve", key)
    require_type(df, "knn_retrieve", vector, T.ArrayType)
    # Element type stays as stored (floats travel at half the width); numpy widens it inside the task.
    return df.select(F.col(key).cast("long").alias(key), vector).filter(F.col(vector).isNotNull())


def local_vectors(df: DataFrame, key: str, vector: str, max_numbers: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix on the driver if the table holds at most ``max_numbers`` numbers, else None."""
    size = df.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0]
    if size > max_numbers:
        return None
    table = df.select(key, vector).toArrow()
    order = np.argsort(_ids(table[key]), kind="stable")
    return _ids(table[key])[order], column_matrix(table[vector])[order]


def _broadcast_hits(vectors: DataFrame, local, k: int, query_id: str, train_id: str, vector: str, schema) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(local)

    def best_of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best = None
        for batch in batches:
            if not batch.num_rows or not len(query_ids):
                continue
            found = _block_best(queries, _ids(batch.column(0)), column_matrix(batch.column(1)), k)
            best = found if best is None else _keep_best(*(np.concatenate(x) for x in zip(best, found)), k)
        if best is not None:
            yield _hits(query_ids, best, (query_id, train_id))

    return vectors.mapInArrow(best_of_partition, schema)


def knn_retrieve(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 4,
    query_id: str = "prediction_id",
    train_id: str = "train_id",
    vector: str = "embedding",
    broadcast_numbers: int = BROADCAST_NUMBERS,
    block_rows: int = 4096,
) -> DataFrame:
    """The k nearest training rows of every query: (query_id, rank, train_id, distance), ties by train id."""
    queries, vectors = _prepared(queries, query_id, vector), _prepared(vectors, train_id, vector)
    schema = f"{query_id} long, {train_id} long, distance double"
    stored = written(queries, "queries")  # measured and then read: whatever computes the vectors runs once
    local = local_vectors(stored, query_id, vector, broadcast_numbers)
    if local is not None and not len(local[0]):
        hits = vectors.sparkSession.createDataFrame([], schema)  # nobody asks: no scan
    elif local is not None:
        hits = _broadcast_hits(vectors, local, k, query_id, train_id, vector, schema)
    else:
        from dataprobe.operators.pivots import pivot_hits, pivot_index

        index = pivot_index(written(vectors, "vectors"), train_id, vector, block_rows)
        hits = vectors.sparkSession.createDataFrame([], schema) if index is None else pivot_hits(index, stored, k, query_id)
    order = Window.partitionBy(query_id).orderBy(F.col("distance").asc(), F.col(train_id).asc())
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query_id, "rank", train_id, "distance")


def every_distance(
    queries: DataFrame, vectors: DataFrame, query_id: str = "prediction_id", train_id: str = "train_id", vector: str = "embedding", block: int = 512
) -> DataFrame:
    """(query_id, train_id, distance) of every pair, for what needs every rank.

    Both sides are dealt into blocks by a hash of their ids and meet block by block; a task holds two blocks and keeps
    nothing.  The pairs are what was asked for: queries times training rows.
    """
    queries, vectors = written(_prepared(queries, query_id, vector), "queries"), written(_prepared(vectors, train_id, vector), "vectors")
    of_queries, of_rows = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    asking = queries.withColumn("_q", F.pmod(F.xxhash64(query_id), F.lit(of_queries))).withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(of_rows - 1)).cast("array<long>")))
    known = vectors.withColumn("_t", F.pmod(F.xxhash64(train_id), F.lit(of_rows))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(of_queries - 1)).cast("array<long>")))
    shape = pa.schema([(query_id, pa.int64()), (train_id, pa.int64()), ("distance", pa.float64())])

    def measure(ask: pa.Table, rows: pa.Table) -> pa.Table:
        if not ask.num_rows or not rows.num_rows:
            return pa.Table.from_batches([], schema=shape)
        a, b = _ids(ask[query_id]), _ids(rows[train_id])
        dist = pair_distances(column_matrix(ask[vector]), column_matrix(rows[vector]))
        return pa.table([pa.array(np.repeat(a, len(b))), pa.array(np.tile(b, len(a))), pa.array(dist.ravel())], names=shape.names)

    key = ["_q", "_t"]
    return asking.groupBy(key).cogroup(known.groupBy(key)).applyInArrow(measure, f"{query_id} long, {train_id} long, distance double")


def sent_vectors(vectors: DataFrame, train_id: str, vector: str, max_bytes: int, *keep: str) -> dict[str, np.ndarray] | None:
    """A stored table (id, vector, kept columns) on the driver, ordered by id, if its vectors take at most ``max_bytes``, else None.

    Vectors stay as wide as they are stored.
    """
    width = 4 if "float" in vectors.schema[vector].dataType.simpleString() else 8
    if vectors.agg(F.coalesce(F.sum(F.size(vector)), F.lit(0))).first()[0] * width > max_bytes:
        return None
    table = vectors.select(train_id, vector, *keep).toArrow()
    order = np.argsort(_ids(table[train_id]), kind="stable")
    matrix = column_matrix(table[vector], np.float32 if width == 4 else np.float64)[order]
    return {"ids": _ids(table[train_id])[order], "vectors": matrix} | {c: table[c].to_numpy().astype(np.float64)[order] for c in keep}


def distances_to_all(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """``pair_distances`` to stored rows of any width, a tile of rows at a time."""
    out = np.empty((len(queries), len(vectors)))
    for start in range(0, len(vectors), _TILE):
        out[:, start : start + _TILE] = pair_distances(queries, vectors[start : start + _TILE].astype(np.float64))
    return out


def order_of(dist: np.ndarray) -> np.ndarray:
    """Positions in ascending order of rounded distances, equal ones as they stand."""
    bits = max(1, int(len(dist) - 1).bit_length())
    if len(dist) and dist.max() * 10.0**DISTANCE_DIGITS < 2.0 ** min(53, 62 - bits):  # distance and position fit one number
        keys = (np.rint(dist * 10.0**DISTANCE_DIGITS).astype(np.int64) << bits) | np.arange(len(dist))
        keys.sort()
        return keys & ((1 << bits) - 1)
    return np.argsort(dist, kind="stable")


def queries_at_once(rows: int) -> int:
    """How many queries' distances to so many rows are held at a time: 2M numbers."""
    return max(1, 2_000_000 // max(1, rows))


def _unique(df: DataFrame, key: str) -> bool:
    """Whether the table has neither a null nor a repeated key."""
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys")).first()
    return n["rows"] == n["keys"]


def distances_in_order(
    queries: DataFrame, vectors: DataFrame, query_id: str = "prediction_id", train_id: str = "train_id", vector: str = "embedding", max_bytes: int = RANKED_BYTES
) -> tuple[DataFrame, bool]:
    """(``every_distance``, in order): whether the rows of one query follow each other in one task, by distance and then id.

    They do as long as ids are unique and the training side can be sent to every task; then nothing is stored or shuffled
    but the vectors, ``place`` is a row's place in its query, from 1, and ``next_id`` the row after it, null on the last.
    """
    queries, vectors = written(_prepared(queries, query_id, vector), "queries"), written(_prepared(vectors, train_id, vector), "vectors")
    local = sent_vectors(vectors, train_id, vector, max_bytes) if _unique(queries, query_id) and _unique(vectors, train_id) else None
    if local is None:
        return every_distance(queries, vectors, query_id, train_id, vector), False
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(local)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        step = queries_at_once(len(held["ids"]))
        for batch in batches:
            ids, asked = _ids(batch.column(0)), column_matrix(batch.column(1))
            for start in range(0, len(ids) if len(held["ids"]) else 0, step):
                for i, dist in zip(ids[start : start + step], distances_to_all(asked[start : start + step], held["vectors"])):
                    order = order_of(dist)
                    for x in range(0, len(order), 100_000):
                        at = order[x : x + 100_000]
                        later = held["ids"][np.append(order[x + 1 : x + 1 + len(at)], at[-1:])[: len(at)]]
                        columns = [np.full(len(at), i), held["ids"][at], dist[at], np.arange(x + 1, x + 1 + len(at))]
                        after = pa.array(later, mask=np.arange(x + 1, x + 1 + len(at)) == len(order))
                        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), after], names=[query_id, train_id, "distance", "place", "next_id"])

    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, queries.count() // 16))
    return queries.repartition(tasks).mapInArrow(measure, f"{query_id} long, {train_id} long, distance double, place long, next_id long"), True


def pairwise_distance(
    pairs: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str = "embedding"
) -> DataFrame:
    """Distance of every listed pair; two equi joins, no pair that was not asked for."""
    a = left.select(left_id, F.col(vector).alias("_a"))
    b = right.select(right_id, F.col(vector).alias("_b"))
    joined = pairs.select(left_id, right_id).join(a, left_id).join(b, right_id)
    return joined.select(left_id, right_id, array_distance("_a", "_b").alias("distance"))


def retrieval_index_wide(index: DataFrame, k: int = 4, query_id: str = "prediction_id", train_id: str = "train_id") -> DataFrame:
    """One row per query with columns train_retrieved_1..k."""
    return index.groupBy(query_id).agg(
        *[F.max(F.when(F.col("rank") == i, F.col(train_id))).alias(f"train_retrieved_{i}") for i in range(1, k + 1)]
    )


def retrieval_index_long(wide: DataFrame, k: int = 4, query_id: str = "prediction_id", train_id: str = "train_id") -> DataFrame:
    """The wide index turned back into (query, rank, train id) rows."""
    ranks = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(f"train_retrieved_{i}").alias(train_id)) for i in range(1, k + 1)])
    return wide.select(query_id, F.inline(ranks)).filter(F.col(train_id).isNotNull())
