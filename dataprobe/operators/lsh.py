"""Approximate nearest neighbours: random projections in several tables, several probes a table, exact verification.

A table hashes a vector to ``width``-wide steps along ``projections`` random directions (Datar et al., SoCG 2004).  The
index stores every row once per table, with its vector, in Parquet folders by a hash of the bucket; a bucket with more
than ``BLOCK_ROWS`` rows is dealt over pieces.  A query asks its own bucket of each table and those it nearly fell into
(Lv et al., VLDB 2007); buckets that hold nothing are dropped before a vector travels.  Inside a bucket distances
are exact, block against block; a pair that shares no bucket is never compared.

What the index is fitted on is bounded: ``SAMPLE_QUERIES`` rows with their exact neighbours and ``SAMPLE_ROWS`` others,
whatever the size of the table.  Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dataprobe.functions.draws import seeded_uniform
from dataprobe.operators.vectors import _block_best, _hits, _ids, _prepared, column_matrix, knn_retrieve
from dataprobe.session import scratch_path, written

SAMPLE_QUERIES, SAMPLE_ROWS = 96, 1024
BLOCK_ROWS = 4096
_FOLDERS = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Hashes:
    """``tables`` times ``projections`` directions; the same seed gives the same buckets everywhere."""

    dims: int
    tables: int
    projections: int
    width: float
    probes: int
    seed: int

    def steps(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, tables, projections): where along each direction, in steps."""
        rng = np.random.default_rng(self.seed)
        count = self.tables * self.projections
        directions, shift = rng.normal(size=(self.dims, count)), rng.random(count)
        return (matrix @ directions / self.width + shift).reshape(-1, self.tables, self.projections)

    def _named(self, cells: np.ndarray) -> np.ndarray:
        """(rows, tables, ways, projections) of whole steps as bucket numbers (rows, tables, ways)."""
        out = np.zeros(cells.shape[:3], np.uint64) + np.arange(1, self.tables + 1, dtype=np.uint64)[None, :, None]
        for j in range(self.projections):
            out = (out ^ cells[..., j].astype(np.int64).view(np.uint64)) * _ODD
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def buckets(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, tables): one bucket a table."""
        return self._named(np.floor(self.steps(matrix))[:, :, None, :])[:, :, 0]

    def probed(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, tables, probes): the own bucket and the nearest others, by up to two neighbouring steps."""
        steps = self.steps(matrix)
        home = np.floor(steps)
        into = steps - home
        moves = np.concatenate([into, 1.0 - into], axis=2) ** 2  # to the step below, to the step above
        n = self.projections
        pairs = [(a, b) for a, b in combinations(range(2 * n), 2) if a % n != b % n]
        sets = [(a, a) for a in range(2 * n)] + pairs
        cost = np.concatenate([moves, *([moves[:, :, [a for a, _ in pairs]] + moves[:, :, [b for _, b in pairs]]] if pairs else [])], axis=2)
        more = min(self.probes - 1, len(sets))
        if not more:
            return self._named(home[:, :, None, :])
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :more]
        change = np.zeros((len(sets), n))
        for i, (a, b) in enumerate(sets):
            for c in {a, b}:
                change[i, c % n] = -1.0 if c < n else 1.0
        ways = np.concatenate([home[:, :, None, :], home[:, :, None, :] + change[best]], axis=2)
        return self._named(ways)


def fit_hashes(vectors: DataFrame, k: int, target: float, seed: int, train_id: str, vector: str) -> Hashes:
    """The cheapest hashes that find ``target`` of the sample's k nearest rows.

    ``vectors`` is a stored table.  Sampled rows are those of the smallest draws; their neighbours are exact, from one
    scan of the whole table.  Cost is how many of the other sampled rows a query's probes meet, as a share, repeats included.
    """
    draw = seeded_uniform(seed, train_id)
    picked = vectors.orderBy(draw, train_id).limit(SAMPLE_QUERIES + SAMPLE_ROWS).toArrow()
    sample = column_matrix(picked[vector])
    if not len(sample):
        return Hashes(1, 1, 1, 1.0, 1, seed)
    ids = _ids(picked[train_id])
    asked, others = sample[:SAMPLE_QUERIES], sample[SAMPLE_QUERIES:]
    chosen = vectors.sparkSession.createDataFrame([(int(i),) for i in ids[:SAMPLE_QUERIES]], "_asked long")
    points = vectors.join(F.broadcast(chosen), F.col(train_id) == F.col("_asked")).select(F.col("_asked"), vector)
    near = knn_retrieve(points, vectors, k + 1, "_asked", train_id, vector).filter(F.col("_asked") != F.col(train_id))
    found = near.join(vectors, train_id).select("_asked", vector, "distance").toArrow()  # at most SAMPLE_QUERIES * (k + 1) rows
    if not found.num_rows:
        return Hashes(sample.shape[1], 1, 1, 1.0, 1, seed)
    place = {int(i): n for n, i in enumerate(ids[:SAMPLE_QUERIES])}
    owner, close = np.array([place[int(i)] for i in _ids(found["_asked"])]), column_matrix(found[vector])
    reach = float(np.median(found["distance"].to_numpy())) or 1.0
    best = None
    for tables in (8, 16, 32):
        for projections in (2, 3, 4, 6, 8, 12):
            for stretch in (0.5, 1.0, 1.5, 2.0, 3.0, 4.0):
                h = Hashes(sample.shape[1], tables, projections, stretch * reach, 16, seed)
                probes = h.probed(asked)
                recall = (probes[owner] == h.buckets(close)[:, :, None]).any(axis=(1, 2)).mean()
                if recall < target and best is not None and recall <= best[0]:
                    continue
                met = 0.0
                if len(others):
                    rows = h.buckets(others)
                    met = np.mean([(rows[:, :, None] == p[None]).sum() / len(others) for p in probes[:16]])  # repeats are compared again
                good = recall >= target
                key = (good, -met if good else recall)
                if best is None or key > best[1]:
                    best = (recall, key, h)
        if best[1][0] and -best[1][1] < 0.5:
            break  # more tables only where these find too little, or meet half of all rows for it
    return best[2]


@dataclass(frozen=True)
class LshIndex:
    """Where the stored buckets and their sizes lie, and the hashes they are named by."""

    path: str
    hashes: Hashes
    train_id: str
    vector: str
    kind: str  # type of the vector

    def rows(self, spark: SparkSession) -> DataFrame:
        """(train_id, vector, bucket, piece, folder)."""
        return spark.read.schema(f"{self.train_id} long, {self.vector} {self.kind}, bucket long, piece int, folder int").parquet(f"{self.path}/rows")

    def directory(self, spark: SparkSession) -> DataFrame:
        """(bucket, rows, pieces)."""
        return spark.read.parquet(f"{self.path}/directory")


def _folder(bucket: str):
    return F.pmod(F.xxhash64(bucket), F.lit(_FOLDERS)).cast("int")


def lsh_index(
    vectors: DataFrame, k: int = 4, target: float = 0.97, train_id: str = "train_id", vector: str = "embedding", seed: int = 61, block_rows: int = BLOCK_ROWS
) -> LshIndex:
    """Fit on a sample, then index every row with a vector; rows without one are left out."""
    vectors = written(_prepared(vectors, train_id, vector), "vectors")
    spark = vectors.sparkSession
    h = fit_hashes(vectors, k, target, seed, train_id, vector)
    kind = vectors.schema[vector].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                buckets = h.buckets(column_matrix(batch.column(1)))
                again = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), h.tables)))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(buckets.ravel())], names=[train_id, vector, "bucket"])

    path = scratch_path(spark, "lsh")
    placed = vectors.mapInArrow(place, f"{train_id} long, {vector} {kind}, bucket long")
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    sizes.withColumn("pieces", F.ceil(F.col("rows") / block_rows).cast("int")).write.parquet(f"{path}/directory")
    crowded = spark.read.parquet(f"{path}/directory").filter("pieces > 1").select("bucket", "pieces")
    dealt = placed.join(crowded, "bucket", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64(train_id), "pieces"), F.lit(0)).cast("int"))
    rows = dealt.select(train_id, vector, "bucket", "piece", _folder("bucket").alias("folder"))
    rows.repartition("folder", "piece").write.partitionBy("folder").parquet(f"{path}/rows")
    return LshIndex(path, h, train_id, vector, kind)


def probes(index: LshIndex, queries: DataFrame, query_id: str = "prediction_id") -> DataFrame:
    """(query, bucket, pieces): the filled buckets that each query asks, once each."""
    h = index.hashes

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = h.probed(column_matrix(batch.column(1))).reshape(batch.num_rows, -1)
                owner = np.repeat(_ids(batch.column(0)), found.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(found.ravel())], names=[query_id, "bucket"])

    asked = _prepared(queries, query_id, index.vector).mapInArrow(ask, f"{query_id} long, bucket long")
    return asked.join(index.directory(queries.sparkSession).select("bucket", "pieces"), "bucket").dropDuplicates([query_id, "bucket"])


def lsh_retrieve(index: LshIndex, queries: DataFrame, k: int = 4, query_id: str = "prediction_id") -> DataFrame:
    """The k nearest rows among those that share a bucket: (query_id, rank, train_id, distance), ties by train id.

    Distances are exact.  A query that meets fewer than k rows gets as many as it meets; queries without a vector none.
    """
    spark, train_id, vector = queries.sparkSession, index.train_id, index.vector
    queries = written(_prepared(queries, query_id, vector), "queries")
    asked = written(probes(index, queries, query_id), "probes")
    pieces = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(query_id, "bucket", "piece")
    to = f"array<{queries.schema[vector].dataType.elementType.simpleString()}>"
    asking = pieces.join(queries, query_id).select("bucket", "piece", F.lit(True).alias("asks"), F.col(query_id).alias("id"), vector)
    # only buckets somebody asks are read: the folder prunes files, the bucket rows
    wanted = asked.select("bucket", _folder("bucket").alias("folder")).distinct()
    known = index.rows(spark).join(wanted, ["folder", "bucket"], "left_semi").select("bucket", "piece", F.lit(False).alias("asks"), F.col(train_id).alias("id"), F.col(vector).cast(to).alias(vector))
    both = asking.unionByName(known).repartition("bucket", "piece").sortWithinPartitions("bucket", "piece", "asks")

    def block(rows: pa.Table) -> pa.RecordBatch | None:
        asks = rows["asks"].to_numpy()
        cut = int(np.searchsorted(asks, True))
        if cut == 0 or cut == len(asks):
            return None
        ids, matrix = _ids(rows["id"]), column_matrix(rows[vector])
        return _hits(ids[cut:], _block_best(matrix[cut:], ids[:cut], matrix[:cut], k), (query_id, train_id))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # one block: a piece of a bucket and who asks it
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, piece = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bucket", "piece"))
            starts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (piece[1:] != piece[:-1])) + 1
            edges = [0, *starts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if held and (bucket[a], piece[a]) != last:
                    out = block(pa.Table.from_batches(held).combine_chunks())
                    held = []
                    if out is not None:
                        yield out
                held.append(batch.slice(a, b - a))
                last = (bucket[a], piece[a])
        if held:
            out = block(pa.Table.from_batches(held).combine_chunks())
            if out is not None:
                yield out

    hits = both.mapInArrow(compare, f"{query_id} long, {train_id} long, distance double")
    once = hits.groupBy(query_id, train_id).agg(F.min("distance").alias("distance"))  # a pair may share several buckets
    order = Window.partitionBy(query_id).orderBy(F.col("distance").asc(), F.col(train_id).asc())
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(query_id, "rank", train_id, "distance")


def recall(found: DataFrame, exact: DataFrame, query_id: str = "prediction_id", train_id: str = "train_id") -> DataFrame:
    """One row (asked, found, recall): exact neighbours, how many of them were found, and the share."""
    both = exact.select(query_id, train_id).join(found.select(query_id, train_id, F.lit(1).alias("_hit")), [query_id, train_id], "left")
    return both.agg(F.count(F.lit(1)).alias("asked"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("asked"))
