"""Exact nearest neighbours of many queries: cells around pivots on two levels, pruned by the triangle inequality.

The number of cells follows the table (about ``block_rows`` / 4 rows each), and each level has its square root: the
first level's pivots are few and known to every task, a cell's own pivots travel to its rows only.

1. Rows go to their nearest first-level pivot, then to the nearest pivot inside that cell; a cell keeps its number of
   rows and its least and largest distance to the pivot.  Cells are dealt into portions of at most ``portion`` numbers.
2. Queries are sorted by their nearest first-level pivot, so that queries of one batch need the same cells.
3. Portion by portion, the cells are sent to every task and the queries stay where they are: no query travels to the cells
   that it asks.  A query knows how near k rows are at most (from pivots, which are rows, from cells, whose rows within
   ``far`` of a pivot at distance d are within d + far, and from the rows met so far), and so which cells it can leave out.
   Disk holds k rows a query and portion, memory one portion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.functions.draws import seeded_uniform
from dataprobe.operators.vectors import _TILE, _hits, _ids, _keep_best, column_matrix, nearer_than, pair_distances
from dataprobe.session import scratch_path, shuffles_removed, written

_SLACK = 1e-6
# Numbers of the index that are sent to every task at a time: 8M doubles = 64 MB.
PORTION_NUMBERS = 8_000_000


def _within(rows: np.ndarray, ceilings: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """For every row of ``ceilings``: the least ceiling below which k rows are sure to lie; infinite if there are fewer."""
    order = np.argsort(ceilings, axis=1)
    enough = np.cumsum(sizes[order], axis=1) >= k
    at = enough.argmax(axis=1)
    out = ceilings[np.arange(len(rows)), order[np.arange(len(rows)), at]]
    return np.where(enough.any(axis=1), out, np.inf)


def _kth(dist: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest value of every row; infinite if there are fewer."""
    return np.partition(dist, k - 1, axis=1)[:, k - 1] if dist.shape[1] >= k else np.full(len(dist), np.inf)


@dataclass(frozen=True)
class PivotIndex:
    """``rows`` (id, vector, c1, c2, portion), ``cells`` (c1, c2, pivot, rows, near, far), the first level's outline, and the number of portions."""

    rows: DataFrame
    cells: DataFrame
    first: np.ndarray
    near: np.ndarray
    far: np.ndarray
    sizes: np.ndarray
    train_id: str
    vector: str
    portions: int


def _shares(df: DataFrame, cell: str, rows: int) -> DataFrame:
    """(cell, shares): how many groups of about ``rows`` rows the cell's rows are dealt over."""
    return df.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("shares"))


def pivot_index(
    vectors: DataFrame, train_id: str = "train_id", vector: str = "embedding", block_rows: int = 4096, portion: int = PORTION_NUMBERS
) -> PivotIndex | None:
    """Index a stored table (id, vector) without null vectors; None if it is empty."""
    total = vectors.count()
    if total == 0:
        return None
    spark = vectors.sparkSession
    wanted = max(1, -(-total // max(1, block_rows // 4)))
    level = math.isqrt(wanted - 1) + 1  # pivots a level
    kind = vectors.schema[vector].dataType.simpleString()
    rate = min(1.0, 8.0 * level / total)
    picked = vectors.filter(seeded_uniform(29, train_id) < rate).orderBy(seeded_uniform(31, train_id), train_id).limit(level).toArrow()
    if not picked.num_rows:
        picked = vectors.orderBy(train_id).limit(level).toArrow()
    first = column_matrix(picked[vector])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dist = pair_distances(column_matrix(batch.column(1)), first)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dist.argmin(axis=1).astype(np.int32)), pa.array(dist.min(axis=1))], names=[train_id, vector, "c1", "r1"])

    placed = written(vectors.mapInArrow(place, f"{train_id} long, {vector} {kind}, c1 int, r1 double"), "placed")
    outline = {r["c1"]: r for r in placed.groupBy("c1").agg(F.count(F.lit(1)).alias("n"), F.min("r1").alias("near"), F.max("r1").alias("far")).collect()}  # one row a first-level pivot
    near, far, sizes = np.full(len(first), np.inf), np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
    for c, r in outline.items():
        near[c], far[c], sizes[c] = r["near"], r["far"], r["n"]

    # a cell's own pivots: its first-level one, and the rows of its smallest draws out of a sample
    draw = seeded_uniform(37, train_id)
    share = F.least(F.lit(1.0), F.lit(4.0 * level) / F.col("n"))
    counted = spark.createDataFrame([(int(c), int(r["n"])) for c, r in outline.items()], "c1 int, n long")
    drawn = placed.join(F.broadcast(counted), "c1").filter((draw < share) & (F.col("r1") > 0))  # no row twice: pivots are rows, and k of them bound a distance
    nth = F.row_number().over(Window.partitionBy("c1").orderBy(draw, train_id))
    own = drawn.withColumn("c2", nth).filter(F.col("c2") < level).select("c1", "c2", F.col(vector).cast("array<double>").alias("pivot"))
    heads = spark.createDataFrame([(int(c), 0, first[c].tolist()) for c in outline], "c1 int, c2 int, pivot array<double>")
    pivots = written(own.unionByName(heads), "pivots")

    dealt = _shares(placed, "c1", 8 * block_rows)
    left = placed.join(dealt, "c1").withColumn("share", F.pmod(F.xxhash64(train_id), "shares").cast("int")).select(train_id, vector, "c1", "share")
    right = pivots.join(dealt, "c1").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("c1", "c2", "pivot", "share")
    shape = pa.schema([(train_id, pa.int64()), (vector, pa.list_(pa.float32() if "float" in kind else pa.float64())), ("c1", pa.int32()), ("c2", pa.int32()), ("r2", pa.float64())])

    def settle(rows: pa.Table, around: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([], schema=shape)
        dist = pair_distances(column_matrix(rows[vector]), column_matrix(around["pivot"]))
        best = dist.argmin(axis=1)
        return pa.table([rows[train_id], rows[vector], rows["c1"], pa.array(around["c2"].to_numpy()[best].astype(np.int32)), pa.array(dist.min(axis=1))], names=shape.names)

    key = ["c1", "share"]
    settled = left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(settle, f"{train_id} long, {vector} {kind}, c1 int, c2 int, r2 double")
    rows = written(settled, "settled")
    sized = rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("rows"), F.min("r2").alias("near"), F.max("r2").alias("far"))
    cells = written(sized.join(pivots, ["c1", "c2"]), "cells")
    dealt_rows, portions = _portions(rows, cells, train_id, max(1, portion // max(1, first.shape[1])))
    return PivotIndex(dealt_rows, cells, first, near, far, sizes, train_id, vector, portions)


def _portions(rows: DataFrame, cells: DataFrame, train_id: str, most: int) -> tuple[DataFrame, int]:
    """``rows`` with ``portion``, and the number of portions: neighbouring cells together, of about ``most`` rows; a larger cell is dealt over several."""
    listed, number, held = [], 0, 0
    for r in cells.select("c1", "c2", "rows").orderBy("c1", "c2").collect():  # one row a cell
        if held and held + r["rows"] > most:
            number, held = number + 1, 0
        shares = -(-r["rows"] // most)
        listed.append((r["c1"], r["c2"], number, shares))
        number, held = (number, held + r["rows"]) if shares == 1 else (number + shares, 0)
    total = number + bool(held)
    if total == 1:
        return rows.withColumn("portion", F.lit(0)), 1
    where = rows.sparkSession.createDataFrame(listed, "c1 int, c2 int, first int, shares int")
    placed = rows.join(F.broadcast(where), ["c1", "c2"]).withColumn("portion", (F.col("first") + F.pmod(F.xxhash64(train_id), "shares")).cast("int"))
    path = scratch_path(rows.sparkSession, "portions")
    narrow = placed.drop("first", "shares")
    narrow.write.partitionBy("portion").parquet(path)
    return rows.sparkSession.read.schema(narrow.schema).parquet(path), total


def _at_home(index: PivotIndex, queries: DataFrame, k: int, query_id: str) -> DataFrame:
    """(query, vector, bound), stored: queries of one neighbourhood together, each with a distance below which k rows are sure to lie."""
    first, far, sizes, vector = index.first, index.far, index.sizes, index.vector
    kind = queries.schema[vector].dataType.simpleString()

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dist = pair_distances(column_matrix(batch.column(1)), first)
                bound = np.minimum(_within(dist, dist + far, sizes, k), _kth(dist, k))
                closest = np.where(sizes > 0, dist, np.inf).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(closest.astype(np.int32)), pa.array(bound)], names=[query_id, vector, "c1", "bound"])

    asked = queries.mapInArrow(home, f"{query_id} long, {vector} {kind}, c1 int, bound double")
    tasks = max(1, min(4 * queries.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // 512)))
    sorted_ = asked.repartitionByRange(tasks, "c1", F.xxhash64(query_id)).sortWithinPartitions("c1")
    with shuffles_removed(queries.sparkSession):
        return written(sorted_.drop("c1"), "at_home")


def _portion(index: PivotIndex, number: int) -> dict[str, np.ndarray]:
    """The rows of a portion, cell by cell, and the outlines of its cells."""
    table = index.rows.filter(F.col("portion") == number).select("c1", "c2", index.train_id, index.vector).toArrow()
    c1, c2 = (table[c].to_numpy() for c in ("c1", "c2"))
    order = np.lexsort((_ids(table[index.train_id]), c2, c1))
    c1, c2 = c1[order], c2[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(c1) != 0) | (np.diff(c2) != 0)]))
    here = index.rows.sparkSession.createDataFrame([(int(c1[s]), int(c2[s]), i) for i, s in enumerate(starts)], "c1 int, c2 int, at int")
    cells = index.cells.join(F.broadcast(here), ["c1", "c2"]).select("at", "pivot", "near", "far").toArrow().sort_by("at")
    return {
        "ids": _ids(table[index.train_id])[order], "vectors": column_matrix(table[index.vector])[order], "starts": np.append(starts, len(c1)),
        "pivots": column_matrix(cells["pivot"]), "near": cells["near"].to_numpy(), "far": cells["far"].to_numpy(),
    }


def _search(index: PivotIndex, queries: DataFrame, k: int, query_id: str, number: int, counted: bool = False) -> DataFrame:
    """(query, train_id, distance), stored: the rows of a portion that can be among the k nearest of a query, k at most.

    ``counted`` gives (query, compared) instead: the rows that a query was compared with.  ``queries`` is what ``_at_home`` returns.
    """
    train_id = index.train_id
    shared = queries.sparkSession.sparkContext.broadcast(_portion(index, number))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            ids, every, bounds = _ids(batch.column(0)), column_matrix(batch.column(1)), batch.column(2).to_numpy()
            for q0 in range(0, len(ids), _TILE):
                part = slice(q0, q0 + _TILE)
                best, compared = _near_cells(held, every[part], bounds[part], k)
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(compared)], names=[query_id, "compared"])
                else:
                    yield _hits(ids[part], best, (query_id, train_id))

    schema = f"{query_id} long, compared long" if counted else f"{query_id} long, {train_id} long, distance double"
    out = written(queries.mapInArrow(near, schema), "compared" if counted else "hits")
    shared.destroy()
    return out


def _near_cells(held: dict[str, np.ndarray], asked: np.ndarray, bound: np.ndarray, k: int):
    """((query, id, distance) of the k nearest rows, number of rows compared by query), nearest cells first."""
    starts, near, far = held["starts"], held["near"], held["far"]
    away = pair_distances(asked, held["pivots"])
    reach = np.minimum(bound, _within(away, away + far, np.diff(starts), k))
    compared = np.zeros(len(asked), np.int64)
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    for c in np.argsort(away.mean(axis=0), kind="stable"):
        for lo in range(starts[c], starts[c + 1], _TILE):
            limit = reach * (1 + _SLACK) + _SLACK
            asking = np.flatnonzero(~((away[:, c] - far[c] > limit) | (near[c] - away[:, c] > limit)))
            if not len(asking):
                break
            rows = slice(lo, min(lo + _TILE, starts[c + 1]))
            compared[asking] += rows.stop - lo
            at, cols, dist = nearer_than(asked[asking], held["vectors"][rows], limit[asking], k)
            if not len(at):
                continue
            best = _keep_best(*(np.concatenate(x) for x in zip(best, (asking[at], held["ids"][rows][cols], dist))), k)
            last = np.flatnonzero(np.bincount(best[0], minlength=len(asked)) >= k)
            ends = np.searchsorted(best[0], last, side="right") - 1
            reach[last] = np.minimum(reach[last], best[2][ends])
    return best, compared


def pivot_hits(index: PivotIndex, queries: DataFrame, k: int, query_id: str = "prediction_id") -> DataFrame:
    """(query, train_id, distance): at least the k nearest rows of every query, k a portion at most.

    ``queries`` is a stored table (query, vector) without null vectors.
    """
    asked = _at_home(index, queries, k, query_id)
    return reduce(DataFrame.unionByName, [_search(index, asked, k, query_id, number) for number in range(index.portions)])


def compared_share(index: PivotIndex, queries: DataFrame, k: int, query_id: str = "prediction_id") -> DataFrame:
    """One row (compared, pairs, share): how many of all pairs a search for k rows compares."""
    asked = _at_home(index, queries, k, query_id)
    each = reduce(DataFrame.unionByName, [_search(index, asked, k, query_id, number, True) for number in range(index.portions)])
    met = each.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))
    pairs = queries.agg(F.count(F.lit(1)).alias("q")).scalar() * F.lit(int(index.sizes.sum()))
    return met.select("compared", pairs.alias("pairs")).withColumn("share", F.col("compared") / F.col("pairs"))
