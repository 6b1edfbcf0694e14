"""Worst-performing slices: conjunctions of categorical values with a high share of errors."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from dataprobe.schemas import require
from dataprobe.session import written


def slice_stats(df: DataFrame, features: list[str], err: str, max_l: int = 2, totals: bool = False) -> DataFrame:
    """Rows and error sum of every slice with 1..max_l fixed features.

    ``<feature>_any`` tells a wildcard from a null value.  The rows are first counted per combination of
    all feature values, so the grouping sets run over those counts and not over the data.  ``totals`` adds the
    slice without any fixed feature, which is the whole table.
    """
    require(df, "slice_stats", err, *features)
    cells = df.groupBy(features).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(err).cast("double")).alias("_e"))
    sets = [list(c) for level in range(1, max_l + 1) for c in combinations(features, level)]
    grouped = cells.groupingSets([[F.col(c) for c in s] for s in sets + ([[]] if totals else [])], *[F.col(c) for c in features])
    return grouped.agg(
        F.sum("_n").alias("slice_rows"),
        F.sum("_e").alias("slice_err"),
        *[(F.grouping(c) == 1).alias(f"{c}_any") for c in features],
    )


def slice_find(
    df: DataFrame,
    features: list[str],
    err: str,
    k: int = 1,
    max_l: int = 2,
    alpha: float = 0.95,
    min_sup: int = 1,
) -> DataFrame:
    """The k best-scoring slices (Sagadeeva & Boehm, SIGMOD 2021), best first.

    score = alpha ((n / |S|)(err_S / err) - 1) - (1 - alpha)(n / |S| - 1).  Slices below ``min_sup`` rows,
    without an error or with a score of 0 or less are no answer.  Errors are not negative.
    """
    return slice_search(df, features, err, k, max_l, alpha, min_sup)[0]


def slice_search(
    df: DataFrame, features: list[str], err: str, k: int = 1, max_l: int = 2, alpha: float = 0.95, min_sup: int = 1, prune: bool = True
) -> tuple[DataFrame, list[int]]:
    """(the k best slices, slices evaluated on each level).

    Level by level.  Rows are counted once per combination of all feature values; inside such a cell a slice is told by
    which features it fixes, a bit mask.  A slice is evaluated only if every slice with one condition less survived, and
    if the best that rows, error sum and largest error of these allow can still be among the k best.  Survivors are
    joined back to the cells that lie in them; the masks of a cell are at most (features choose level).
    """
    require(df, "slice_search", err, *features)
    sure = F.col(err).cast("double")
    grouped = df.groupBy(features).agg(F.count(F.lit(1)).alias("_n"), F.sum(sure).alias("_e"), F.max(sure).alias("_m"))
    cells = written(grouped.withColumn("_cell", F.expr("uuid()")), "cells")
    total = cells.agg(F.sum("_n").alias("n"), F.sum("_e").alias("e")).first()
    n, whole = float(total["n"] or 0), float(total["e"] or 0.0)
    least = max(int(min_sup), 1)
    flags = [f"{c}_any" for c in features]
    order = [F.round("score", 9).desc(), *[o for c in features for o in (F.col(f"{c}_any").asc(), F.col(c).asc_nulls_first())]]

    def score(rows: Column, error: Column) -> Column:
        share = F.lit(n) / rows
        return F.lit(alpha) * (share * (error / F.lit(whole)) - 1) - F.lit(1 - alpha) * (share - 1)

    def most(rows: Column, error: Column, largest: Column) -> Column:
        """No part of a slice with at least ``min_sup`` rows scores higher: its score is monotone between these sizes."""
        sizes = (F.lit(float(least)), F.greatest(F.lit(float(least)), F.least(rows, error / largest)), rows)
        return F.greatest(*[score(s, F.least(error, s * largest)) for s in sizes])

    bit = {c: 1 << i for i, c in enumerate(features)}
    fixed = lambda c, mask: F.when(mask.bitwiseAND(F.lit(bit[c])) != 0, F.col(c))
    best, evaluated, floor = None, [], None
    live = cells.withColumn("_live", F.lit(None).cast("array<struct<mask:int,rows:double,err:double,top:double>>"))
    for level in range(1, min(max_l, len(features)) + 1):
        if whole <= 0:
            break
        if level == 1:
            wanted = F.array(*[F.struct(F.lit(b).alias("mask")) for b in bit.values()])
        else:
            wanted = _extended(F.col("_live"), list(bit.values()))
            if prune and floor is not None:
                wanted = F.filter(wanted, lambda c: most(c["rows"], c["err"], c["top"]) >= floor - 1e-8)
        placed = live.withColumn("_mask", F.explode(F.transform(wanted, lambda c: c["mask"])))
        key = {c: fixed(c, F.col("_mask")) for c in features}
        named = placed.select("_cell", "_n", "_e", "_m", "_mask", *[v.alias(c) for c, v in key.items()])
        stats = named.groupBy("_mask", *features).agg(F.sum("_n").alias("slice_rows"), F.sum("_e").alias("slice_err"), F.max("_m").alias("_top"))
        stats = written(stats.withColumn("score", score(F.col("slice_rows"), F.col("slice_err"))), f"level{level}")
        evaluated.append(stats.count())
        kept = stats.filter((F.col("slice_rows") >= least) & (F.col("slice_err") > 0))
        shown = kept.filter(F.col("score") > 0).withColumns({f"{c}_any": F.col("_mask").bitwiseAND(F.lit(bit[c])) == 0 for c in features})
        shown = shown.select(*features, *flags, "slice_rows", "slice_err", "score")
        best = shown if best is None else best.unionByName(shown)
        best = written(best.orderBy(*order).limit(k), "best")
        scores = [r[0] for r in best.select(F.round("score", 9)).collect()]  # k rows
        floor = min(scores) if len(scores) == k else 0.0
        if level == max_l:
            break
        if prune:
            kept = kept.filter(most(F.col("slice_rows").cast("double"), F.col("slice_err"), F.col("_top")) >= floor - 1e-8)
        kept = kept.select(F.col("_mask").alias("_kept"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(features)], "slice_rows", "slice_err", "_top")
        same = [F.col("_mask") == F.col("_kept"), *[F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(features)]]
        inside = named.join(kept, reduce(lambda a, b: a & b, same))
        entry = F.struct(F.col("_mask").alias("mask"), F.col("slice_rows").cast("double").alias("rows"), F.col("slice_err").alias("err"), F.col("_top").alias("top"))
        masks = inside.groupBy("_cell").agg(F.collect_list(entry).alias("_live"))
        live = written(cells.join(masks, "_cell"), "live")
    if best is None:
        kinds = [df.schema[c] for c in features]
        empty = df.limit(0).select(*[f.name for f in kinds], *[F.lit(True).alias(f) for f in flags])
        best = empty.withColumns({"slice_rows": F.lit(0).cast("long"), "slice_err": F.lit(0.0), "score": F.lit(0.0)})
    return best.orderBy(*order).limit(k), evaluated


def _extended(live: Column, bits: list[int]) -> Column:
    """Slices of one condition more all of whose parents are in ``live``, each with the least of what its parents have.

    A parent is extended by bits above its highest, so each slice comes out once.
    """
    def grown(bit: int) -> Column:
        def of(c: Column) -> Column:
            mask = c["mask"].bitwiseOR(F.lit(bit)).cast("int")
            parents = F.filter(live, lambda p: p["mask"].bitwiseAND(mask) == p["mask"])
            low = lambda name: F.array_min(F.transform(parents, lambda p: p[name])).alias(name)
            return F.struct(mask.alias("mask"), low("rows"), low("err"), low("top"), F.size(parents).alias("parents"))

        more = F.transform(F.filter(live, lambda c: c["mask"] < bit), of)
        return F.filter(more, lambda c: c["parents"] == F.bit_count(c["mask"]))

    return F.concat(*[grown(b) for b in bits])


def slice_condition(found: list[Row], features: list[str]) -> Column:
    """True on rows inside any of the given slices; a wildcard feature is no condition."""
    terms = []
    for row in found:
        fixed = [F.col(c).eqNullSafe(F.lit(row[c])) for c in features if not row[f"{c}_any"]]
        terms.append(reduce(lambda a, b: a & b, fixed, F.lit(True)))
    return reduce(lambda a, b: a | b, terms, F.lit(False))


def slice_mask(df: DataFrame, slices: DataFrame, features: list[str], name: str = "in_slice") -> DataFrame:
    """Mark the rows of the top-k slices.

    The k rows of the report become a plain filter expression, which reaches the Parquet scan.
    """
    return df.withColumn(name, slice_condition(slices.collect(), features))


def top_slice(slices: DataFrame) -> DataFrame:
    return slices.orderBy(F.col("score").desc()).limit(1)
