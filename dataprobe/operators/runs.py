"""Run ledgers: medians of repetitions, totals, and how much faster one way is than another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.schemas import LEDGER_KEYS, require

# The order of scenarios, predictors and optimisation levels in a report.
SCENARIO_ORDER = {"original": 0, "fairness": 1, "robustness": 2, "mislabel": 3}
VARIANT_ORDER = {"llm": 0, "ml": 1}
OPT_ORDER = {"original": 0, "naive": 1, "opt": 2, "proxy_opt": 3}


def median_by_config(ledger: DataFrame, columns: list[str], keys: tuple[str, ...] = LEDGER_KEYS, accuracy: int = 10_000) -> DataFrame:
    """Exact median of each column per configuration; nulls are skipped and an all-null column stays null.

    The built-in median gathers every value of a group in one task.  Here a quantile sketch brackets the
    middle (its rank is off by at most n / accuracy), values below the bracket are only counted, and only
    the distinct values inside it are put in order.
    """
    require(ledger, "median_by_config", *keys, *columns)
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_value")) for c in columns]))
    long = ledger.select(*keys, named.alias("_m")).select(*keys, "_m.*").filter(F.col("_value").isNotNull())
    group = [*keys, "_name"]
    margin = 3.0 / accuracy
    ends = F.percentile_approx("_value", [max(0.0, 0.5 - margin), min(1.0, 0.5 + margin)], accuracy)
    brackets = long.groupBy(*group).agg(ends.alias("_ends"), F.count(F.lit(1)).alias("_n"))
    left, right = long.alias("v"), brackets.alias("b")
    placed = left.join(right, reduce(lambda x, y: x & y, [F.col(f"v.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group])).select(
        *[F.col(f"v.{c}").alias(c) for c in group], "_value", "_ends", "_n"
    )
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    inside = placed.filter(F.col("_value") <= high).groupBy(
        *group, "_n", F.when(F.col("_value") >= low, F.col("_value")).alias("_value")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    upto = F.sum("_rows").over(Window.partitionBy(*group).orderBy(F.col("_value").asc_nulls_first()))
    first, second = F.floor((F.col("_n") + 1) / 2), F.ceil((F.col("_n") + 1) / 2)
    ranked = inside.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_rows"))
    holds = lambda nth: F.max(F.when((F.col("_from") < nth) & (nth <= F.col("_upto")), F.col("_value")))
    medians = ranked.groupBy(*group).agg(((holds(first) + holds(second)) / 2).alias("_median"))
    # The configurations themselves come from the ledger, so that an all-null one is not lost.
    blank = ledger.select(*keys).distinct().select(*keys, F.lit(None).cast("string").alias("_name"), F.lit(None).cast("double").alias("_median"))
    return medians.unionByName(blank).groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == c, F.col("_median"))).alias(c) for c in columns]
    )


def null_aware_total(round_no: int) -> Column:
    """detect + fix + explanation of one round, where a missing explanation counts nothing."""
    r = round_no
    return F.col(f"detect_eval_{r}") + F.col(f"fix_eval_{r}") + F.coalesce(F.col(f"explanation_{r}"), F.lit(0.0))


def with_totals(medians: DataFrame) -> DataFrame:
    rounds = [r for r in (1, 2) if f"detect_eval_{r}" in medians.columns]
    return medians.withColumns({f"total_{r}": null_aware_total(r) for r in rounds})


def order_of(column: str, order: dict[str, int]) -> Column:
    pairs = [F.lit(x) for item in order.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col(column))


def sort_by_rank_map(df: DataFrame) -> DataFrame:
    """Report order: scenario, then predictor, then optimisation level."""
    return df.orderBy(
        order_of("scenario", SCENARIO_ORDER), order_of("variant", VARIANT_ORDER), order_of("opt", OPT_ORDER)
    )


def join_pair_runs(medians: DataFrame, time: str, keys: tuple[str, ...] = ("experiment", "scenario", "variant")) -> DataFrame:
    """One row per scenario and predictor with the time of each optimisation level beside the others."""
    levels = [o for o in OPT_ORDER if o != "original"]
    return medians.groupBy(*keys).agg(*[F.max(F.when(F.col("opt") == o, F.col(time))).alias(o) for o in levels])


def speedup_ratio(paired: DataFrame) -> DataFrame:
    return paired.withColumns(
        {"speedup": F.col("naive") / F.col("opt"), "proxy_speedup": F.col("naive") / F.col("proxy_opt")}
    )


def original_rows(medians: DataFrame, time: str, by_opt: bool = False) -> DataFrame:
    """Median time of the plain pipeline per predictor (and per level), as report rows."""
    keys = ["variant", "opt"] if by_opt else ["variant"]
    rows = medians.groupBy(*keys).agg(F.median(time).alias("time"))
    opt = F.col("opt") if by_opt else F.lit("original")
    return rows.select("variant", F.lit("original").alias("scenario"), opt.alias("opt"), "time")


def run_report(ledger: DataFrame, columns: list[str]) -> DataFrame:
    """Medians, totals and speed-ups per configuration: one row per (experiment, scenario, variant, opt)."""
    totals = with_totals(median_by_config(ledger, columns))
    paired = speedup_ratio(join_pair_runs(totals, "total_1"))
    keys = ["experiment", "scenario", "variant"]
    out = totals.join(paired.select(*keys, "naive"), keys)
    return out.withColumn("speedup_1", F.col("naive") / F.col("total_1")).drop("naive")
