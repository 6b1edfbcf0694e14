"""Scans, sinks, projections, filters, joins, sets, orders and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.catalog.registry import (
    DOC_RULES, EDITED_INDEX, EDITED_RULE, LEDGER_ALL, LEDGER_ONE, R1, R2, R2_NEW, R3, SEED, SQL_DOC_TEST, SQL_DOC_TRAIN,
    SQL_LEDGER, SQL_MEDIANS, doc_test, doc_train, ledger, query, table, tweets, u, users, with_,
)
from dataprobe.functions.labels import binarize, class_name
from dataprobe.operators import keyed, labels, ordering, runs
from dataprobe.schemas import ledger_schema
from dataprobe.session import scratch_path
from dataprobe.sources.tables import read_csv, read_table, scan_run_csv, sink_csv, sink_parquet

LISTED = ["src0", "src1", "src2", "src3", "src4"]
IN_LISTED = "('src0', 'src1', 'src2', 'src3', 'src4')"


@query("scan_parquet", "select doc_id, lang, source, n_chars from documents")
def scan_parquet(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("sink_parquet", "select doc_id as user_id, lang, source as country from documents")
def sink_and_read_parquet(spark, d):
    path = scratch_path(spark, "users.parquet")
    sink_parquet(users(spark, d), path)
    return read_table(spark, path)


@query(
    "sink_csv",
    with_(SQL_LEDGER) + "select original_pipeline, detect_eval_1, fix_eval_1, explanation_1 from ledger",
)
def sink_and_read_csv(spark, d):
    path = scratch_path(spark, "ledger.csv")
    sink_csv(ledger(spark, d).select(LEDGER_ONE), path)
    return read_csv(spark, path, ledger_schema(LEDGER_ONE))


@query(
    "scan_run_csv",
    with_(SQL_LEDGER) + "select experiment, scenario, variant, opt, original_pipeline, detect_eval_1, fix_eval_1, explanation_1 from ledger",
)
def scan_run_csv_query(spark, d):
    """One CSV folder per configuration, read back with the configuration taken from the folder names."""
    base = scratch_path(spark, "runs")
    named = ledger(spark, d).withColumn("run", F.concat(F.concat_ws("_", "experiment", "scenario", "variant", "opt"), F.lit(".csv")))
    named.select("run", *LEDGER_ONE).write.partitionBy("run").option("header", True).csv(base)
    return scan_run_csv(spark, base, LEDGER_ONE)


@query(
    "records_to_table",
    "select doc_id as user_id, lang, source as country, text as tweet, (quality = 1) as anhedonia from documents join labels using (doc_id)",
)
def records_to_table_query(spark, d):
    """The expert set as a declared table: columns in schema order and type."""
    t = doc_test(spark, d)
    return t.select(F.col("prediction_id").alias("user_id"), "lang", F.col("source").alias("country"), F.col("text").alias("tweet"),
                    F.col("judged").alias("anhedonia"))


@query("filter_isin", f"select doc_id as user_id, lang, source as country from documents where source in {IN_LISTED}")
def filter_isin(spark, d):
    return users(spark, d).filter(F.col("country").isin(LISTED))


@query("project_columns", "select doc_id as user_id, lang, source as country, text as tweet from documents")
def project_columns(spark, d):
    return users(spark, d).join(tweets(spark, d), "user_id").select("user_id", "lang", "country", "tweet")


@query(
    "filter_mask_compound",
    "select doc_id, quality, toxic from labels where (quality = 1 and toxic is distinct from quality) or not (quality = 1 or toxic = 0)",
)
def filter_mask_compound(spark, d):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, d, "labels").filter(((q == 1) & ~t.eqNullSafe(q)) | ~((q == 1) | (t == 0))).select("doc_id", "quality", "toxic")


@query(
    "filter_changed_text",
    "select * from (select doc_id, replace(replace(replace(replace(text, 'n', 'm'), 'b', 'v'), 't', 'r'), 'o', 'p') as slipped, text from documents)"
    " where slipped <> text",
)
def filter_changed_text(spark, d):
    from dataprobe.functions.text import keyboard_substitute

    before = table(spark, d, "documents").select("doc_id", "text", F.col("text").alias("slipped"))
    after = before.withColumn("slipped", keyboard_substitute("text"))
    return keyed.changed_rows(before, after, "doc_id", "slipped").select("doc_id", "slipped", "text")


@query("map_label_names", with_(SQL_DOC_TEST) + "select prediction_id, judged, case when judged then 'anhedonia' else 'regular' end as class_name from doc_test")
def map_label_names(spark, d):
    return doc_test(spark, d).select("prediction_id", "judged", class_name("judged", "anhedonia", "regular").alias("class_name"))


@query(
    "binarize_label",
    with_(SQL_DOC_TEST) + "select prediction_id, (not judged)::int as encoded, (case when judged then 0 else 1 end)::int as encoded_name from doc_test",
)
def binarize_label(spark, d):
    names = class_name("judged", "anhedonia", "regular")
    return doc_test(spark, d).select(
        "prediction_id", binarize("judged", (True, False)).alias("encoded"), binarize(names, ("anhedonia", "regular")).alias("encoded_name")
    )


@query(
    "flip_labels",
    "select l.doc_id, case when d.doc_id is not null then 1 - quality else quality end as quality from labels l"
    " left join (select doc_id from documents where lang = 'fr') d on l.doc_id = d.doc_id",
)
def flip_labels(spark, d):
    ids = table(spark, d, "documents").filter(F.col("lang") == "fr").select("doc_id")
    return keyed.flip_labels(table(spark, d, "labels").select("doc_id", "quality"), ids, "doc_id", "quality")


@query("gather_rows", "select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels where toxic = 1)")
def gather_rows(spark, d):
    ids = table(spark, d, "labels").filter(F.col("toxic") == 1).select("doc_id")
    return keyed.gather_rows(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ids, "doc_id")


@query(
    "patch_rows",
    "select d.doc_id, case when l.doc_id is not null then l.quality else 0 - d.n_chars end as score from documents d left join labels l on d.doc_id = l.doc_id",
)
def patch_rows(spark, d):
    base = table(spark, d, "documents").select("doc_id", (F.lit(0) - F.col("n_chars")).alias("score"))
    new = table(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("score"))
    return keyed.patch_rows(base, new, "doc_id", "score")


@query("assign_row_id", "select doc_id, row_number() over (order by doc_id) - 1 as row_id from labels")
def assign_row_id(spark, d):
    return ordering.assign_row_id(table(spark, d, "labels").select("doc_id"), "doc_id")


@query(
    "derive_columns",
    "select doc_id as test_id, text as before_translation, null::varchar as tweet, 'original' as stage, n_chars::float as n_chars from documents",
)
def derive_columns(spark, d):
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("test_id"), F.col("text").alias("before_translation"), F.lit(None).cast("string").alias("tweet"),
        F.lit("original").alias("stage"), F.col("n_chars").cast("float"),
    )


@query(
    "null_aware_total",
    with_(SQL_LEDGER) + "select experiment, scenario, variant, opt, round(detect_eval_1 + fix_eval_1 + coalesce(explanation_1, 0), 6) as total_1,"
    " round(detect_eval_2 + fix_eval_2 + coalesce(explanation_2, 0), 6) as total_2 from ledger",
)
def null_aware_total(spark, d):
    rows = runs.with_totals(ledger(spark, d))
    return rows.select("experiment", "scenario", "variant", "opt", F.round("total_1", 6).alias("total_1"), F.round("total_2", 6).alias("total_2"))


@query(
    "join_users_tweets",
    f"select d.doc_id as user_id, lang, source as country, t.tweet from documents d join (select doc_id, text as tweet from documents) t"
    f" on d.doc_id = t.doc_id where source in {IN_LISTED}",
)
def join_users_tweets(spark, d):
    return labels.join_users_tweets(users(spark, d), tweets(spark, d), LISTED)


@query(
    "join_users_tweets_fanout",
    "select a.conv_id as user_id, a.role as lang, cast(a.turn as varchar) as country, b.text as tweet from conversations a join conversations b using (conv_id)",
)
def join_users_tweets_fanout(spark, d):
    c = table(spark, d, "conversations")
    left = c.select(F.col("conv_id").alias("user_id"), F.col("role").alias("lang"), F.col("turn").cast("string").alias("country"))
    return labels.join_users_tweets(left, c.select(F.col("conv_id").alias("user_id"), F.col("text").alias("tweet")))


def _wanted(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("lang") != "en").select(F.col("doc_id").alias("test_id"))


def _done(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("source").isin(LISTED)).select(F.col("doc_id").alias("test_id"), "source")


@query("join_anti_not_done", f"select doc_id as test_id from documents where lang <> 'en' and source not in {IN_LISTED}")
def join_anti_not_done(spark, d):
    return keyed.drop_rows(_wanted(spark, d), _done(spark, d), "test_id")


@query("join_reuse_done", f"select doc_id as test_id, source from documents where lang <> 'en' and source in {IN_LISTED}")
def join_reuse_done(spark, d):
    return _wanted(spark, d).join(_done(spark, d), "test_id")


@query("join_intersect_ids", f"select doc_id as test_id from documents where lang <> 'en' and source in {IN_LISTED}")
def join_intersect_ids(spark, d):
    return keyed.gather_rows(_wanted(spark, d), _done(spark, d), "test_id")


@query("accuracy", "select avg((quality = toxic)::int::double) as accuracy from labels")
def accuracy(spark, d):
    return keyed.accuracy(table(spark, d, "labels"), "quality", "toxic")


@query(
    "slice_accuracy",
    "select avg((quality = 1)::int::double) as accuracy, avg(case when lang = 'fr' then (quality = 1)::int::double end) as slice_accuracy"
    " from documents join labels using (doc_id)",
)
def slice_accuracy(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").withColumn("expected", F.lit(1))
    return keyed.accuracy(rows, "quality", "expected", F.col("lang") == "fr")


@query("distinct_values", with_(SQL_LEDGER) + "select distinct scenario, variant from ledger")
def distinct_values(spark, d):
    return ledger(spark, d).select("scenario", "variant").distinct()


_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in LEDGER_ALL)


@query("median_by_config", with_(SQL_LEDGER, SQL_MEDIANS) + f"select experiment, scenario, variant, opt, {_ROUNDED} from med")
def median_by_config(spark, d):
    med = runs.median_by_config(ledger(spark, d), LEDGER_ALL)
    return med.select("experiment", "scenario", "variant", "opt", *[F.round(c, 6).alias(c) for c in LEDGER_ALL])


_SQL_TOTAL = "total as (select *, detect_eval_1 + fix_eval_1 + coalesce(explanation_1, 0) as total_1 from med)"
_SQL_PAIRS = """pairs as (select experiment, scenario, variant, max(case when opt = 'naive' then total_1 end) as naive,
  max(case when opt = 'opt' then total_1 end) as opt, max(case when opt = 'proxy_opt' then total_1 end) as proxy_opt from total group by 1, 2, 3)"""


def _totals(spark, d) -> DataFrame:
    return runs.with_totals(runs.median_by_config(ledger(spark, d), LEDGER_ALL))


@query(
    "join_pair_runs",
    with_(SQL_LEDGER, SQL_MEDIANS, _SQL_TOTAL, _SQL_PAIRS)
    + "select experiment, scenario, variant, round(naive, 6) as naive, round(opt, 6) as opt, round(proxy_opt, 6) as proxy_opt from pairs",
)
def join_pair_runs(spark, d):
    p = runs.join_pair_runs(_totals(spark, d), "total_1")
    return p.select("experiment", "scenario", "variant", *[F.round(c, 6).alias(c) for c in ("naive", "opt", "proxy_opt")])


@query(
    "speedup_ratio",
    with_(SQL_LEDGER, SQL_MEDIANS, _SQL_TOTAL, _SQL_PAIRS)
    + "select experiment, scenario, variant, round(naive / opt, 6) as speedup, round(naive / proxy_opt, 6) as proxy_speedup from pairs",
)
def speedup_ratio(spark, d):
    p = runs.speedup_ratio(runs.join_pair_runs(_totals(spark, d), "total_1"))
    return p.select("experiment", "scenario", "variant", F.round("speedup", 6).alias("speedup"), F.round("proxy_speedup", 6).alias("proxy_speedup"))


@query(
    "sort_by_rank_map",
    with_(SQL_LEDGER, SQL_MEDIANS)
    + """select experiment, scenario, variant, opt, row_number() over (order by case scenario when 'original' then 0 when 'fairness' then 1 when 'robustness' then 2 else 3 end,
      case variant when 'llm' then 0 else 1 end, case opt when 'original' then 0 when 'naive' then 1 when 'opt' then 2 else 3 end, experiment) as position from med""",
)
def sort_by_rank_map(spark, d):
    """The report order; the position column (a window over the few report rows) shows it to the check."""
    from pyspark.sql import Window

    med = runs.median_by_config(ledger(spark, d), ["detect_eval_1"])
    order = [runs.order_of("scenario", runs.SCENARIO_ORDER), runs.order_of("variant", runs.VARIANT_ORDER), runs.order_of("opt", runs.OPT_ORDER)]
    placed = med.withColumn("position", F.row_number().over(Window.orderBy(*order, "experiment")).cast("long"))
    return runs.sort_by_rank_map(placed).select("experiment", "scenario", "variant", "opt", "position")


@query(
    "run_report",
    with_(SQL_LEDGER, SQL_MEDIANS, _SQL_TOTAL, _SQL_PAIRS)
    + f"""select t.experiment, t.scenario, t.variant, t.opt, {', '.join(f'round(t.{c}, 6) as {c}' for c in LEDGER_ALL)},
      round(t.total_1, 6) as total_1, round(t.detect_eval_2 + t.fix_eval_2 + coalesce(t.explanation_2, 0), 6) as total_2,
      round(p.naive / t.total_1, 6) as speedup_1 from total t join pairs p using (experiment, scenario, variant)""",
)
def run_report(spark, d):
    r = runs.run_report(ledger(spark, d), LEDGER_ALL)
    return r.select("experiment", "scenario", "variant", "opt", *[F.round(c, 6).alias(c) for c in [*LEDGER_ALL, "total_1", "total_2", "speedup_1"]])


@query(
    "report_original_rows",
    with_(SQL_LEDGER, SQL_MEDIANS) + "select variant, 'original' as scenario, opt, round(median(original_pipeline), 6) as time from med group by variant, opt",
)
def report_original_rows(spark, d):
    rows = runs.original_rows(runs.median_by_config(ledger(spark, d), ["original_pipeline"]), "original_pipeline", by_opt=True)
    return rows.withColumn("time", F.round("time", 6))


@query("union_ragged", with_(SQL_LEDGER) + "select experiment, opt, detect_eval_1, null::double as detect_eval_2 from ledger where experiment = 'exp1'"
       " union all select experiment, opt, detect_eval_1, detect_eval_2 from ledger where experiment = 'exp2'")
def union_ragged(spark, d):
    rows = ledger(spark, d)
    first = rows.filter(F.col("experiment") == "exp1").select("experiment", "opt", "detect_eval_1")
    second = rows.filter(F.col("experiment") == "exp2").select("experiment", "opt", "detect_eval_1", "detect_eval_2")
    return keyed.union_ragged(first, second)


@query("union_distinct", f"select doc_id as test_id from documents where lang <> 'en' union select doc_id from documents where source in {IN_LISTED}")
def union_distinct(spark, d):
    return keyed.union_distinct(_wanted(spark, d), _done(spark, d).select("test_id"))


@query("union_all", f"select doc_id as test_id from documents where lang <> 'en' union all select doc_id from documents where source in {IN_LISTED}")
def union_all(spark, d):
    return keyed.union_all(_wanted(spark, d), _done(spark, d).select("test_id"))


@query("dedup_rows", "select distinct text from documents")
def dedup_rows(spark, d):
    return table(spark, d, "documents").select("text").dropDuplicates()


@query("label_symdiff", f"select doc_id, {R2} as old_rule, {R2_NEW} as new_rule from documents where {R2} <> {R2_NEW}")
def label_symdiff(spark, d):
    from dataprobe.functions.labels import rule_hit

    rows = table(spark, d, "documents", "doc_id").select(
        "doc_id", rule_hit("text", DOC_RULES.patterns[EDITED_INDEX]).alias("old_rule"), rule_hit("text", EDITED_RULE).alias("new_rule")
    )
    return keyed.label_symdiff(rows, "old_rule", "new_rule")


@query(
    "equality_check",
    f"""with f as (select doc_id, (({R1} or {R2_NEW}) and not {R3}) as label from documents),
      p as (select doc_id, case when {R2} <> {R2_NEW} then (({R1} or {R2_NEW}) and not {R3}) else (({R1} or {R2}) and not {R3}) end as label from documents)
      select (select count(*) from (select * from p except all select * from f)) as only_left,
             (select count(*) from (select * from f except all select * from p)) as only_right,
             not exists (select * from p except all select * from f) and not exists (select * from f except all select * from p) as equal""",
)
def equality_check(spark, d):
    """Labels maintained by diff equal labels computed anew, over the whole table."""
    docs = table(spark, d, "documents", "doc_id").select("doc_id", "text")
    old = labels.weak_label(docs, "text", DOC_RULES, "label")
    _, patched = labels.label_diff(old, "doc_id", "text", DOC_RULES, EDITED_INDEX, EDITED_RULE)
    full = labels.weak_label(docs, "text", DOC_RULES.replace(EDITED_INDEX, EDITED_RULE), "label")
    return keyed.equality_check(patched.select("doc_id", "label"), full.select("doc_id", "label"))


@query("topk_smallest", "select doc_id, n_chars from documents order by n_chars, doc_id limit 20")
def topk_smallest(spark, d):
    return ordering.topk_smallest(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 20)


@query("sort_restore_order", "select doc_id, lang, row_number() over (order by doc_id) - 1 as position from labels join documents using (doc_id)")
def sort_restore_order(spark, d):
    """Rows back in key order after a join; the position makes the order visible."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return ordering.assign_row_id(rows, "doc_id", "position").orderBy("position")


_PICK = f"row_number() over (order by {u(SEED, 'doc_id')}, doc_id) as nth, count(*) over () as n"


@query("sample_exact_fraction", f"select doc_id, lang from (select doc_id, lang, {_PICK} from documents) where nth <= floor(n * 0.1::double)")
def sample_exact_fraction(spark, d):
    return ordering.sample_exact(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.1, SEED)


@query("sample_bernoulli", f"select doc_id, lang from documents where {u(SEED, 'doc_id')} < 0.1")
def sample_bernoulli(spark, d):
    return ordering.sample_bernoulli(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.1, SEED)


@query(
    "weak_label",
    f"select doc_id, {R1} as rule_1, {R2} as rule_2, {R3} as rule_3, (({R1} or {R2}) and not {R3}) as label from documents",
)
def weak_label(spark, d):
    docs = table(spark, d, "documents", "doc_id").select("doc_id", "text")
    return labels.weak_label(docs, "text", DOC_RULES).drop("text")


@query(
    "weak_label_diff",
    f"select doc_id, {R2_NEW} as rule_2, (({R1} or {R2}) and not {R3}) as old_label, (({R1} or {R2_NEW}) and not {R3}) as label"
    f" from documents where {R2} <> {R2_NEW}",
)
def weak_label_diff(spark, d):
    docs = labels.weak_label(table(spark, d, "documents", "doc_id").select("doc_id", "text"), "text", DOC_RULES)
    diff, _ = labels.label_diff(docs, "doc_id", "text", DOC_RULES, EDITED_INDEX, EDITED_RULE)
    return diff.select("doc_id", "rule_2", "old_label", "label")


@query("weak_label_patched", f"select doc_id, {R2_NEW} as rule_2, (({R1} or {R2_NEW}) and not {R3}) as label from documents")
def weak_label_patched(spark, d):
    docs = labels.weak_label(table(spark, d, "documents", "doc_id").select("doc_id", "text"), "text", DOC_RULES)
    diff, _ = labels.label_diff(docs, "doc_id", "text", DOC_RULES, EDITED_INDEX, EDITED_RULE)
    patched = keyed.patch_rows(docs, diff, "doc_id", "label")
    return keyed.patch_rows(patched, diff, "doc_id", "rule_2").select("doc_id", "rule_2", "label")


@query(
    "label_count",
    with_(SQL_DOC_TRAIN) + f"select lang, weak, count(*) as texts from doc_train where source in {IN_LISTED} group by lang, weak",
)
def label_count(spark, d):
    """Scan, country filter, join, weak label, count: the data-preparation part of the base pipeline."""
    rows = doc_train(spark, d).filter(F.col("source").isin(LISTED))
    return rows.groupBy("lang", "weak").agg(F.count(F.lit(1)).alias("texts"))
