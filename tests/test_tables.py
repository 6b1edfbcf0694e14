import pytest
from conftest import rows
from pyspark.sql import functions as F

from dataprobe.functions.labels import RuleSet
from dataprobe.operators import collection, keyed, labels, lookup, memo, noise, ordering, runs
from dataprobe.schemas import LEDGER_ROUND_1, require
from dataprobe.session import scratch_path
from dataprobe.sources.tables import read_csv, records_to_table, scan_run_csv, sink_csv


def table(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_patch_rows(spark):
    base = table(spark, [(1, "a"), (2, "b"), (3, None)], "id long, v string")
    new = table(spark, [(2, None), (3, "c"), (9, "z")], "id long, v string")
    assert rows(keyed.patch_rows(base, new, "id", "v")) == [(1, "a"), (2, None), (3, "c")]
    assert rows(keyed.patch_rows(base, new.limit(0), "id", "v")) == rows(base)


def test_flip_and_gather_tolerate_repeated_ids(spark):
    base = table(spark, [(1, 0), (2, 1), (3, 1)], "id long, y int")
    ids = table(spark, [(2,), (2,)], "id long")
    assert rows(keyed.flip_labels(base, ids, "id", "y")) == [(1, 0), (2, 0), (3, 1)]
    assert rows(keyed.gather_rows(base, ids, "id")) == [(2, 1)]
    truth = base.select("id", (F.col("y") == 1).alias("y"))
    assert rows(keyed.flip_labels(truth, ids, "id", "y")) == [(1, False), (2, False), (3, True)]


def test_equality_check_counts_repeats(spark):
    a = table(spark, [(1,), (1,), (2,), (None,)], "x long")
    b = table(spark, [(1,), (2,), (2,), (None,)], "x long")
    assert tuple(keyed.equality_check(a, b).first()) == (1, 1, False)
    assert tuple(keyed.equality_check(a, a.repartition(3)).first()) == (0, 0, True)
    assert tuple(keyed.equality_check(a.limit(0), a.limit(0)).first()) == (0, 0, True)


@pytest.mark.parametrize("fraction", [0.0, 0.001, 0.1, 0.5, 0.9999, 1.0])
def test_sample_exact(spark, fraction):
    df = spark.range(777)
    got = rows(ordering.sample_exact(df, "id", fraction, 5))
    assert len(got) == int(777 * fraction)
    assert got == rows(ordering.sample_exact(df.repartition(5), "id", fraction, 5))


def test_sample_exact_of_nothing(spark):
    assert ordering.sample_exact(spark.range(0), "id", 0.5, 5).count() == 0


def test_sample_exact_when_all_draws_share_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_SAMPLE_BUCKETS", 1)
    assert ordering.sample_exact(spark.range(100), "id", 0.37, 5).count() == 37


def test_row_ids_by_ranges_equal_one_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100003).alias("k"), F.col("id").alias("v"))
    one = rows(ordering.assign_row_id(df, "k"))
    assert one == rows(ordering.assign_row_id(df.repartition(3), "k", rows_per_bucket=90))
    words = df.select(F.concat(F.lit("w"), F.col("k").cast("string")).alias("k"))
    assert rows(ordering.assign_row_id(words, "k")) == rows(ordering.assign_row_id(words, "k", rows_per_bucket=100))


def test_corruption_repeats_and_hits_the_exact_share(spark):
    df = table(spark, [(i, f"the north bottom of number {i}") for i in range(200)] + [(200, ""), (201, None)], "id long, text string")
    once = rows(noise.corrupt_text(df, "id", "text", 0.25, 9))
    assert once == rows(noise.corrupt_text(df.repartition(6), "id", "text", 0.25, 9))
    assert noise.corrupted_sample(df, "id", "text", 0.25, 9).count() == 50
    diff = rows(noise.corruption_diff(df, "id", "text", 0.25, 9))
    assert diff == [r for r in once if r not in set(rows(df))]
    assert noise.corruption_diff(df, "id", "text", 0.0, 9).count() == 0


def test_label_diff_equals_full_recompute(spark):
    rules = RuleSet(positives=("a", "b"), negatives=("c",))
    df = table(spark, [(i, t) for i, t in enumerate(["a", "b", "ab", "bc", "d", "bd", None])], "id long, text string")
    old = labels.weak_label(df, "text", rules)
    diff, patched = labels.label_diff(old, "id", "text", rules, 1, "bd")
    full = labels.weak_label(df, "text", rules.replace(1, "bd"))
    assert keyed.equality_check(patched, full).first()["equal"]
    assert {r["id"] for r in diff.collect()} == {1, 2, 3}
    assert keyed.equality_check(labels.patch_labels(old, diff, "id").select("id", "label"), full.select("id", "label")).first()["equal"]


def test_cached_transform_calls_the_function_once_per_missing_text(spark):
    known = memo.memo_rows(table(spark, [("a", "A!")], "input string, output string"), 1)
    asked = table(spark, [(1, "a"), (2, "b"), (3, "b"), (4, "c")], "id long, text string")
    seen = []

    def upper(missing):
        seen.append(missing.count())
        return missing.select("input_hash", F.upper("input").alias("output"))

    out, after = memo.cached_transform(asked, "id", "text", known, upper)
    assert rows(out) == [(1, "A!"), (2, "B"), (3, "B"), (4, "C")] and seen == [2]
    assert rows(after.select("input", "output")) == [("a", "A!"), ("b", "B"), ("c", "C")]
    again, _ = memo.cached_transform(asked, "id", "text", after, upper)
    assert rows(again) == rows(out) and seen == [2, 0]


def test_spread_lookup_deals_hot_keys_and_loses_nothing(spark):
    data = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    data = data.unionByName(table(spark, [(1000, None), (1001, "absent")], "id long, k string"))
    dim = data.select("k").distinct().filter("k <> 'absent'").withColumn("v", F.upper("k"))
    hot = lookup.hot_keys(data.select("k"), "k", 8)
    assert dict(rows(hot))["hot"] == 3 and hot.count() <= lookup.HOT_KEYS
    got = lookup.spread_lookup(data, dim, "k", ["id"], hot)
    assert rows(got.select("id", "k", "v")) == rows(data.join(dim, "k", "left").select("id", "k", "v"))


def test_medians_equal_the_built_in_ones(spark):
    data = spark.range(4000).select(
        (F.col("id") % 3).alias("g"), F.when(F.col("id") % 4 == 0, 7.0).otherwise((F.col("id") * 7919 % 1009) / 7).alias("a"),
        F.when(F.col("id") % 3 == 1, None).otherwise(F.col("id").cast("double")).alias("b"),
    )
    want = rows(data.groupBy("g").agg(F.median("a").alias("a"), F.median("b").alias("b")))
    assert rows(runs.median_by_config(data, ["a", "b"], ("g",))) == want
    assert rows(runs.median_by_config(data, ["a", "b"], ("g",), accuracy=20)) == want
    few = data.limit(7)
    assert rows(runs.median_by_config(few, ["a", "b"], ("g",))) == rows(few.groupBy("g").agg(F.median("a").alias("a"), F.median("b").alias("b")))


def test_memo_keeps_the_highest_version(spark):
    pairs = lambda *p: table(spark, list(p), "input string, output string")
    old, new = memo.memo_rows(pairs(("a", "1"), ("b", "1")), 1), memo.memo_rows(pairs(("a", "2")), 2)
    both = memo.cache_table_upsert(old, new)
    assert rows(both.select("input", "output", "version")) == [("a", "2", 2), ("b", "1", 1)]
    assert rows(memo.latest_version(old.unionByName(new))) == rows(both)


def test_memo_survives_a_restart(spark):
    path = scratch_path(spark, "memo")
    memo.cache_table_write(memo.memo_rows(table(spark, [("a", "1")], "input string, output string"), 1), path)
    memo.cache_table_write(memo.memo_rows(table(spark, [("a", "2")], "input string, output string"), 2), path)
    assert rows(memo.latest_version(memo.cache_table_read(spark, path)).select("output")) == [("2",)]


def test_enrich_incremental_equals_first_round(spark):
    source = table(spark, [(i, f"t{i}") for i in range(10)], "id long, text string")
    upper = lambda df: df.select("id", F.upper("text").alias("text"))
    ids = lambda *n: table(spark, [(i,) for i in n], "id long")
    done = memo.first_round(ids(1, 2, 3), source, upper, "id", "text")
    calls = []

    def counted(df):
        calls.append(rows(df.select("id")))
        return upper(df)

    got = memo.enrich_incremental(ids(2, 3, 4), source, done, counted, "id", "text")
    assert rows(got) == rows(memo.first_round(ids(2, 3, 4), source, upper, "id", "text")) and calls == [[(4,)]]


def test_collection_update_keeps_other_keys_and_the_base(spark):
    texts = table(spark, [(1, "x", "en"), (2, "y", "fr")], "k long, t string, lang string")
    vectors = table(spark, [(1, [0.0]), (2, [1.0])], "k long, v array<float>")
    c = collection.vector_table_load(texts, vectors, "k", "t", "v", ["k", "lang"])
    updates = table(spark, [("2", {"lang": "de"})], "id string, metadata map<string,string>")
    shown = lambda df: {r["id"]: r["metadata"] for r in df.collect()}
    before = shown(c)
    assert shown(collection.vector_table_update(c, updates)) == {"1": {"k": "1", "lang": "en"}, "2": {"k": "2", "lang": "de"}}
    assert shown(c) == before


def test_require_names_the_missing_column(spark):
    with pytest.raises(ValueError, match="missing"):
        require(spark.range(1), "op", "nope")


def test_ledger_files(spark, tmp_path):
    cols = ",".join(LEDGER_ROUND_1)
    for run, base in (("exp1_fairness_llm_naive", 10), ("exp1_mislabel_ml_proxy_opt", 1)):
        lines = [",".join([str(base * i)] * 9 + ([""] if "naive" in run else [str(i)])) for i in (1, 2, 3)]
        (tmp_path / f"{run}.csv").write_text("\n".join([cols, *lines]) + "\n")
    ledger = scan_run_csv(spark, str(tmp_path), LEDGER_ROUND_1)
    totals = {r["opt"]: r for r in runs.with_totals(runs.median_by_config(ledger, list(LEDGER_ROUND_1))).collect()}
    assert totals["naive"]["explanation_1"] is None and totals["naive"]["total_1"] == 40.0
    assert totals["proxy_opt"]["total_1"] == 6.0 and totals["proxy_opt"]["scenario"] == "mislabel"
    ordered = [r["scenario"] for r in runs.sort_by_rank_map(ledger.select("scenario", "variant", "opt").distinct()).collect()]
    assert ordered == ["fairness", "mislabel"]
    ragged = keyed.union_ragged(ledger.select("opt"), ledger.select("opt", "explanation_1"))
    assert ragged.count() == 12


def test_csv_and_records_round_trip(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    df = records_to_table(spark, [(1.5, None), (2.0, 3.0)], schema)
    path = scratch_path(spark, "x.csv")
    sink_csv(df, path)
    assert rows(read_csv(spark, path, schema)) == rows(df)


def test_scratch_has_a_folder_of_its_own(spark):
    """Written tables lie below the application's folder, which ``clear_scratch`` removes in one go."""
    from dataprobe.session import scratch_path, scratch_root

    one, other = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert one != other and all(p.startswith(scratch_root(spark) + "/") for p in (one, other))
    assert spark.sparkContext.applicationId in scratch_root(spark)


def test_strings_of_a_large_group_are_joined_in_order(spark):
    from dataprobe.operators.ordering import ordered_string_agg

    text = "".join(chr(97 + i * i % 26) for i in range(900))
    data = [(1, i, c) for i, c in enumerate(text)] + [(2, 5, "b"), (2, 1, None), (2, 3, "a"), (2, 3, "A"), (None, 1, "x"), (3, 1, None)]
    df = spark.createDataFrame(data, "g long, pos long, c string").repartition(6)
    for size in (100, 10**6):
        assert dict(rows(ordered_string_agg(df, "g", "pos", "c", rows_per_range=size))) == {1: text, 2: "Aab", None: "x", 3: ""}


def test_frequencies_follow_texts_that_come_and_go(spark):
    import math

    from dataprobe.operators import features

    texts = [(1, "a b b"), (2, "A c"), (3, None), (4, " "), (5, "b d d"), (6, "a")]
    df = spark.createDataFrame(texts, "id long, text string")
    part = lambda *ids: features.document_frequencies(df.filter(df["id"].isin(*ids)), "text")
    now = features.merged_frequencies(part(1, 2, 3, 5), added=part(4, 6), removed=part(2, 5))
    assert rows(now) == rows(part(1, 3, 4, 6)) and dict(rows(now)) == {None: 4, "a": 2, "b": 1}
    got = {(r["id"], r["token"]): r["weight"] for r in features.weighted_words(df, "id", "text", now).collect()}
    raw = {"a": math.log(5 / 3) + 1, "b": 2 * (math.log(5 / 2) + 1)}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert abs(got[1, "a"] - raw["a"] / norm) < 1e-12 and abs(got[1, "b"] - raw["b"] / norm) < 1e-12
    assert {k for k, _ in got} == {1, 2, 5, 6}


def test_membership_filter_holds_every_key(spark):
    from dataprobe.operators.lookup import membership
    from dataprobe.session import written

    keys = written(spark.range(3000).selectExpr("concat('k', id) as k"), "keys")
    may_hold = membership(keys, "k")
    assert keys.filter(may_hold(keys["k"])).count() == 3000
    others = spark.range(3000).selectExpr("concat('other', id) as k")
    assert others.filter(may_hold(others["k"])).count() < 300
    nothing = membership(keys.limit(0), "k")
    assert keys.filter(nothing(keys["k"])).count() == 0
