"""Partitioned tables with versions, and plug-in functions on nulls."""

from dataprobe.operators import predict, stored
from dataprobe.session import scratch_path

SCHEMA = "id bigint, said string"


def _rows(df):
    return sorted(map(tuple, df.select("id", "said").collect()), key=repr)


def test_upserts_touch_only_their_parts(spark):
    path = scratch_path(spark, "stored")
    first = [(i, f"a{i}") for i in range(200)] + [(None, "none")]
    assert stored.create(spark.createDataFrame(first, SCHEMA), path, "id", parts=8) == 0
    assert _rows(stored.read(spark, path, SCHEMA)) == sorted(first, key=repr)
    change = [(7, "b7"), (10**6, "new")]
    assert stored.upsert(spark.createDataFrame(change, SCHEMA), path, "id", SCHEMA) == 1
    want = {**dict(first), **dict(change)}
    assert _rows(stored.read(spark, path, SCHEMA)) == sorted(want.items(), key=repr)
    assert _rows(stored.read(spark, path, SCHEMA, version=0)) == sorted(first, key=repr)
    made = {r["n"]: (r["parts"], r["rewritten"]) for r in stored.versions(spark, path).collect()}
    assert made[0] == (8, 8) and made[1][0] == 8 and 1 <= made[1][1] <= 2
    stored.upsert(spark.createDataFrame([(None, "now")], SCHEMA), path, "id", SCHEMA)
    stored.upsert(spark.createDataFrame([], SCHEMA), path, "id", SCHEMA)
    want[None] = "now"
    assert _rows(stored.read(spark, path, SCHEMA)) == sorted(want.items(), key=repr)
    assert stored.compact(spark, path, SCHEMA) == 4
    assert _rows(stored.read(spark, path, SCHEMA)) == sorted(want.items(), key=repr)
    assert {r["n"]: r["rewritten"] for r in stored.versions(spark, path).collect()}[4] == 8
    plan = stored.read(spark, path, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_empty_stored_table(spark):
    path = scratch_path(spark, "stored")
    stored.create(spark.createDataFrame([], SCHEMA), path, "id", parts=4)
    assert _rows(stored.read(spark, path, SCHEMA)) == []
    stored.upsert(spark.createDataFrame([(1, "x"), (1, "y")], SCHEMA), path, "id", SCHEMA)
    assert _rows(stored.read(spark, path, SCHEMA)) == [(1, "x"), (1, "y")]


def test_plug_in_functions_do_not_see_nulls(spark):
    df = spark.createDataFrame([(1, "the"), (2, None), (3, "")], "id bigint, text string").coalesce(1)
    got = predict.udf_text_transform(df, "id", "text", lambda batch: [t.upper() for t in batch])
    assert sorted(map(tuple, got.collect())) == [(1, "THE"), (2, None), (3, "")]
    got = predict.udf_predictor(df, lambda batch: [len(t) for t in batch], "text", key="id")
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, None), (3, 0)]
    nothing = predict.udf_text_transform(df.filter("id = 2"), "id", "text", lambda batch: [t.upper() for t in batch])
    assert list(map(tuple, nothing.collect())) == [(2, None)]
