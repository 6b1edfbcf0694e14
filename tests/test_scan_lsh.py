"""Scans of groups that are cut into ranges, the LSH index, and the cells of the two-level search."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_neighbours import brute, direct_values, sample_points, vectors

from dataprobe.operators import lsh, ordering, pivots, scan, shapley
from dataprobe.operators.vectors import every_distance
from dataprobe.session import written


@pytest.fixture(scope="module")
def listed(spark):
    """Groups of 1 to 700 rows, one of them null, most distances tied."""
    rng, data = random.Random(5), []
    for g, n in ((1, 700), (2, 1), (3, 40), (None, 90), (4, 250)):
        data += [(g, round(rng.random(), 1), i, float(rng.randrange(-3, 4))) for i in rng.sample(range(10000), n)]
    return data, spark.createDataFrame(data, "q long, d double, i long, v double").repartition(4)


@pytest.mark.parametrize("size", [37, 100000])
def test_scans_of_cut_groups(listed, size):
    data, df = listed
    want = {}
    for g in {r[0] for r in data}:
        part = sorted((r for r in data if r[0] == g), key=lambda r: r[1:3])
        for k, r in enumerate(part):
            want[g, r[2]] = (k + 1, r[3] - part[k + 1][3] if k + 1 < len(part) else None, sum(x[3] for x in part[k:]))
    ranked = ordering.rank_by_distance(df, "q", "d", "i", size)
    assert {(r["q"], r["i"]): r["rank"] for r in ranked.collect()} == {k: v[0] for k, v in want.items()}
    diffs = ordering.adjacent_diff(ranked, "q", "v", size).collect()
    assert {(r["q"], r["i"]): r["diff"] for r in diffs} == {k: v[1] for k, v in want.items()}
    sums = ordering.suffix_sum(ranked, "q", "v", size).collect()
    assert all(abs(r["suffix"] - want[r["q"], r["i"]][2]) < 1e-9 for r in sums) and len(sums) == len(want)


def test_a_hot_group_is_cut(listed):
    _, df = listed
    cut = scan.ranged(written(df, "listed"), "q", ["d", "i"], 50)
    assert cut.groupBy("_range").count().agg(F.max("count")).first()[0] < 200
    assert cut.filter("q = 1").select("_range").distinct().count() >= 7


@pytest.mark.parametrize("k", [1, 5])
def test_exact_values_of_cut_ranks(spark, k):
    train, test = sample_points()
    rng = np.random.default_rng(3)
    y, yt = rng.integers(0, 2, len(train)), rng.integers(0, 2, len(test))
    t, q = vectors(spark, train, "train_id", y), vectors(spark, test, "test_id", yt)
    pairs = every_distance(q, t, "test_id", block=64)
    assert pairs.count() == len(train) * len(test)
    got = {r[0]: r[1] for r in shapley.values_of_all_ranks(pairs, t, q, k, rows_per_range=70).collect()}
    assert np.allclose([got[i] for i in range(len(train))], direct_values(train, y, test, yt, k), atol=1e-12)


def test_empty_sides_have_no_pairs(spark):
    train, test = sample_points(n=5, m=3)
    q, t = vectors(spark, test, "prediction_id"), vectors(spark, train, "train_id")
    assert every_distance(q.limit(0), t).count() == 0 and every_distance(q, t.limit(0)).count() == 0


# ---- approximate search ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def crowd(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24)) * 3
    train = centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 24))
    train[:1000] = train[0]  # a third of the rows are copies: one crowded bucket a table
    test = np.concatenate([centres[rng.integers(0, 40, 80)] + rng.normal(size=(80, 24)), train[:1], train[2000:2020]])
    return train, test, vectors(spark, train, "train_id").cache(), vectors(spark, test, "prediction_id").cache()


@pytest.fixture(scope="module")
def index(crowd):
    return lsh.lsh_index(crowd[2], block_rows=256)


def test_recall_and_distances(crowd, index):
    train, test, _, queries = crowd
    found = lsh.lsh_retrieve(index, queries).collect()
    exact = {(q, i) for q, _, i, _ in brute(test, train, 4)}
    got = {(r["prediction_id"], r["train_id"]): r["distance"] for r in found}
    assert len(got) == len(found) and len(exact & set(got)) >= 0.9 * len(exact)
    for (q, i), distance in got.items():
        assert abs(distance - np.sqrt(((test[q] - train[i]) ** 2).sum())) < 1e-8
    for q in {r["prediction_id"] for r in found}:
        mine = [(r["distance"], r["train_id"], r["rank"]) for r in found if r["prediction_id"] == q]
        assert sorted(mine) == sorted(mine, key=lambda m: m[2]) and [m[2] for m in sorted(mine, key=lambda m: m[2])] == list(range(1, len(mine) + 1))


def test_pairs_share_a_bucket(crowd, index, spark):
    train, test, _, queries = crowd
    h = index.hashes
    own, asked = h.buckets(train), h.probed(test)
    for r in lsh.lsh_retrieve(index, queries).collect():
        assert (asked[r["prediction_id"]] == own[r["train_id"]][:, None]).any()
    assert index.rows(spark).count() == len(train) * h.tables  # every row is indexed
    assert index.rows(spark).groupBy("bucket", "piece").count().agg(F.max("count")).first()[0] < 512


def test_lsh_of_nothing(crowd, index):
    _, _, t, q = crowd
    empty = lsh.lsh_index(t.limit(0))
    assert lsh.lsh_retrieve(empty, q).count() == 0
    assert lsh.lsh_retrieve(index, q.limit(0)).count() == 0
    assert lsh.lsh_retrieve(lsh.lsh_index(t.limit(1)), q).count() <= q.count()


def test_probes_hold_the_own_bucket():
    rng = np.random.default_rng(0)
    h, x = lsh.Hashes(6, 5, 4, 1.5, 9, 3), rng.normal(size=(50, 6))
    assert (h.probed(x)[:, :, 0] == h.buckets(x)).all() and h.probed(x).shape == (50, 5, 9)
    assert len({int(b) for b in h.probed(x[:1])[0, 0]}) == 9  # all different


# ---- cells on two levels ------------------------------------------------------------------------------------------------


def test_cells_follow_the_table_and_prune(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 6)) * 8
    train = centres[rng.integers(0, 30, 4000)] + rng.normal(size=(4000, 6)) * 0.3
    t = written(vectors(spark, train, "train_id").select("train_id", "embedding"), "t")
    q = written(t.filter("train_id % 40 = 0").withColumnRenamed("train_id", "prediction_id"), "q")
    index = pivots.pivot_index(t, block_rows=128)
    assert index.rows.count() == 4000 and index.sizes.sum() == 4000
    assert index.cells.count() > 60 and index.cells.agg(F.sum("rows")).first()[0] == 4000
    few = pivots.pivot_index(t.filter("train_id < 400"), block_rows=128)
    assert few.cells.count() < index.cells.count()
    r = pivots.compared_share(index, q, 4).first()
    assert r["pairs"] == 4000 * 100 and r["share"] < 0.35
    got = pivots.pivot_hits(index, q, 4).collect()
    best = {}
    for h in got:
        best.setdefault(h["prediction_id"], []).append((h["distance"], h["train_id"]))
    for p, found in best.items():
        want = [(d, i) for _, _, i, d in brute(train[p : p + 1], train, 4)]
        assert sorted(found)[:4] == sorted(want)
    assert len(best) == 100
    assert rows(q.limit(0)) == []
