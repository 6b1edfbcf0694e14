"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Operators run alone; the three analyses run both ways on the same stored base pipeline: ``<name>`` computes
what changed, ``<name>_full`` computes everything again, and both must give the same report.  Each number is a median
after one warm-up (of ``BENCH_REPEATS`` runs; one run for ``_full``).  Every ``_second`` applies a label edit first.
``value`` is the sum over the operators and incremental analyses; ``recomputed_rows`` says what the edits reached.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from dataprobe.catalog import analyses as A  # noqa: E402
from dataprobe.catalog import runnable  # noqa: E402
from dataprobe.catalog.registry import SEED, VOCAB_MIN, doc_features, vec_split  # noqa: E402
from dataprobe.catalog.texts import lexicon  # noqa: E402
from dataprobe.operators import wordfix  # noqa: E402
from dataprobe.operators.impact import impact_set  # noqa: E402
from dataprobe.plans import fairness, full, mislabel, robustness  # noqa: E402
from dataprobe.plans.retrieval import extend, relabel  # noqa: E402
from dataprobe.session import clear_scratch, local_session, written  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

OPERATORS = [
    "join_users_tweets", "weak_label", "weak_label_diff", "equality_check", "ml_text_features", "knn_retrieve", "knn_retrieve_large",
    "knn_vote", "knn_shapley", "knn_shapley_truncated", "slice_find", "sample_exact_fraction", "corruption_diff", "repair_text",
    "lexicon_translate", "udf_cached_transform", "enrich_incremental", "rag_classify", "flagship", "ml_logistic", "ml_mlp", "explain_proxy", "robustness_report_ml", "fairness_report_ml", "run_report",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def median_seconds(run, repeats: int = REPEATS) -> float:
    run()
    spent = []
    for _ in range(repeats):
        start = time.perf_counter()
        run()
        spent.append(time.perf_counter() - start)
    return round(statistics.median(spent), 3)


def same_report(one, other) -> None:
    """Both reports agree in the columns they share, to nine decimals."""
    names = [c for c in one.columns if c in other.columns]
    rounded = [[round(v, 9) if isinstance(v, float) else v for v in df.select(names).first()] for df in (one, other)]
    if rounded[0] != rounded[1]:
        raise AssertionError(f"incremental and full reports differ: {names} {rounded}")


def analyses(spark) -> tuple[dict, dict, dict, dict]:
    """The analyses as callables, incremental and full, over one stored base pipeline; the pairs of reports that must
    agree; rows that the edits reach."""
    train, vectors, test, base = A._prepared(spark, FOLDER)
    train, test = written(train, "train"), written(test, "test")
    changed, new = A._label_edit(train)
    new = written(new, "new_labels")
    rebased = relabel(base, changed, new)
    vocab = written(wordfix.vocab_counts(train, "text", VOCAB_MIN), "vocab")
    enrich = A._translate(written(lexicon(spark, FOLDER), "lexicon"))
    old = train.select("train_id", "label")
    featurize_train = lambda rows: doc_features(rows, "train_id")

    by_vote = A._by_vote(vectors)
    update = lambda diffs, needed: extend(diffs, needed, changed, vectors, new, A.features_of)

    robust = robustness.robustness_round(test, vocab, by_vote, 0.1, SEED)
    fair = fairness.fairness_round(test, base.predictions, A.FEATURES, enrich, by_vote)
    vtrain, vtest = vec_split(spark, FOLDER)
    vtest = vtest.withColumnRenamed("label", "truth")
    vlabels, vtruth = vtrain.select("train_id", "label"), vtest.select("prediction_id", "truth")
    vbase = A.classify_vectors(vtest, vtrain)
    wrong = mislabel.mislabel_round(vtrain, vtest)

    def robustness_first():
        state = robustness.robustness_round(test, vocab, by_vote, 0.1, SEED)
        drain(robustness.robustness_report(state, base.predictions, test))

    def robustness_second():
        drain(robust_again())

    def fairness_first():
        state = fairness.fairness_round(test, base.predictions, A.FEATURES, enrich, by_vote)
        drain(fairness.fairness_report(state, base.predictions, test))

    def fairness_second():
        drain(fair_again())

    def mislabel_first():
        drain(mislabel.mislabel_report(mislabel.mislabel_round(vtrain, vtest), vbase, vlabels, vtruth))

    value_index = mislabel.value_index(vtrain, vtest)
    # the edit of the vector analysis turns a twentieth of the labels
    turned = F.pmod(F.xxhash64("train_id"), F.lit(20)) == 0
    vchanged = written(vlabels.filter(turned).select("train_id"), "changed")
    vnew = written(vlabels.select("train_id", F.when(turned, 1 - F.col("label")).otherwise(F.col("label")).alias("label")), "new")

    def mislabel_second_report():
        state = mislabel.mislabel_round_from_index(value_index, vnew, vtruth)
        return mislabel.mislabel_report(state, relabel(vbase, vchanged, vnew), vnew, vtruth)

    def mislabel_second_full():
        train_now = vtrain.drop("label").join(vnew, "train_id")
        return full.mislabel_full(vtest, train_now, mislabel.mislabel_round(train_now, vtest), vtruth)

    def mislabel_ml():
        before, after = mislabel.model_what_if(vtrain, vtest, wrong, "logistic")
        drain(before.join(after.withColumnRenamed("prediction", "after"), "prediction_id"))

    robust_again = lambda: robustness.robustness_report(
        robustness.robustness_recheck(robust, lambda diffs: relabel(diffs, changed, new)), rebased.predictions, test
    )
    fair_again = lambda: fairness.fairness_report(fairness.fairness_recheck(fair, test, rebased.predictions, enrich, update), rebased.predictions, test)

    quick = {
        "base_pipeline": lambda: A._prepared(spark, FOLDER),
        "rule_edit": lambda: relabel(base, *A._label_edit(train)),
        "robustness_first": robustness_first,
        "robustness_second": robustness_second,
        "fairness_first": fairness_first,
        "fairness_second": fairness_second,
        "mislabel_first": mislabel_first,
        "mislabel_second": lambda: drain(mislabel_second_report()),
        "mislabel_ml_proxy": mislabel_ml,
        "mislabel_fix_only": lambda: drain(mislabel.mislabel_report(wrong, vbase, vlabels, vtruth)),
    }
    slow = {
        "rule_edit_full": lambda: drain(full.predict_all(test.select("prediction_id", "text"), train, new, A.features_of, featurize_train)),
        "robustness_full": lambda: drain(
            full.robustness_full_report(full.robustness_full(test, train, old, vocab, A.features_of, featurize_train), test)
        ),
        "fairness_full": lambda: drain(full.fairness_full(test, train, old, A.FEATURES, enrich, A.features_of, featurize_train)),
        "mislabel_full": lambda: drain(full.mislabel_full(vtest, vtrain, mislabel.mislabel_round(vtrain, vtest), vtruth)),
        "mislabel_second_full": lambda: drain(mislabel_second_full()),
    }
    agree = {
        "robustness_second": (robust_again, lambda: full.robustness_full_report(full.robustness_full(test, train, new, vocab, A.features_of, featurize_train), test)),
        "fairness_second": (fair_again, lambda: full.fairness_full(test, train, new, A.FEATURES, enrich, A.features_of, featurize_train)),
        "mislabel_second": (mislabel_second_report, mislabel_second_full),
    }
    reached = {
        "rule_edit_labels": changed.count(), "rule_edit_predictions": impact_set(base.index, changed).count(), "vector_edit_predictions": impact_set(vbase.index, vchanged).count(),
        "test_rows": test.count(), "vector_test_rows": vtest.count(),
    }
    return quick, slow, agree, reached


def main() -> None:
    spark = local_session(CPUS, "bench")
    registry = runnable()
    times = {name: median_seconds(lambda n=name: drain(registry[n](spark, FOLDER))) for name in OPERATORS}
    quick, slow, agree, reached = analyses(spark)
    for one, other in agree.values():
        same_report(one(), other())
    times.update({name: median_seconds(run) for name, run in quick.items()})
    total = round(sum(times.values()), 3)
    times.update({name: median_seconds(run, 1) for name, run in slow.items()})
    ratios = {
        "rule_edit": "rule_edit_full", "robustness_first": "robustness_full", "robustness_second": "robustness_full",
        "fairness_first": "fairness_full", "fairness_second": "fairness_full", "mislabel_first": "mislabel_full", "mislabel_second": "mislabel_second_full",
    }
    sf = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    line = {
        "metric": "sum of median seconds over operators and incremental analyses",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "recomputed_rows": reached,
        "full_over_incremental": {k: round(times[v] / times[k], 2) for k, v in ratios.items()},
    }
    clear_scratch(spark)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
