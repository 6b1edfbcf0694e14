"""Shapley values, slices, what-ifs, reports and explanation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.catalog.registry import (
    DOC_RULES, EDITED_INDEX, EDITED_RULE, SEED, SQL_DOC_INDEX, SQL_VEC_INDEX, SQL_VEC_SPLIT, SQL_VEC_VOTE, VOCAB_MIN, doc_features,
    doc_test, doc_train, packed, query, sql_features, sql_index, sql_packed, sql_vote, table, vec_split, with_,
)
from dataprobe.catalog.texts import SQL_LEXICON, SQL_REPAIRED, lexicon, sql_rewritten
from dataprobe.operators import explain, keyed, labels, slices, wordfix
from dataprobe.operators.shapley import knn_shapley, mislabel_candidates, values_of_all_ranks
from dataprobe.operators.vectors import every_distance
from dataprobe.plans import fairness, mislabel, retrieval, robustness
from dataprobe.plans.retrieval import Retrieval, changed_labels, classify, edited_labels, relabel
from dataprobe.session import written

FEATURES = ["lang", "source"]
DIGITS = 9

# ---- values of training rows -----------------------------------------------------------------------

SQL_PAIRS = """
pr as (select te.prediction_id, tr.train_id, (tr.label = te.truth)::int::double as eq, count(*) over (partition by te.prediction_id) as n,
         row_number() over (partition by te.prediction_id order by round(list_distance(te.v, tr.v), 9), tr.train_id) as i
       from te cross join tr)"""


def sql_shapley(k: int) -> str:
    return f"""
cc as (select *, case when i = n then eq / n else (eq - lead(eq) over (partition by prediction_id order by i)) / {k} * least({k}, i) / i end as c from pr),
ss as (select *, sum(c) over (partition by prediction_id order by i rows between current row and unbounded following) as s from cc),
shap as (select train_id, round(avg(s), 9) as shapley_value from ss group by train_id)"""


def sql_truncated(k: int, last: int) -> str:
    return f"""
cc as (select *, case when i < {last} then (eq - coalesce(lead(eq) over (partition by prediction_id order by i), 0)) / {k} * least({k}, i) / i else 0 end as c from pr where i <= {last}),
ss as (select *, sum(c) over (partition by prediction_id order by i rows between current row and unbounded following) as s from cc),
shap as (select t.train_id, round(coalesce(sum(s), 0) / (select count(*) from te), 9) as shapley_value from tr t left join ss using (train_id) group by 1)"""


def _values(spark, d, epsilon: float = 0.0, **options) -> DataFrame:
    """Exact unless an error bound is given."""
    train, test = vec_split(spark, d)
    options["epsilon"] = epsilon
    values = knn_shapley(train, test.withColumnRenamed("prediction_id", "test_id"), **options)
    return values.select("train_id", F.round("shapley_value", DIGITS).alias("shapley_value"))


@query("knn_shapley", with_(SQL_VEC_SPLIT, SQL_PAIRS, sql_shapley(1)) + "select * from shap")
def knn_shapley_query(spark, d):
    return _values(spark, d)


@query("knn_shapley_k5", with_(SQL_VEC_SPLIT, SQL_PAIRS, sql_shapley(5)) + "select * from shap")
def knn_shapley_k5(spark, d):
    return _values(spark, d, k=5)


@query("knn_shapley_truncated", with_(SQL_VEC_SPLIT, SQL_PAIRS, sql_truncated(1, 20)) + "select * from shap")
def knn_shapley_truncated(spark, d):
    return _values(spark, d, epsilon=0.05)


@query("shapley_mean", with_(SQL_VEC_SPLIT, SQL_PAIRS, sql_shapley(3)) + "select train_id, shapley_value as mean_score from shap")
def shapley_mean(spark, d):
    """Mean over the test points of the scores of every rank, from stored distances."""
    train, test = vec_split(spark, d)
    points = test.withColumnRenamed("prediction_id", "test_id")
    pairs = written(every_distance(points, train, "test_id"), "distances")
    values = values_of_all_ranks(pairs, train, points, 3)
    return values.select("train_id", F.round("shapley_value", DIGITS).alias("mean_score"))


SQL_CANDIDATES = "cand as (select train_id, shapley_value from shap order by shapley_value, train_id limit 20)"


def _candidates(spark, d) -> DataFrame:
    return mislabel_candidates(_values(spark, d), 20)


@query("mislabel_candidates", with_(SQL_VEC_SPLIT, SQL_PAIRS, sql_shapley(1), SQL_CANDIDATES) + "select train_id, shapley_value from cand")
def mislabel_candidates_query(spark, d):
    return _candidates(spark, d)


SQL_FLIP = (
    SQL_VEC_SPLIT + "," + SQL_PAIRS + "," + sql_shapley(1) + "," + SQL_CANDIDATES + "," + SQL_VEC_INDEX + "," + SQL_VEC_VOTE + ","
    + "flipped as (select t.train_id, case when c.train_id is not null then 1 - label else label end as label from tr t left join cand c on c.train_id = t.train_id),"
    + sql_vote("pred_new", "idx", "flipped")
)


def _mislabel(spark, d):
    train, test = vec_split(spark, d)
    stored = classify_vectors(test, train)
    candidates = written(_candidates(spark, d), "candidates")
    flipped = keyed.flip_labels(train.select("train_id", "label"), candidates, "train_id", "label")
    return train, test, stored, mislabel.MislabelState(candidates, flipped)


def classify_vectors(test: DataFrame, train: DataFrame) -> Retrieval:
    return classify(test.select("prediction_id", "embedding"), train, train, lambda df: df)


@query("flip_what_if", with_(SQL_FLIP) + """
  select round(avg((p.prediction = q.truth)::int::double), 9) as accuracy_before, round(avg((n.prediction = q.truth)::int::double), 9) as accuracy_after,
         (select count(distinct prediction_id) from idx where train_id in (select train_id from cand)) as rerun_rows, count(*) as total_rows
  from te q join pred p using (prediction_id) join pred_new n using (prediction_id)""")
def flip_what_if(spark, d):
    train, test, stored, state = _mislabel(spark, d)
    truth = test.select("prediction_id", F.col("label").alias("truth"))
    out = mislabel.mislabel_report(state, stored, train.select("train_id", "label"), truth)
    return out.withColumns({c: F.round(c, DIGITS) for c in ("accuracy_before", "accuracy_after")})


@query("explain_label_flip_train", with_(SQL_VEC_SPLIT, SQL_PAIRS, sql_shapley(1), SQL_CANDIDATES) + """
  select c.train_id, d.text, d.lang, d.source, """ + sql_packed("t.embedding") + """ as features, e.rule_1, e.rule_2, e.rule_3, t.label = 0 as original_label, t.label <> 0 as modified_label,
         (t.label <> 0)::int as encoded_original_label, (t.label = 0)::int as encoded_modified_label, c.shapley_value
  from cand c join tr t using (train_id) join documents d on d.doc_id = c.train_id join (
    select doc_id, coalesce(regexp_matches(text, '(the|of|and) (in|to|is)'), false) as rule_1, coalesce(regexp_matches(text, '(Apache|MIT|Public) License'), false) as rule_2,
           coalesce(regexp_matches(text, '&&&'), false) as rule_3 from documents) e on e.doc_id = c.train_id""")
def explain_label_flip_train(spark, d):
    """The flipped rows with their document, vector, rule results, labels before and after, and value."""
    train, _ = vec_split(spark, d)
    docs = table(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("train_id"), "text", "lang", "source")
    ruled = labels.weak_label(docs, "text", DOC_RULES, "_rules").drop("_rules")
    rows = train.select("train_id", "embedding", (F.col("label") == 0).alias("label")).join(ruled, "train_id")
    out = explain.explain_flip_train(rows, written(_candidates(spark, d), "candidates"), labels.rule_columns(DOC_RULES), ["text", "lang", "source"], "embedding")
    return out.withColumn("features", packed("features"))


@query("explain_label_flip_test", with_(SQL_FLIP) + """
  select prediction_id, q.grp as "group", """ + sql_packed("q.embedding") + """ as features, q.truth = 0 as true_label, q.truth::int as encoded_true_label,
         p.prediction as encoded_original_predicted_label, n.prediction as encoded_modified_predicted_label,
         p.prediction = q.truth and p.prediction <> n.prediction as broken, p.prediction <> q.truth and n.prediction = q.truth as successfully_fixed
  from te q join pred p using (prediction_id) join pred_new n using (prediction_id) where p.prediction <> n.prediction""")
def explain_label_flip_test(spark, d):
    _, test, stored, state = _mislabel(spark, d)
    modified = mislabel.flipped_predictions(state, stored)
    rows = test.withColumn("true_label", F.col("label") == 0)
    out = explain.explain_flip_test(rows, stored.predictions, modified, ["group"], "embedding", "true_label")
    return out.withColumn("features", packed("features"))


SQL_DOC_PAIRS = """
pr as (select q.prediction_id, t.train_id, (l.label_new = d.truth)::int::double as eq, count(*) over (partition by q.prediction_id) as n,
         row_number() over (partition by q.prediction_id order by round(list_distance(q.v, t.v), 9), t.train_id) as i
       from f_test q cross join f_train t join doc_train l using (train_id) join doc_test d on d.prediction_id = q.prediction_id)"""


@query("mislabel_recheck", with_(
    SQL_DOC_INDEX, SQL_DOC_PAIRS, "tr as (select train_id from doc_train)", "te as (select prediction_id from doc_test)", sql_shapley(1), SQL_CANDIDATES,
    "flipped as (select t.train_id, case when c.train_id is not null then 1 - label_new else label_new end as label from doc_train t left join cand c on c.train_id = t.train_id)",
    sql_vote("pred", "idx", "doc_train", "label_new"), sql_vote("pred_new", "idx", "flipped")) + """
  select round(avg((p.prediction = q.truth)::int::double), 9) as accuracy_before, round(avg((n.prediction = q.truth)::int::double), 9) as accuracy_after,
         (select count(distinct prediction_id) from idx where train_id in (select train_id from cand)) as rerun_rows, count(*) as total_rows
  from doc_test q join pred p using (prediction_id) join pred_new n using (prediction_id)""")
def mislabel_recheck(spark, d):
    """After the rule edit: values from the stored neighbour index, predictions rerun where the edit or a flip reaches."""
    train, vectors, test, base = _prepared(spark, d)
    index = mislabel.value_index(vectors, features_of(test))
    changed, new = _label_edit(train)
    rebased = relabel(base, changed, new)
    state = mislabel.mislabel_round_from_index(index, new, test)
    return _rounded(mislabel.mislabel_report(state, rebased, new, test))


# ---- slices ----------------------------------------------------------------------------------------


def _judged(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return rows.withColumn("err", (F.col("quality") == 0).cast("int"))


def sql_slices(source: str, err: str) -> str:
    return f"""
st as (select lang, source, grouping(lang) = 1 as lang_any, grouping(source) = 1 as source_any, count(*) as slice_rows, sum({err})::double as slice_err
       from {source} group by grouping sets ((lang), (source), (lang, source))),
tot as (select count(*)::double as n, sum({err})::double as e from {source}),
scored as (select st.*, 0.95::double * ((n / slice_rows) * (slice_err / e) - 1) - (1 - 0.95::double) * (n / slice_rows - 1) as score from st cross join tot),
top as (select * from scored where slice_err > 0 and score > 0
        order by round(score, 9) desc, lang_any, lang nulls first, source_any, source nulls first limit 1)"""


SQL_JUDGED = "judged as (select doc_id, lang, source, quality, (quality = 0)::int as err from documents join labels using (doc_id))"


@query("slice_stats", with_(SQL_JUDGED, sql_slices("judged", "err")) + "select * from st")
def slice_stats(spark, d):
    return slices.slice_stats(_judged(spark, d), FEATURES, "err")


@query("slice_find", with_(SQL_JUDGED, sql_slices("judged", "err").replace("limit 1", "limit 5")) + "select lang, source, lang_any, source_any, slice_rows, slice_err, round(score, 6) as score from top")
def slice_find(spark, d):
    return slices.slice_find(_judged(spark, d), FEATURES, "err", k=5).withColumn("score", F.round("score", 6))


@query("top_slice", with_(SQL_JUDGED, sql_slices("judged", "err")) + "select lang, source, lang_any, source_any, slice_rows, slice_err, round(score, 6) as score from top")
def top_slice(spark, d):
    return slices.top_slice(slices.slice_find(_judged(spark, d), FEATURES, "err", k=5)).withColumn("score", F.round("score", 6))


SQL_IN_TOP = "(t.lang_any or r.lang is not distinct from t.lang) and (t.source_any or r.source is not distinct from t.source)"


@query("slice_mask", with_(SQL_JUDGED, sql_slices("judged", "err")) + f"select doc_id, coalesce({SQL_IN_TOP}, false) as in_slice from judged r left join top t on true")
def slice_mask(spark, d):
    rows = _judged(spark, d)
    return slices.slice_mask(rows, slices.slice_find(rows, FEATURES, "err"), FEATURES).select("doc_id", "in_slice")


# ---- robustness ------------------------------------------------------------------------------------


def _prepared(spark, d):
    """(labelled texts, their vectors and labels, test, base retrieval) of the document classifier.

    Vectors and labels of the training texts come out of one pass and are written once.
    """
    train, test = doc_train(spark, d), doc_test(spark, d)
    vectors = written(doc_features(train, "train_id", keep=("label",)), "train_vectors")
    base = classify(test.select("prediction_id", "text"), vectors, vectors, features_of)
    return train, vectors, test, base


def features_of(rows: DataFrame) -> DataFrame:
    return doc_features(rows, "prediction_id")


def _by_vote(vectors: DataFrame):
    """Classify texts by the labels of their neighbours; ``vectors`` holds the training labels too."""
    return lambda texts: classify(texts, vectors, vectors, features_of)


def _label_edit(train: DataFrame):
    """(ids whose label the rule edit changed, labels after it)."""
    edited = edited_labels(train, DOC_RULES, EDITED_INDEX, EDITED_RULE)
    return changed_labels(edited), edited.select("train_id", "label")


def sql_robust(label: str) -> str:
    """All three versions of the whole test set predicted from scratch."""
    versions = """
versions as (
  select prediction_id * 3 as vid, text from doc_test
  union all select q.prediction_id * 3 + 1, case when c.prediction_id is not null then c.text else q.text end from doc_test q left join corrupt_diff c on c.prediction_id = q.prediction_id
  union all select q.prediction_id * 3 + 2, coalesce(r.text, case when c.prediction_id is not null then c.text else q.text end)
            from doc_test q left join corrupt_diff c on c.prediction_id = q.prediction_id left join repaired r on r.prediction_id = q.prediction_id),"""
    wide = """
wide as (select q.prediction_id, q.truth, a.prediction as predicted_label, b.prediction as predicted_corrupt_label, c.prediction as predicted_fix_corrupt_label
         from doc_test q join pred a on a.vid = q.prediction_id * 3 join pred b on b.vid = q.prediction_id * 3 + 1 join pred c on c.vid = q.prediction_id * 3 + 2)"""
    return (
        SQL_REPAIRED + "," + versions + sql_features("f_train", "doc_train", "train_id") + "," + sql_features("f_test", "versions", "vid") + ","
        + sql_index("idx", "f_test", "f_train", query_id="vid") + "," + sql_vote("pred", "idx", "doc_train", label, query_id="vid") + "," + wide
    )


SQL_ROBUST_REPORT = """
  select round(avg((predicted_label = truth)::int::double), 9) as accuracy, round(avg((predicted_corrupt_label = truth)::int::double), 9) as accuracy_corrupt,
         round(avg((predicted_fix_corrupt_label = truth)::int::double), 9) as accuracy_fix_corrupt, (select count(*) from corrupt_diff) as corrupted_rows,
         (select count(*) from repaired r join corrupt_diff c using (prediction_id) where r.text is distinct from c.text) as repaired_rows, count(*) as total_rows from wide"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, DIGITS) for c in df.columns if "accuracy" in c})


def _robust(spark, d):
    train, vectors, test, base = _prepared(spark, d)
    vocab = written(wordfix.vocab_counts(train, "text", VOCAB_MIN), "vocab")
    return train, test, base, robustness.robustness_round(test, vocab, _by_vote(vectors), 0.1, SEED)


@query("robustness_report", with_(sql_robust("label")) + SQL_ROBUST_REPORT)
def robustness_report(spark, d):
    _, test, base, state = _robust(spark, d)
    return _rounded(robustness.robustness_report(state, base.predictions, test))


@query("robustness_recheck", with_(sql_robust("label_new")) + SQL_ROBUST_REPORT)
def robustness_recheck(spark, d):
    """After the rule edit; the SQL recomputes everything with the new labels."""
    train, test, base, state = _robust(spark, d)
    changed, new = _label_edit(train)
    again = robustness.robustness_recheck(state, lambda diffs: relabel(diffs, changed, new))
    return _rounded(robustness.robustness_report(again, relabel(base, changed, new).predictions, test))


SQL_EXPLAIN_CORRUPTION = """
  select w.*, q.lang, q.source, q.text, c.text as corrupted_text, r.text as fix_corrupted_text, """ + f"{sql_packed('a.v')} as features, {sql_packed('b.v')} as features_corrupted, {sql_packed('f.v')} as features_fix_corrupted," + """
         predicted_label = w.truth and predicted_label <> predicted_corrupt_label as corruption_effect,
         predicted_label = w.truth and predicted_label <> predicted_corrupt_label and predicted_label = predicted_fix_corrupt_label as successfully_fixed,
         predicted_label = w.truth and predicted_label <> predicted_fix_corrupt_label as worsened, predicted_label <> w.truth and predicted_fix_corrupt_label = w.truth as otherwise_fixed
  from corrupt_diff c join wide w using (prediction_id) join doc_test q using (prediction_id) join repaired r using (prediction_id)
  join f_test a on a.vid = prediction_id * 3 join f_test b on b.vid = prediction_id * 3 + 1 join f_test f on f.vid = prediction_id * 3 + 2"""


@query("explain_corruption", with_(sql_robust("label")) + SQL_EXPLAIN_CORRUPTION)
def explain_corruption(spark, d):
    _, test, base, state = _robust(spark, d)
    out = robustness.robustness_explanation(state, base.predictions, test, ["lang", "source"], features_of)
    return out.withColumns({c: packed(c) for c in ("features", "features_corrupted", "features_fix_corrupted")})


@query("explain_corruption_recheck", with_(sql_robust("label_new")) + SQL_EXPLAIN_CORRUPTION)
def explain_corruption_recheck(spark, d):
    """The explanation after the rule edit: stored texts and neighbours, patched predictions."""
    train, test, base, state = _robust(spark, d)
    changed, new = _label_edit(train)
    again = robustness.robustness_recheck(state, lambda diffs: relabel(diffs, changed, new))
    out = robustness.robustness_explanation(again, relabel(base, changed, new).predictions, test, ["lang", "source"], features_of)
    return out.withColumns({c: packed(c) for c in ("features", "features_corrupted", "features_fix_corrupted")})


# ---- fairness --------------------------------------------------------------------------------------


def _translate(lexicon_table: DataFrame):
    return lambda rows: wordfix.lexicon_translate(rows, "prediction_id", "text", lexicon_table)


def sql_fair(label: str) -> str:
    """Slice search on fresh predictions; the slice translated; everything predicted from scratch."""
    return (
        SQL_DOC_INDEX + "," + sql_vote("pred", "idx", "doc_train", label) + "," + SQL_LEXICON + ","
        + "judged as (select q.*, (p.prediction <> q.truth)::int as err, p.prediction as before from doc_test q join pred p using (prediction_id)),"
        + sql_slices("judged", "err") + ","
        + f"marked as (select r.*, coalesce({SQL_IN_TOP}, false) as in_slice from judged r left join top t on true),"
        + "wanted as (select prediction_id, text from marked where in_slice)," + sql_rewritten("translated", "wanted", "prediction_id", "lexicon") + ","
        + sql_features("f_tr", "translated", "prediction_id") + "," + sql_index("idx_tr", "f_tr", "f_train") + "," + sql_vote("pred_tr", "idx_tr", "doc_train", label) + ","
        + "both_preds as (select m.*, coalesce(p.prediction, m.before) as after from marked m left join pred_tr p on p.prediction_id = m.prediction_id)"
    )


SQL_FAIR_REPORT = """
  select round(avg((before = truth)::int::double), 9) as accuracy, round(avg((after = truth)::int::double), 9) as accuracy_enriched,
         round(avg(case when in_slice then (before = truth)::int::double end), 9) as slice_accuracy, round(avg(case when in_slice then (after = truth)::int::double end), 9) as slice_accuracy_enriched,
         count(case when in_slice then 1 end) as slice_rows, count(*) as total_rows from both_preds"""


def _fair(spark, d):
    train, vectors, test, base = _prepared(spark, d)
    enrich = _translate(written(lexicon(spark, d), "lexicon"))
    state = fairness.fairness_round(test, base.predictions, FEATURES, enrich, _by_vote(vectors))
    return train, vectors, test, base, enrich, state


@query("fairness_report", with_(sql_fair("label")) + SQL_FAIR_REPORT)
def fairness_report(spark, d):
    _, _, test, base, _, state = _fair(spark, d)
    return _rounded(fairness.fairness_report(state, base.predictions, test))


@query("fairness_recheck", with_(sql_fair("label_new")) + SQL_FAIR_REPORT)
def fairness_recheck(spark, d):
    """After the rule edit: slice search again, translations and neighbours reused where they exist."""
    train, vectors, test, base, enrich, state = _fair(spark, d)
    changed, new = _label_edit(train)
    rebased = relabel(base, changed, new)
    update = lambda diffs, needed: retrieval.extend(diffs, needed, changed, vectors, new, features_of)
    again = fairness.fairness_recheck(state, test, rebased.predictions, enrich, update)
    return _rounded(fairness.fairness_report(again, rebased.predictions, test))


SQL_EXPLAIN_ENRICHMENT = """
  select b.prediction_id, b.lang, b.source, b.text, t.text as enriched_text, b.truth, """ + f"{sql_packed('fb.v')} as features, {sql_packed('fa.v')} as features_enriched," + """
         before as predicted_label, after as predicted_enriched_label,
         case when before = truth and before <> after then 'broken' when before <> truth and after = truth then 'successfully_fixed' when before <> truth and after <> truth then 'nothing_changed' end as category
  from both_preds b join translated t using (prediction_id) join f_test fb using (prediction_id) join f_tr fa using (prediction_id)"""


@query("explain_enrichment", with_(sql_fair("label")) + SQL_EXPLAIN_ENRICHMENT)
def explain_enrichment(spark, d):
    _, _, test, base, _, state = _fair(spark, d)
    out = fairness.fairness_explanation(state, base.predictions, test, ["lang", "source"], features_of)
    return out.withColumns({c: packed(c) for c in ("features", "features_enriched")})


@query("explain_enrichment_recheck", with_(sql_fair("label_new")) + SQL_EXPLAIN_ENRICHMENT)
def explain_enrichment_recheck(spark, d):
    """The explanation after the rule edit, for the slice that is worst then."""
    train, vectors, test, base, enrich, state = _fair(spark, d)
    changed, new = _label_edit(train)
    rebased = relabel(base, changed, new)
    update = lambda diffs, needed: retrieval.extend(diffs, needed, changed, vectors, new, features_of)
    again = fairness.fairness_recheck(state, test, rebased.predictions, enrich, update)
    out = fairness.fairness_explanation(again, rebased.predictions, test, ["lang", "source"], features_of)
    return out.withColumns({c: packed(c) for c in ("features", "features_enriched")})
