"""Feature jobs and trained models.

Model outputs depend on the optimiser; queries report what SQL can recompute about them: the rows, their classes,
the counts of touched rows, and that a model fits its own rows better than always naming the larger class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.catalog import analyses as A
from dataprobe.catalog.analyses import SQL_FLIP, sql_robust
from dataprobe.catalog.registry import SEED, SQL_VEC_SPLIT, VOCAB_MIN, doc_features, packed, query, sql_features, sql_packed, sql_vote, table, u, vec_split, with_
from dataprobe.catalog.texts import SQL_WORD, lexicon
from dataprobe.functions.draws import seeded_uniform
from dataprobe.operators import explain, features, models, wordfix
from dataprobe.operators.predict import vote_from_index
from dataprobe.operators.vectors import knn_retrieve
from dataprobe.plans import fairness, mislabel, robustness, trained
from dataprobe.session import written


@query("ml_text_features", with_("docs as (select doc_id, text from documents)", sql_features("f", "docs", "doc_id"))
       + f"select doc_id, {sql_packed('v')} as features, len(v) as dims from f")
def ml_text_features(spark, d):
    rows = doc_features(table(spark, d, "documents", "doc_id"), "doc_id")
    return rows.select("doc_id", packed("embedding").alias("features"), F.size("embedding").cast("long").alias("dims"))


_BARE = "regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')"


@query("ml_text_features_weighted", f"""
  with t as (select doc_id, unnest(case when {_BARE} = '' then [] else string_split_regex({_BARE}, '\\s+') end) as token from documents),
  c as (select doc_id, token, count(*) as n from t group by all),
  f as (select token, count(*) as docs from c where doc_id % 7 <> 0 group by token),
  r as (select doc_id, token, n * (ln((1.0::double + (select count(*) from documents where doc_id % 7 <> 0)) / (1.0::double + coalesce(docs, 0))) + 1.0::double) as weight
        from c left join f using (token) where doc_id in (select doc_id from labels))
  select doc_id, token, round(weight / sqrt(sum(weight * weight) over (partition by doc_id)), 6) as weight from r""")
def ml_text_features_weighted(spark, d):
    """Words of the labelled documents by weight, with frequencies to which texts were added and from which texts went."""
    rows = table(spark, d, "documents", "doc_id").select("doc_id", "text")
    part = lambda i: features.document_frequencies(rows.filter(F.col("doc_id") % 7 == i), "text")
    known = features.document_frequencies(rows.filter(F.col("doc_id") % 7 != 1), "text")
    now = written(features.merged_frequencies(known, part(1), part(0)), "frequencies")
    judged = rows.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return features.weighted_words(judged, "doc_id", "text", now).withColumn("weight", F.round("weight", 6))


# ---- learners: what SQL can say about a model: who was predicted, a known class, and that it fits its own rows ------

_JUDGED = "select prediction_id, true as known_class, true as has_learned from te"


def _scores(predictions: DataFrame, test: DataFrame) -> DataFrame:
    """One row: rows predicted, whether all have a known class, accuracy, and the share of the larger class."""
    rows = predictions.join(test.select("prediction_id", "label"), "prediction_id")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("prediction").isin(0, 1)).alias("known_class"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.greatest(F.avg("label"), 1 - F.avg("label")).alias("majority"),
    )


def _predictions(spark, d, kind: str) -> DataFrame:
    train, test = vec_split(spark, d)
    model = models.fit(train, kind)
    return models.predict(model, test).select("prediction_id", F.col("prediction").isin(0, 1).alias("known_class"), _has_learned(model, train).alias("has_learned"))


def _has_learned(model, train: DataFrame):
    """On its training rows the model is right more often than always naming the larger class."""
    own = train.withColumnRenamed("train_id", "prediction_id")
    return _scores(models.predict(model, own), own).select(F.col("accuracy") > F.col("majority")).scalar()


@query("ml_mlp", with_(SQL_VEC_SPLIT) + _JUDGED)
def ml_mlp(spark, d):
    return _predictions(spark, d, "mlp")


@query("ml_mlp_large", with_(SQL_VEC_SPLIT) + _JUDGED)
def ml_mlp_large(spark, d):
    return _predictions(spark, d, "mlp_large")


@query("ml_logistic", with_(SQL_VEC_SPLIT) + _JUDGED)
def ml_logistic(spark, d):
    return _predictions(spark, d, "logistic")


@query("ml_gbt", with_(SQL_VEC_SPLIT) + _JUDGED)
def ml_gbt(spark, d):
    return _predictions(spark, d, "gbt")


@query("ml_pipeline", with_(SQL_VEC_SPLIT) + "select count(*) as rows, true as known_class, true as in_range, true as has_learned from te")
def ml_pipeline(spark, d):
    """Features, learner and score in one job."""
    train, test = vec_split(spark, d)
    model = models.fit(train)
    scored = _scores(models.predict(model, test), test)
    return scored.select("rows", "known_class", F.col("accuracy").between(0, 1).alias("in_range"), _has_learned(model, train).alias("has_learned"))


def _edited(train: DataFrame) -> DataFrame:
    """Training rows after a label edit that turns a keyed twentieth of the labels."""
    turned = seeded_uniform(SEED, "train_id") < 0.05
    return train.withColumn("label", F.when(turned, 1 - F.col("label")).otherwise(F.col("label")).cast("int"))


SQL_EDITED = f"edited as (select train_id, v, case when {u(SEED, 'train_id')} < 0.05 then 1 - label else label end as label from tr)"


@query("learner_scores", with_(SQL_VEC_SPLIT) + "select unnest(['gbt', 'logistic', 'mlp', 'mlp_large', 'neighbours']) as learner, (select count(*) from te) as rows, true as known_class, true as in_range")
def learner_scores(spark, d):
    """Five learners fitted on the edited labels and scored on the test set."""
    train, test = vec_split(spark, d)
    train = written(_edited(train), "edited")
    out = None
    for kind in ("gbt", "logistic", "mlp", "mlp_large", "neighbours"):
        found = vote_from_index(knn_retrieve(test, train, 5), train) if kind == "neighbours" else models.fit_predict(train, test, kind)
        row = _scores(found, test).select(F.lit(kind).alias("learner"), "rows", "known_class", F.col("accuracy").between(0, 1).alias("in_range"))
        out = row if out is None else out.unionByName(row)
    return out


@query("ml_word_vectors", f"""select lower(token) as token, 100::bigint as size, max(hits) >= {VOCAB_MIN} as learned
  from (select lower(w) as token, count(*) as hits from (select unnest(regexp_extract_all(text, '{SQL_WORD}+')) as w from documents) group by 1) group by 1""")
def ml_word_vectors(spark, d):
    """A vector per distinct word of the corpus; rare words get the zero vector."""
    docs = table(spark, d, "documents", "doc_id")
    words = wordfix.vocab_counts(docs, "text").select(F.lower("token").alias("token")).distinct()
    found = models.word_vectors(words, docs, "text", min_count=VOCAB_MIN)
    return found.select("token", F.size("vector").cast("long").alias("size"), F.exists("vector", lambda x: x != 0).alias("learned"))


# ---- trained models under label flips ------------------------------------------------------------------------------

SQL_PROXY = (
    SQL_FLIP + "," + "one as (select * from idx where rank = 1)," + sql_vote("proxy", "one", "tr") + "," + sql_vote("proxy_new", "one", "flipped")
)


@query("explain_proxy", with_(SQL_PROXY) + """
  select prediction_id, q.grp as "group", """ + sql_packed("q.embedding") + """ as features, q.truth = 0 as true_label, q.truth::int as encoded_true_label,
         p.prediction as encoded_original_predicted_label, n.prediction as encoded_proxy_modified_predicted_label, x.prediction as encoded_proxy_original_predicted_label,
         x.prediction = q.truth and x.prediction <> n.prediction as broken, x.prediction <> q.truth and n.prediction = q.truth as successfully_fixed
  from te q join pred p using (prediction_id) join proxy x using (prediction_id) join proxy_new n using (prediction_id) where p.prediction <> n.prediction""")
def explain_proxy(spark, d):
    """The nearest neighbour as a surrogate of the vote of four, on the labels as they are and on the flipped ones."""
    _, test, stored, state = A._mislabel(spark, d)
    nearest = stored.index.filter(F.col("rank") == 1)
    train, _ = vec_split(spark, d)
    proxy, modified = vote_from_index(nearest, train.select("train_id", "label")), vote_from_index(nearest, state.flipped)
    rows = test.withColumn("true_label", F.col("label") == 0)
    out = explain.explain_flip_test(rows, stored.predictions, modified, ["group"], "embedding", "true_label", proxy)
    return out.withColumn("features", packed("features"))


@query("mislabel_report_ml", with_(SQL_VEC_SPLIT) + """
  select unnest([1, 1, 2, 2])::int as round, unnest([false, true, false, true]) as proxy, 20::bigint as flipped_rows, (select count(*) from te) as rows,
         true as known_class, true as in_range""")
def mislabel_report_ml(spark, d):
    """A trained model and its cheaper proxy on flipped labels, before and after a label edit.

    Values of the second round come from the neighbour index of the first; both models are trained again.
    """
    train, test = vec_split(spark, d)
    points = written(test.withColumn("truth", F.col("label")), "points")
    index = mislabel.value_index(train, points)
    out = None
    for number, rows in ((1, train), (2, _edited(train))):
        rows = written(rows, "rows")
        state = mislabel.mislabel_round_from_index(index, rows, points)
        for proxy, kind in ((False, "mlp"), (True, "logistic")):
            before, after = (_scores(p, test) for p in mislabel.model_what_if(rows, test, state, kind))
            report = mislabel.model_report(before, after, state).withColumns({"round": F.lit(number), "proxy": F.lit(proxy)})
            out = report if out is None else out.unionByName(report)
    return out.select("round", "proxy", "flipped_rows", "rows", "known_class", (F.col("accuracy_before").between(0, 1) & F.col("accuracy_after").between(0, 1)).alias("in_range"))


def _trained(spark, d):
    """(train, its vectors, test, model, base state) with a logistic model on document vectors."""
    train, vectors, test, _ = A._prepared(spark, d)
    model = models.fit(vectors, "logistic")
    return train, vectors, test, model, trained.classify(test.select("prediction_id", "text"), model, A.features_of)


def _retrained(train, vectors):
    """The model after the rule edit: the same vectors with the edited labels."""
    _, new = A._label_edit(train)
    return models.fit(vectors.drop("label").join(new, "train_id"), "logistic")


@query("robustness_report_ml", with_(sql_robust("label")) + """
  select unnest([1, 2])::int as round, (select count(*) from corrupt_diff) as corrupted_rows,
         (select count(*) from repaired r join corrupt_diff c using (prediction_id) where r.text is distinct from c.text) as repaired_rows, (select count(*) from wide) as total_rows, true as in_range""")
def robustness_report_ml(spark, d):
    """First round and recheck with a trained model: the recheck encodes nothing."""
    train, vectors, test, model, base = _trained(spark, d)
    vocab = written(wordfix.vocab_counts(train, "text", VOCAB_MIN), "vocab")
    state = robustness.robustness_round(test, vocab, lambda t: trained.classify(t, model, A.features_of), 0.1, SEED)
    first = robustness.robustness_report(state, base.predictions, test).withColumn("round", F.lit(1))
    newer = _retrained(train, vectors)
    again = robustness.robustness_recheck(state, lambda diffs: trained.repredict(diffs, newer))
    second = robustness.robustness_report(again, trained.repredict(base, newer).predictions, test).withColumn("round", F.lit(2))
    shares = F.col("accuracy").between(0, 1) & F.col("accuracy_corrupt").between(0, 1) & F.col("accuracy_fix_corrupt").between(0, 1)
    return first.unionByName(second).select("round", "corrupted_rows", "repaired_rows", "total_rows", shares.alias("in_range"))


@query("fairness_report_ml", "select unnest([1, 2])::int as round, count(*) as total_rows, true as in_range from documents join labels using (doc_id)")
def fairness_report_ml(spark, d):
    """First round and recheck with a trained model: only newly enriched texts are encoded in the recheck."""
    train, vectors, test, model, base = _trained(spark, d)
    enrich = A._translate(written(lexicon(spark, d), "lexicon"))
    state = fairness.fairness_round(test, base.predictions, A.FEATURES, enrich, lambda t: trained.classify(t, model, A.features_of))
    first = fairness.fairness_report(state, base.predictions, test).withColumn("round", F.lit(1))
    newer = _retrained(train, vectors)
    rebased = trained.repredict(base, newer).predictions
    again = fairness.fairness_recheck(state, test, rebased, enrich, lambda diffs, needed: trained.extend(diffs, needed, newer, A.features_of))
    both = first.unionByName(fairness.fairness_report(again, rebased, test).withColumn("round", F.lit(2)))
    # the worst slice has rows and does worse than the whole
    worse = F.col("slice_rows").between(1, F.col("total_rows")) & (F.col("slice_accuracy") <= F.col("accuracy"))
    return both.select("round", "total_rows", (worse & F.col("accuracy_enriched").between(0, 1)).alias("in_range"))
