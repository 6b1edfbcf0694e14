"""Vector tables, nearest neighbours, votes, impact of label edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.catalog.registry import (
    DOC_RULES, EDITED_INDEX, EDITED_RULE, SEED, SQL_DOC_INDEX, SQL_VEC_INDEX, SQL_VEC_SPLIT, SQL_VEC_VOTE, doc_features, doc_test,
    doc_train, packed, query, sent, sql_features, sql_index, sql_packed, sql_vote, table, vec_split, with_,
)
from dataprobe.functions.labels import class_name
from dataprobe.functions.prompts import prompt_parts
from dataprobe.functions.vectors import array_distance
from dataprobe.operators import collection, impact, keyed, lsh, ordering, predict
from dataprobe.operators.vectors import distances_in_order, every_distance, knn_retrieve, pairwise_distance, retrieval_index_long, retrieval_index_wide
from dataprobe.plans.retrieval import changed_labels, edited_labels
from dataprobe.session import written


# ---- the vector table ------------------------------------------------------------------------------


def _collection(spark, d) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    vectors = table(spark, d, "embeddings")
    both = texts.join(vectors.select("vec_id", "label"), "vec_id")
    return collection.vector_table_load(both, vectors, "vec_id", "text", "embedding", ["label", "lang"])


def _shown(c: DataFrame) -> DataFrame:
    return c.select("id", "text", packed("embedding").alias("vector"), F.col("metadata")["label"].alias("label"), F.col("metadata")["lang"].alias("lang"))


SQL_COLLECTION = f"""
coll as (select cast(vec_id as varchar) as id, text, {sql_packed('embedding')} as vector, cast(label as varchar) as label, lang
         from documents join embeddings on vec_id = doc_id)"""


@query("vector_table_load", with_(SQL_COLLECTION) + "select * from coll")
def vector_table_load(spark, d):
    return _shown(_collection(spark, d))


@query("vector_table_get", with_(SQL_COLLECTION) + "select id, text, label from coll where lang = 'fr'")
def vector_table_get(spark, d):
    c = _collection(spark, d)
    ids = table(spark, d, "documents").filter(F.col("lang") == "fr").select(F.col("doc_id").cast("string").alias("id"))
    return collection.vector_table_get(c, ids, ["text", "metadata"]).select("id", "text", F.col("metadata")["label"].alias("label"))


def _relabelled(c: DataFrame) -> DataFrame:
    updates = c.filter(F.col("metadata")["label"] == "3").select("id", F.create_map(F.lit("label"), F.lit("flipped")).alias("metadata"))
    return collection.vector_table_update(c, updates)


@query("vector_table_update", with_(SQL_COLLECTION) + "select id, text, vector, case when label = '3' then 'flipped' else label end as label, lang from coll")
def vector_table_update(spark, d):
    return _shown(_relabelled(_collection(spark, d)))


@query("vector_table_revert", with_(SQL_COLLECTION) + "select count(*) filter (where label = '3') as flipped, true as base_untouched from coll")
def vector_table_revert(spark, d):
    """A what-if beside its base: the derived table differs in the updated rows, the base is what it was."""
    base = _shown(_collection(spark, d)).select("id", "label")
    what_if = _shown(_relabelled(_collection(spark, d))).select("id", "label")
    flipped = what_if.filter(F.col("label") == "flipped").agg(F.count(F.lit(1)).alias("flipped"))
    same = keyed.equality_check(base, _shown(_collection(spark, d)).select("id", "label")).select("equal").scalar()
    return flipped.withColumn("base_untouched", same)


@query("collection_reset", with_(SQL_COLLECTION) + "select id, label from coll where lang = 'fr'")
def collection_reset(spark, d):
    """Two runs write the same collection name; the second one holds its own entries only."""
    c = _collection(spark, d)
    collection.save_collection(c.filter(F.col("metadata")["lang"] == "en"))
    second = collection.save_collection(c.filter(F.col("metadata")["lang"] == "fr"))
    return spark.read.parquet(second).select("id", F.col("metadata")["label"].alias("label"))


# ---- distances and neighbours ----------------------------------------------------------------------


@query("fn_array_distance", "select a.vec_id, round(round(list_distance(a.embedding::double[], b.embedding::double[]), 9), 6) as distance from embeddings a"
       " join embeddings b on b.vec_id = a.vec_id + 1")
def fn_array_distance(spark, d):
    e = table(spark, d, "embeddings")
    shifted = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(shifted, "vec_id").select("vec_id", F.round(array_distance("embedding", "other"), 6).alias("distance"))


@query("knn_retrieve", with_(SQL_VEC_SPLIT, SQL_VEC_INDEX) + "select prediction_id, rank::int as rank, train_id, round(distance, 6) as distance from idx")
def knn_retrieve_query(spark, d):
    train, test = vec_split(spark, d)
    return knn_retrieve(test, train).withColumn("distance", F.round("distance", 6))


@query("knn_retrieve_large", with_("allv as (select vec_id, vec_id as train_id, vec_id as prediction_id, embedding::double[] as v from embeddings)",
       sql_index("idx", "allv", "allv", 3)) + "select prediction_id, rank::int as rank, train_id, round(distance, 6) as distance from idx")
def knn_retrieve_large(spark, d):
    """Every vector against every vector through the pivot cells, as for a query side too big to send."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = knn_retrieve(
        rows.withColumnRenamed("vec_id", "prediction_id"), rows.withColumnRenamed("vec_id", "train_id"), 3, broadcast_numbers=0
    )
    return found.withColumn("distance", F.round("distance", 6))


def _approximate(spark, d) -> tuple[DataFrame, DataFrame]:
    """(found, exact): every twentieth vector against all, by the index and by brute force."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = rows.filter(F.col("vec_id") % 20 == 0).withColumnRenamed("vec_id", "prediction_id")
    known = rows.withColumnRenamed("vec_id", "train_id")
    return lsh.lsh_retrieve(lsh.lsh_index(known), asked), knn_retrieve(asked, known)


@query("knn_retrieve_lsh")
def knn_retrieve_lsh(spark, d):
    """Approximate neighbours: which are found depends on random directions, their distances do not."""
    return _approximate(spark, d)[0].withColumn("distance", F.round("distance", 6))


@query("knn_lsh_recall", """
  with n as (select count(*) filter (vec_id % 20 = 0) as q, least(count(*), 4) as k from embeddings) select (q * k)::bigint as asked, true as nine_in_ten, 0::bigint as wrong from n""")
def knn_lsh_recall(spark, d):
    """How many exact neighbours there are, whether nine in ten are found, and how many found distances are not those of their pair."""
    found, exact = _approximate(spark, d)
    found = written(found, "found")
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    checked = pairwise_distance(found, rows.withColumnRenamed("vec_id", "prediction_id"), rows.withColumnRenamed("vec_id", "train_id"), "prediction_id", "train_id")
    wrong = found.join(checked.withColumnRenamed("distance", "true"), ["prediction_id", "train_id"], "left").filter(F.abs(F.col("distance") - F.col("true")).isNull() | (F.abs(F.col("distance") - F.col("true")) > 1e-6))
    counted = wrong.agg(F.count(F.lit(1)).alias("n")).scalar()
    return lsh.recall(found, exact).select("asked", (F.col("recall") >= 0.9).alias("nine_in_ten"), counted.alias("wrong"))


@query("pairwise_distance", with_(SQL_VEC_SPLIT, SQL_VEC_INDEX) + "select prediction_id, train_id, round(distance, 6) as distance from idx")
def pairwise_distance_query(spark, d):
    train, test = vec_split(spark, d)
    pairs = knn_retrieve(test, train).select("prediction_id", "train_id")
    return pairwise_distance(pairs, test, train, "prediction_id", "train_id").withColumn("distance", F.round("distance", 6))


# an index that holds every rank: k is above the number of rows
SQL_ALL_RANKS = sql_index("idx", "te", "tr", "(select count(*) from tr)")


@query("rank_by_distance", with_(SQL_VEC_SPLIT, SQL_ALL_RANKS) + "select prediction_id, train_id, rank::int as rank from idx")
def rank_by_distance(spark, d):
    train, test = vec_split(spark, d)
    return ordering.rank_by_distance(every_distance(test, train), "prediction_id", "distance", "train_id").select("prediction_id", "train_id", F.col("rank").cast("int").alias("rank"))


_EQ = "eq as (select i.prediction_id, i.rank::int as rank, (t.label = q.truth)::int::double as eq from idx i join tr t using (train_id) join te q using (prediction_id))"


def _eq_ranked(spark, d) -> tuple[DataFrame, bool]:
    """(rows, whether they know ``next_eq``, that of the next rank)."""
    train, test = vec_split(spark, d)
    pairs, in_order = distances_in_order(test, train)
    index = ordering.rank_by_distance(pairs, "prediction_id", "distance", "train_id", in_order=in_order)
    # written, so that the draw that splits the vectors is not made again for every pair
    known, asked = written(train.select("train_id", F.col("label").alias("known")), "known"), written(test.select("prediction_id", "label"), "asked")
    joined = index.join(sent(known), "train_id").join(sent(asked), "prediction_id")
    eq = lambda c: (F.col(c) == F.col("label")).cast("double")
    columns = ["prediction_id", F.col("rank").cast("int").alias("rank"), eq("known").alias("eq")]
    if not in_order:
        return joined.select(*columns), False
    joined = joined.join(sent(known.select(F.col("train_id").alias("next_id"), F.col("known").alias("next_known"))), "next_id", "left")
    return joined.select(*columns, eq("next_known").alias("next_eq")), True


@query("adjacent_diff", with_(SQL_VEC_SPLIT, SQL_ALL_RANKS, _EQ)
       + "select prediction_id, rank, eq, eq - lead(eq) over (partition by prediction_id order by rank) as diff from eq")
def adjacent_diff(spark, d):
    ranked, knows = _eq_ranked(spark, d)
    return ordering.adjacent_diff(ranked, "prediction_id", "eq", later="next_eq" if knows else None)


@query("suffix_sum", with_(SQL_VEC_SPLIT, SQL_ALL_RANKS, _EQ)
       + "select prediction_id, rank, eq, sum(eq) over (partition by prediction_id order by rank rows between current row and unbounded following) as suffix from eq")
def suffix_sum(spark, d):
    return ordering.suffix_sum(_eq_ranked(spark, d)[0].select("prediction_id", "rank", "eq"), "prediction_id", "eq")


@query("knn_vote", with_(SQL_VEC_SPLIT, sql_index("idx", "te", "tr", 5), sql_vote("pred", "idx", "tr", tie="lowest")) + "select prediction_id, prediction from pred")
def knn_vote(spark, d):
    train, test = vec_split(spark, d)
    return predict.knn_vote(test, train, 5)


@query("retrieval_index", with_(SQL_DOC_INDEX) + "select prediction_id, rank::int as rank, train_id from idx")
def retrieval_index(spark, d):
    train, test = doc_train(spark, d), doc_test(spark, d)
    return knn_retrieve(doc_features(test, "prediction_id"), doc_features(train, "train_id")).drop("distance")


_WIDE = ", ".join(f"max(case when rank = {i} then train_id end) as train_retrieved_{i}" for i in range(1, 5))


@query("retrieval_index_wide", with_(SQL_VEC_SPLIT, SQL_VEC_INDEX) + f"select prediction_id, {_WIDE} from idx group by prediction_id")
def retrieval_index_wide_query(spark, d):
    train, test = vec_split(spark, d)
    return retrieval_index_wide(knn_retrieve(test, train))


@query("rag_classify", with_(SQL_DOC_INDEX, sql_vote("pred", "idx", "doc_train")) + "select prediction_id, prediction from pred")
def rag_classify(spark, d):
    train, test = doc_train(spark, d), doc_test(spark, d)
    vectors = written(doc_features(train, "train_id", keep=("label",)), "train_vectors")
    return predict.rag_classify(doc_features(test, "prediction_id"), vectors)[0]


_HEAD, _MIDDLE, _TAIL = (part.replace("'", "''") for part in prompt_parts(("anhedonia", "regular")))


@query("fn_prompt_build", with_(SQL_DOC_INDEX) + f""", ctx as (
  select i.prediction_id, string_agg('```' || t.text || '```' || chr(10) || 'assigned category: [''' || case when t.weak then 'anhedonia' else 'regular' end || ''']', chr(10) || chr(10) order by i.rank) as context
  from idx i join doc_train t using (train_id) group by 1)
  select prediction_id, '{_HEAD}' || context || '{_MIDDLE}' || q.text || '{_TAIL}' as prompt from doc_test q join ctx using (prediction_id)""")
def fn_prompt_build(spark, d):
    train, test = doc_train(spark, d), doc_test(spark, d)
    index = knn_retrieve(doc_features(test, "prediction_id"), doc_features(train, "train_id"))
    named = train.withColumn("class_name", class_name("weak", "anhedonia", "regular"))
    return predict.prompts(index, test, named, ("anhedonia", "regular"))


# ---- impact of a label edit ------------------------------------------------------------------------


def _edited(spark, d):
    """(index, ids whose label the rule edit changed, old labels, new labels, test) on the documents."""
    train, test = doc_train(spark, d), doc_test(spark, d)
    index = written(knn_retrieve(doc_features(test, "prediction_id"), doc_features(train, "train_id")), "index")
    edited = edited_labels(train, DOC_RULES, EDITED_INDEX, EDITED_RULE)
    old = edited.select("train_id", F.col("old_label").alias("label"))
    return index, changed_labels(edited), old, edited.select("train_id", "label"), test


_CHANGED = "changed as (select train_id from doc_train where weak <> weak_new)"
_IMPACTED = "impacted as (select distinct prediction_id from idx where train_id in (select train_id from changed))"


@query("impact_set", with_(SQL_DOC_INDEX, _CHANGED, _IMPACTED) + "select prediction_id from impacted")
def impact_set(spark, d):
    index, changed, _, _, _ = _edited(spark, d)
    return impact.impact_set(index, changed)


_GROUP_CHANGED = "changed as (select train_id from tr where grp = 3)"


@query("join_impacted_predictions", with_(SQL_VEC_SPLIT, SQL_VEC_INDEX, _GROUP_CHANGED, f"wide as (select prediction_id, {_WIDE} from idx group by prediction_id)")
       + "select distinct prediction_id from changed c join wide w on c.train_id = train_retrieved_1 or c.train_id = train_retrieved_2"
         " or c.train_id = train_retrieved_3 or c.train_id = train_retrieved_4")
def join_impacted_predictions(spark, d):
    """The wide index is turned into rows first, so the four-way OR becomes one equi join."""
    train, test = vec_split(spark, d)
    wide = retrieval_index_wide(knn_retrieve(test, train))
    return impact.impact_set(retrieval_index_long(wide), train.filter(F.col("group") == 3).select("train_id"))


@query("join_impacted_union_form", with_(SQL_VEC_SPLIT, SQL_VEC_INDEX, _GROUP_CHANGED, _IMPACTED) + "select prediction_id from impacted")
def join_impacted_union_form(spark, d):
    train, test = vec_split(spark, d)
    wide = written(retrieval_index_wide(knn_retrieve(test, train)), "wide")
    return impact.impact_set_by_rank(wide, train.filter(F.col("group") == 3).select("train_id"))


@query("join_impacted_enriched", with_(SQL_VEC_SPLIT, SQL_VEC_INDEX, _GROUP_CHANGED, _IMPACTED)
       + """select doc_id as prediction_id, 'first:' || text as text from documents where lang <> 'en' and doc_id in (select prediction_id from impacted)
            union select doc_id, replace(text, 'the', 'THE') from documents where lang = 'en' and text <> replace(text, 'the', 'THE')""")
def join_impacted_enriched(spark, d):
    train, test = vec_split(spark, d)
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("prediction_id"), F.col("text").alias("before"), "lang")
    reused = rows.filter(F.col("lang") != "en").withColumn("after", F.concat(F.lit("first:"), "before"))
    fresh = rows.filter(F.col("lang") == "en").withColumn("after", F.replace("before", F.lit("the"), F.lit("THE")))
    changed = train.filter(F.col("group") == 3).select("train_id")
    return impact.impacted_enriched(knn_retrieve(test, train), changed, reused, fresh)


@query("rerun_and_patch", with_(SQL_DOC_INDEX, sql_vote("pred", "idx", "doc_train", "label_new")) + "select prediction_id, prediction from pred")
def rerun_and_patch(spark, d):
    """Incremental: old predictions, patched where the rule edit reaches; the SQL predicts everything anew."""
    index, changed, old, new, _ = _edited(spark, d)
    patched, _ = impact.rerun_and_patch(predict.vote_from_index(index, old), index, changed, new)
    return patched


@query("flagship", with_(SQL_DOC_INDEX, _CHANGED, _IMPACTED, sql_vote("pred", "idx", "doc_train"), sql_vote("pred_new", "idx", "doc_train", "label_new"))
       + """select q.prediction_id, p.prediction as before, n.prediction as after, q.truth, i.prediction_id is not null as rerun
            from doc_test q join pred p using (prediction_id) join pred_new n using (prediction_id) left join impacted i on i.prediction_id = q.prediction_id""")
def flagship(spark, d):
    """Retrieve, classify, edit a labelling rule, rerun what the edit reaches, and show both answers."""
    index, changed, old, new, test = _edited(spark, d)
    before = predict.vote_from_index(index, old)
    after, impacted = impact.rerun_and_patch(before, index, changed, new)
    return (
        test.select("prediction_id", "truth")
        .join(before.select("prediction_id", F.col("prediction").alias("before")), "prediction_id")
        .join(after.select("prediction_id", F.col("prediction").alias("after")), "prediction_id")
        .join(impacted.withColumn("rerun", F.lit(True)), "prediction_id", "left")
        .select("prediction_id", "before", "after", "truth", F.coalesce("rerun", F.lit(False)).alias("rerun"))
    )
