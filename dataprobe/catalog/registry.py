"""The query registry and the tables that stand in for users, texts, test set, vectors and run ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.functions.draws import seeded_uniform
from dataprobe.functions.labels import RuleSet, binarize
from dataprobe.operators.features import bag_features
from dataprobe.operators.labels import weak_label
from dataprobe.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return add


def runnable() -> dict[str, Query]:
    return {name: entry.run for name, entry in REGISTRY.items()}


def oracles() -> dict[str, str]:
    return {name: entry.sql for name, entry in REGISTRY.items() if entry.sql is not None}


# ---- whole vectors as one comparable value ---------------------------------------------------------


def packed(vector: str) -> Column:
    """Every element in millionths, joined: what a query reports of a vector."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 1000000.0).cast("long").cast("string")), ",")


def sql_packed(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: cast(cast(round(x::double * 1000000.0) as bigint) as varchar)), ',')"


# ---- rules on the document table -------------------------------------------------------------------

DOC_RULES = RuleSet(positives=(r"(the|of|and) (in|to|is)", r"(Apache|MIT|Public) License"), negatives=(r"&&&",))
EDITED_RULE = r"(MIT|Public) License"
EDITED_INDEX = 1
SEED = 42
SPLIT_SEED = 11
TEST_SHARE = 0.2
DIMS = 32
VOCAB_MIN = 5


# ---- stand-in tables -------------------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str, spread_by: str | None = None) -> DataFrame:
    return read_table(spark, f"{d}/{name}.parquet", spread_by=spread_by)


# Judgements up to this number are sent to every task (about 50 bytes each), so that texts stay where they are read; more meet them in a shuffle.
SENT_LABELS = 2_000_000


def sent(labels: DataFrame) -> DataFrame:
    return F.broadcast(labels) if labels.count() <= SENT_LABELS else labels


def users(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), "lang", F.col("source").alias("country"))


def tweets(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), F.col("text").alias("tweet"))


def doc_train(spark, d) -> DataFrame:
    """Documents nobody judged, with rule columns, boolean ``weak`` and 0/1 ``label`` (1 = not positive)."""
    judged = sent(table(spark, d, "labels").select("doc_id"))
    rows = table(spark, d, "documents", "doc_id").join(judged, "doc_id", "left_anti")
    labelled = weak_label(rows, "text", DOC_RULES, "weak")
    return labelled.withColumn("label", binarize("weak", (True, False))).withColumnRenamed("doc_id", "train_id")


def doc_test(spark, d) -> DataFrame:
    """Judged documents: boolean ``judged`` and 0/1 ``truth`` (1 = not positive)."""
    rows = table(spark, d, "documents", "doc_id").join(sent(table(spark, d, "labels")), "doc_id")
    out = rows.withColumn("judged", F.col("quality") == 1)
    return out.withColumn("truth", binarize("judged", (True, False))).withColumnRenamed("doc_id", "prediction_id")


def doc_features(rows: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return bag_features(rows, key, "text", DIMS, keep=keep)


def vec_split(spark, d) -> tuple[DataFrame, DataFrame]:
    """(train, test) vectors: a keyed draw sends a fifth of the rows to the test side."""
    rows = table(spark, d, "embeddings").select(
        "vec_id", "embedding", F.col("label").alias("group"), F.when(F.col("label") < 5, 1).otherwise(0).alias("label")
    )
    is_test = seeded_uniform(SPLIT_SEED, "vec_id") < TEST_SHARE
    train = rows.filter(~is_test).withColumnRenamed("vec_id", "train_id")
    test = rows.filter(is_test).withColumnRenamed("vec_id", "prediction_id")
    return train, test


def ledger(spark, d) -> DataFrame:
    """Run times derived from the events table: one row per event."""
    e = table(spark, d, "events")
    scenario = (
        F.when(F.col("event_type").isin("click", "signup"), "fairness")
        .when(F.col("event_type").isin("view", "error"), "robustness")
        .otherwise("mislabel")
    )
    opt = F.element_at(F.array(F.lit("naive"), F.lit("opt"), F.lit("proxy_opt")), (F.col("event_id") % 3 + 1).cast("int"))
    second = F.col("user_id") % 2 == 1
    return e.select(
        F.when(second, "exp2").otherwise("exp1").alias("experiment"),
        scenario.alias("scenario"),
        F.when(F.col("user_id") % 3 == 0, "llm").otherwise("ml").alias("variant"),
        opt.alias("opt"),
        (F.col("value") * 10).alias("original_pipeline"),
        F.col("value").alias("detect_eval_1"),
        (F.col("value") * 2).alias("fix_eval_1"),
        F.when(opt != "naive", F.col("value") / 2).alias("explanation_1"),
        F.when(second, F.col("value") * 3).alias("detect_eval_2"),
        F.when(second, F.col("value") * 4).alias("fix_eval_2"),
        F.when(second & (opt != "naive"), F.col("value") / 4).alias("explanation_2"),
    )


LEDGER_ONE = ["original_pipeline", "detect_eval_1", "fix_eval_1", "explanation_1"]
LEDGER_ALL = LEDGER_ONE + ["detect_eval_2", "fix_eval_2", "explanation_2"]


# ---- the same stand-ins as SQL ---------------------------------------------------------------------


def u(seed: int, *parts: str, slot: int = 0) -> str:
    """SQL text of ``seeded_uniform``."""
    key = ", ".join(parts)
    return f"(cast('0x' || substr(md5(concat_ws(':', '{seed}', {key})), {1 + 8 * slot}, 8) as bigint) / 4294967296.0::double)"


def hit(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, '{pattern}'), false)"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n"


R1, R2, R3 = (hit("text", p) for p in DOC_RULES.patterns)
R2_NEW = hit("text", EDITED_RULE)

SQL_DOC_TRAIN = f"""
doc_train as (
  select *, ((rule_1 or rule_2) and not rule_3) as weak, (not ((rule_1 or rule_2) and not rule_3))::int as label,
         ((rule_1 or rule_2_new) and not rule_3) as weak_new, (not ((rule_1 or rule_2_new) and not rule_3))::int as label_new
  from (select doc_id as train_id, text, lang, source, n_chars, {R1} as rule_1, {R2} as rule_2, {R3} as rule_3, {R2_NEW} as rule_2_new
        from documents where doc_id not in (select doc_id from labels)))"""

SQL_DOC_TEST = """
doc_test as (
  select d.doc_id as prediction_id, d.text, d.lang, d.source, d.n_chars, l.quality = 1 as judged, (l.quality <> 1)::int as truth
  from documents d join labels l using (doc_id))"""


def sql_features(name: str, source: str, key: str, dims: int = DIMS) -> str:
    """Bag-of-words vectors of ``source(key, text)``."""
    blank = "regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g')"
    return f"""
{name}_tok as (
  select {key}, cast('0x' || substr(md5(w), 1, 8) as bigint) % {dims} as b
  from (select {key}, unnest(case when {blank} = '' then [] else string_split_regex({blank}, '\\s+') end) as w from {source})),
{name}_cnt as (select {key}, b, count(*) as n from {name}_tok group by all),
{name}_all as (
  select s.{key}, g.b, coalesce(c.n, 0) as n
  from (select distinct {key} from {source}) s cross join (select unnest(range({dims})) as b) g
  left join {name}_cnt c on c.{key} = s.{key} and c.b = g.b),
{name} as (
  select {key}, list(case when s = 0 then 0.0::double else n / sqrt(s::double) end order by b) as v
  from (select *, sum(n * n) over (partition by {key}) as s from {name}_all) group by {key})"""


SQL_VEC_SPLIT = f"""
vec_rows as (select vec_id, embedding::double[] as v, embedding, label as grp, (label < 5)::int as label,
                    {u(SPLIT_SEED, 'vec_id')} < {TEST_SHARE} as is_test from embeddings),
tr as (select vec_id as train_id, v, embedding, grp, label from vec_rows where not is_test),
te as (select vec_id as prediction_id, v, embedding, grp, label as truth from vec_rows where is_test)"""


def sql_index(name: str, queries: str, train: str, k: int = 4, query_id: str = "prediction_id") -> str:
    """k nearest of ``train(train_id, v)`` for ``queries(query_id, v)``."""
    return f"""
{name} as (
  select {query_id}, rank, train_id, distance from (
    select q.{query_id}, t.train_id, round(list_distance(q.v, t.v), 9) as distance,
           row_number() over (partition by q.{query_id} order by round(list_distance(q.v, t.v), 9), t.train_id) as rank
    from {queries} q cross join {train} t) where rank <= {k})"""


def sql_vote(name: str, index: str, labels: str, label: str = "label", tie: str = "nearest", query_id: str = "prediction_id") -> str:
    order = "nearest" if tie == "nearest" else "label"
    return f"""
{name} as (
  select {query_id}, label as prediction from (
    select {query_id}, label, row_number() over (partition by {query_id} order by votes desc, {order}) as nth
    from (select i.{query_id}, l.{label} as label, count(*) as votes, min(i.rank) as nearest
          from {index} i join {labels} l using (train_id) group by 1, 2)) where nth = 1)"""


SQL_VEC_INDEX = sql_index("idx", "te", "tr")
SQL_VEC_VOTE = sql_vote("pred", "idx", "tr")
SQL_DOC_INDEX = (
    SQL_DOC_TRAIN + "," + SQL_DOC_TEST + "," + sql_features("f_train", "doc_train", "train_id") + ","
    + sql_features("f_test", "doc_test", "prediction_id") + "," + sql_index("idx", "f_test", "f_train")
)

SQL_LEDGER = """
ledger as (
  select case when user_id % 2 = 1 then 'exp2' else 'exp1' end as experiment,
         case when event_type in ('click', 'signup') then 'fairness' when event_type in ('view', 'error') then 'robustness' else 'mislabel' end as scenario,
         case when user_id % 3 = 0 then 'llm' else 'ml' end as variant,
         ['naive', 'opt', 'proxy_opt'][event_id % 3 + 1] as opt,
         value * 10 as original_pipeline, value as detect_eval_1, value * 2 as fix_eval_1,
         case when event_id % 3 <> 0 then value / 2 end as explanation_1,
         case when user_id % 2 = 1 then value * 3 end as detect_eval_2, case when user_id % 2 = 1 then value * 4 end as fix_eval_2,
         case when user_id % 2 = 1 and event_id % 3 <> 0 then value / 4 end as explanation_2
  from events)"""
SQL_MEDIANS = """
med as (select experiment, scenario, variant, opt, """ + ", ".join(f"median({c}) as {c}" for c in LEDGER_ALL) + """
        from ledger group by all)"""
