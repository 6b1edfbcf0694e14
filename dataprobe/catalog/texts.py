"""Text functions, corruption, spelling repair, translation, memo tables, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.catalog.registry import (
    EDITED_RULE, R1, R2, R2_NEW, R3, SEED, SQL_DOC_TEST, SQL_DOC_TRAIN, VOCAB_MIN, doc_test, doc_train, query, table, u, with_,
)
from dataprobe.functions import text as T
from dataprobe.functions.draws import seeded_uniform
from dataprobe.functions.labels import rule_label
from dataprobe.functions.prompts import parse_response
from dataprobe.operators import features, memo, noise, ordering, predict, stored, wordfix
from dataprobe.session import scratch_path, written

CLASSES = ("anhedonia", "regular")


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents", "doc_id").select("doc_id", "text")


# ---- character functions ---------------------------------------------------------------------------

SLIPPED = "replace(replace(replace(replace(text, 'n', 'm'), 'b', 'v'), 't', 'r'), 'o', 'p')"


def _letter(key: str, tag: str) -> str:
    offset = f"cast(floor({u(SEED, key, tag, 'i - 1', slot=1)} * 25.0::double) as int)"
    return f"chr(65 + (abs(ascii(c)) + {offset}) % 26)"


def sql_substitute(key: str) -> str:
    draw = u(SEED, key, "'sub'", "i - 1")
    return f"array_to_string(list_transform(string_split(text, ''), lambda c, i: case when {draw} < 0.03 then {_letter(key, chr(39) + 'sub' + chr(39))} else c end), '')"


def sql_insert(key: str) -> str:
    draw = u(SEED, key, "'ins'", "i - 1")
    return f"array_to_string(list_transform(string_split(text, ''), lambda c, i: case when {draw} < 0.02 then c || {_letter(key, chr(39) + 'ins' + chr(39))} else c end), '')"


def sql_delete(key: str) -> str:
    draw = u(SEED, key, "'del'", "i - 1")
    kept = f"list_filter(string_split(text, ''), lambda c, i: {draw} > 0.02)"
    return f"case when len({kept}) > 0 then array_to_string({kept}, '') end"


def sql_kind(key: str) -> str:
    draws = [u(SEED, key, "'kind'", slot=s) for s in range(3)]
    return (
        f"case when {draws[0]} < 0.3 then 'keyboard' when {draws[1]} < 0.3 then 'substitute' when {draws[2]} < 0.3 then 'insert' else 'delete' end"
    )


def sql_corrupted(source: str, key: str) -> str:
    """CTE ``corrupted(key, kind, before, text)``: the drawn tenth of ``source`` with damaged texts."""
    return f"""
picked as (
  select {key}, text, {sql_kind(key)} as kind from (
    select {key}, text, row_number() over (order by {u(SEED, key)}, {key}) as nth, count(*) over () as n from {source})
  where nth <= floor(n * 0.1::double)),
corrupted as (
  select {key}, kind, text as before,
    case kind when 'keyboard' then {SLIPPED} when 'substitute' then {sql_substitute(key)} when 'insert' then {sql_insert(key)} else {sql_delete(key)} end as text
  from picked)"""


@query("fn_regex_rules", f"select doc_id, (({R1} or {R2}) and not {R3}) as label, {R2_NEW} as edited from documents")
def fn_regex_rules(spark, d):
    from dataprobe.catalog.registry import DOC_RULES
    from dataprobe.functions.labels import rule_hit

    return docs(spark, d).select("doc_id", rule_label("text", DOC_RULES).alias("label"), rule_hit("text", EDITED_RULE).alias("edited"))


@query("fn_keyboard_substitute", f"select doc_id, {SLIPPED} as text from documents")
def fn_keyboard_substitute(spark, d):
    return docs(spark, d).select("doc_id", T.keyboard_substitute("text").alias("text"))


@query("fn_char_substitute", f"select doc_id, {sql_substitute('doc_id')} as text from documents")
def fn_char_substitute(spark, d):
    return docs(spark, d).select("doc_id", T.char_substitute("text", SEED, "doc_id").alias("text"))


@query("fn_char_insert", f"select doc_id, {sql_insert('doc_id')} as text from documents")
def fn_char_insert(spark, d):
    return docs(spark, d).select("doc_id", T.char_insert("text", SEED, "doc_id").alias("text"))


@query("fn_char_delete", f"select doc_id, {sql_delete('doc_id')} as text from documents")
def fn_char_delete(spark, d):
    return docs(spark, d).select("doc_id", T.char_delete("text", SEED, "doc_id").alias("text"))


@query("fn_case_random", f"select doc_id, {sql_kind('doc_id')} as kind from documents")
def fn_case_random(spark, d):
    return docs(spark, d).select("doc_id", T.noise_kind(SEED, "doc_id").alias("kind"))


@query("fn_split_join_chars", "select doc_id, len(string_split(text, '')) as chars, array_to_string(string_split(text, ''), '') as text from documents")
def fn_split_join_chars(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.split_chars("text")).cast("long").alias("chars"), T.split_join_chars("text").alias("text"))


@query("ordered_string_agg", "select text as joined, doc_id from documents")
def ordered_string_agg(spark, d):
    """Characters with their positions, sorted and put back together inside the row."""
    placed = F.transform(T.split_chars("text"), lambda c, i: F.struct(i.alias("pos"), c.alias("c")))
    return docs(spark, d).select("doc_id", F.array_join(F.transform(F.array_sort(placed), lambda p: p["c"]), "").alias("joined"))


@query("ordered_string_agg_rows", "select text as joined, doc_id from documents where text <> ''")
def ordered_string_agg_rows(spark, d):
    """The same from a table of (document, position, character) rows."""
    rows = docs(spark, d).select("doc_id", F.posexplode(T.split_chars("text")).alias("pos", "c"))
    return ordering.ordered_string_agg(rows, "doc_id", "pos", "c", "joined")


@query(
    "fn_numeric",
    "select l_orderkey, l_linenumber, abs(l_discount - 1) as gap, l_orderkey % 26 as part, cast(floor(l_extendedprice) as bigint) as whole,"
    " round(sqrt(l_extendedprice), 9) as root, round(l_quantity * l_quantity, 6) as square, least(l_quantity, 10.0) as capped from lineitem",
)
def fn_numeric(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(F.col("l_discount") - 1).alias("gap"), (F.col("l_orderkey") % 26).alias("part"),
        F.floor("l_extendedprice").alias("whole"), F.round(F.sqrt("l_extendedprice"), 9).alias("root"),
        F.round(F.col("l_quantity") * F.col("l_quantity"), 6).alias("square"), F.least(F.col("l_quantity"), F.lit(10.0)).alias("capped"),
    )


@query("fn_seeded_uniform", f"select doc_id, {u(7, 'doc_id', chr(39) + 'x' + chr(39))} as draw, {u(7, 'doc_id', chr(39) + 'x' + chr(39), slot=3)} as fourth from documents")
def fn_seeded_uniform(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", seeded_uniform(7, "doc_id", F.lit("x")).alias("draw"), seeded_uniform(7, "doc_id", F.lit("x"), slot=3).alias("fourth")
    )


SQL_BLANK = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
SQL_WORDS = f"case when {SQL_BLANK} = '' then 0 else len(string_split_regex({SQL_BLANK}, '\\s+')) end"


@query("fn_word_count", f"select doc_id, {SQL_WORDS} as words from documents")
def fn_word_count(spark, d):
    return docs(spark, d).select("doc_id", T.word_count("text").cast("long").alias("words"))


@query("fn_to_string_key", "select cast(doc_id as varchar) as id, md5(text) as text_key from documents")
def fn_to_string_key(spark, d):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), T.to_key("text").alias("text_key"))


# ---- corruption and repair -------------------------------------------------------------------------


@query("corrupt_text", with_("docs as (select doc_id, text from documents)", sql_corrupted("docs", "doc_id"))
       + "select d.doc_id, case when c.doc_id is not null then c.text else d.text end as text from docs d left join corrupted c on d.doc_id = c.doc_id")
def corrupt_text(spark, d):
    return noise.corrupt_text(docs(spark, d), "doc_id", "text", 0.1, SEED)


@query("corruption_diff", with_("docs as (select doc_id, text from documents)", sql_corrupted("docs", "doc_id"))
       + "select doc_id, text from corrupted where text is distinct from before")
def corruption_diff(spark, d):
    return noise.corruption_diff(docs(spark, d), "doc_id", "text", 0.1, SEED)


SQL_WORD = "[\\p{L}\\p{M}]"
SQL_PIECE = "[\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+"


def sql_vocab(source: str, min_count: int) -> str:
    return f"""
vocab as (select token, count(*) as n from (select unnest(regexp_extract_all(text, '{SQL_WORD}+')) as token from {source}) group by token having count(*) >= {min_count})"""


# DuckDB measures edits in bytes; each accented letter of the test texts becomes one byte no word contains.
_ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_BYTES = "0123456789!#$%&()*+,-"[: len(_ACCENTS)]


def _flat(col: str) -> str:
    return f"translate({col}, '{_ACCENTS}', '{_BYTES}')"


def sql_fixes(source: str, distance: int = 2) -> str:
    """CTE ``fixes(token, fix)`` by comparing every unknown word of ``source`` with the whole vocabulary."""
    return f"""
unknown as (
  select token, {_flat('token')} as flat from (select distinct unnest(regexp_extract_all(text, '{SQL_WORD}+')) as token from {source})
  where token not in (select token from vocab)),
known as (select token, n, {_flat('token')} as flat, length(token) as len from vocab),
fixes as (
  select token, fix from (
    select a.token, b.token as fix,
           row_number() over (partition by a.token order by levenshtein(a.flat, b.flat), b.n desc, b.token) as nth
    from unknown a join known b on abs(length(a.token) - b.len) <= {distance} and levenshtein(a.flat, b.flat) <= {distance}) where nth = 1)"""


def sql_rewritten(name: str, source: str, key: str, fixes: str) -> str:
    return f"""
{name}_p as (select {key}, unnest(pieces) as piece, generate_subscripts(pieces, 1) as pos
             from (select {key}, regexp_extract_all(text, '{SQL_PIECE}') as pieces from {source})),
{name}_j as (select p.{key}, string_agg(coalesce(f.fix, p.piece), '' order by p.pos) as out from {name}_p p left join {fixes} f on f.token = p.piece group by 1),
{name} as (select s.{key}, coalesce(j.out, s.text) as text from {source} s left join {name}_j j on j.{key} = s.{key})"""


SQL_REPAIRED = (
    SQL_DOC_TRAIN + "," + SQL_DOC_TEST + "," + sql_vocab("doc_train", VOCAB_MIN) + "," + sql_corrupted("doc_test", "prediction_id") + ","
    + "corrupt_diff as (select prediction_id, text, before from corrupted where text is distinct from before)," + sql_fixes("corrupt_diff") + ","
    + sql_rewritten("repaired", "corrupt_diff", "prediction_id", "fixes")
)


@query("vocab_counts", f"select token, count(*) as n from (select unnest(regexp_extract_all(text, '{SQL_WORD}+')) as token from documents) group by token having count(*) >= {VOCAB_MIN}")
def vocab_counts(spark, d):
    return wordfix.vocab_counts(docs(spark, d), "text", VOCAB_MIN)


def _corrupt_diff(spark, d) -> DataFrame:
    return noise.corruption_diff(doc_test(spark, d).select("prediction_id", "text"), "prediction_id", "text", 0.1, SEED)


@query("spelling_fixes", with_(SQL_REPAIRED) + "select token, fix from fixes")
def spelling_fixes(spark, d):
    vocab = written(wordfix.vocab_counts(doc_train(spark, d), "text", VOCAB_MIN), "vocab")
    unknown = wordfix.vocab_counts(_corrupt_diff(spark, d), "text").join(vocab.select("token"), "token", "left_anti")
    return wordfix.spelling_fixes(written(unknown, "unknown"), vocab)


@query("repair_text", with_(SQL_REPAIRED) + "select prediction_id, text from repaired")
def repair_text(spark, d):
    vocab = written(wordfix.vocab_counts(doc_train(spark, d), "text", VOCAB_MIN), "vocab")
    return wordfix.repair_text(written(_corrupt_diff(spark, d), "corrupted"), "prediction_id", "text", vocab)


# ---- translation and memo tables -------------------------------------------------------------------

LEXICON_BUCKETS = 4096


def lexicon(spark, d) -> DataFrame:
    """A lexicon made of the corpus itself: each foreign word gets an English word of the same hash bucket."""
    rows = table(spark, d, "documents", "doc_id")
    word = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD_CLASS + "+"), F.lit(0))).alias("token"))
    bucket = features.token_bucket(F.col("token"), LEXICON_BUCKETS).alias("bucket")
    english = word(rows.filter(F.col("lang") == "en")).groupBy(bucket).agg(F.min("token").alias("target"))
    foreign = word(rows.filter(F.col("lang") != "en")).distinct().select("token", bucket)
    return foreign.join(english, "bucket").select("token", "target")


SQL_LEXICON = f"""
en_words as (select distinct unnest(regexp_extract_all(text, '{SQL_WORD}+')) as token from documents where lang = 'en'),
other_words as (select distinct unnest(regexp_extract_all(text, '{SQL_WORD}+')) as token from documents where lang <> 'en'),
en_buckets as (select cast('0x' || substr(md5(token), 1, 8) as bigint) % {LEXICON_BUCKETS} as bucket, min(token) as target from en_words group by 1),
lexicon as (select o.token, e.target as fix from other_words o join en_buckets e on e.bucket = cast('0x' || substr(md5(o.token), 1, 8) as bigint) % {LEXICON_BUCKETS})"""


@query("lexicon_translate", with_(SQL_LEXICON, "all_docs as (select doc_id, text from documents)",
       sql_rewritten("translated", "all_docs", "doc_id", "lexicon")) + "select doc_id, text from translated")
def lexicon_translate(spark, d):
    return wordfix.lexicon_translate(docs(spark, d), "doc_id", "text", lexicon(spark, d))


def _slip(rows: DataFrame) -> DataFrame:
    return rows.select("input_hash", T.keyboard_substitute("input").alias("output"))


def _first_memo(spark, d) -> DataFrame:
    """Entries of an earlier run: the texts of five sources, at version 1."""
    known = table(spark, d, "documents").filter(F.col("source").isin("src0", "src1", "src2", "src3", "src4")).select(F.col("text").alias("input")).distinct()
    return memo.memo_rows(known.withColumn("output", F.concat(F.lit("memo:"), T.keyboard_substitute("input"))), 1)


SQL_MEMO = f"""
memo as (select distinct md5(text) as input_hash, text as input, 'memo:' || {SLIPPED} as output, 1::bigint as version
         from documents where source in ('src0', 'src1', 'src2', 'src3', 'src4')),
newer as (select distinct md5(text) as input_hash from documents where source in ('src0', 'src1'))"""


@query("udf_cached_transform", with_(SQL_MEMO) + f"select doc_id, case when m.output is null then {SLIPPED} when n.input_hash is not null then 'again:' || {SLIPPED} else m.output end as text"
       " from documents d left join memo m on m.input_hash = md5(d.text) left join newer n on n.input_hash = md5(d.text)")
def udf_cached_transform(spark, d):
    """Against a stored memo that holds two versions of some inputs: the later one answers."""
    path = scratch_path(spark, "memo.parquet")
    first = _first_memo(spark, d)
    memo.cache_table_write(first, path)
    again = table(spark, d, "documents").filter(F.col("source").isin("src0", "src1")).select(F.col("text").alias("input")).distinct()
    memo.cache_table_write(memo.memo_rows(again.withColumn("output", F.concat(F.lit("again:"), T.keyboard_substitute("input"))), 2), path)
    out, _ = memo.cached_transform(docs(spark, d), "doc_id", "text", memo.cache_table_read(spark, path), _slip, version=3)
    return out


@query("cache_table_upsert", with_(SQL_MEMO) + f"""select input_hash, input, output, version from memo where input_hash not in (select md5(text) from documents where lang = 'fr')
       union all select distinct md5(text), text, {SLIPPED}, 2::bigint from documents where lang = 'fr'""")
def cache_table_upsert(spark, d):
    fresh = table(spark, d, "documents").filter(F.col("lang") == "fr").select(F.col("text").alias("input")).distinct()
    return memo.cache_table_upsert(_first_memo(spark, d), memo.memo_rows(fresh.withColumn("output", T.keyboard_substitute("input")), 2))


@query("cache_table_upsert_stored", with_(SQL_MEMO) + f"""select input_hash, input, output, version from memo where input_hash not in (select md5(text) from documents where lang = 'fr')
       union all select distinct md5(text), text, {SLIPPED}, 2::bigint from documents where lang = 'fr'""")
def cache_table_upsert_stored(spark, d):
    """The same memo as a stored table of parts: only parts that hold a French text are written again."""
    path, schema = scratch_path(spark, "memo_parts"), "input_hash string, input string, output string, version bigint"
    stored.create(_first_memo(spark, d), path, "input_hash")
    fresh = table(spark, d, "documents").filter(F.col("lang") == "fr").select(F.col("text").alias("input")).distinct()
    stored.upsert(written(memo.memo_rows(fresh.withColumn("output", T.keyboard_substitute("input")), 2), "fresh"), path, "input_hash", schema)
    return stored.read(spark, path, schema)


@query("cache_table_read", f"select distinct md5(text) as input_hash, text as input, 'memo:' || {SLIPPED} as output, 1::bigint as version from documents")
def cache_table_read(spark, d):
    path = scratch_path(spark, "memo.parquet")
    every = table(spark, d, "documents").select(F.col("text").alias("input")).distinct()
    memo.cache_table_write(memo.memo_rows(every.withColumn("output", F.concat(F.lit("memo:"), T.keyboard_substitute("input"))), 1), path)
    return memo.cache_table_read(spark, path)


@query("enrich_incremental", f"""
  select doc_id, text as before, case when source in ('src0', 'src1', 'src2', 'src3', 'src4') then 'first:' || {SLIPPED} else {SLIPPED} end as after
  from documents where lang <> 'en'""")
def enrich_incremental(spark, d):
    """Round 1 enriched five sources; round 2 wants every foreign text and reuses what round 1 has."""
    rows = table(spark, d, "documents", "doc_id").select("doc_id", "lang", "source", "text")
    first = rows.filter(F.col("source").isin("src0", "src1", "src2", "src3", "src4"))
    done = first.select("doc_id", F.col("text").alias("before"), F.concat(F.lit("first:"), T.keyboard_substitute("text")).alias("after"))
    slip = lambda df: df.select("doc_id", T.keyboard_substitute("text").alias("text"))
    return memo.enrich_incremental(rows.filter(F.col("lang") != "en"), rows, done, slip, "doc_id", "text")


# ---- plug-in functions, prompts and answers --------------------------------------------------------


@query("udf_text_transform", "select doc_id, replace(text, 'the', 'THE') as text from documents")
def udf_text_transform(spark, d):
    return predict.udf_text_transform(docs(spark, d), "doc_id", "text", lambda batch: [t.replace("the", "THE") for t in batch])


@query("udf_predictor", "select doc_id as prediction_id, (length(text) > 1000)::int as prediction from documents")
def udf_predictor(spark, d):
    rows = docs(spark, d).withColumnRenamed("doc_id", "prediction_id")
    return predict.udf_predictor(rows, lambda texts: [int(len(t) > 1000) for t in texts], "text")


SQL_RESPONSE = """
responses as (select doc_id as prediction_id, case doc_id % 6 when 0 then '{"label": "anhedonia"}' when 1 then '{"label": "regular"}'
  when 2 then '{"label": "' || lang || '"}' when 3 then '{"answer": "regular"}' when 4 then source else '["regular"]' end as response from documents)"""


@query("fn_response_parse", with_(SQL_RESPONSE) + f"""
  select prediction_id, (case label when 'anhedonia' then 0 when 'regular' then 1 else case when {u(SEED, 'prediction_id', "'answer'")} < 0.5 then 0 else 1 end end)::int as prediction
  from (select prediction_id, case when response like '{{%}}' then json_extract_string(response, '$.label') end as label from responses)""")
def fn_response_parse(spark, d):
    kind = F.col("doc_id") % 6
    response = (
        F.when(kind == 0, '{"label": "anhedonia"}').when(kind == 1, '{"label": "regular"}')
        .when(kind == 2, F.concat(F.lit('{"label": "'), F.col("lang"), F.lit('"}'))).when(kind == 3, '{"answer": "regular"}')
        .when(kind == 4, F.col("source")).otherwise('["regular"]')
    )
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("prediction_id"), response.alias("response"))
    return rows.select("prediction_id", parse_response("response", CLASSES, SEED, "prediction_id").alias("prediction"))


@query("inference_cost", with_(SQL_DOC_TEST, sql_corrupted("doc_test", "prediction_id")) + f"""
  select round(f.words * 3 / 500.0, 6) as full_seconds, round(p.words * 3 / 500.0, 6) as diff_seconds, round((f.words - p.words) * 3 / 500.0, 6) as saved_seconds,
         round(p.words * 4 / 6000.0, 6) as translation_seconds
  from (select sum({SQL_WORDS})::double as words from doc_test) f cross join (select sum({SQL_WORDS})::double as words from corrupted where text is distinct from before) p""")
def inference_cost(spark, d):
    """Estimated service time of predicting the whole test set, only its changed rows, and the difference."""
    full = doc_test(spark, d).agg(F.sum(T.word_count("text")).alias("words")).scalar()
    part = _corrupt_diff(spark, d).agg(F.sum(T.word_count("text")).alias("part"))
    cost = lambda c, **k: F.round(predict.service_seconds(c, **k), 6)
    return part.withColumn("full", full).select(
        cost(F.col("full")).alias("full_seconds"), cost(F.col("part")).alias("diff_seconds"),
        cost(F.col("full") - F.col("part")).alias("saved_seconds"), cost(F.col("part"), translation=True).alias("translation_seconds"),
    )
