import pytest
from conftest import rows
from pyspark.sql import functions as F

from dataprobe.functions import labels as L
from dataprobe.functions import text as T
from dataprobe.functions.draws import seeded_uniform
from dataprobe.functions.prompts import parse_response, prompt_parts
from dataprobe.functions.vectors import array_distance
from dataprobe.operators.labels import weak_label


def one(spark, expr, schema="text string", value=("x",)):
    return spark.createDataFrame([value], schema).select(expr).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("I have no motivation", True),
        ("I lost all interest", True),
        ("losing any pleasure", True),
        ("nothing here", False),
        ("NO MOTIVATION", False),
        (None, False),
        ("recovering slowly from no motivation", False),
        ("lost some\nday interest", False),
        ("lost some\rday interest", True),
        ("lost more than fifteen letters of interest", False),
    ],
)
def test_symptom_rules(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert weak_label(df, "text", L.SYMPTOM_RULES).first()["label"] is expected


def test_all_rule_combinations(spark):
    rules = L.RuleSet(positives=("a", "b"), negatives=("c",))
    texts = [p + q + r for p in ("", "a") for q in ("", "b") for r in ("", "c")]
    got = weak_label(spark.createDataFrame([(t,) for t in texts], "text string"), "text", rules).collect()
    assert all(r["label"] == (("a" in r["text"] or "b" in r["text"]) and "c" not in r["text"]) for r in got)


def test_weak_label_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "no motivation"), (2, "fine")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = weak_label(stream, "text", L.SYMPTOM_RULES).writeStream.format("memory").queryName("weak").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["id"], r["label"]) for r in spark.table("weak").collect()} == {(1, True), (2, False)}


def test_binarize_marks_the_last_class(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "y boolean")
    assert [r[0] for r in df.select(L.binarize("y", (True, False))).collect()] == [0, 1, None]
    with pytest.raises(ValueError):
        L.binarize("y", ("a", "b", "c"))


def test_key_slips_equal_nested_replacements(spark):
    text = "boston bottom north"
    expected = text.replace("n", "m").replace("b", "v").replace("t", "r").replace("o", "p")
    assert one(spark, T.keyboard_substitute("text"), value=(text,)) == expected


@pytest.mark.parametrize("text", ["", "abc", "é😀x", " two  words\n"])
def test_pieces_and_chars_are_lossless(spark, text):
    assert one(spark, F.array_join(T.text_pieces("text"), ""), value=(text,)) == text
    assert one(spark, T.split_join_chars("text"), value=(text,)) == text


def test_noise_extremes(spark):
    df = spark.createDataFrame([(1, "abcé😀")], "id long, text string")
    assert df.select(T.char_delete("text", 1, "id", rate=1.0)).first()[0] is None
    assert df.select(T.char_delete("text", 1, "id", rate=-1.0)).first()[0] == "abcé😀"
    assert df.select(T.char_insert("text", 1, "id", rate=0.0)).first()[0] == "abcé😀"
    longer = df.select(T.char_insert("text", 1, "id", rate=1.1)).first()[0]
    assert len(longer) == 10 and longer[0::2] == "abcé😀" and all("A" <= c <= "Z" for c in longer[1::2])
    assert all("A" <= c <= "Z" for c in df.select(T.char_substitute("text", 1, "id", rate=1.1)).first()[0])


def test_draws_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = rows(df.repartition(1).select("k", seeded_uniform(3, "k").alias("u")))
    assert a == rows(df.repartition(7).select("k", seeded_uniform(3, "k").alias("u")))
    values = [u for _, u in a]
    assert 0 <= min(values) and max(values) < 1 and abs(sum(values) / 500 - 0.5) < 0.05
    kinds = dict(rows(df.select("k", T.noise_kind(3, "k").alias("kind")).groupBy("kind").count()))
    assert set(kinds) == set(T.KIND_NAMES) and kinds["delete"] > kinds["insert"]


@pytest.mark.parametrize("text, n", [("", 0), ("  ", 0), ("one", 1), (" a  b\nc ", 3), (None, None)])
def test_word_count(spark, text, n):
    got = one(spark, T.word_count("text"), value=(text,))
    assert got == n or (n is None and got in (None, -1))


def test_response_parse(spark):
    answers = ['{"label": "anhedonia"}', '{"label": "regular"}', '{"label": "other"}', '{"x": 1}', "no json", '["regular"]', None]
    df = spark.createDataFrame(list(enumerate(answers)), "id long, response string")
    got = dict(rows(df.select("id", parse_response("response", L.SYMPTOM_CLASSES, 1, "id"))))
    assert got[0] == 0 and got[1] == 1 and set(got.values()) <= {0, 1}
    head, middle, tail = prompt_parts(L.SYMPTOM_CLASSES)
    assert "['anhedonia', 'regular']" in head and "Training data:" in head and "JSON" in tail and "```" in middle


def test_array_distance(spark):
    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0])], "a array<float>, b array<double>")
    assert df.select(array_distance("a", "b")).first()[0] == 5.0
