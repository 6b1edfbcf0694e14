"""Queries on the smallest tables, and operators on rows of edge cases, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from dataprobe.llm import chains, decontaminate, licenses, mixing, quality, queries, simhash, suffix_dedup, urls, warc
from tests.llm import brute

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def edge_texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"word{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = say(70), say(120)
    texts = [None, "", " ", "a", "A b", "A B c", "\n\n", "x" * 49, "x" * 50, "x" * 51, "x" * 500, "ab" * 400, base, base, base, base.replace("word1 ", "WORD1 "), base[:300] + "é" + base[300:]]
    texts += [say(30) + " " + passage + " " + say(25) for _ in range(6)]
    texts += [base[k:] for k in range(1, 60, 7)] + ["line one\nline one\nline two\n" * 30, "É" * 60 + "É" * 60, "日本語 " * 80, "under the MIT license " * 3 + say(4)]
    texts += [say(4000), "the same words here " * 900, "This is CC BY-NC. Apache License, Version 2.0. (MIT)\nSPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */"]
    for _ in range(12):
        cut = base.split()
        cut[rng.randrange(len(cut))] = rng.choice(vocabulary)
        texts.append(" ".join(cut))
    return texts


@pytest.fixture(scope="module")
def edge(spark):
    """Rows of edge cases: null ids, repeated rows, an extra column with a clashing name."""
    rows = [(i * 3 - 20, t, None, "s" if i % 3 else None, None) for i, t in enumerate(edge_texts())]
    rows += [rows[12], rows[18], (None, rows[12][1], "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(5).withColumn("n_words", F.lit("mine")).withColumn("fingerprint", F.lit("mine")).withColumn("id", F.lit("mine"))


def by(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def check_quality(df):
    got = by(quality.rule_ledger(df), "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_bits")
    want = by(df, "doc_id", "text")
    assert [r[:2] for r in got] == want
    for r in got:
        assert r[2:7] == brute.quality(r[1])[:5] and bool(r[7] & quality.BASE) == brute.quality(r[1])[5], r


def check_suffix(df):
    found = suffix_dedup.suffix_dedup(df, keep=["doc_id", "text"])
    got = by(found.select("doc_id", "text", F.octet_length("kept").alias("left"), F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).alias("spans"), F.sha2("kept", 256).alias("sha")), "doc_id", "text", "left", "spans", "sha")
    want = brute.suffix([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    assert [r[:2] for r in got] == by(df, "doc_id", "text")
    for d, t, left, spans, sha in got:
        n, gone, runs, digest = want[d, t]
        assert (left, spans, sha) == (n - gone, runs, digest), (d, t)


def check_contamination(df, benchmark):
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    found = decontaminate.contamination(df, benchmark).collect()
    got = sorted(((r["id"], r["n_words"], r["n_hit"], sorted(map(str, r["items"]))) for r in found), key=repr)
    want = []
    for r in df.collect():
        n, hit, _, _, _ = brute.contamination(r["text"], items)
        each = [i for i, s in items if brute.contamination(r["text"], [(i, s)])[4]]
        want.append((r["doc_id"], n, hit, sorted({str(i) for i in each})))
    assert got == sorted(want, key=repr)


def check_simhash(df):
    got = simhash.simhash_components(df, keep=["doc_id", "text"]).select("doc_id", "text", simhash.hex16(F.col("fingerprint")).alias("f"), "component_id").collect()
    prints = [(r["doc_id"], brute.fingerprint(r["text"])) for r in got]
    assert [f"{p:016x}" for _, p in prints] == [r["f"] for r in got]
    distinct = sorted({p for _, p in prints})
    least = {p: min((d for d, q in prints if q == p and d is not None), default=float("inf")) for p in distinct}
    group = brute.linked([(i, p) for i, p in enumerate(distinct)])
    best = {}
    for i, p in enumerate(distinct):
        best[group[i]] = min(best.get(group[i], float("inf")), least[p])
    want = {p: best[group[i]] for i, p in enumerate(distinct)}
    for (_, p), r in zip(prints, got):
        assert r["component_id"] == (None if want[p] == float("inf") else want[p])


def check_licences(df):
    for r in licenses.license_scan(df.withColumnRenamed("n_words", "other")).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licence(r["text"])
        assert (r["labels"], r["score"]) == brute.licence_labels(r["text"])


@pytest.fixture(scope="module")
def tables(spark, folder):
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark", "pages", "conversations")}


def test_quality(tables, edge):
    check_quality(tables["documents"])
    check_quality(edge.drop("n_words"))
    assert "n_words" in quality.rule_ledger(edge).columns


def test_quality_policies(tables):
    ledger = quality.rule_ledger(tables["documents"]).cache()
    bits = [r[0] for r in ledger.select("failed_bits").collect()]
    for policy, mask in quality.POLICIES.items():
        assert ledger.filter(~quality.rejected(policy)).count() == sum(not b & mask for b in bits)
        for r in quality.ablations(ledger, policy).collect():
            bit = quality.BIT[r["rule"]]
            assert (r["failed"], r["only"], r["kept_without"]) == (sum(bool(b & bit) for b in bits), sum(b & mask == bit for b in bits), sum(not b & mask & ~bit for b in bits))
    kept = quality.quality_filter(tables["documents"])
    assert kept.columns == tables["documents"].columns


def test_suffix(tables, edge):
    check_suffix(tables["documents"])
    check_suffix(edge)


def test_suffix_small_buckets(tables, edge, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BUCKET", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 1 << 13)
    monkeypatch.setattr(suffix_dedup, "_SORTED", 1 << 11)
    monkeypatch.setattr(suffix_dedup, "_PART", 1 << 11)
    check_suffix(edge)


def test_contamination(spark, tables, edge, monkeypatch):
    check_contamination(tables["documents"], tables["benchmark"])
    some = [t for t in edge_texts() if t and len(t) > 200][:6]
    items = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "A", "a b c", "the same words here the same", some[0][40:180], some[1], some[3][100:260], "É" * 60])], "item_id int, text string")
    check_contamination(edge, items)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    check_contamination(edge, items)


def test_decontaminate_cuts(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Clean words, {passage.upper()}! And (a tail) of many more clean words here that stay.", "x"), (2, passage + ".", "x"), (3, "Nothing.", "x"), (3, None, "x")], "doc_id int, text string, words string")
    left = {(r["doc_id"], r["text"]) for r in decontaminate.decontaminate(docs, spark.createDataFrame([(7, passage)], "item_id int, text string")).collect()}
    assert left == {(1, "Clean words, And (a tail) of many more clean words here that stay."), (3, "Nothing."), (3, None)}


def test_simhash(tables, edge):
    check_simhash(tables["documents"])
    check_simhash(edge)


def test_simhash_links_every_close_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint")).collect()}
    mask = (1 << 64) - 1
    assert got == {(min(x, y), max(x, y)) for x in signed for y in signed if x != y and bin((x ^ y) & mask).count("1") <= 3}


def test_licences(tables, edge):
    check_licences(tables["documents"])
    check_licences(edge)


@pytest.mark.parametrize(
    "said, want",
    [("MIT", ({"mit"}, True, None)), ("GPL-3.0-only OR MIT AND ISC", ({"gpl", "mit", "isc"}, True, None)), ("(GPL-3.0-only OR MIT) AND GPL-2.0+", ({"gpl", "mit"}, False, None)),
     ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ({"gpl with classpath-exception-2.0", "mit"}, True, None)), ("MIT */", ({"mit"}, True, None)), ("OR MIT", (set(), False, None)),
     ("(MIT", (set(), False, None)), ("", (set(), False, None)), ("MIT AND", ({"mit"}, True, None)), ("(MIT OR ISC) WITH x", ({"mit", "isc"}, True, None)), ("see LICENSE file", (set(), False, "see")),
     ("MIT OR", ({"mit"}, True, None)), ("MIT OR Foo-1.0", ({"mit"}, True, "foo-1.0")), ("GPL-2.0 WITH MIT", ({"gpl"}, False, "mit")), ("Classpath-exception-2.0", (set(), False, "classpath-exception-2.0")),
     ("Apache-2.0 MIT", ({"apache-2"}, True, None)), ("LicenseRef-mine AND MIT", ({"licenseref", "mit"}, False, None))],
)
def test_expressions(said, want):
    assert licenses.evaluate(said) == want


def test_expressions_of_random_tokens():
    """Against a recursive parser that tries every beginning, longest first."""
    rng = random.Random(8)
    tokens = ["MIT", "GPL-2.0-only", "ISC", "LLVM-exception", "(", ")", "and", "OR", "with", "see"]
    for _ in range(20_000):
        said = rng.choices(tokens, [5, 4, 4, 2, 3, 3, 4, 4, 3, 1], k=rng.randint(0, 9))
        assert licenses.evaluate(" ".join(said))[:2] == brute.expression(said, licenses.ALLOWED), said


def test_licence_tags_where_they_stand(spark):
    texts = ["x\n# SPDX-License-Identifier: see LICENSE file", "// SPDX-License-Identifier: MIT OR\nGPL-2.0", "é SPDX-License-Identifier : BSD-3-Clause", "spdx license identifier is a tag",
             "SPDX-License-Identifier: Nope\n" * 500 + "SPDX-License-Identifier:\tApache-2.0 AND CC-BY-NC-4.0\nunder the MIT license", "spdx-license-identifier:", None, ""]
    got = [(r["labels"], list(r["unknown"]), r["permitted"], r["score"]) for r in licenses.license_scan(spark.createDataFrame(enumerate(texts), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got == [("", ["see"], None, 0.3), ("mit", [], True, 1.0), ("", [], None, 0.0), ("", [], None, 0.0), ("apache-2,cc-by-nc,mit", ["nope"], False, 1.0), ("", [], None, 0.0), ("", [], None, 0.0), ("", [], None, 0.0)]
    assert {"mit", "apache-2", "cc-by-nc"} <= set(licenses.FAMILIES)


def test_warc(spark, tables, tmp_path):
    pages = tables["pages"].select("page_id", "url", "html")
    long = "".join(chr(0x4E00 + i % 5000) for i in range(120_000))
    more = spark.createDataFrame([(10**6, "u", long), (10**6 + 1, None, long), (10**6 + 2, "a\r\nb: c", None), (10**6 + 3, "x", ""), (-5, "x", "WARC/1.1\r\n\r\n\r\n\r\n0\r\n\r\n")], "page_id bigint, url string, html string")
    every = pages.union(more).repartition(3)
    warc.write_archives(every, str(tmp_path / "a"))
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    rows = every.collect()
    want = brute.warc([(r["page_id"], r["html"]) for r in rows])
    assert {k: v[:4] for k, v in got.items()} == want
    assert all(got[r["page_id"]][4] == (r["html"] or "").encode() for r in rows if got[r["page_id"]][2] == "response")


def test_warc_odd_rows(spark, tmp_path):
    odd = spark.createDataFrame([(None, None, None), (None, "u", ""), (4, "u", "same"), (4, "u", "same"), (3, "u", "same")], "page_id bigint, url string, html string")
    warc.write_archives(odd, str(tmp_path / "a"), min_bytes=1)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()), key=repr)
    assert got == sorted([(None, "response", None), (None, "response", None), (4, "response", None), (4, "response", None), (3, "revisit", 4)], key=repr)
    warc.write_archives(odd.filter("false"), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_dechunked_damage():
    assert warc.dechunked(warc.chunked(b"abc" * 9000, 100)) == b"abc" * 9000
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_urls(spark, tables):
    odd = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.NET/EN/", "x://example.net/en/?q", "x://a.example.com/de/1", "x://badexample.com/de/1", "x://é.ORG/fr/#x", "a://b://c.net/", "x://net/", "x://h.net?x", "x://h.net"]
    pages = tables["pages"].select("page_id", "url", "html").union(spark.createDataFrame([(-i, u, None) for i, u in enumerate(odd, 1)] + [(None, None, None)], "page_id bigint, url string, html string"))
    for rules in (urls.RULES, spark.createDataFrame([(r.verdict, r.host, r.path) for r in urls.RULES], "verdict string, host string, path string")):
        got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.judge(pages, rules).collect()), key=repr)
        assert got == sorted(((r["page_id"], *brute.url(r["url"])[:3]) for r in pages.collect()), key=repr)
    for r in urls.judge(pages).join(pages.select("page_id", "url"), "page_id").collect():
        assert r["rule"] is None or r["verdict"] == brute.url(r["url"])[3]


def test_propagation(spark):
    links = [("a", "b", 2), ("a", "c", 1), ("b", "d", 1), ("e", "f", 3), ("g", "e", 1), ("c", "a", 1), ("h", "h2", 1)]
    seeds = {"a": (1.0, 0.0), "f": (0.0, 0.5), "d": (0.0, 0.5)}
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urls.propagate(spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(links, "src string, dst string, links bigint"), rounds=7).collect()}
    hosts = {h for x in links for h in x[:2]} | set(seeds)
    for side in (0, 1):
        arcs = [(s, d, n) if side == 0 else (d, s, n) for s, d, n in links]
        out = {h: sum(n for s, _, n in arcs if s == h) for h in hosts}
        rank = {h: 0.15 * seeds.get(h, (0, 0))[side] for h in hosts}
        for _ in range(7):
            rank = {h: 0.15 * seeds.get(h, (0, 0))[side] + 0.85 * sum(rank[s] * n / out[s] for s, d, n in arcs if d == h) for h in hosts}
        assert all(abs(got[h][side] - rank[h]) < 1e-9 for h in hosts)


def test_links_reach_other_hosts(spark):
    html = """<a href="http://B.example/x">1</a> <a HREF='//c.example'>2</a><img src=https://b.example> <a href="/own">3</a><a href="http://a.example/z">4</a>"""
    pages = spark.createDataFrame([(1, "http://a.example/", html), (2, "http://a.example/2", None)], "page_id int, url string, html string").withColumn("host", F.lit("a.example"))
    assert sorted(map(tuple, urls.host_links(pages).collect())) == [("a.example", "b.example", 2), ("a.example", "c.example", 1)]
    judged = urls.judge(spark.createDataFrame([(1, "http://near.org/x", '<a href="http://bad.net/">x</a>'), (2, "http://bad.net/", ""), (3, "http://far.org/", ""), (4, "http://good.org/fr/", '<a href="http://far.org/">')], "page_id int, url string, html string"))
    assert {r["page_id"]: r["verdict"] for r in judged.collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_distrust_reaches_far_hosts_of_large_tables(spark):
    """10,000 blocked pages elsewhere, fans of 300 hosts and a path of 30 hosts in front of one blocked page."""
    to = lambda host: f'<a href="http://{host}/">x</a>'
    rows = [("bad.net", "")] + [(f"path{k}", to(f"path{k - 1}" if k else "bad.net")) for k in range(30)]
    for level in range(3):
        rows += [(f"fan{level}-{k}", to(f"fan{level - 1}-0" if level else "bad.net")) for k in range(300)]
    near = spark.createDataFrame([(i, f"http://{h}/", html) for i, (h, html) in enumerate(rows)], "page_id bigint, url string, html string")
    far = spark.range(10_000).selectExpr("-1 - id as page_id", "'http://other.net/' as url", "'' as html")
    judged = {r["host"]: r["verdict"] for r in urls.judge(near.union(far).union(spark.createDataFrame([(-20000, "http://clean.org/", to("bad.org"))], near.schema))).collect()}
    assert judged.pop("clean.org") == "allow"
    assert set(judged.values()) == {"block"} and len(judged) == len(rows) + 1


def test_propagation_settles(spark):
    """Scores of a circle are those of the equation, whatever the scale of the seeds."""
    links, scale = [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("b", "d", 1)], 1e-9
    seeds = spark.createDataFrame([("a", scale, 0.0), ("d", 0.0, scale)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"] / scale, r["distrust"] / scale) for r in urls.propagate(seeds, spark.createDataFrame(links, "src string, dst string, links bigint")).collect()}
    a = 0.15 / (1 - 0.85**3 * 2 / 3)
    trust = {"a": a, "b": 0.85 * a, "c": 0.85**2 * a * 2 / 3, "d": 0.85**2 * a / 3}
    # back from d to b, and around; b is the only one that links to c and d
    b = 0.85 * 0.15 / (1 - 0.85**3)
    distrust = {"a": 0.85 * b, "b": b, "c": 0.85**2 * b, "d": 0.15}
    for h in got:
        assert got[h] == (pytest.approx(trust[h], rel=1e-5), pytest.approx(distrust[h], rel=1e-5)), h


def test_mixing(spark, tables, edge):
    for df in (tables["documents"], edge):
        got = mixing.mix(df, keep=["doc_id", "source"]).collect()
        assert len(got) == df.count()
        slots, sizes = {r["source"]: r["slots"] for r in mixing.size_weights(df).collect()}, {}
        for r in got:
            sizes[r["source"]] = sizes.get(r["source"], 0) + 1
        assert slots == {s: round(n**0.5 * mixing.UNIT) for s, n in sizes.items()}
        order, p = brute.schedule(slots, {s: -(-n // mixing.BLOCK_DOCS) for s, n in sizes.items()}), sum(slots.values())
        for r in got:
            q, k = slots[r["source"]], r["mix_block"]
            assert r["mix_slot"] == order[r["source"], k]
            assert r["mix_release"] == k * p // q and r["mix_deadline"] == -(-(k + 1) * p // q)
            assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] and 0 <= r["mix_place"] < mixing.BLOCK_DOCS
        places = [(r["source"], r["mix_block"], r["mix_place"]) for r in got]
        assert len(set(places)) == len(places)


@pytest.mark.parametrize("slots", [{"a": 1}, {"a": 9, "b": 1}, {"a": 50, **{f"s{i}": 5 for i in range(10)}}, {"a": 7, "b": 5, None: 3, "d": 1}])
def test_schedule_is_within_one_block(spark, slots):
    weights = spark.createDataFrame(list(slots.items()), "source string, slots int")
    got = mixing.period_schedule(weights).collect()
    p = sum(slots.values())
    assert {(r["source"], r["turn"]): r["slot"] for r in got} == brute.schedule(slots)
    assert sorted(r["slot"] for r in got) == list(range(p))
    for t in range(p + 1):
        for s, q in slots.items():
            assert abs(sum(r["source"] == s and r["slot"] < t for r in got) - t * q / p) < 1


@pytest.mark.parametrize("sizes, rounds", [([1000, 700, 300, 120, 40], 100), ([10**6, 10**5, 3000], 100), ([1 + i % 90 for i in range(300)], 20), ([1 + i * 2 // 5 for i in range(3000)], 1)])
def test_targets_hold_over_many_segments(spark, sizes, rounds):
    """Every source is within one block of its exact share at every moment, across borders of short segments.

    A round is as long as the smallest weight's block.  Shares are those of the square roots, exact to 2^-30.
    """
    slots = [round(n**0.5 * mixing.UNIT) for n in sizes]
    p = sum(slots)
    end = rounds * (p // min(slots))
    weights = spark.createDataFrame([(f"s{i:04}", q, end * q // p) for i, q in enumerate(slots)], "source string, slots bigint, blocks bigint")
    got = mixing.block_schedule(weights, segment=1).toPandas()
    assert len(got) == sum(end * q // p for q in slots) and got["slot"].is_unique
    assert not got.duplicated(["source", "turn"]).any()
    assert ((got["release"] <= got["slot"]) & (got["slot"] < got["deadline"])).all()
    for row in got.sample(min(len(got), 2000), random_state=1).itertuples():
        q = slots[int(row.source[1:])]
        assert row.release == row.turn * p // q and row.deadline == -(-(row.turn + 1) * p // q)
    # a window holds each block within one of its exact share: turn < share of slot + 1, and turn + 1 > share of slot


def test_named_weights(spark):
    """Sources without a weight go, weights without documents keep their time; segments change no property."""
    slots = {"a": 7, "b": 5, None: 3, "": 2, "é": 1, "d": 40}
    weights = spark.createDataFrame(list(slots.items()), "source string, slots int")
    docs = spark.createDataFrame([(i, f"t{i}", s) for i in range(900) for s in ["a", "b", None, "é", "unnamed"][i % 5 : i % 5 + 1]], "doc_id bigint, text string, source string")
    for segment in (1, 4096):
        got = mixing.mix(docs, weights, block_docs=4, segment=segment).collect()
        assert len(got) == 720 and len({r["mix_slot"] for r in got}) == 180
        for r in got:
            q, k = slots[r["source"]], r["mix_block"]
            assert k * 58 // q == r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] == -(-(k + 1) * 58 // q)
    order = brute.schedule(slots, {"a": 45, "b": 45, None: 45, "é": 45, "": 0, "d": 0})
    assert all(order[r["source"], r["mix_block"]] == r["mix_slot"] for r in got)


def test_chat(spark, tables, folder):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in tables["conversations"].collect()]
    odd = [(10**6, 0, None, None), (10**6, 0, "x", None), (None, None, None, None), (None, 1, "p", "t"), (7 * 10**5, 0, "system", "s")] + [(10**6 + 1, i // 2, f"n{i % 5}", "same") for i in range(400)] + [(10**6 + 1, 0, "n0", "same")] * 3
    turns = spark.createDataFrame(rows + odd, "conv_id bigint, turn bigint, role string, text string").withColumn("name", F.lit("clash"))
    from dataprobe.llm import chat

    got = sorted(((r["conv_id"], r["perspective"], r["turn"], r["segment"], r["segment"][r["mask_start"] : r["mask_end"]]) for r in chat.rotate(turns).collect()), key=repr)
    want, speakers = [], {}
    for c, _, s, _ in rows + odd:
        if s not in (None, "system"):
            speakers.setdefault(c, set()).add(s)
    for c, t, s, x in rows + odd:
        for p in speakers.get(c, ()):
            head = "assistant" if s == p else "system" if s == "system" else f"user name={s or 'unknown'}"
            want.append((c, p, t, f"<|im_start|>{head}\n{x or ''}<|im_end|>\n", f"{x or ''}<|im_end|>\n" if s == p else ""))
    assert got == sorted(want, key=repr)
    sizes = chat.renderings(chat.rotate(turns)).collect()
    assert sum(r["n_segments"] for r in sizes) == len(want)


def test_chains_find_planted_passages(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = say(90)
    docs, planted = [], set()
    for i in range(40):
        body = say(rng.randint(30, 300))
        if i % 4 == 0:
            own = list(passage)
            if i:
                # differences with more than RESUME equal words between them, and before the ends
                for k in sorted(rng.sample(range(8, 80, 9), rng.randint(0, 3)), reverse=True):
                    own[k : k + 1] = rng.choice([[], ["new"], ["new", "one"]])
                planted.add(i)
            at = rng.randrange(len(body))
            body[at:at] = own
        docs.append((i, " ".join(body)))
    docs += [(50, docs[3][1]), (50, docs[3][1]), (None, docs[3][1]), (51, None), (52, ""), (53, "a b c")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    rows = chains.document_passages(frame).collect()
    assert len(rows) == len(docs)
    found = {r["doc_id"]: r for r in rows if r["n_passages"]}
    assert set(found) == planted | {50}
    assert all(found[i]["class_id"] == 0 and 80 <= found[i]["n_words"] <= 110 for i in planted)
    assert found[50]["class_id"] == 3 and found[50]["n_words"] == len(docs[3][1].split())


@pytest.mark.parametrize("size, more", [(60, 0), (60, 3), (100, 0)])
def test_exact_passages_survive_what_lies_between(spark, size, more):
    """Two exact passages with ``gap`` different words between them, ``more`` words longer in one document."""
    rng = random.Random(size + more)
    say = lambda n: [f"u{rng.getrandbits(48)}" for _ in range(n)]
    gaps, docs = list(range(10, 151, 10)), []
    for g in gaps:
        one, two = say(size), say(size)
        docs += [(2 * g, " ".join(say(20) + one + say(g) + two + say(20))), (2 * g + 1, " ".join(say(25) + one + say(g + more) + two + say(9)))]
    found = {r["doc_id"]: r for r in chains.document_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    for g in gaps:
        r = found[2 * g + 1]
        assert r["class_id"] == 2 * g and r["n_links"] == 1 and r["n_passages"] in (1, 2), (g, r)
        assert r["n_words"] == 2 * size + (g + more if r["n_passages"] == 1 else 0), (g, r)


def test_failed_chain_keeps_every_range_of_its_own():
    """The worst gap may lie inside a passage: cutting there would leave parts that are too short."""
    a, b, parts, at = [], [], [], 0
    for size, gap in [(20, 5), (20, 4), (6, 4), (6, 4), (6, 4), (6, 4), (6, 0)]:
        same = list(range(at, at + size))
        parts.append([len(a), len(a) + size, len(b), len(b) + size])
        a, b, at = a + same + list(range(1000 + at, 1000 + at + gap)), b + same + list(range(2000 + at, 2000 + at + gap)), at + size
    assert not chains.is_passage(*chains.align(a, b, parts, 0, 0))
    found = chains.passages_of(a, b, parts, 0, 0)
    assert all(chains.is_passage(*x) for x in found) and min(x[0] for x in found) == 0 and max(x[1] for x in found) >= 45


def test_edit_distance():
    rng = random.Random(2)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i] + [0] * len(b) if not (old := row) else [i] + [0] * len(b)
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(9))], [rng.randrange(4) for _ in range(rng.randrange(9))]
        assert chains.edit_distance(a, b) == slow(a, b)


def test_chain_takes_the_best_order():
    segments = [(0, 10, 100, 110), (12, 20, 112, 120), (22, 40, 5, 23), (42, 50, 124, 132)]
    assert chains.chain(segments)[0] == [0, 1, 3] and sorted(sum(chains.chain(segments), [])) == [0, 1, 2, 3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert quality.rule_ledger(docs).count() == 0 and suffix_dedup.suffix_dedup(docs).count() == 0
    assert decontaminate.contamination(docs, items).count() == 0 and decontaminate.decontaminate(docs, items).count() == 0
    assert simhash.simhash_components(docs).count() == 0 and mixing.mix(docs).count() == 0
    assert chains.document_passages(docs).count() == 0 and licenses.license_scan(docs).count() == 0 and urls.judge(pages).count() == 0
    from dataprobe.llm import chat

    assert chat.rotate(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_no_items_hit_nothing(spark, tables):
    none = spark.createDataFrame([(1, None), (2, "?!")], "item_id bigint, text string")
    rows = decontaminate.contamination(tables["documents"], none).collect()
    assert len(rows) == tables["documents"].count() and not any(r["n_hit"] for r in rows)


def test_registered_queries(spark, folder):
    assert set(queries.QUERIES) == {n for n in queries.QUERIES if n.startswith("op")} and len(queries.QUERIES) == 10
