"""Lines, URLs, mixing, tokens, templates, quality, tool calls and licences on small cases."""

import json
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from compare import compare, oracle_connection
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import decontaminate, licenses, lines, mixing, quality, tokens, toolcalls, urls
from tidemark.llm.queries import URL_RULES, grades
from tidemark.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name], ORACLES[name], spark, SF, oracle_connection(SF)) is None


def test_shared_lines(spark):
    long = "x" * 40
    rows = [(k, f"a{k}\n {long.upper()} \nend\n{long}", "s") for k in range(5)]
    rows += [(7, None, "s"), (8, "", "s"), (9, f"{'y' * 39}\n\n", "s"), (None, f"{long}\nz", "s"), (7, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_text string")
    got = lines.drop_shared_lines(docs)
    assert sorted(got.columns) == ["doc_id", "dropped_count", "kept_text", "line_count", "text"]
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert all(out[k].kept_text == f"a{k}\nend" and out[k].dropped_count == 2 for k in range(4))
    assert out[4].dropped_count == 0 and out[4].kept_text == rows[4][1]
    assert (out[7].line_count, out[7].kept_text, out[8].line_count) == (1, "", 1)
    assert out[9].kept_text == rows[7][1] and out[9].line_count == 3
    assert out[None].kept_text == "z"
    assert lines.drop_shared_lines(docs.limit(0)).count() == 0
    # four documents are not enough, however often one of them repeats the line
    few = spark.createDataFrame([(k, "\n".join([long] * 3)) for k in range(4)], "doc_id long, text string")
    assert lines.drop_shared_lines(few).agg(F.sum("dropped_count")).first()[0] == 0


def test_url_rules(spark):
    cases = [
        ("http://a.example.org/es/x", "block", "example.org/es/"),
        ("https://EXAMPLE.org/en/123?x=/es/", "block", "example.org/en/1"),
        ("https://example.org/en/2", "allow", "org/"),
        ("https://notexample.org/es/", "allow", "org/"),
        ("ftp://x.com/fr/1", "allow", "com/fr/"),
        ("ftp://x.com/de/", "block", "com/de/"),
        ("ftp://x.com/de", "allow", None),
        ("http://org", "allow", None),
        ("no url", "allow", None),
        ("http://", "allow", None),
        ("", "allow", None),
        (None, "allow", None),
    ]
    pages = spark.createDataFrame([(u, "old") for u, _, _ in cases], "url string, host string")
    got = {r.url: (r.verdict, r.rule) for r in urls.filter_urls(pages, URL_RULES).collect()}
    assert got == {u: (v, r) for u, v, r in cases}
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(pages, URL_RULES, max_rules=2)
    # more labels win over a longer path, the longer path over a shorter one
    trie = urls.RuleTrie([("block", "com", "/a/b/c/"), ("allow", "x.com", "/"), ("block", "x.com", "/a/b")])
    assert trie.find("x.com", "/a/q") == ("allow", "x.com/") and trie.find("x.com", "/a/bc") == ("block", "x.com/a/b")


def test_targets_fill_up():
    got = mixing.source_targets([("b", 100), ("a", 10), (None, 1000)], (3, 1, 2), 1500, 2)
    assert got == {"a": 20.0, "b": 200.0, None: 1280.0}
    assert mixing.source_targets([], (3, 1, 2), 0, 2) == {}


def test_mix_comes_near_targets(spark):
    rows = [(k, "w " * (k % 50), s) for k, s in enumerate(["x"] * 600 + ["y"] * 90 + [None] * 30)]
    rows += [(5000, None, "x"), (5001, "", None), (7, "w " * 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.mix_sources(docs, block_words=16)
    got = mix.taken.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    for source in ("x", "y", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.03 * own[0].target + 32
        assert own[0].source_size == sum(r.size for r in own)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_sources(docs, block_words=16).taken.collect()))
    # every prefix of the schedule is near the shares
    slots = mix.schedule.orderBy("slot").select("source").toPandas()["source"]
    whole = (slots == "x").mean()
    assert all(abs((slots[:n] == "x").mean() - whole) < 5 / n for n in (50, 200, 500))
    assert mixing.mix_sources(docs.limit(0)).taken.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sé .,\n\t\r\x1c\x85\xa0 ​3<|endoftext|>"), max_size=60)))
def test_cached_encoding_is_the_librarys(texts):
    plain = Tokenizer.from_file(VOCABULARY)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokens.encoder(VOCABULARY).encode(texts) == want


@pytest.mark.parametrize("planes", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 100, 4096, 9001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**17, n).astype(np.uint32)
    assert (tokens.unpack(tokens.pack(ids, 4096, planes)) == ids).all()


def test_token_files(spark, tmp_path):
    rows = [(5, "five  words\n\nhere"), (1, None), (3, ""), (2, "word " * 3000), (None, "no id"), (5, "five  words\n\nhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens.write_token_files(docs, f"{tmp_path}/t", VOCABULARY, chunk_ids=100, block_ids=64, planes="bit")
    got = tokens.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    plain, start = Tokenizer.from_file(VOCABULARY), 0
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 5, 5]
    texts = {None: "no id", **{i: t for i, t in rows if i}}
    for r in got:
        ids = plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    tokens.write_token_files(docs.limit(0), f"{tmp_path}/none", VOCABULARY)
    assert tokens.read_token_files(spark, f"{tmp_path}/none").count() == 0


def test_leaks_with_other_values(spark):
    item = "If Anna buys 12 apples and gives Anna back 3.5 kg of them then how many are left over"
    doc = "unrelated words before it. if Carl buys 40 apples and gives Carl back 7 kg of them then how many are left over now"
    swapped = doc.replace("gives Carl", "gives Dora")
    docs = spark.createDataFrame(
        [(1, doc), (2, swapped), (3, "nothing like it at all " * 30), (4, None), (5, ""), (6, item), (6, item), (None, item)],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, "")], "item_id long, text string")
    for limit in (1000, 0):
        leaks = decontaminate.find_leaks(docs, bench, window_words=8, min_share=0.6, broadcast_windows=limit)
        got = {(r.doc_id, r.item_id) for r in leaks.collect()}
        assert got == {(1, 1), (6, 1), (None, 1)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaked(docs, leaks).collect()) == [2, 3, 4, 5]
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_equal_substring_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in bench if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    assert want and want <= got


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = grades(spark.read.parquet(f"{folder}/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    model = quality.train_quality(docs, rated.where(~held), sample_rows=3000)
    assert np.all(np.diff(model.thresholds) > 0)
    scored = quality.score_quality(docs.join(rated.where(held), "doc_id"), model, least_grade=2)
    share = {r.grade: r.s for r in scored.groupBy("grade").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert share[2] > 0.97 and share[0] < 0.05 and share[1] < 0.55


def test_quality_repeated_rows_count_once(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = grades(spark.read.parquet(f"{folder}/labels.parquet"))
    once = quality.train_quality(docs, rated)
    again = F.explode(F.sequence(F.lit(1), F.when(F.col("doc_id") % 3 == 0, 20).otherwise(1)))
    often = quality.train_quality(docs.withColumn("_n", again).drop("_n"), rated.withColumn("_n", again).drop("_n"))
    assert np.array_equal(once.weights, often.weights) and np.array_equal(once.thresholds, often.thresholds)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 1.0), (3, "a b c " * 4000, 2.0), (None, "x", 0.0)], "doc_id long, text string, expected_grade double")
    none = spark.createDataFrame([(1, None), (None, 1), (8, 1), (2, 9)], "doc_id long, grade int")
    model = quality.train_quality(docs, none)
    got = quality.score_quality(docs, model, least_grade=2)
    assert sorted(got.columns) == ["doc_id", "expected_grade", "selected", "tail_probability", "text"]
    assert [(r.tail_probability, r.selected) for r in got.collect()] == [(0.5, True)] * 4
    assert quality.score_quality(docs.limit(0), model, 2).count() == 0


TOOLS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}}


def test_tool_calls(spark):
    calls = [
        (1, "c", "b", "add", '{"a": 3}', 5),
        (1, "a", None, "add", '{ "a":1 }', 1),
        (1, "b", "a", "add", '{"a": true, "z": "é"}', 3),
        (1, "b", "a", "add", '{"a": 9}', 9),
        (1, "x", "y", "add", '{"a": 1}', 20),
        (1, "y", "x", "none", '{"a": 1}', 21),
        (1, "z", "gone", "add", "not json", 22),
        (1, None, None, "add", None, 23),
        (None, "n", None, "add", '{"a": 1}', 1),
    ]
    results = [(1, "a", "one", 2), (1, "a", "again", 8), (1, "b", "two", 2), (1, "lost", None, 4), (None, "n", "", 2), (2, "a", "other", 1)]
    call_table = spark.createDataFrame(calls, "conv_id long, call_id string, parent_id string, name string, arguments string, position long")
    result_table = spark.createDataFrame(results, "conv_id long, call_id string, content string, position long")
    every = toolcalls.link_tool_calls(call_table, result_table, TOOLS).collect()
    got = {(r.conv_id, r.call_id): r for r in every if r.status != "repeated"}
    assert len(got) == 10 and len(every) == len(got) + 2
    assert {(r.call_id, r.errors[0], r.depth) for r in every if r.status == "repeated"} == {("a", "repeated result", None), ("b", "repeated call", None)}
    status = {k: (r.status, r.depth, r.errors) for k, r in got.items()}
    assert status[1, "a"] == ("linked", 0, ["repeated result"])
    assert status[1, "b"] == ("early", 1, ["repeated call", "$.a: not integer", "$.z: unknown"])
    assert status[1, "c"] == ("unanswered", 2, []) and got[1, "c"].valid
    assert status[1, "x"] == ("cyclic", None, []) and status[1, "y"] == ("cyclic", None, ["unknown tool"])
    assert status[1, "z"] == ("unanswered", 0, ["unknown parent", "$: not JSON"])
    assert status[1, None][:2] == ("unanswered", 0) and status[None, "n"] == ("linked", 0, [])
    assert status[1, "lost"][0] == status[2, "a"][0] == "orphan"
    assert got[1, "a"].json == '{"arguments":{"a":1},"id":"a","name":"add","result":"one","status":"linked"}'
    for r in got.values():
        assert toolcalls.canonical_json(json.loads(r.json)) == r.json
    assert toolcalls.link_tool_calls(call_table.limit(0), result_table.limit(0), TOOLS).count() == 0


def test_conversations_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    by = {(r.conv_id, r.turn): r for r in rows}
    got = {(r.conv_id, r.position): r for r in QUERIES["op4_tool_call_linking"](spark, SF).collect() if r.status != "orphan"}
    assert set(got) == {(r.conv_id, r.turn) for r in rows if r.role == "user"}
    for (conv, turn), r in got.items():
        depth = 0
        while (before := by.get((conv, turn - 2 * (depth + 1)))) is not None and before.role == "user":
            depth += 1
        answer = by.get((conv, turn + 1))
        text = answer.text if answer is not None and answer.role == "assistant" else None
        assert r.depth == depth and r.status == ("linked" if answer is not None and answer.role == "assistant" else "unanswered")
        message = json.loads(r.json)
        assert message["result"] == text and message["arguments"] == {"prompt": by[conv, turn].text, "turn": turn}


def test_license_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = [(9001, "Some words.\nReleased under the MIT License.\n\nLicensed under CC BY-SA 4.0."), (9002, None), (9003, " \n"), (None, "Licensed under CC BY-NC 4.0."), (9004, "license " * 3000)]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    model = licenses.train_licenses(docs)
    got = {(r.doc_id, r.position): r.family for r in licenses.scan_licenses(docs, model).where("confirmed").collect()}
    want = {
        (r.doc_id, k): family
        for r in docs.collect()
        for k, line in enumerate((r.text or "").split("\n"))
        for family, text in licenses.TEMPLATES
        if line.strip() == text
    }
    assert want.items() <= got.items() and len(got) <= len(want) + 1
    assert licenses.scan_licenses(docs.limit(0), model).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output",
    ]
    for _, stage in corpus_pipeline.STAGES[1:3]:
        before, docs = docs.count(), stage(spark, docs, SF)
        assert docs.columns == names and 0 < docs.count() < before
    mixed = corpus_pipeline.source_mixing(spark, docs, SF)
    copies = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    taken = {r.doc_id: r for r in mixing.mix_sources(docs).taken.collect()}
    assert mixed.columns == names
    assert all(copies[i] == int(r.taken / r.size + 0.5) for i, r in taken.items() if r.size)
    text, plain, start = {r.doc_id: r.text for r in docs.collect()}, Tokenizer.from_file(VOCABULARY), 0
    for r in corpus_pipeline.token_planes(spark, mixed, SF).orderBy("start").collect():
        ids = plain.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_leaks_of_numbers_and_names(spark):
    sums, names = "Compute 12 + 7 = 19 and 45 - 3 = 42", "Anna Berta Carl Dora Emil Fritz Gustav"
    bench = spark.createDataFrame([(1, sums), (2, names)], "item_id long, text string")
    rows = [(1, f"as said: {sums} so far"), (2, "Compute 13 + 8 = 21 and 44 - 2 = 42"), (3, f"the list {names} ends"), (4, "see Hans Iris Jan Karl Lena Max Nora")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1000, 0):
        leaks = decontaminate.find_leaks(docs, bench, window_words=5, broadcast_windows=limit)
        assert {(r.doc_id, r.item_id) for r in leaks.collect()} == {(1, 1), (3, 2)}


def test_every_turn_is_carried_once(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(990001, 0, None, "a"), (990001, 1, "tool", None), (990002, 0, "system", "s"), (990002, 1, "user", "q"), (990002, 2, "assistant", "r")]
    rows.unionByName(spark.createDataFrame(odd, rows.schema)).write.parquet(f"{tmp_path}/conversations.parquet")
    got = Counter()
    for r in QUERIES["op4_tool_call_linking"](spark, str(tmp_path)).collect():
        got[r.conv_id, r.position] += 1
        if r.status in ("linked", "early"):  # the answer stands in the row of its call
            got[r.conv_id, r.position + 1] += 1
    assert got == Counter((r.conv_id, r.turn) for r in spark.read.parquet(f"{tmp_path}/conversations.parquet").collect())


def test_every_call_and_result_is_carried_once(spark, tmp_path):
    odd = [
        (7, 0, "user", "q1"), (7, 0, "user", "q2"), (7, 0, "user", "q2"), (7, 1, "assistant", "r1"), (7, 1, "assistant", "r1"),
        (7, 1, "assistant", "r2"), (7, None, "user", "n1"), (7, None, "user", None), (7, None, "assistant", "n2"),
        (7, None, "assistant", "n2"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, None, None, None), (8, 3, "assistant", "late"),
    ]
    table = spark.createDataFrame([(*r, 1, 2) for r in odd], "conv_id long, turn long, role string, text string, calls int, first int")
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    rows = QUERIES["op4_tool_call_linking"](spark, str(tmp_path)).collect()
    carried = Counter()
    for r in rows:
        message = json.loads(r.json)
        if "arguments" in message:
            carried[r.conv_id, r.position, "user", message["arguments"].get("prompt") or None] += 1
            if r.status in ("linked", "early"):
                carried[r.conv_id, r.position + 1, "assistant", message["result"]] += 1
        elif "role" in message:
            carried[r.conv_id, r.position, message["role"], message["content"]] += 1
        else:
            carried[r.conv_id, r.position, "assistant", message["result"]] += 1
    assert carried == Counter(odd)
    assert Counter(r.status for r in rows) == {"linked": 2, "repeated": 4, "unanswered": 2, "orphan": 4}
    assert all(r.status not in ("linked", "early") for r in rows if r.position is None)


def test_shortened_licenses(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    short = ["All rights reserved.", "Copyright 2021 Some Firm. All rights reserved.", "No part of this work may be reproduced", "Permission is hereby granted, free of charge, to any person"]
    extra = spark.createDataFrame([(9100 + k, f"Words before.\n{t}\nWords behind.") for k, t in enumerate(short)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    found = licenses.scan_licenses(docs, licenses.train_licenses(docs)).where("confirmed and doc_id >= 9100").collect()
    assert {(r.doc_id, r.position, r.family) for r in found} == {(9100 + k, 1, "MIT" if k == 3 else "Proprietary") for k in range(4)}


def test_a_worker_keeps_the_cache_of_one_operator():
    from tidemark.llm.vocabulary import lean, worker_cache

    cache = worker_cache("mine")
    cache["word"] = 1
    assert list(lean(lambda batches: (b + len(cache) for b in batches), "mine")(iter([1]))) == [2] and cache
    assert list(lean(lambda batches: (b + len(cache) for b in batches))(iter([1]))) == [1] and not cache
    assert tokens._ENCODERS is worker_cache("tokens")
