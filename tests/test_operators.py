"""Cases that the tables don't have: strictness, thresholds, order of rules, file formats, streams."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import stats, strict_json, text
from tessera.operators import attention, consistency, conversations, entries, markup, names, subwords, tensors, vocabularies
from tessera.sources import jsonl, model_files
from tessera.streaming import events

VALID = ['{"a":1}', "[]", "{}", " 1 ", '"x"', "null", '{"a":1,"a":2}', '{"a":1e400}', '{"a":0.10}', "﻿{}", '"\\ud83d\\ude00"', "[" * 1200 + "]" * 1200, '{"":{"":[]}}']
INVALID = ["", "{'a':1}", '{"a":NaN}', '{"a":1} x', '{"a":1}{"b":2}', '{"a":01}', '{"a":1,}', "[1,2", "[,1]", "[1,]", '"\\ud800"', '"\\x"', '"a\nb"', "tru", "1.", "+1", '{"a" 1}', '{a:1}', "[1 2]", '"\\u12g4"', "-", "[}", '{"a":1]']


@pytest.mark.parametrize("s", VALID)
def test_valid_json(s):
    found = strict_json.nodes(s)
    assert found[0]["parent"] is None
    for n in found:
        assert s[n["start"] : n["end"]].strip()
        if n["parent"] is not None:
            p = found[n["parent"]]
            assert p["start"] <= n["start"] <= n["end"] <= p["end"]


@pytest.mark.parametrize("s", INVALID)
def test_invalid_json(s):
    with pytest.raises(strict_json.Bad):
        strict_json.nodes(s)


def test_json_mutations():
    rng = random.Random(4)
    seeds = ['{"a":[1,2.5e3,{"b":"x\\n\\u00e9"}],"c":null}', '[true,false,"q\\"",-0.1]']
    for _ in range(3000):
        s = list(rng.choice(seeds))
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = rng.choice(['"', "{", "]", ",", "1", "\\", "e", ""])
        s = "".join(s)

        def strict(_):
            raise ValueError

        try:
            json.loads(s, parse_constant=strict)
            good = True
        except ValueError:
            good = False
        try:
            strict_json.nodes(s)
            mine = True
        except strict_json.Bad:
            mine = False
        assert mine == good, s


def test_entry_status(spark):
    rows = [(s.encode(), "Valid") for s in VALID] + [(s.encode(), "InvalidJson") for s in INVALID] + [(b"\xff{}", "InvalidUtf8")]
    df = spark.createDataFrame([(k, bytearray(r), w) for k, (r, w) in enumerate(rows)], "id int, raw binary, want string")
    got = entries.entry_status(df, "raw").collect()
    assert [(r["raw"], r.status) for r in got if r.status != r.want] == []
    assert all(r.error is not None for r in got if r.status == "InvalidJson")


def test_paths_and_pretty():
    found = strict_json.nodes('{"a":[{"b c":1}],"a":0.10}')
    path = {}
    for n in found:
        path[n["id"]] = "$" if n["parent"] is None else path[n["parent"]] + strict_json.path_part(n)
    assert [*path.values()] == ["$", "$.a", "$.a[0]", '$.a[0]["b c"]', "$.a#2"]
    assert strict_json.pretty('{"a":[1,{}],"b":0.10}') == '{\n  "a": [\n    1,\n    {}\n  ],\n  "b": 0.10\n}'


def verdict(spark, objects):
    df = spark.createDataFrame([(k, json.dumps(o) if not isinstance(o, str) else o) for k, o in enumerate(objects)], "id int, json string")
    return entries.event_verdict(entries.event_samples(df, "id", "json"), "id", "json").first()


def test_event_verdicts(spark):
    event, other = {"type": "a", "timestamp": 1}, {"text": "x"}
    assert verdict(spark, [event] * 7 + [other] * 3).is_event_stream
    assert not verdict(spark, [event] * 6 + [other] * 4).is_event_stream
    assert not verdict(spark, [event] * 9).is_event_stream
    assert not verdict(spark, [{"training_sample": 1}] * 10).is_event_stream
    r = verdict(spark, ['{"session_id":1}'] * 4 + ['{"sessionId":1}', '{"session_id":1.0}', '{"session_id":"1"}', '{"session_id":null}', '{"sessionId":null}', '{"session_id":"s"}'])
    assert (r["grouping"], r.repeated, r.is_event_stream) == (10, 7, False)
    assert verdict(spark, [{"type": "a", "seq": k} for k in range(10)]).is_event_stream


def test_event_summary(spark):
    df = spark.createDataFrame([('{"kind":"k","event":"e","ts":5,"runId":null}',), ('{"type":"' + "x" * 300 + '"}',), ("[1]",)], "json string")
    a, b, c = entries.event_summary(df, "json").collect()
    assert (a.event_type.value, a.timestamp.value, a.grouping.value) == ("e", "5", "null")
    assert (len(b.event_type.value), b.event_type.has_more, b.timestamp) == (256, True, None)
    assert c.event_type is None


def test_node_search(spark):
    df = spark.createDataFrame([(1, '{"ab":"xabyab","c":["ab",12]}')], "id int, s string")
    found = entries.search_nodes(entries.json_nodes(df, "id", "s"), "id", "ab").orderBy("node_id", "phase", "start").collect()
    assert [(r.path, r.field, r.start) for r in found] == [("$.ab", "key", 0), ("$.ab", "value", 1), ("$.ab", "value", 4), ("$.c[0]", "value", 0)]
    assert entries.first_evidence(entries.search_nodes(entries.json_nodes(df, "id", "s"), "id", "ab"), "id").first().field == "key"
    assert entries.subtree(entries.json_nodes(df, "id", "s"), "id", 2).count() == 3


@pytest.mark.parametrize(("glob", "yes", "no"), [("a*c", "xxabbc\nz", "acx"[:1]), ("a?c", "abc", "ac"), (r"a\*c", "a*c", "abc"), (r"\\x", r"\x", "x"), ("a.c", "a.c", "abc")])
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(yes,), (no,)], "s string")
    assert [r[0] for r in df.select(F.rlike("s", F.lit(text.glob_pattern(glob)))).collect()] == [True, False]


@pytest.mark.parametrize("glob", ["*", "**", "", "a" * 257])
def test_bad_globs(glob):
    with pytest.raises(ValueError):
        text.glob_pattern(glob)


CASES = [("# Heading\ntext", "markdown"), ("> quoted", "markdown"), ("- a\n- b", "markdown"), ("- a", "plain"), ("| a | b |\n| --- | :---: |\n| 1 | 2 |", "markdown"), ("```py\nx\n```", "markdown"), ("foo_bar a*b", "plain"), ("<T>", "plain"), ('{"a":1}', "json"), ('{"a":1,}', "plain"), ("[1] text", "plain"), ("<p>x</p>", "html"), ("<?xml version='1'?><a></a>", "plain"), ("#!/bin/sh\necho", "code"), ("def f(x):\n    return x", "code"), ("let x = 1", "plain"), ("let x = 1\nvar y = 2", "code"), ("plain words", "plain"), ("", "plain")]


def test_detection_order(spark):
    df = spark.createDataFrame(CASES, "s string, want string")
    got = df.select("s", "want", text.detected(F.col("s"), None, markup.looks_html(F.col("s"))).alias("kind")).collect()
    assert [(r.s, r.kind) for r in got if r.kind != r.want] == []
    assert df.select(text.detected(F.lit("let x = 1"), F.lit("Code"))).first()[0] == "code"


def test_code_languages(spark):
    rows = [("#!/usr/bin/env bash\nls", "shell"), ('{"a": [1]}', "json"), ("select a from b where c", "sql"), ("def f(a):\n    return None", "python"), ("fn main() { let mut x = 1; }", "rust"), ("interface A { b: string }", "typescript"), ("const a = () => { return 1 }", "javascript"), ("#include <iostream>\nstd::cout", "cpp"), ('#include <stdio.h>\nint main() {}', "c"), ("package main\nfunc main() {}", "go"), ("a: 1\nb: x", "yaml"), ("words only", None)]
    df = spark.createDataFrame(rows, "s string, want string")
    assert [(r.s, r.got) for r in df.select("s", "want", text.code_language(F.col("s")).alias("got")).collect() if r.got != r.want] == []


def test_html(spark):
    rows = [(1, "<div><p>a</p></div>", True), (2, "<div><p>a</div>", False), (3, "<br><img src='x>y'>", True), (4, "<!-- <p> --><script>if (a<b) '<p>'</script>", True), (5, "<div/>", False)]
    df = spark.createDataFrame(rows, "id int, s string, want boolean")
    got = {r.id: r.balanced for r in markup.balanced(df, "id", "s").collect()}
    assert got == {i: w for i, _, w in rows}
    unsafe = '<p onclick="x()">a &lt; b<script>alert(1)</script><iframe src=x><b>no</b></iframe><custom>c</custom><b>d'
    assert df.limit(1).select(markup.sanitised(F.lit(unsafe))).first()[0] == "<p>a &lt; bc<b>d</b></p>"
    assert df.limit(1).select(markup.rendered_text(F.lit("<h1>A  b</h1><p>c<br>d</p><style>x</style>"))).first()[0] == "A b\nc\nd"
    assert df.limit(1).select(markup.safe_markdown(F.lit("![i](u) [t](v)"))).first()[0] == "[image: i] (u) t (v)"
    card = "---\na: b\n---\n# T<br>x <i>y</i>\n```\n<keep>\n```\n<b>z</b>"
    assert df.limit(1).select(markup.card_body(F.lit(card))).first()[0] == "# T\nx y\n```\n<keep>\n```\nz"


def test_conversation_kinds(spark):
    say = lambda **m: json.dumps(m)
    user = say(role="user", content="x")
    rows = {1: [user, say(role="tool", content="y")], 2: [user, say(role="assistant", content=[{"type": "tool_use"}])], 3: [user, say(role="assistant", content="y")], 4: [user], 5: [say(a=1)], 6: [say(role="developer", content="c"), say(role="assistant", content=[{"type": "thinking"}])], 7: [user] * 4 + [say(a=1)], 8: [user] * 3 + [say(a=1)] * 2, 9: ['{"role":"tool","role":"tool","content":"x"}']}
    df = spark.createDataFrame([(k, m) for k, all_ in rows.items() for m in all_], "id int, m string")
    got = {r.id: r.kind for r in conversations.kinds(df, "id", "m").collect()}
    assert got == {1: "openai", 2: "anthropic", 3: "generic", 4: "possible", 5: "none", 6: "mixed", 7: "generic", 8: "possible", 9: "possible"}


def test_openai_blocks(spark):
    m = json.dumps({"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image_url", "image_url": {"url": "u"}}], "tool_calls": [{"function": {"name": "f", "arguments": "{}"}}]})
    df = spark.createDataFrame([(1, 0, m), (1, 1, '{"role":"tool","content":"r"}')], "id int, turn int, m string")
    got = conversations.openai_blocks(df, "id", "turn", "m").orderBy("turn", "element").collect()
    assert [(r.kind, r.text) for r in got] == [("text", "a"), ("image", "u"), ("toolCall", "f {}"), ("toolResult", "r")]


def test_token_ids(spark):
    rows = [("[1, 2,3]", [1, 2, 3], None, None), ("7 8", [7, 8], None, None), ("", None, "empty", None), ("1,-2", None, "negative", 2), ("1 x 2", None, "invalid", 2), ("9" * 30, None, "overflow", 1)]
    df = spark.createDataFrame([(r[0],) for r in rows], "s string")
    assert [(r[0].ids, r[0].error, r[0].item) for r in df.select(vocabularies.token_ids(F.col("s"))).collect()] == [r[1:] for r in rows]


def test_token_roles(spark):
    rendered = "<u>hi</u><a>hi yo</a>"
    segments = ["<u>", "hi", "</u>", "<a>", "hi", " yo", "</a>"]
    df = spark.createDataFrame([(1, rendered, [("user", "hi"), ("assistant", "hi yo")], segments)], "id int, text string, bodies array<struct<role:string,body:string>>, segments array<string>")
    assert [r.role for r in vocabularies.attributed(df, "id").orderBy("position").collect()] == ["template", "user", "template", "template", "assistant", "assistant", "template"]


def test_special_tokens(spark):
    fields = spark.createDataFrame([("t", "eos_token", "</s>"), ("t", "pad_token", "<pad>")], "tokenizer string, name string, piece string")
    added = spark.createDataFrame([("t", 2, "</s>", True), ("t", 9, "<x>", True), ("t", 5, "word", False)], "tokenizer string, token_id int, content string, special boolean")
    special = vocabularies.special_tokens(fields, added)
    assert {(r.piece, r.token_id, r.name) for r in special.collect()} == {("</s>", 2, "eos_token"), ("<x>", 9, "<x>"), ("</s>", None, "eos_token"), ("<x>", None, "<x>"), ("<pad>", None, "pad_token")}
    vocabulary = spark.createDataFrame([("t", "<pad>", 7), ("t", "a", 3)], "tokenizer string, piece string, token_id int")
    assert ("<pad>", 7, "pad_token") in {(r.piece, r.token_id, r.name) for r in vocabularies.special_tokens(fields, added, vocabulary).collect()}
    cold = spark.createDataFrame([("t", 0, 77, None, "<pad>"), ("t", 1, 78, "b", "<pad>")], "tokenizer string, pos int, token_id int, piece string, cold string")
    assert [r.flag for r in vocabularies.flagged(cold, special).orderBy("pos").collect()] == ["pad_token", None]
    tokens = spark.createDataFrame([("t", 0, 2, "</s>"), ("t", 1, 7, "<pad>"), ("t", 2, 3, "a")], "tokenizer string, pos int, token_id int, piece string")
    assert [r.flag for r in vocabularies.flagged(tokens, special).orderBy("pos").collect()] == ["eos_token", "pad_token", None]


def test_encoded_round_trip(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "Hello 😀 élan"), (2, "")], "id int, s string")
    a, b = vocabularies.encoded(df, "id", "s", subwords.from_json(public_tokenizers.path("byte_bpe_50k.json"))).orderBy("id").collect()
    assert "".join(a.segments) == a.decoded == "Hello 😀 élan" and a.mapping == "Exact" and len(a.ids) == len(a.pieces)
    assert b.ids == [] and b.mapping == "Exact"


def test_hierarchy(spark):
    df = spark.createDataFrame([("a.b.w",), ("a.b",), ("a..c.10.w",), ("a.c.2.w",)], "name string")
    got = {r.path: (r.descendants, r.is_tensor) for r in names.hierarchy(df, "name").collect()}
    assert got["a"] == (4, False) and got["a.b"] == (2, True) and got["a.c"] == (2, False)
    nodes = names.hierarchy(df, "name").select("path")
    seen = names.shown(nodes, spark.createDataFrame([("a",), ("a.c",)], "path string")).orderBy("sort_key").collect()
    assert [r.path for r in seen] == ["a", "a.b", "a.c", "a.c.2", "a.c.10"]


def test_files(spark):
    rows = [("config.json", "configuration"), ("x/generation_config.json", "configuration"), ("tokenizer_config.json", "tokenizer"), ("processor_config.json", "configuration"), ("m.safetensors", "weights"), ("model.safetensors.index.json", "weightMetadata"), ("a.gguf", "weights"), ("chat_template.jinja", "templates"), ("README.md", "documentation"), ("LICENSE", "documentation"), ("a.py", "other"), ("vocab.json", "tokenizer"), ("paper.pdf", "documentation"), ("sub/my_config.json", "configuration")]
    df = spark.createDataFrame(rows, "path string, want string")
    assert [(r.path, r.category) for r in names.ordered_files(df, "path").collect() if r.category != r.want] == []
    files = spark.createDataFrame([("r", "b/tokenizer.json"), ("r", "a/tokenizer.json"), ("s", "tokenizer.json"), ("s", "a/tokenizer.json")], "repo string, path string")
    assert {(r.repo, r.path) for r in names.picked(files, "repo", "path", ["tokenizer.json"], F.lit("b")).collect()} == {("r", "b/tokenizer.json"), ("s", "tokenizer.json")}
    ids = [("https://hub.co/o/n/tree/main", "o/n"), ("o/n", "o/n"), ("nothing", None)]
    assert [r[0] for r in spark.createDataFrame(ids, "u string, w string").select(names.model_id(F.col("u"), ("hub.co",))).collect()] == [w for _, w in ids]
    sizes = spark.createDataFrame([(5,), (1500,), (2_500_000,)], "n long")
    assert [r[0] for r in sizes.select(names.format_bytes(F.col("n"))).collect()] == ["5 bytes", "2 KB", "2.5 MB"]


def test_natural_order(spark):
    df = spark.createDataFrame([("a10",), ("a9",), ("A1b",), ("a01c",)], "s string")
    assert [r.s for r in df.orderBy(text.natural_key(F.col("s"))).collect()] == ["A1b", "a01c", "a9", "a10"]


def safetensors(header):
    data = json.dumps(header).encode()
    return struct.pack("<Q", len(data)) + data + b"\0" * 8


def test_safetensors(spark, tmp_path):
    (tmp_path / "a.safetensors").write_bytes(safetensors({"__metadata__": {"k": "v"}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "s": {"dtype": "I64", "shape": [], "data_offsets": [24, 32]}}))
    (tmp_path / "b.safetensors").write_bytes(b"\1\0\0\0\0\0\0\0x")
    got = model_files.tensors(model_files.files(spark, str(tmp_path), "*.safetensors")).collect()
    assert {(r.name, r.dtype, tuple(r.shape), int(r.parameters), int(r.bytes)) for r in got if r.error is None} == {("w", "F32", (2, 3), 6, 24), ("s", "I64", (), 1, 8)}
    assert sum(r.error is not None for r in got) == 1


def test_gguf(spark, tmp_path):
    s = lambda t: struct.pack("<Q", len(t)) + t.encode()
    meta = s("general.architecture") + struct.pack("<I", 8) + s("llama") + s("llama.context_length") + struct.pack("<II", 4, 4096) + s("list") + struct.pack("<IIQ", 9, 4, 3) + struct.pack("<III", 1, 2, 3)
    tensor = s("t") + struct.pack("<IQQIQ", 2, 4, 5, 12, 64)
    (tmp_path / "m.gguf").write_bytes(b"GGUF" + struct.pack("<IQQ", 3, 1, 3) + meta + tensor)
    binary = model_files.files(spark, str(tmp_path), "*.gguf")
    assert {(r.key, r.value) for r in model_files.gguf_metadata(binary).collect()} == {("general.architecture", '"llama"'), ("llama.context_length", "4096"), ("list", '{"count": 3, "first": [1, 2, 3]}')}
    (row,) = model_files.gguf_tensors(binary).collect()
    assert (row.name, row.dtype, row.shape, int(row.parameters), int(row.offset), row.error) == ("t", "Q4_K", [4, 5], 20, 64, None)


def test_imatrix(spark, tmp_path):
    (tmp_path / "i.dat").write_bytes(struct.pack("<i", 1) + struct.pack("<i", 1) + b"n" + struct.pack("<ii", 7, 2) + struct.pack("<ff", 1.0, 3.0))
    (row,) = model_files.imatrix(model_files.files(spark, str(tmp_path), "*.dat")).collect()
    assert (row.name, row.calls, row.n, row.least, row.most, row.mean) == ("n", 7, 2, 1.0, 3.0, 2.0)


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a":1}\n\n \t\r\n{"a":2}\r\n[3]')
    got = jsonl.entries(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.source_line, r.ordinal, bytes(r.raw)) for r in got] == [(1, 0, b'{"a":1}'), (4, 1, b'{"a":2}'), (5, 2, b"[3]")]
    assert [r.ordinal for r in jsonl.page(jsonl.entries(spark, str(tmp_path)), 0, 1).collect()] == [1]


def test_jsonl_over_splits(spark, tmp_path):
    lines = ["" if k % 5 == 0 else json.dumps({"k": k}) for k in range(4000)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = jsonl.entries(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [(k + 1, n, lines[k].encode()) for n, k in enumerate(k for k in range(4000) if lines[k])]
    assert sorted((r.source_line, r.ordinal, bytes(r.raw)) for r in got if "a.jsonl" in r.file) == want
    assert len(got) == 2 * len(want)


def test_routes(spark):
    rows = [("a.json", b"[1]", "Collection"), ("b.json", b"{}", "Document"), ("c.jsonl", b"{}", "Entry"), ("d.gz", b"x", "Unsupported"), ("e.txt", b"{}\n{}\n", "Entry"), ("f.txt", b"{}", "Document"), ("g.txt", b"words\nmore", "Choice"), ("h.json", b"\xff\xfe{\0", "Unsupported")]
    df = spark.createDataFrame([(p, bytearray(c), w) for p, c, w in rows], "path string, content binary, want string")
    assert {r.path: r.route for r in jsonl.routes(df).collect()} == {p: w for p, _, w in rows}
    bad = spark.createDataFrame([(bytearray(b"\xff"),), (bytearray(b"x"),)], "raw binary")
    assert jsonl.many_invalid(bad, "raw").first().many


def test_consistency(spark):
    rows = [("r", "config", "available", '{"vocab_size":10,"n_positions":5,"architectures":["A"]}'), ("r", "tokenizer", "available", '{"vocab_count":11}'), ("r", "tokenizerConfig", "available", '{"tokenizer_class":" ","eos_token_id":[3,2]}'), ("r", "generationConfig", "available", '{"eos_token_id":[2,3,3]}'), ("r", "gguf", "available", '{"context_length":6,"vocabulary":11}'), ("q", "tokenizer", "failed", None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "repo string, kind string, state string, value string, reason string")
    got = {(r.repo, r.id) for r in consistency.findings(df).collect()}
    assert got == {("r", "vocab-mismatch"), ("r", "missing-tokenizer-class"), ("r", "gguf-context-mismatch"), ("q", "missing-config")}
    assert {(r.repo, r.warnings, r.badge) for r in consistency.badge(df).collect()} == {("r", 3, "warnings"), ("q", 0, "insufficient")}
    assert [r.state for r in consistency.coverage(df).where("repo = 'q'").orderBy("place").collect()].count("missing") == 7
    assert [(r.field, r.value) for r in consistency.identity(df).orderBy("place").collect()] == [("architecture", "A"), ("vocab_size", "10"), ("context", "5")]


def test_layers(spark):
    assert stats.parsed_layers("0-2,5,-1") == [-1, 0, 1, 2, 5]
    assert stats.parsed_layers([3, -1, 9, 3], 4) == [3]
    names_ = ["m", "model.layers.0", "model.layers.0.self_attn", "model.layers.10.mlp.up", "model.layers.10", "model.layers.10.norm", "model.layers.2", "lm_head"]
    got = tensors.transformer_layers(spark.createDataFrame([(n,) for n in names_], "name string"), "name").orderBy("layer", "name").collect()
    assert ("model.layers.0", 0) in [(r.name, r.layer) for r in got] and ("model.layers.10", 10) in [(r.name, r.layer) for r in got] and not any(r.name in ("m", "lm_head", "model.layers.2") for r in got)
    a, b = (spark.createDataFrame(r, "layer int, v string") for r in ([(0, "h")], [(0, "n"), (1, "n")]))
    assert {(r.layer, r.v) for r in tensors.first_of(a, b, "layer").collect()} == {(0, "h"), (1, "n")}
    with pytest.raises(ValueError):
        stats.confidence(F.lit(1), F.lit(1), "other")


def test_progression(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0, 0.0])], "layer int, x array<double>")
    got = tensors.layer_progression(df, "layer", "x", "entropy").orderBy("layer").collect()
    assert [r.layer for r in got] == [1, 2] and got[1].normalised_entropy == pytest.approx(1)


def test_attention_of_one_head(spark):
    df = spark.createDataFrame([(0, 0, 0, q, k, float(q == k)) for q in range(3) for k in range(3)], "layer int, batch int, head int, q int, k int, weight double")
    assert attention.diagonal(df).first().dominance_vs_offdiag == float("inf")
    assert attention.head_similarity(df).count() == 0
    assert attention.entropy_distribution(df).first()["mean"] == pytest.approx(0, abs=1e-9)


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = events.windowed_counts(events.table_stream(spark, str(tmp_path / "e")), "ts", "event_type", late="365 days")
    got = {(r.start, r.event_type, r.n) for r in events.run_to_end(stream, "counts").collect()}
    assert got == {(r.start, r.event_type, r.n) for r in events.windowed_counts(source, "ts", "event_type").collect()}
    assert events.sessions(source, "ts", "user_id").agg(F.sum("n")).first()[0] == source.count()
