import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import entries, inspection


def test_tokenizers(spark):
    a = {"version": "1.0", "model": {"type": "BPE", "vocab": {"x": 0, "yé": 1}, "merges": ["x y"]}, "added_tokens": [{"id": 5}]}
    b = {"model": {"type": "Unigram", "vocab": [["<unk>", 0.0], ["▁a", -1.5]]}}
    df = spark.createDataFrame([(1, json.dumps(a)), (2, json.dumps(b))], "key int, t string")
    assert [tuple(r) for r in inspection.tokenizer_structure(df, "key", "t").orderBy("key").collect()] == [(1, "1.0", "BPE", 2, 1, 1), (2, None, "Unigram", 2, 0, 0)]
    rows = inspection.vocabulary_rows(df, "key", "t")
    assert {tuple(r) for r in rows.collect()} == {(1, 0, "x", 1), (1, 1, "yé", 2), (2, 0, "<unk>", 5), (2, 1, "▁a", 2)}
    assert inspection.vocabulary_errors(rows, "key").count() == 0
    bad = spark.createDataFrame([(1, -1, "a"), (1, 2, "b"), (1, 2, "c")], "key int, token_id long, token string")
    assert {(r.token_id, r.error) for r in inspection.vocabulary_errors(bad, "key").collect()} == {(-1, "negative"), (2, "repeated")}


def test_messages(spark):
    df = spark.createDataFrame([(1, '[{"role":"user","content":"a"},{"role":"tool","content":[1]},{"content":"x"},{"role":"user"}]')], "key int, m string")
    got = inspection.chat_messages(df, "key", "m").orderBy("turn").collect()
    assert [(r.role, r.content, r.error) for r in got] == [("user", "a", None), ("tool", "[1]", None), (None, "x", "role missing"), ("user", None, "content missing")]


def test_model_files(spark):
    df = spark.createDataFrame([(1, '{"metadata":{"total_size":9},"weight_map":{"a":"1.st","b":"1.st","c":"2.st"}}')], "key int, i string")
    assert tuple(inspection.shard_summary(df, "key", "i").first()) == (1, 3, 2, 9)
    meta = spark.createDataFrame([("p", "general.architecture", '"llama"'), ("p", "a.context_length", "1"), ("p", "llama.context_length", "7"), ("q", "z.context_length", "3")], "path string, key string, value string")
    assert {tuple(r) for r in inspection.gguf_overview(meta).collect()} == {("p", "llama", None, 7), ("q", None, None, 3)}
    names = spark.createDataFrame([("p", "a.in_sum2"), ("p", "a.counts"), ("p", "b.counts")], "path string, name string")
    assert [tuple(r) for r in inspection.imatrix_entries(names).collect()] == [("p", 1)]
    files = spark.createDataFrame([("r", "a/tokenizer.json", 5), ("r", "a/tokenizer_config.json", 5), ("r", "tokenizer_config.json", 5), ("s", "tokenizer.json", 1 << 40)], "repo string, path string, size long")
    assert {(r.repo, r.folder, r.fits, len(r["names"])) for r in inspection.bundles(files, "repo", "path", "size").collect()} == {("r", "a", True, 2), ("s", "", False, 1)}


def test_nodes_and_pages(spark):
    nodes = entries.json_nodes(spark.createDataFrame([(1, '{"a":"x","a":[1,2]}')], "key0 int, s string"), "key0", "s")
    got = inspection.projected(nodes).orderBy("node_id").collect()
    assert [(r.label.value, r.preview and r.preview.value) for r in got] == [("$", None), ("a", "x"), ("a#2", None), ("[0]", "1"), ("[1]", "2")]
    df = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert [tuple(r) for r in inspection.keyset_page(df, ["a", "b"], (0, 1), 3).collect()] == [(0, 2), (1, 0), (1, 1)]
    assert inspection.keyset_page(df, ["a", "b"], None, 2).count() == 2
    with pytest.raises(ValueError):
        inspection.keyset_page(df, ["a"], None, 0)
    raw = spark.createDataFrame([(bytearray(b"a\xff"),)], "b binary")
    assert raw.select(inspection.copied(F.col("b"), "hex"), inspection.copied(F.col("b"), "lossy")).first()[:] == ("61ff", "a�")
