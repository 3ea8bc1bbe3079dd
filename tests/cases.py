"""Operators over literal rows that reach every branch; the SQL of each is the rows that it must give."""

from __future__ import annotations

import struct
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.operators import attention, consistency, conversations, entries, inspection, markup, names, templates, tensors, vocabularies
from tessera.sources import jsonl, model_files, sinks
from tessera.streaming import events

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SQL_TYPES = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def case(columns: str, expected: list[tuple]):
    """Registers what gives ``columns`` (name and type each) with the rows expected of it."""
    named = [c.split() for c in columns.split(", ")]
    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in expected)
    picked = ", ".join(f"CAST(c{k} AS {SQL_TYPES[kind]}) AS \"{name}\"" for k, (name, kind) in enumerate(named))
    sql = f"SELECT {picked} FROM (VALUES {values}) AS t({', '.join(f'c{k}' for k in range(len(named)))})"

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(spark).select(*(F.col(name).cast(kind).alias(name) for name, kind in named))

        run.__name__ = f.__name__
        QUERIES[f.__name__], ORACLES[f.__name__] = run, sql
        return f

    return add


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names, else, on a local master, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="cases-")
    return f"{root.rstrip('/')}/cases-{uuid.uuid4().hex}"


# ---- tensors


@case("layer int, max_prob double, margin double", [(0, 0.5, 0.0), (2, 0.731059, 0.462117)])
def layer_progression(spark):
    df = rows(spark, [(0, [1.0, 1.0]), (1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0])], "layer int, x array<double>")
    got = tensors.layer_progression(df, "layer", "x")
    own = got.join(df.select("layer", stats.softmax(F.col("x")).alias("p")), "layer")
    return own.select("layer", F.round(F.array_max("p"), 6).alias("max_prob"), F.round(F.array_max("p") - F.array_min("p"), 6).alias("margin"))


@case("metric string, trend string, change_ratio double", [("a", "increasing", 3.0), ("b", "decreasing", 0.5), ("c", "decreasing", 1.0), ("e", "increasing", float("1e308"))])
def metric_trends(spark):
    df = rows(spark, [(1, 1.0, 4.0, 2.0, None, 0.0), (2, 9.0, 1.0, 7.0, 5.0, 1.0), (3, 3.0, 2.0, 2.0, None, 4.0)], "step int, a double, b double, c double, d double, e double")
    got = tensors.trends(df, "step", ["a", "b", "c", "d", "e"])
    return got.withColumn("change_ratio", F.when(F.col("change_ratio") == float("inf"), 1e308).otherwise(F.col("change_ratio")))


@case("name string, kind string", [("GPT2LMHead", "causal_lm"), ("LlamaForCausalLM", "causal_lm"), ("BertModel", "encoder"), ("EncoderStack", "encoder"), ("T5Stack", "seq2seq"), ("Seq2SeqNet", "seq2seq"), ("ViTModel", "vision_transformer"), ("VisionNet", "vision_transformer"), ("CLIPText", "multimodal"), ("BlipModel", "vision_language"), ("Mamba", "unknown")])
def architecture_kinds(spark):
    data = ["GPT2LMHead", "LlamaForCausalLM", "BertModel", "EncoderStack", "T5Stack", "Seq2SeqNet", "ViTModel", "VisionNet", "CLIPText", "BlipModel", "Mamba"]
    return rows(spark, [(n,) for n in data], "name string").select("name", tensors.architecture(F.col("name")).alias("kind"))


@case("name string, layer int", [("model.layers.0", 0), ("model.layers.11", 11), ("transformer.h.2", 2)])
def layer_modules(spark):
    data = ["model", "model.layers", "model.layers.0", "model.layers.0.self_attn", "model.layers.0.mlp", "model.layers.11", "model.layers.11.mlp", "model.layers.11.input_norm", "model.layers.12", "model.layers.12.mlp", "transformer.h.2", "transformer.h.2.attn", "model.norm", "heads.3", "heads.3.attention"]
    return tensors.transformer_layers(rows(spark, [(n,) for n in data], "name string"), "name")


@case("spec string, found string", [("0-2,5", "0,1,2,5"), ("3,1,1", "1,3"), ("-1", "5"), ("-2,9,0", "0,4"), ("", "")])
def layer_specs(spark):
    data = [(spec, ",".join(map(str, stats.parsed_layers(spec, 6)))) for spec in ("0-2,5", "3,1,1", "-1", "-2,9,0", "")]
    return rows(spark, data, "spec string, found string")


@case("id int, output double, failed boolean", [(1, 2.5, False), (2, None, True), (3, None, True)])
def outputs_or_errors(spark):
    df = rows(spark, [(1, "2.5"), (2, "x"), (3, None)], "id int, s string")
    return tensors.each_or_none(df, "id", "s", float, "double").select("id", "output", F.col("error").isNotNull().alias("failed"))


@case("analyzed_layers long, attention_layers long, has_confidence_analysis boolean, top_token int", [(2, 1, True, 1)])
def analysis_summary(spark):
    logits = rows(spark, [("a", [0.0, 2.0, 1.0])], "id string, x array<double>")
    hidden = tensors.layer_logits(rows(spark, [(0, [1.0, 2.0]), (1, [0.0, 1.0])], "layer int, values array<double>")).withColumnRenamed("logits", "values")
    heads = rows(spark, [(0, 0, 0, 0, 0, 1.0)], "layer int, batch int, head int, q int, k int, weight double")
    got = tensors.full_analysis(logits, "id", "x", hidden, heads)
    return got["summary"].crossJoin(got["top_tokens"].where("rank = 1").select(F.col("token_id").alias("top_token")))


@case("layer int, mean double, std double, pairs long", [(0, -0.333333, 0.942809, 3), (1, -1.0, 0.0, 1)])
def similar_heads(spark):
    """Layer 0: correlations 1, -1 and -1, and a head without variance, which has none; layer 2 has no pair."""
    cells = {(0, 0): [1, 2, 3, 4], (0, 1): [2, 4, 6, 8], (0, 2): [4, 3, 2, 1], (0, 3): [5, 5, 5, 5], (1, 0): [1, 0, 1, 0], (1, 1): [0, 3, 0, 3], (2, 0): [1, 2, 3, 4]}
    data = [(layer, 0, head, k // 2, k % 2, float(v)) for (layer, head), own in cells.items() for k, v in enumerate(own)]
    got = attention.head_similarity(rows(spark, data, "layer int, batch int, head int, q int, k int, weight double"))
    return got.select("layer", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "pairs")


# ---- JSON

ERRORS = [
    ("1 2", "trailing_data", 2, 1, 3), ("", "unexpected_end_of_input", 0, 1, 1), ("[1,", "unexpected_end_of_input", 3, 1, 4), ("[,1]", "expected_scalar_json_value", 1, 1, 2), ("[1,]", "expected_scalar_json_value", 3, 1, 4),
    ("{1:2}", "expected_object_key", 1, 1, 2), ('{"a":1,}', "expected_object_key", 7, 1, 8), ('{"a" 1}', "expected_colon_after_object_key", 5, 1, 6), ('{"a":1;', "expected_object_value_separator", 6, 1, 7), ("[1 2]", "expected_array_element_separator", 3, 1, 4),
    ("nul", "invalid_json_literal", 0, 1, 1), ("01", "leading_zero_not_allowed", 1, 1, 2), ("-", "expected_digit", 1, 1, 2), ("1.", "expected_digit_after_decimal_point", 2, 1, 3), ("1e+", "expected_digit_in_exponent", 3, 1, 4),
    ('"a', "unterminated_string", 2, 1, 3), ('"a\tb"', "unescaped_control_character_in_string", 2, 1, 3), ('"\\', "unterminated_string_escape", 2, 1, 3), ('"é\\x"', "invalid_string_escape", 3, 1, 4), ('"\\ud800"', "unpaired_high_surrogate", 7, 1, 8),
    ('"\\ud800\\u0041"', "invalid_low_surrogate", 9, 1, 10), ('["\\udc00"]', "unpaired_low_surrogate", 2, 1, 3), ('"\\u12', "incomplete_unicode_escape", 3, 1, 4), ('"\\u12g4"', "invalid_unicode_escape_digit", 5, 1, 6), ('{\n "é": x}', "expected_scalar_json_value", 9, 2, 8),
]


@case("s string, code string, at long, line long, column long", ERRORS)
def json_errors(spark):
    df = rows(spark, [(s,) for s, *_ in ERRORS], "s string")
    return df.withColumn("e", entries.strict_error("s")).select("s", "e.*")


@case("id int, status string, code string", [(1, "Valid", None), (2, "Valid", None), (3, "InvalidJson", "unpaired_high_surrogate"), (4, "InvalidUtf8", None), (5, "InvalidJson", "expected_scalar_json_value"), (6, "Oversized", None), (7, "Valid", None)])
def entry_statuses(spark):
    df = rows(spark, [(1, b'{"a":1,"a":2}'), (2, b"1e400"), (3, b'"\\ud83d"'), (4, b"\xff{}"), (5, b"[1,]"), (7, b"\xef\xbb\xbf[]")], "id int, raw binary")
    big = rows(spark, [(6,)], "id int").withColumn("raw", F.repeat(F.lit(" "), (16 << 20) + 1).cast("binary"))
    return entries.entry_status(df.union(big), "raw").select("id", "status", F.col("error.code").alias("code"))


@case("id int, head string, tail string", [(1, "abc", "def"), (2, None, None)])
def oversized_previews(spark):
    df = rows(spark, [(1, b"abcdef"), (2, b"abcde")], "id int, raw binary")
    got = jsonl.oversized_preview(df, "raw", 5, 3)
    return got.select("id", F.col("head").cast("string").alias("head"), F.col("tail").cast("string").alias("tail"))


@case("node_id int, parent int, kind string, path string, start long, end long, lexeme string, value string", [
    (0, None, "Object", "$", 1, 50, None, None), (1, 0, "String", "$.a", 6, 12, '"é\\n"', "é\n"), (2, 0, "Array", '$["b c"]', 21, 32, None, None), (3, 2, "Number", '$["b c"][0]', 22, 26, "1.50", None), (4, 2, "Null", '$["b c"][1]', 27, 31, "null", None), (5, 0, "True", "$.a#2", 37, 41, "true", None), (6, 0, "Object", '$[""]', 45, 47, None, None),
])
def node_details(spark):
    df = rows(spark, [(1, ' {"a":"é\\n", "b c": [1.50,null],"a":true,"":{}  }')], "id int, s string")
    return entries.json_nodes(df, "id", "s")


@case("node_id int, labels string, truncated boolean", [(0, "$", False), (1, "$|a", False), (2, "$|a|[0]", False), (3, '$|["a"]#2', False), (4, '$|["[x"]', False), (5, '$|[""]', False), (6, "$|" + "k" * 256, True)])
def node_path_labels(spark):
    df = rows(spark, [(1, '{"a":[1],"a":2,"[x":3,"":4,"' + "k" * 300 + '":5}')], "id int, s string")
    got = entries.path_labels(df, "id", "s")
    return got.select("node_id", F.array_join("labels", "|").alias("labels"), "truncated")


@case("node_id int, label string, preview string, more boolean", [(0, "$", None, None), (1, "a", "x" * 256, True), (2, "a#2", "7", False), (3, "c", None, None), (4, "[0]", "true", False)])
def projected_nodes(spark):
    df = rows(spark, [(1, '{"a":"' + "x" * 300 + '","a":7,"c":[true]}')], "id int, s string")
    got = inspection.projected(entries.json_nodes(df, "id", "s"))
    return got.select("node_id", F.col("label.value").alias("label"), F.col("preview.value").alias("preview"), F.col("preview.has_more").alias("more"))


@case("step string, node_id int", [("first", 1), ("first", 2), ("next", 3), ("subtree", 3), ("subtree", 4), ("subtree", 5)])
def tree_pages(spark):
    """Two children of the root, the next one, and what is inside of it."""
    nodes = entries.json_nodes(rows(spark, [(1, '{"a":1,"b":2,"c":{"d":[3]}}')], "id int, s string"), "id", "s")
    own = lambda step, df: df.select(F.lit(step).alias("step"), "node_id")
    return own("first", entries.children_page(nodes, "id", 0, -1, 2)).union(own("next", entries.children_page(nodes, "id", 0, 2, 2))).union(own("subtree", entries.subtree(nodes, "id", 3)))


@case("ordinal long, raw string", [(2, "c"), (3, "d")])
def entry_pages(spark):
    df = rows(spark, [("f", k, c) for k, c in enumerate("abcde")], "file string, ordinal long, raw string")
    return jsonl.page(df, 1, 2)


@case("depth int, path string, text string", [(1, "$ → $.a", '{"b":"[\\"{}\\"]"}'), (2, "$ → $.a → $.b", '["{}"]'), (3, "$ → $.a → $.b → $[0]", "{}")])
def nested_json(spark):
    df = rows(spark, [(1, '{"a":"{\\"b\\":\\"[\\\\\\"{}\\\\\\"]\\"}","c":"{no","d":"plain"}')], "id int, s string")
    return entries.nested_scopes(df, "id", "s")


@case("id int, levels long", [(1, 1), (2, 0), (3, 2)])
def nested_limits(spark):
    """One level at depth 1; none beyond the bytes of a container; no third where the containers together exceed theirs."""
    deep = '{"b":"[\\"{}\\"]"}'
    import json

    s = json.dumps({"a": deep})
    count = lambda k, **own: entries.nested_scopes(rows(spark, [(k, s)], "id int, s string"), "id", "s", **own).groupBy().agg(F.lit(k).alias("id"), F.count("*").alias("levels"))
    return count(1, depth=1).union(count(2, most=5)).union(count(3, in_all=len(deep) + 6))


@case("id int, hex string, lossy string", [(1, "61ff62", "a\ufffdb"), (2, "c3a9", "é")])
def copied_bytes(spark):
    df = rows(spark, [(1, b"a\xffb"), (2, "é".encode())], "id int, b binary")
    return df.select("id", inspection.copied(F.col("b"), "hex").alias("hex"), inspection.copied(F.col("b"), "lossy").alias("lossy"))


@case("at int, text string, next long", [(0, "aé", 3), (1, "é漢", None), (3, "漢", None)])
def text_chunks(spark):
    df = rows(spark, [("aé漢",)], "s string")
    chunk = lambda at, size: df.select(F.lit(at).alias("at"), entries.text_chunk(F.col("s"), at, size).alias("c")).select("at", "c.*")
    return chunk(0, 5).union(chunk(1, 50)).union(chunk(3, 3))


@case("id int, pretty string", [(1, '{\n  "a\\/b" : [\n    1,\n    0.10000000000000001,\n    1e+30\n  ],\n  "b" : {\n\n  }\n}'), (2, '"\\"é"'), (3, None), (4, "[\n\n]"), (5, '{\n  "k" : 2\n}'), (6, "0")])
def pretty_sorted(spark):
    df = rows(spark, [(1, '{"b":{},"a/b":[1,0.1,1e30]}'), (2, '"\\u0022\\u00e9"'), (3, "{"), (4, "[]"), (5, '{"k":1,"k":2}'), (6, "-0")], "id int, s string")
    return df.select("id", entries.sorted_pretty("s").alias("pretty"))


@case("id int, key string, start int, end int", [(1, "b", 1, 4), (1, "a", 16, 19), (2, "é\n", 2, 7)])
def root_key_ranges(spark):
    df = rows(spark, [(1, '{"b":{"c":[1]},\n"a":1}'), (2, '{ "é\\n": 1}'), (3, "[1]"), (4, "{")], "id int, s string")
    return df.select("id", F.explode(entries.key_ranges("s")).alias("r")).select("id", "r.*")


@case("lexeme string, shown string", [("1", "1"), ("-0", "0"), ("12345678901234567890", "12345678901234567890"), ("1.50", "1.5"), ("1e3", "1000"), ("0.1", "0.1"), ("1e-7", "1e-07"), ("2.5e30", "2.5e+30")])
def number_texts(spark):
    data = ["1", "-0", "12345678901234567890", "1.50", "1e3", "0.1", "1e-7", "2.5e30"]
    return rows(spark, [(s,) for s in data], "lexeme string").select("lexeme", templates.number_text(F.col("lexeme")).alias("shown"))


# ---- entries, files, search


@case("source_line long, ordinal long, raw string, status string", [(1, 0, "7B7D", "Valid"), (3, 1, "FFFE", "InvalidUtf8"), (4, 2, "5B315D", "Valid"), (5, 3, "7B", "InvalidJson"), (7, 4, "220D", "InvalidJson")])
def jsonl_bytes(spark):
    """Blank lines, a CR before a line feed, bytes that aren't UTF-8, and a CR at the end of the file."""
    path = scratch(spark)
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/x.jsonl")
    out = fs.getFileSystem(spark._jsc.hadoopConfiguration()).create(fs)
    out.write(bytearray(b'{}\n \t\r\n\xff\xfe\r\n[1]\n{\n\n"\r'))
    out.close()
    return entries.entry_status(jsonl.entries(spark, path), "raw").select("source_line", "ordinal", F.hex("raw").alias("raw"), "status")


@case("path string, route string", [("a.json", "Collection"), ("b.json", "Document"), ("c.jsonl", "Entry"), ("d.NDJSON", "Entry"), ("e.json5", "Unsupported"), ("f.txt", "Entry"), ("g", "Document"), ("h.txt", "Choice"), ("i.txt", "Unsupported"), ("j.json", "Unsupported"), ("k.jsonl", "Unsupported"), ("l.log", "Collection")])
def file_routes(spark):
    data = [("a.json", b"[1]"), ("b.json", b"{}"), ("c.jsonl", b"x"), ("d.NDJSON", b"{}"), ("e.json5", b"{}"), ("f.txt", b"{}\n\n{}\n"), ("g", b"7"), ("h.txt", b"some words\nand more"), ("i.txt", b'{"a":1} {"b":2}\nx'), ("j.json", b"\xff\xfe{\x00"), ("k.jsonl", b"\x1e{}"), ("l.log", b" [{}]")]
    return jsonl.routes(rows(spark, data, "path string, content binary"))


@case("path string, mode string, route string, error string", [("a.json", "Entry", "Document", "conflict"), ("b.txt", "Entry", "Entry", None), ("c.txt", "Document", "Entry", "not allowed"), ("d.gz", "Entry", "Unsupported", None), ("b.txt", "Collection", "Choice", "not allowed"), ("a.json", "Collection", "Document", "conflict"), ("a.json", None, "Document", None)])
def route_overrides(spark):
    r = rows(spark, [("a.json", "Document"), ("b.txt", "Choice"), ("c.txt", "Entry"), ("d.gz", "Unsupported")], "path string, route string")
    own = lambda path, mode: jsonl.chosen(r.where(F.col("path") == path), mode).withColumn("mode", F.lit(mode))
    out = own("a.json", "Entry")
    for path, mode in (("b.txt", "Entry"), ("c.txt", "Document"), ("d.gz", "Entry"), ("b.txt", "Collection"), ("a.json", "Collection"), ("a.json", None)):
        out = out.unionByName(own(path, mode))
    return out


@case("path string, current boolean", [("a", True), ("b", False), ("c", False), ("d", False)])
def file_identity(spark):
    schema = "path string, length long, modificationTime string"
    before = rows(spark, [("a", 1, "t"), ("b", 1, "t"), ("c", 1, "t"), ("d", 1, "t")], schema)
    now = rows(spark, [("a", 1, "t"), ("b", 2, "t"), ("c", 1, "u")], schema)
    return jsonl.unchanged(now, before)


@case("n long, invalid long, many boolean", [(6, 2, True)])
def invalid_share(spark):
    return jsonl.many_invalid(rows(spark, [(b"{}",), (b"\xff",), (b"",), (b"\xc3",), (b"x",), ("é".encode(),)], "raw binary"), "raw")


@case("mode string, entries long, matched long, skipped_invalid_json long, skipped_invalid_utf8 long, skipped_oversized long", [("decoded", 7, 3, 1, 1, 1), ("raw", 7, 4, 0, 1, 0)])
def entry_filter(spark):
    """The decoded key é matches in decoded mode only; an oversized and a broken entry that hold the bytes match in raw mode only."""
    df = rows(spark, [(b'{"\\u00e9x":1}',), ('{"éx":1}'.encode(),), ('["a éx b"]'.encode(),), (b"[1]",), ('{"éx'.encode(),), (b"\xff\xc3\xa9x",)], "raw binary")
    big = df.limit(1).select(F.concat(F.lit("éx"), F.repeat(F.lit(" "), 16 << 20)).cast("binary").alias("raw"))
    count = lambda mode: entries.filter_counts(entries.filtered_entries(df.union(big), "raw", "éx", mode)).withColumn("mode", F.lit(mode))
    # In raw mode two valid entries match (not the escaped key), the broken and the oversized one; the one that isn't UTF-8 is skipped.
    return count("decoded").unionByName(count("raw"))


@case("page int, path string, field string, start long", [(1, "$.abc", "key", 1), (1, "$.x", "value", 0), (2, "$.x", "value", 2), (2, "$.y[0]", "value", 1)])
def search_pages(spark):
    df = rows(spark, [(1, '{"abc":1,"x":"b b","y":[-b]}'.replace("-b", '"ab"'))], "id int, s string")
    found = entries.search_nodes(entries.json_nodes(df, "id", "s"), "id", "b")
    order = ["node_id", "phase", "start"]
    one = inspection.keyset_page(found, order, None, 2)
    last = one.orderBy(*(F.desc(c) for c in order)).first()
    two = inspection.keyset_page(found, order, tuple(last[c] for c in order), 2)
    return one.withColumn("page", F.lit(1)).unionByName(two.withColumn("page", F.lit(2)))


@case("id int, path string, field string, start long", [(1, "$.a", "key", 0), (2, "$.k", "value", 2)])
def search_evidence(spark):
    df = rows(spark, [(1, '{"a":"xa"}'), (2, '{"k":"bba","z":"a"}'), (3, '{"k":1}')], "id int, s string")
    return entries.first_evidence(entries.search_nodes(entries.json_nodes(df, "id", "s"), "id", "a"), "id")


@case("id int, path string, field string, snippet string, match_start int, match_end int", [(1, "$.k", "value", "…" + "x" * 80 + "needle" + "y" * 80 + "…", 81, 87), (2, "$.needles", "key", "needles", 0, 6), (3, "$[1]", "value", "😀needle", 2, 8)])
def evidence_in_context(spark):
    df = rows(spark, [(1, '{"k":"' + "x" * 90 + "needle" + "y" * 90 + '"}'), (2, '{"needles":"needle"}'), (3, '["a","😀needle"]'), (4, "{}")], "id int, s string")
    return entries.evidence_snippets(entries.json_nodes(df, "id", "s"), "id", "needle")


@case("at int, line long", [(-3, 1), (0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (6, 4), (99, 4)])
def lines_at(spark):
    """a LF b CR LF CR c: the offset between CR and LF is already on the next line."""
    df = rows(spark, [(k,) for k in (-3, 0, 1, 2, 3, 4, 5, 6, 99)], "at int")
    return df.select("at", text.line_at(F.lit("a\nb\r\n\rc"), F.col("at")).alias("line"))


@case("side string, total long, piece string", [("leftOnly", 2, "An"), ("leftOnly", 2, "an"), ("shared", 1, "ban"), ("rightOnly", 2, "x"), ("rightOnly", 2, "y")])
def difference_search(spark):
    left, right = (rows(spark, [(t,) for t in own], "token string") for own in (["An", "an", "ban", "q"], ["ban", "x", "y"]))
    diff = vocabularies.difference(left, right, "token")
    own = lambda side, query, most=1000: vocabularies.difference_search(diff, "token", side, query, most).withColumn("side", F.lit(side))
    return own("leftOnly", " AN ").unionByName(own("shared", "an")).unionByName(own("rightOnly", ""))


@case("query string, token string, token_id long", [("", "A1", 5), ("", "b", 12), ("1", "A1", 5), ("1", "b", 12), ("a", "A1", 5)])
def vocabulary_file_search(spark):
    df = rows(spark, [("b", 12), ("A1", 5)], "token string, token_id long")
    own = lambda q: vocabularies.vocabulary_entries(df, "token", "token_id", q).withColumn("query", F.lit(q))
    return own("").unionByName(own("1")).unionByName(own("a"))


# ---- events

SAMPLES = [
    ("typed", [f'{{"type":"a","timestamp":{k}}}' if k < 7 else '{"x":1}' for k in range(10)], True),
    ("few", ['{"type":"a","timestamp":1}'] * 9, False),
    ("training", ['{"training_sample":{"type":"a","timestamp":1}}'] * 10, False),
    ("sequence", [f'{{"kind":"a","seq":{k}}}' for k in range(10)], True),
    ("grouped", [f'{{"event":"a","runId":{k // 2}}}' for k in range(10)], True),
    ("ungrouped", [f'{{"event":"a","run_id":{k}}}' for k in range(10)], False),
    ("timed", [f'{{"ts":{k},"case_id":"c"}}' for k in range(10)], True),
    ("values", ['{"run_id":1}', '{"run_id":1.0}', '{"run_id":"1"}', '{"run_id":null}'] * 2 + ['{"run_id":"x"}', '{"run_id":"y"}'], False),
]


@case("name string, is_event_stream boolean", [(name, want) for name, _, want in SAMPLES])
def event_rules(spark):
    out = None
    for name, data, _ in SAMPLES:
        df = rows(spark, [*enumerate(data)], "id int, json string")
        own = entries.event_verdict(entries.event_samples(df, "id", "json"), "id", "json").withColumn("name", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


@case("name string, n long", [("count", 200), ("bytes", 7), ("others", 2)])
def event_sample_bounds(spark):
    """The first 200 objects; those within 8 MiB; entries that aren't objects and broken ones count with their bytes."""
    many = spark.range(300).select(F.col("id"), F.lit('{"a":1}').alias("json"))
    filled = lambda n: F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), n), F.lit('"}'))
    big = spark.range(20).select("id", filled((1 << 20) + 100).alias("json"))
    others = spark.range(6).select("id", F.when(F.col("id") == 1, F.repeat(F.lit("y"), 6 << 20)).when(F.col("id") >= 3, filled(3 << 20)).otherwise(F.lit('{"a":1}')).alias("json"))
    own = lambda name, df: entries.event_samples(df, "id", "json").groupBy().agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return own("count", many).union(own("bytes", big)).union(own("others", others))


@case("id int, type string, time string, grp string, more boolean", [(1, "a", "5", "s", False), (2, "null", None, None, False), (3, None, None, None, False), (4, "{\"b\":1}", "1.50", None, False), (5, "t" * 256, None, None, True), (6, None, None, None, False)])
def event_summaries(spark):
    df = rows(spark, [(1, '{"kind":"z","type":"a","time":5,"runId":"r","session_id":"s"}'), (2, '{"event":null}'), (3, "[1]"), (4, '{"type":{"b":1},"ts":1.50}'), (5, '{"type":"' + "t" * 300 + '"}'), (6, "{")], "id int, json string")
    got = entries.event_summary(df, "json")
    return got.select("id", F.col("event_type.value").alias("type"), F.col("timestamp.value").alias("time"), F.col("grouping.value").alias("grp"), F.coalesce("event_type.has_more", F.lit(False)).alias("more"))


@case("name string, entries long, complete boolean, total long, hint boolean", [("early", 12, False, None, None), ("full", 260, False, None, True), ("end", 12, True, 12, True)])
def streamed_verdicts(spark):
    """Progress of streams by what they have read: before the sample is full the verdict is open, then it is final."""

    def fed(name: str, sizes: list[int], complete: bool) -> tuple:
        own, at = events.Verdicts(spark, scratch(spark), "id", "json"), 0
        for number, n in enumerate(sizes):
            own.feed(spark.range(at, at + n).select("id", F.lit('{"type":"a","ts":1}').alias("json")), number)
            at += n
        own.feed(spark.range(5).select("id", F.lit("{}").alias("json")), len(sizes) - 1)  # a batch that is run again
        return name, *own.progress(complete).values()

    data = [fed("early", [5, 7], False), fed("full", [150, 110], False), fed("end", [12], True)]
    return rows(spark, data, "name string, entries long, complete boolean, total long, hint boolean")


@case("n long, start_hour int", [(2, 10), (1, 11)])
def late_sessions(spark):
    df = rows(spark, [("u", "2024-01-01 10:00:00"), ("u", "2024-01-01 10:20:00"), ("u", "2024-01-01 11:30:00")], "user string, at string").withColumn("at", F.col("at").cast("timestamp"))
    return events.sessions(df, "at", "user").select("n", F.hour("start").alias("start_hour"))


# ---- detection, markup

DETECTED = [
    ("# Head\ntext", "markdown"), ("      ## deep", "markdown"), ("####### seven", "plain"), ("#tag", "plain"), ("#", "markdown"), ("> quoted", "markdown"), ("- a\n- b", "markdown"), ("- a", "plain"), ("-\ta\n-\tb", "plain"), ("1. a\n22.\tb", "markdown"), ("1) a\n2) b", "plain"), ("+ a\n* b", "markdown"),
    ("| a | b |\n| --- | :---: |", "markdown"), ("a | b\n--|---", "plain"), ("a | b\n\n---|---", "plain"), ("a | b\n---|:---", "markdown"), ("|a|\n|---|", "plain"),
    ("```py\nx\n```", "markdown"), ("        ```\nx\n    `````", "markdown"), ("``` a`b\nx\n```", "markdown"), ("````\nx\n```", "plain"), ("~~~\n```\nx\n~~~ ", "markdown"), ("```\nx\n``` y", "plain"),
    ('{"a":1}', "json"), ('{"a":1,}', "plain"), ("[1] text", "plain"), ("  [1]", "json"), ("<p>x</p>", "html"), ("<T>", "plain"), ("<?xml version='1'?><a></a>", "plain"), ("<p>x", "plain"),
    ("#!/bin/sh\necho", "code"), ("  package main", "code"), ("def f(x):", "code"), ("def f(x)", "plain"), ("def f(x)\nlet a = 1", "code"), ("let x = 1", "plain"), ("let x = 1\nvar y = 2", "code"), ("call(x);", "plain"), ("call(x);\nf(y);", "code"), ("a => { b", "plain"), ("x => y;\nz => {", "code"), ("fn main() {", "code"), ("function f(", "code"), ("#include <a>", "code"), ("a public static b", "code"), ("plain words", "plain"), ("", "plain"), ("foo_bar a*b", "plain"),
]


@case("s string, kind string", DETECTED)
def detected_strings(spark):
    df = rows(spark, [(k, s) for k, (s, _) in enumerate(DETECTED)], "id int, s string")
    even = df.join(markup.balanced(df, "id", "s"), "id")
    return even.select("s", text.detected(F.col("s"), None, markup.looks_html(F.col("s"))).alias("kind"))


@case("key string, kind string", [("Code", "code"), ("SOURCE", "code"), ("script", "code"), ("codes", "plain"), (None, "plain")])
def detected_by_key(spark):
    df = rows(spark, [("Code",), ("SOURCE",), ("script",), ("codes",), (None,)], "key string")
    return df.select("key", text.detected(F.lit("let x = 1"), F.col("key")).alias("kind"))


@case("size string, kind string", [("two MiB", "markdown"), ("more", "plain")])
def detection_limits(spark):
    body = lambda n: F.concat(F.lit("> "), F.repeat(F.lit("x"), n))
    df = spark.range(1).select(F.explode(F.array(F.struct(F.lit("two MiB").alias("size"), body((2 << 20) - 2).alias("s")), F.struct(F.lit("more").alias("size"), body((2 << 20) - 1).alias("s")))).alias("r")).select("r.*")
    return df.select("size", text.detected(F.col("s")).alias("kind"))


LANGUAGES = [
    ("#!/usr/bin/env bash\nls", "shell"), ('{"a": [1]}', "json"), ("select a from b", "sql"), ("import os\ndef f(x):\n    return None\n", "python"), ("fn f() -> u8 { 1 }", "rust"), ("interface A { x: number }", "typescript"), ("const f = () => { return 1; }", "javascript"),
    ("#include <iostream>\nusing namespace std;", "cpp"), ("#include <stdio.h>\nint main(void) {}", "c"), ("public class A { Object o = new Object(); }", "java"), ("package main\nfunc main() {}", "go"), ("a: 1\nb: two\n", "yaml"), ("---\nx", "yaml"), ("only words", None), ("", None),
]


@case("s string, language string", LANGUAGES)
def language_patterns(spark):
    return rows(spark, [(s,) for s, _ in LANGUAGES], "s string").select("s", text.code_language(F.col("s")).alias("language"))


@case("s string, safe string", [("[a](http://x)", "a (http://x)"), ("![p](u.png)", "[image: p] (u.png)"), ("a ![](u) [b](c)", "a [image: ] (u) b (c)"), ("no links <b>", "no links <b>")])
def safe_markdown(spark):
    return rows(spark, [("[a](http://x)",), ("![p](u.png)",), ("a ![](u) [b](c)",), ("no links <b>",)], "s string").select("s", markup.safe_markdown(F.col("s")).alias("safe"))


@case("id int, body string", [(1, "# T\nx\ny z"), (2, "a\n```\n<b>kept</b>\n```\nc"), (3, "plain")])
def model_cards(spark):
    df = rows(spark, [(1, "---\nlicense: mit\n---\n# T\nx<br/>y <b>z</b><!-- c -->"), (2, "<i>a</i>\n```\n<b>kept</b>\n```\n<i>c</i>"), (3, "plain")], "id int, s string")
    return df.select("id", markup.card_body(F.col("s")).alias("body"))


@case("html string, safe string, shown string", [("<p onclick=x>a&lt;b</p>", "<p>a&lt;b</p>", "a<b"), ("<div>a<script>alert(1)</script>b</div>", "<div>ab</div>", "ab"), ("<blink>x</blink><b>y", "x<b>y</b>", "xy"), ("<p>a</p><p>b  c</p>", "<p>a</p><p>b  c</p>", "a\nb c"), ("<iframe><p>x</p></iframe>z", "z", "x\nz"), ('"q"', "&quot;q&quot;", '"q"')])
def html_cases(spark):
    data = ["<p onclick=x>a&lt;b</p>", "<div>a<script>alert(1)</script>b</div>", "<blink>x</blink><b>y", "<p>a</p><p>b  c</p>", "<iframe><p>x</p></iframe>z", '"q"']
    return rows(spark, [(s,) for s in data], "html string").select("html", markup.sanitised("html").alias("safe"), markup.rendered_text("html").alias("shown"))


@case("s string, n long", [("The the THEM other", 2), ("the_x the", 1), ("théa the", 1), ("", 0)])
def whole_words(spark):
    df = rows(spark, [("The the THEM other",), ("the_x the",), ("théa the",), ("",)], "s string")
    return df.select("s", F.regexp_count("s", F.lit(text.find_pattern("the", "fullWord"))).cast("long").alias("n"))


# ---- conversations

KINDS = [
    ("openai", ['{"role":"user","content":"x"}', '{"role":"assistant","tool_calls":[]}']), ("openai", ['{"role":"tool","content":"x"}']), ("anthropic", ['{"role":"user","content":"x"}', '{"role":"assistant","content":[{"type":"thinking","thinking":"x"}]}']),
    ("mixed", ['{"role":"developer","content":"x"}', '{"role":"user","content":[{"type":"tool_use"}]}']), ("generic", ['{"from":"human","value":"x"}', '{"from":"gpt","value":"y"}']), ("possible", ['{"role":"user","content":"x"}']), ("possible", ['{"role":"user","content":"x"}', '{"a":1}', "7"]),
    ("none", ['{"a":1}', '{"b":2}']), ("generic", ['{"role":"user","content":"x","tool_calls":[],"tool_calls":[]}', '{"role":"assistant","content":"y"}']), ("generic", ['{"role":"user","content":"x"}'] * 4 + ['{"role":"other"}']),
]


@case("id int, n_messages long, kind string", [(k, len(m), kind) for k, (kind, m) in enumerate(KINDS)])
def protocol_kinds(spark):
    data = [(k, m) for k, (_, all_) in enumerate(KINDS) for m in all_]
    return conversations.kinds(rows(spark, data, "id int, m string"), "id", "m")


@case("id int, scope int, label string, path string", [(1, 0, "messages", "$.messages"), (1, 0, "conversation", "$.conversation"), (1, 0, "messages#2", "$.messages#2"), (2, 1, "conversations", "$[0].conversations"), (2, 3, "messages", "$[1].messages")])
def conversation_candidates(spark):
    df = rows(spark, [(1, '{"messages":[],"conversation":[],"meta":{"messages":[]},"messages":[1]}'), (2, '[{"conversations":[]},{"messages":[]},[[]]]'), (3, '{"messages":{}}'), (4, '{"a":[{"messages":[]}]}')], "id int, s string")
    return conversations.candidates(df, "id", "s")


@case("turn int, block int, field string, element int, category string, text string", [
    (0, 0, None, None, "header", "assistant"), (0, 1, "role", None, "role", "assistant"), (0, 2, "content", None, "content", None), (0, 3, "content", 0, "text", "hi"), (0, 4, "content", 1, "thinking", "hm"), (0, 5, "content", 2, "redactedThinking", "zz"), (0, 6, "content", 3, "toolUse", "f"), (0, 7, "content", 4, "toolResult", "t1"),
    (0, 8, "content", 5, "unknown", None), (0, 9, "content", 6, "unknown", None), (0, 10, "content", 7, "unknown", None), (0, 11, "content", 8, "unknown", None),
    (1, 0, None, None, "header", "user"), (1, 1, "role", None, "role", "user"), (1, 2, "content", None, "text", "plain"), (1, 3, "id", None, "unknown", "7"),
])
def anthropic_blocks(spark):
    elements = ['{"type":"text","text":"hi"}', '{"type":"thinking","thinking":"hm"}', '{"type":"redacted_thinking","data":"zz"}', '{"type":"tool_use","id":"1","name":"f","input":{}}', '{"type":"tool_result","tool_use_id":"t1","content":[]}', '{"type":"tool_use","id":"1","name":"f","input":"x"}', '{"type":"text","text":"a","text":"b"}', '"bare"', '{"text":"no type"}']
    data = [(1, 0, '{"role":"assistant","content":[' + ",".join(elements) + "]}"), (1, 1, '{"role":"user","content":"plain","id":"7"}')]
    return conversations.message_blocks(rows(spark, data, "conv int, turn int, m string"), "conv", "turn", "m", "anthropic")


@case("turn int, block int, field string, element int, category string, text string", [
    (0, 0, None, None, "header", "user"), (0, 1, "role", None, "role", "user"), (0, 2, "content", None, "content", None), (0, 3, "content", 0, "text", "hi"), (0, 4, "content", 1, "image", "u"), (0, 5, "content", 2, "unknown", None), (0, 6, "content", 3, "unknown", None),
    (1, 0, None, None, "header", "assistant"), (1, 1, "role", None, "role", "assistant"), (1, 2, "tool_calls", None, "tool", None), (1, 3, "tool_calls", 0, "toolCall", "f"), (1, 4, "tool_calls", 1, "unknown", "g"), (1, 5, "function_call", None, "toolCall", "h"),
    (2, 0, None, None, "header", "tool"), (2, 1, "role", None, "role", "tool"), (2, 2, "content", None, "toolResult", "done"), (2, 3, "tool_call_id", None, "toolResult", "1"), (2, 4, "x", None, "unknown", None),
])
def openai_message_blocks(spark):
    data = [
        (1, 0, '{"role":"user","content":[{"type":"text","text":"hi"},{"type":"image_url","image_url":{"url":"u"}},{"type":"image_url","image_url":{"ur":"u"}},{"type":"audio"}]}'),
        (1, 1, '{"role":"assistant","tool_calls":[{"id":"1","type":"function","function":{"name":"f","arguments":"{}"}},{"function":{"name":"g"}}],"function_call":{"name":"h","arguments":{}}}'),
        (1, 2, '{"role":"tool","content":"done","tool_call_id":"1","x":null}'),
    ]
    return conversations.message_blocks(rows(spark, data, "conv int, turn int, m string"), "conv", "turn", "m", "openai")


@case("turn int, block int, field string, element int, category string, text string", [(0, 0, None, None, "header", "user"), (0, 1, "from", None, "role", "human"), (0, 2, "value", None, "value", None), (0, 3, "value", 0, "value", "a"), (0, 4, "value", 1, "value", None), (0, 5, "tool_calls", None, "tool", None), (1, 0, None, None, "header", "unknown"), (1, 1, "role", None, "role", "narrator"), (1, 2, "content", None, "content", "b"), (1, 3, "z", None, "unknown", None)])
def generic_blocks(spark):
    data = [(1, 0, '{"from":"human","value":["a",1],"tool_calls":[1]}'), (1, 1, '{"role":"narrator","content":"b","z":{}}')]
    return conversations.message_blocks(rows(spark, data, "conv int, turn int, m string"), "conv", "turn", "m", "generic")


@case("id int, element int, category string, text string", [(1, None, "text", "x"), (2, 0, "unknown", None), (2, 1, "unknown", None), (2, 2, "text", "ok"), (2, 3, "unknown", None), (3, None, "unknown", None)])
def system_fields(spark):
    df = rows(spark, [(1, '{"system":"x","messages":[]}'), (2, '{"system":[{"type":"text","text":"a","text":"b"},{"type":"image"},{"type":"text","text":"ok"},"s"]}'), (3, '{"system":7}'), (4, "{}")], "id int, s string")
    return conversations.system_blocks(df, "id", "s")


@case("page int, turn int, block int", [(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 1, 1), (2, 2, 0)])
def block_pages(spark):
    """Pages of three blocks by keyset; a conversation's second page begins where its first ended."""
    data = [(1, k, '{"role":"user"}') for k in range(3)]
    own = conversations.message_blocks(rows(spark, data, "conv int, turn int, m string"), "conv", "turn", "m", "generic")
    order = ["turn", "block"]
    one = inspection.keyset_page(own, order, None, 3, 100)
    two = inspection.keyset_page(own, order, (1, 0), 2, 100)
    return one.withColumn("page", F.lit(1)).union(two.withColumn("page", F.lit(2)))


@case("id int, n_recognised long, generic boolean", [(1, 2, True), (2, 1, False), (3, 4, True), (4, 3, False)])
def conversation_profiles(spark):
    """Two of two; one alone; four of five; three of five."""
    data = [(1, "user", "a"), (1, "bot", "b"), (2, "user", "a"), *((3, r, "x") for r in ("user", "model", "user", "gpt", "other")), *((4, r, "x") for r in ("user", "model", "user", "other", "other"))]
    return conversations.profile(rows(spark, data, "id int, role string, content string"), "id", "role", "content")


@case("role string, normal string", [("system", "system"), ("developer", "developer"), ("user", "user"), ("human", "user"), ("assistant", "assistant"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("tool", "tool"), ("function", "tool"), ("narrator", "unknown"), (None, "unknown")])
def roles_normalised(spark):
    data = ["system", "developer", "user", "human", "assistant", "gpt", "bot", "model", "tool", "function", "narrator", None]
    return rows(spark, [(r,) for r in data], "role string").select("role", conversations.normal_role(F.col("role")).alias("normal"))


# ---- model files


def gguf(version: int, order: str = "<", key: str = "general.alignment", name: str = "a.w", offset: int = 64) -> bytes:
    count = "I" if version == 1 else "Q"
    pack = lambda code, *v: struct.pack(order + code, *v)
    said = lambda s: pack(count, len(s)) + s.encode()
    meta = said(key) + pack("II", 4, 32) + said("general.name") + pack("I", 8) + said("x") + said("l") + pack("II", 9, 5) + pack(count + "iii", 3, 1, 2, 3)
    tensor = said(name) + pack("I", 2) + pack(count + count, 2, 3) + pack("IQ", 1, offset)
    return b"GGUF" + pack("I", version) + pack(count + count, 1, 3) + meta + tensor


def binary(spark: SparkSession, data: list[tuple[str, bytes]]) -> DataFrame:
    return rows(spark, [(path, len(b), bytearray(b)) for path, b in data], "path string, length long, content binary")


@case("path string, name string, dtype string, shape string, parameters long, offset long, failed boolean", [("v1", "a.w", "F16", "[2,3]", 6, 64, False), ("v2", "a.w", "F16", "[2,3]", 6, 64, False), ("v3", "a.w", "F16", "[2,3]", 6, 64, False), ("v3big", "a.w", "F16", "[2,3]", 6, 64, False), *((n, None, None, None, None, None, True) for n in ("v2big", "v4", "key", "name", "offset", "cut", "magic"))])
def gguf_versions(spark):
    data = [("v1", gguf(1)), ("v2", gguf(2)), ("v3", gguf(3)), ("v3big", gguf(3, ">")), ("v2big", gguf(2, ">")), ("v4", gguf(4)), ("key", gguf(3, key="General.alignment")), ("name", gguf(3, name="")), ("offset", gguf(3, offset=8)), ("cut", gguf(3)[:-3]), ("magic", b"GGML" + gguf(3)[4:])]
    return model_files.gguf_tensors(binary(spark, data)).select("path", "name", "dtype", F.to_json("shape").alias("shape"), "parameters", "offset", F.col("error").isNotNull().alias("failed"))


@case("path string, key string, value string", [("v1", "general.alignment", "32"), ("v1", "general.name", '"x"'), ("v1", "l", '{"count": 3, "first": [1, 2, 3]}'), ("bad", None, None)])
def gguf_values(spark):
    return model_files.gguf_metadata(binary(spark, [("v1", gguf(1)), ("bad", b"GG")])).select("path", "key", "value")


@case("path string, architecture string, name string, context_length long", [("a", "llama", "n", 4096), ("b", "x", None, 7), ("c", None, None, None)])
def gguf_overviews(spark):
    meta = [("a", "general.architecture", '"llama"'), ("a", "general.name", '"n"'), ("a", "bert.context_length", "1"), ("a", "llama.context_length", "4096"), ("b", "general.architecture", '"x"'), ("b", "y.context_length", "7"), ("c", "k", "1")]
    return inspection.gguf_overview(rows(spark, meta, "path string, key string, value string"))


@case("path string, entries long", [("a", 1)])
def gguf_importance(spark):
    return inspection.imatrix_entries(rows(spark, [("a", "x.in_sum2"), ("a", "x.counts"), ("a", "y.counts"), ("b", "z.in_sum2")], "path string, name string"))


@case("path string, name string, dtype string, shape string, parameters long, bytes long, failed boolean", [("ok", "w", "F32", "[2,2]", 4, 16, False), ("ok", "s", "F16", "[]", 1, 2, False), ("cut", None, None, None, None, None, True), ("json", None, None, None, None, None, True), ("offsets", None, None, None, None, None, True)])
def safetensors_headers(spark):
    import json

    def own(header) -> bytes:
        raw = header if isinstance(header, bytes) else json.dumps(header).encode()
        return struct.pack("<Q", len(raw)) + raw + bytes(32)

    good = {"__metadata__": {"format": "pt"}, "w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}, "s": {"dtype": "F16", "shape": [], "data_offsets": [16, 18]}}
    data = [("ok", own(good)), ("cut", own(good)[:20]), ("json", own(b"{no")), ("offsets", own({"w": {"dtype": "F32", "shape": [1], "data_offsets": [4, 0]}}))]
    return model_files.tensors(binary(spark, data)).select("path", "name", "dtype", F.to_json("shape").alias("shape"), "parameters", "bytes", F.col("error").isNotNull().alias("failed"))


@case("path string, name string, calls int, n int, least double, most double, mean double, chunks int, dataset string, failed boolean", [("full", "a", 2, 2, 1.0, 3.0, 2.0, 5, "wiki", False), ("short", "a", 2, 2, 1.0, 3.0, 2.0, None, None, False), *((p, *[None] * 8, True) for p in ("nan", "twice", "none", "cut", "rest"))])
def importance_matrices(spark):
    i = lambda *v: struct.pack(f"<{len(v)}i", *v)
    one = lambda name="a", *v: i(len(name)) + name.encode() + i(2, len(v) or 2) + struct.pack(f"<{len(v) or 2}f", *(v or (1.0, 3.0)))
    data = [("full", i(1) + one() + i(5, 4) + b"wiki"), ("short", i(1) + one()), ("nan", i(1) + one("a", float("nan"))), ("twice", i(2) + one() + one()), ("none", i(0)), ("cut", (i(1) + one())[:-1]), ("rest", i(1) + one() + i(5, 2) + b"wiki")]
    got = model_files.imatrix(binary(spark, data))
    return got.withColumn("failed", F.col("error").isNotNull())


@case("n long, shown string", [(0, "Zero bytes"), (1, "1 byte"), (999, "999 bytes"), (1499, "1 KB"), (1500, "2 KB"), (999499, "999 KB"), (999500, "1 MB"), (2_550_000, "2.6 MB"), (2_000_000, "2 MB"), (1_234_567_890, "1.23 GB"), (1_500_000_000, "1.5 GB"), (3 * 10**15, "3 PB"), (2 * 10**12, "2 TB")])
def byte_counts(spark):
    data = [0, 1, 999, 1499, 1500, 999499, 999500, 2_550_000, 2_000_000, 1_234_567_890, 1_500_000_000, 3 * 10**15, 2 * 10**12]
    return rows(spark, [(n,) for n in data], "n long").select("n", names.format_bytes(F.col("n")).alias("shown"))


@case("path string, language string, image string, is_image boolean", [("a/b.PY", "python", "application/octet-stream", False), ("x.tsx", "tsx", "application/octet-stream", False), ("i.jpeg", None, "image/jpeg", True), ("v.svg", "markup", "image/svg+xml", True), ("a.b/none", None, "application/octet-stream", False), ("k.kts", "kotlin", "application/octet-stream", False)])
def file_types(spark):
    df = rows(spark, [("a/b.PY",), ("x.tsx",), ("i.jpeg",), ("v.svg",), ("a.b/none",), ("k.kts",)], "path string")
    return df.select("path", names.syntax_language(F.col("path")).alias("language"), names.image_type(F.col("path")).alias("image"), names.is_image(F.col("path")).alias("is_image"))


@case("id int, title string, subtitle string, place int, part string, field string, value string", [(1, "LlamaForCausalLM", "llama · bf16 · 2 layers", 0, "scale", "hidden_size", "8"), (1, "LlamaForCausalLM", "llama · bf16 · 2 layers", 3, "attention", "num_attention_heads", "4"), (1, "LlamaForCausalLM", "llama · bf16 · 2 layers", 7, "context", "rope_theta", "10000.0"), (2, "m", "m", 2, "scale", "vocab_size", "5")])
def config_summaries(spark):
    df = rows(spark, [(1, '{"architectures":["LlamaForCausalLM","B"],"model_type":"llama","torch_dtype":"bf16","num_hidden_layers":2,"hidden_size":8,"num_attention_heads":4,"rope_theta":10000.0}'), (2, '{"model_type":"m","vocab_size":5}'), (3, "[1]")], "id int, s string")
    return inspection.config_summary(df, "id", "s", "config").join(df.select("id", inspection.config_title("s").alias("title"), inspection.config_subtitle("s").alias("subtitle")), "id")


@case("id int, tensors long, shards long, total_size long, mapping string", [(1, 3, 2, 10, "a=x,b=y,c=x"), (2, None, None, None, None)])
def weight_indexes(spark):
    df = rows(spark, [(1, '{"metadata":{"total_size":10},"weight_map":{"c":"x","a":"x","b":"y"}}'), (2, "{}")], "id int, s string")
    mapped = inspection.shard_mapping(df, "id", "s").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "tensor", "shard"))), ",").alias("mapping"))
    own = inspection.shard_summary(df, "id", "s")
    null = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)  # noqa: E731  the size of null is -1 in some modes
    return own.select("id", null("tensors"), null("shards"), "total_size").join(mapped, "id", "left")


# ---- tokenizers, templates


@case("id int, version string, model_type string, vocab_count long, merge_count long, added_count long", [(1, "1.0", "BPE", 2, 1, 1), (2, None, "Unigram", 3, 0, 0)])
def tokenizer_structures(spark):
    df = rows(spark, [(1, '{"version":"1.0","model":{"type":"BPE","vocab":{"a":0,"b":1},"merges":["a b"]},"added_tokens":[{"id":2}]}'), (2, '{"model":{"type":"Unigram","vocab":[["a",0],["b",-1],["c",-2]]}}')], "id int, s string")
    return inspection.tokenizer_structure(df, "id", "s")


@case("id int, token_id long, token string, scalar_length int, error string", [(1, 0, "a", 1, None), (1, -1, "😀b", 2, "negative"), (1, 5, "c", 1, "repeated"), (1, 5, "d", 1, "repeated"), (2, 0, "x", 1, None), (2, 1, "yz", 2, None)])
def vocabulary_tables(spark):
    df = rows(spark, [(1, '{"model":{"vocab":{"a":0,"😀b":-1,"c":5,"d":5}}}'), (2, '{"model":{"vocab":[["x",0.5],["yz",-1]]}}')], "id int, s string")
    own = inspection.vocabulary_rows(df, "id", "s")
    return own.join(inspection.vocabulary_errors(own, "id"), ["id", "token_id"], "left")


@case("turn int, role string, content string, error string", [(0, "user", "hi", None), (1, "tool", '{"a":1}', None), (2, None, "x", "role missing"), (3, "user", None, "content missing"), (4, "user", "null", None)])
def chat_files(spark):
    df = rows(spark, [(1, '[{"role":"user","content":"hi"},{"role":"tool","content":{"a":1}},{"content":"x"},{"role":"user"},{"role":"user","content":null}]')], "id int, s string")
    return inspection.chat_messages(df, "id", "s")


@case("folder string, names string, fits boolean", [("", "tokenizer.json,tokenizer_config.json", True), ("sub", "tokenizer.model", False)])
def tokenizer_bundles(spark):
    df = rows(spark, [("r", "tokenizer.json", 5), ("r", "tokenizer_config.json", 5), ("r", "sub/tokenizer.model", 40 << 20), ("r", "alone/tokenizer_config.json", 1)], "repo string, path string, size long")
    return inspection.bundles(df, "repo", "path", "size").select("folder", F.array_join("names", ",").alias("names"), "fits")


@case("text string, ids string, error string, item int", [("[1, 2]", "1,2", None, None), ("3 4,5", "3,4,5", None, None), ("", None, "empty", None), ("1 -2 x", None, "negative", 2), ("1 x", None, "invalid", 2), ("99999999999999999999", None, "overflow", 1)])
def token_id_lists(spark):
    df = rows(spark, [(s,) for s in ("[1, 2]", "3 4,5", "", "1 -2 x", "1 x", "99999999999999999999")], "text string")
    got = df.select("text", vocabularies.token_ids(F.col("text")).alias("t"))
    return got.select("text", F.array_join(F.col("t.ids").cast("array<string>"), ",").alias("ids"), "t.error", "t.item")


@case("pos int, flag string", [(0, "eos_token"), (1, "pad_token"), (2, None), (3, "<x>"), (4, None)])
def special_flags(spark):
    """A named token by its id, one without an id by its piece, one marked special, and plain ones, an added one that isn't special among them."""
    fields = rows(spark, [("t", "eos_token", "</s>"), ("t", "pad_token", "<pad>")], "tokenizer string, name string, piece string")
    added = rows(spark, [("t", 2, "</s>", True), ("t", 9, "<x>", True), ("t", 5, "word", False)], "tokenizer string, token_id int, content string, special boolean")
    tokens = rows(spark, [("t", 0, 2, "</s>"), ("t", 1, 7, "<pad>"), ("t", 2, 3, "a"), ("t", 3, 9, "<x>"), ("t", 4, 5, "word")], "tokenizer string, pos int, token_id int, piece string")
    return vocabularies.flagged(tokens, vocabularies.special_tokens(fields, added))


@case("id int, left_count long, right_count long, delta long, ids_match boolean, first_difference long, left_id int, right_id int", [(1, 2, 2, 0, True, None, None, None), (2, 3, 2, -1, False, 1, 2, 9), (3, 1, 3, 2, False, 1, None, 5), (4, 0, 0, 0, True, None, None, None)])
def token_comparisons(spark):
    df = rows(spark, [(1, [1, 2], [1, 2]), (2, [1, 2, 3], [1, 9]), (3, [1], [1, 5, 6]), (4, [], [])], "id int, a array<int>, b array<int>")
    return df.select("id", *(c.alias(n) for n, c in vocabularies.comparison(F.col("a"), F.col("b")).items()))


@case("id int, position int, segment string, role string", [(1, 0, "<u>", "template"), (1, 1, "he", "user"), (1, 2, "llo", "user"), (1, 3, "<a>o", "template"), (1, 4, "k", "assistant"), (2, 0, "x", None)])
def segment_roles(spark):
    schema = "id int, text string, bodies array<struct<role:string,body:string>>, segments array<string>, mapping string"
    df = rows(spark, [(1, "<u>hello<a>ok", [("user", "hello"), ("assistant", "ok")], ["<u>", "he", "llo", "<a>o", "k"], "Exact"), (2, "x", [("user", "x")], ["x"], "Decoded only")], schema)
    return vocabularies.attributed(df, "id")


@case("id int, place int, tid string, usable boolean, error string", [(1, 0, "tokenizerConfig:default", True, None), (2, 0, "tokenizerConfig:a", True, None), (2, 1, "tokenizerConfig:b", False, None), (3, 0, "jinjaFile:default", True, None), (3, 1, "tokenizerConfig:t", True, None), (4, None, "", None, "unsupported value"), (5, None, "", None, "item without name or template")])
def template_catalogue(spark):
    df = rows(spark, [(1, '"x"', None), (2, '{"b":" ","a":"y"}', None), (3, '[{"name":"t","template":"z"}]', "j"), (4, "7", None), (5, '[{"name":"t"}]', None)], "id int, t string, j string")
    return templates.catalogue(df, "id", "t", "j").withColumnRenamed("id", "own").toDF(*["id", "place", "tid", "name", "source", "body", "usable", "error"])


@case("requested string, tid string", [(None, "tokenizerConfig:default"), ("tokenizerConfig:b", "tokenizerConfig:c"), ("tokenizerConfig:gone", "tokenizerConfig:default"), ("tokenizerConfig:default", "tokenizerConfig:default")])
def active_templates(spark):
    df = rows(spark, [(1, "x", True, 0, "a"), (1, "x", True, 1, "default"), (1, "x", False, 2, "b"), (1, "x", True, 3, "c")], "repo int, body string, usable boolean, place int, name string")
    cat = df.withColumn("source", F.lit("tokenizerConfig")).withColumn("id", F.concat_ws(":", "source", "name"))
    out = None
    for requested in (None, "tokenizerConfig:b", "tokenizerConfig:gone", "tokenizerConfig:default"):
        own = templates.active(cat, "repo", requested).select(F.lit(requested).cast("string").alias("requested"), F.col("id").alias("tid"))
        out = own if out is None else out.union(own)
    return out


@case("name string, kind string, value string", [("bos_token", "string", "<s>"), ("eos_token", "null", None), ("enable_thinking", "boolean", "true"), ("documents", "json", "[]")])
def template_variables(spark):
    df = rows(spark, [(1, "{{ enable_thinking }} {% for d in documents %}", '{"bos_token":"<s>","eos_token":null}')], "id int, t string, c string")
    return templates.initial_variables(df, "id", "t", "c")


@case("place int, name string, error string", [(1, "", "name required"), (2, "messages", "reserved"), (3, "x", "repeated"), (4, "n", "integer required"), (5, "d", "number required"), (6, "j", "json required")])
def template_request_errors(spark):
    df = rows(spark, [(1, 0, "x", "string", "a"), (1, 1, " ", "string", "a"), (1, 2, "messages", "string", "a"), (1, 3, " x", "string", "a"), (1, 4, "n", "integer", "1.5"), (1, 5, "d", "decimal", "z"), (1, 6, "j", "json", "{"), (1, 7, "m", "integer", "-4"), (1, 8, "k", "json", "[1]")], "id int, place int, name string, kind string, value string")
    return templates.variable_errors(df, "id").select("place", F.trim("name").alias("name"), "error")


@case("id int, start int, end int, kind string", [
    (1, 2, 4, "delimiter"), (1, 4, 5, "expression"), (1, 5, 8, "string"), (1, 8, 9, "expression"), (1, 9, 11, "delimiter"),
    (2, 0, 2, "delimiter"), (2, 2, 3, "statement"), (2, 3, 5, "keyword"), (2, 5, 11, "statement"), (2, 11, 12, "string"), (2, 12, 14, "keyword"), (2, 14, 17, "string"), (2, 17, 18, "statement"), (2, 18, 20, "delimiter"),
    (3, 0, 2, "delimiter"), (3, 2, 6, "comment"), (3, 6, 8, "delimiter"), (3, 9, 11, "delimiter"),
])
def jinja_parts(spark):
    df = rows(spark, [(1, "a {{ 'x' }}"), (2, "{% if x == 'in y' %}"), (3, "{# if #} {{ open")], "id int, s string")
    return df.select("id", F.explode(templates.jinja_spans("s")).alias("r")).select("id", "r.*")


@case("id int, start_line int, end_line int", [(1, 1, 4), (1, 2, 3), (1, 6, 7), (2, 1, 3)])
def python_folds(spark):
    df = rows(spark, [(1, "class A:\n  def f(self):\n    pass\n  x = 1\n\nif y:\n  z\nw"), (2, "def g():\n\n  a\n\n"), (3, "def h(): pass\nx")], "id int, s string")
    return templates.indent_folds(df, "id", "s", templates.PYTHON_HEADER)


@case("start_line int, end_line int", [(2, 4), (1, 5)])
def json_line_folds(spark):
    df = rows(spark, [(1, '{\n"a":[\n1\n],"b":[2]\n}')], "id int, s string")
    return df.select(F.explode(templates.json_folds("s")).alias("f")).select("f.*")


@case("name string, title string, first string", [("json", "n", '{"a":1,"b":null}'), ("yaml", "n", '- a: 1\n  b: null'), ("report", "n", "a: 1")])
def report_sinks(spark):
    """Written and read back: JSON keeps nulls, YAML has a row an item, a report a line a value."""
    df = rows(spark, [(1, None)], "a int, b string")
    path = scratch(spark)
    sinks.write_json(df, f"{path}/json")
    sinks.write_yaml(df, f"{path}/yaml")
    whole = lambda kind: spark.read.text(f"{path}/{kind}", wholetext=True).select(F.lit(kind).alias("name"), F.lit("n").alias("title"), F.rtrim(F.regexp_replace("value", r"\n$", "")).alias("first"))
    said = sinks.report(df.select("a"), "t").where("line LIKE 'a%'").select(F.lit("report").alias("name"), F.lit("n").alias("title"), F.col("line").alias("first"))
    return whole("json").union(whole("yaml")).union(said)


@case("place int, name string, value string", [(0, "messages", '[{"role":"user","content":"a \\"b\\""},{"role":"tool","content":{"x":1}}]'), (1, "add_generation_prompt", "true"), (2, "tools", '[{"type":"function","function":{"name":"f","description":"d","parameters":{"p":1}}}]'), (3, "s", '"v"'), (4, "n", "-4"), (6, "b", "true"), (7, "z", "null")])
def template_contexts(spark):
    messages = rows(spark, [(1, 1, "tool", "json", '{"x":1}'), (1, 0, "user", "text", 'a "b"')], "id int, turn int, role string, kind string, content string")
    tools = rows(spark, [(1, 0, " f ", "d", '{"p":1}'), (1, 1, "g", "d", "[1]")], "id int, place int, name string, description string, parameters string")
    variables = rows(spark, [(1, 0, "s", "string", "v"), (1, 1, "n", "integer", "-4"), (1, 2, "messages", "string", "x"), (1, 3, "b", "boolean", "yes"), (1, 4, "z", "null", None), (1, 5, "s", "string", "again")], "id int, place int, name string, kind string, value string")
    return templates.request_context(messages, tools, variables, "id")


# ---- repositories


@case("id int, start long, end long, first_line long, n_lines long", [(1, 0, 4, 1, 2), (1, 4, 6, 3, 1), (2, 0, 4, 1, 1), (2, 4, 8, 1, 1), (2, 8, 10, 1, 1), (3, 0, 0, 1, 1), (4, 0, 5, 1, 1), (4, 5, 6, 2, 1), (5, 0, 5, 1, 1), (5, 5, 6, 1, 1)])
def source_pieces(spark):
    """At most two lines, 100 units and, inside of a line, 4: short lines, a long line, nothing, a CR and LF and a pair at a cut."""
    df = rows(spark, [(1, "a\nb\nc\n"), (2, "x" * 10), (3, ""), (4, "abc\r\nd"), (5, "abc😀d")], "id int, s string")
    return names.source_cuts(df, "id", "s", 2, 100, 4)


@case("repo int, place int, id string, severity string, left string, right string", [
    (1, 0, "vocab-mismatch", "warning", "10", "11"), (1, 1, "missing-tokenizer-class", "warning", None, None), (1, 2, "missing-chat-template", "info", None, None), (1, 3, "eos-mismatch", "warning", "1,2", "3"), (1, 4, "context-info", "info", "8", "9"), (1, 5, "gguf-context-mismatch", "warning", "8", "7"), (1, 6, "gguf-vocab-mismatch", "warning", "12", "11"), (2, 7, "missing-config", "info", None, None),
])
def consistency_rules(spark):
    data = [(1, "config", '{"vocab_size":10,"n_positions":8}'), (1, "tokenizerConfig", '{"tokenizer_class":" ","model_max_length":9,"eos_token_id":3}'), (1, "tokenizer", '{"vocab_count":11}'), (1, "generationConfig", '{"eos_token_id":[2,1,2]}'), (1, "chatTemplates", '{"active":""}'), (1, "gguf", '{"context_length":7,"vocabulary":12}'), (2, "tokenizer", '{"vocab_count":11}')]
    df = rows(spark, [(r, k, "available", v, None) for r, k, v in data], "repo int, kind string, state string, value string, reason string")
    return consistency.findings(df)


@case("repo string, path string", [("a", "config.json"), ("b", "x/config.json"), ("c", "z/config.json")])
def picked_files(spark):
    df = rows(spark, [("a", "sub/config.json"), ("a", "config.json"), ("b", "yy/config.json"), ("b", "x/config.json"), ("c", "z/config.json"), ("d", "other.txt")], "repo string, path string")
    return names.picked(df, "repo", "path", ["config.json"], F.lit("x"))


@case("path string, place int", [("b/config.json", 0), ("generation_config.json", 1), ("tokenizer.json", 2), ("chat_template.jinja", 3), ("model.safetensors.index.json", 4), ("README.md", 5), ("a2.txt", 6), ("a10.txt", 7), ("model.safetensors", 8)])
def file_order(spark):
    from pyspark.sql import Window

    df = rows(spark, [(p,) for p in ("model.safetensors", "a10.txt", "README.md", "tokenizer.json", "a2.txt", "chat_template.jinja", "model.safetensors.index.json", "generation_config.json", "b/config.json")], "path string")
    own = names.ordered_files(df, "path")
    return own.select("path", (F.row_number().over(Window.orderBy("category_rank", "name_rank", "natural")) - 1).alias("place"))


@case("url string, model string", [("https://host.co/a/b", None), ("a/b", "a/b"), ("https://huggingface.co/a/b/tree/main", "a/b"), ("HTTP://www.huggingface.co/datasets/a/b?x=1", "datasets/a"), ("just", None), (" .a/b", None), ("https://huggingface.co/a", None)])
def model_ids(spark):
    data = ["https://host.co/a/b", "a/b", "https://huggingface.co/a/b/tree/main", "HTTP://www.huggingface.co/datasets/a/b?x=1", "just", " .a/b", "https://huggingface.co/a"]
    return rows(spark, [(u,) for u in data], "url string").select("url", names.model_id(F.col("url")).alias("model"))


@case("path string, shown boolean", [("a", True), ("a.b", True), ("c", True)])
def shown_nodes(spark):
    nodes = rows(spark, [("a",), ("a.b",), ("a.b.d",), ("c",), ("c.e",)], "path string")
    return names.shown(nodes, rows(spark, [("a",)], "path string")).select("path", F.lit(True).alias("shown"))

