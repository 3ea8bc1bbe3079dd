"""Inputs that operators once got wrong, each with what is right."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import conversations, entries, markup, names, vocabularies
from tessera.sources import jsonl


def column(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, s string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("s"))).collect()]


def test_repeated_keys_are_json(spark):
    twice, lone = '{"a":1,"a":2}', '["\\ud800"]'
    assert column(spark, [twice, lone, '{"a":1', "plain", "1 2", "7", None], text.is_json) == [True, False, False, False, False, True, None]
    assert column(spark, [twice, lone, "{ x"], lambda s: text.detected(s)) == ["json", "plain", "plain"]
    assert column(spark, [twice, lone, '{"a":NaN}', "[1,]"], text.code_language)[:2] == ["json", "json"]
    assert column(spark, ['{"a":NaN}', "[1,]"], text.code_language) == [None, None]
    files = spark.createDataFrame([("x.txt", twice.encode()), ("y.txt", f"{twice}\n{twice}\n".encode()), ("z.txt", b"{\n}\n[1\n"), ("w.txt", b'{"a":1}\n["\\ud800"]\n')], "path string, content binary")
    assert {r["path"]: r["route"] for r in jsonl.routes(files).collect()} == {"x.txt": "Document", "y.txt": "Entry", "z.txt": "Choice", "w.txt": "Choice"}


SANITISED = [
    ("<form>hello</form>", "hello"), ("<title>T</title>", "T"), ("<nav>a</nav><samp>b</samp><var>c</var><wbr>", "<nav>a</nav><samp>b</samp><var>c</var><wbr>"),
    ("<a href=x>l</a><del>d</del><table><caption>c</caption></table>", "ld<table>c</table>"), ("it's \"q\" &amp; <", "it&#39;s &quot;q&quot; &amp; &lt;"),
    ("<b>" * 33 + "x" + "</b>" * 33, None), ("<b>" * 32 + "x" + "</b>" * 32, "<b>" * 32 + "x" + "</b>" * 32), ("<svg><p>x</p></svg>y", "y"), ("<img src=x>t<input>", "t"),
    ("<p>a<p>b", "<p>a</p><p>b</p>"), ("<p><b>a<p>b</b>c", "<p><b>a</b></p><p><b>b</b>c</p>"), ("<ul><li>a<li>b</ul>", "<ul><li>a</li><li>b</li></ul>"), ("x" * (1 << 20), None), ('"' * (400 << 10), None), ("<!-- c -->z", "z"),
]


def test_sanitised(spark):
    got = column(spark, [a for a, _ in SANITISED], lambda s: markup.sanitised(s))
    assert [(a[:40], g and g[:60]) for (a, _), g in zip(SANITISED, got)] == [(a[:40], w and w[:60]) for a, w in SANITISED]


def test_looks_html(spark):
    rows = {"<p>a</p> tail": False, "\n <p>a</p>\n": True, "<!-- c -->": False, "<!-- c --><p>x</p>": True, "<Div>x</Div>": True, "<T>x</T>": False, "<b><i>x</b></i>": False, "<br>": True, "<p>x": False, "<?XML v?><a></a>": False, "<div/>": False, "head <p>x</p>": False, "<!doctype html><html><body><p>x</p></body></html>": True, "< 3": False}
    assert dict(zip(rows, column(spark, list(rows), markup.looks_html))) == rows


def test_anthropic_signals(spark):
    block = '{"type":"tool_use","id":"1","name":"n","input":{}}'
    rows = {
        f'{{"role":"user","content":["x",{block}]}}': "anthropic",
        '{"role":"user","content":[{"type":"tool_use","id":"1","id":"2"}]}': "possible",
        '{"role":"user","content":[{"type":"thinking","type":"thinking"}]}': "possible",
        '{"role":"user","content":"{\\"type\\":\\"tool_use\\"}"}': "possible",
        '{"role":"user","content":["{\\"type\\":\\"tool_use\\"}"]}': "possible",
        '{"role":"user","content":[{"type":"tool_result","content":[{"type":"text","text":"a","text":"b"}]}]}': "possible",
    }
    df = spark.createDataFrame(list(enumerate(rows)), "k int, m string")
    assert {r["k"]: r["kind"] for r in conversations.kinds(df, "k", "m").collect()} == dict(enumerate(rows.values()))


def test_event_summary(spark):
    rows = ['{"type":"a"} x', '\ufeff{"type":"a","ts":1.50}', '{"type":{"a" : 1}}', '{"type":"x","type":"y"}', '{"type":"\\ud800"}', '{"event":"e","type":null}', '[{"type":"a"}]', '{"ts":[1, 2],"sessionId":"s"}', '{"other":1}', None]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, j string")
    got = {r["k"]: tuple(r[c] and r[c]["value"] for c in ("event_type", "timestamp", "grouping")) for r in entries.event_summary(df, "j").collect()}
    assert got == {0: (None,) * 3, 1: ("a", "1.50", None), 2: ('{"a" : 1}', None, None), 3: ("x", None, None), 4: (None,) * 3, 5: ("null", None, None), 6: (None,) * 3, 7: (None, "[1, 2]", "s"), 8: (None,) * 3, 9: (None,) * 3}


IDS = [("[1 2]", None, "jsonInvalid", None), ("1 2]", None, "invalid", 2), ("+5", [5], None, None), ("-0", [0], None, None), ("9007199254740993", None, "overflow", 1), ("9007199254740991", [9007199254740991], None, None), ("[1.0, 2e1]", [1, 20], None, None), ("\n1,\t2 ", [1, 2], None, None), ("[]", None, "empty", None), (" , ", None, "empty", None), ("[1, -2, x]", None, "jsonInvalid", None), ("[1, -2, \"3\"]", None, "negative", 2), ("[\"3\"]", None, "invalid", 1), ("[1.5]", None, "invalid", 1), ("[null]", None, "invalid", 1), ("3 99999999999999999999999999999999999999999 -1", None, "overflow", 2), ("1 " * 40000, None, "tooLarge", None), ("{}", None, "invalid", 1)]


def test_token_ids(spark):
    got = column(spark, [a for a, *_ in IDS], vocabularies.token_ids)
    assert [(a[:30], g["ids"], g["error"], g["item"]) for (a, *_), g in zip(IDS, got)] == [(a[:30], *want) for a, *want in IDS]


@pytest.mark.parametrize("host,want", [(names.MODEL_HOSTS, "a/b"), (("models.example",), None)])
def test_model_ids(spark, host, want):
    assert column(spark, ["https://huggingface.co/a/b/tree/main"], lambda s: names.model_id(s, host)) == [want]


def test_clashing_columns(spark):
    """Columns that operators use inside are the caller's all the same."""
    df = spark.createDataFrame([(1, '{"type":"a"}', "own")], "id long, j string, x string")
    for name in ("fields", "odd", "own_text", "sure", "found", "bytes", "nth", "part", "_text", "_own"):
        own = df.withColumnRenamed("x", name)
        raw = own.withColumn("raw", F.col("j").cast("binary"))
        assert entries.event_summary(own, "j").first()[name] == "own"
        assert entries.entry_status(raw, "raw").first()[name] == "own"
        assert entries.event_samples(own, "id", "j").first()[name] == "own"
        assert entries.event_samples_by(own.withColumn("s", F.lit(1)), "s", "id", "j").first()[name] == "own"
