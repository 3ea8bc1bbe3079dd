import json

from pyspark.sql import functions as F

from tessera.operators import entries, templates
from tessera.sources import sinks


def test_catalogue(spark):
    rows = [(1, '"{{x}}"', None), (2, '{"b":"B","a":" "}', None), (3, '[{"name":"default","template":"D"},{"name":"t","template":"T"}]', "J"), (4, "[{\"name\":\"\",\"template\":\"D\"}]", None), (5, "7", None), (6, None, " ")]
    df = spark.createDataFrame(rows, "key int, t string, j string")
    cat = templates.catalogue(df, "key", "t", "j")
    by = {}
    for key, _, own, *_, usable, error in cat.orderBy("place").collect():
        by.setdefault(key, []).append((own, usable, error))
    assert [x[0] for x in by[3]] == ["jinjaFile:default", "tokenizerConfig:default", "tokenizerConfig:t"]
    assert [x[:2] for x in by[2]] == [("tokenizerConfig:a", False), ("tokenizerConfig:b", True)]
    assert by[4][0][2] and by[5][0][2] and by[6] == [("jinjaFile:default", False, None)]


def test_active(spark):
    df = spark.createDataFrame([(1, '[{"name":"a","template":"A"},{"name":"b","template":" "},{"name":"c","template":"C"},{"name":"default","template":"D"}]')], "key int, t string")
    cat = templates.catalogue(df, "key", "t")
    pick = lambda r=None: templates.active(cat, "key", r).first()["id"]
    assert pick() == "tokenizerConfig:default"
    assert pick("tokenizerConfig:b") == "tokenizerConfig:c"
    assert pick("tokenizerConfig:a") == "tokenizerConfig:a"
    assert pick("other") == "tokenizerConfig:default"


def test_variables(spark):
    df = spark.createDataFrame([(1, "{% if enable_thinking %}", '{"bos_token":"<s>","pad_token":null}')], "key int, t string, c string")
    assert [(r["name"], r.kind, r.value) for r in templates.initial_variables(df, "key", "t", "c").orderBy("place").collect()] == [("bos_token", "string", "<s>"), ("pad_token", "null", None), ("enable_thinking", "boolean", "true")]
    rows = [(1, 0, " ", "string", "x"), (1, 1, "tools", "string", "x"), (1, 2, "a", "integer", "1.5"), (1, 3, "a", "string", ""), (1, 4, "b", "json", "{"), (1, 5, "c", "decimal", "1e3")]
    bad = templates.variable_errors(spark.createDataFrame(rows, "key int, place int, name string, kind string, value string"), "key")
    assert {(r.place, r.error) for r in bad.collect()} == {(0, "name required"), (1, "reserved"), (2, "integer required"), (3, "repeated"), (4, "json required")}


def test_spans_and_folds(spark):
    s = "a{# c #}{{ x if 'y' }}"
    df = spark.createDataFrame([(1, s)], "key int, s string")
    got = [(s[x.start : x.end], x.kind) for x in df.select(templates.jinja_spans("s")).first()[0]]
    assert got == [("{#", "delimiter"), (" c ", "comment"), ("#}{{", "delimiter"), (" x ", "expression"), ("if", "keyword"), (" ", "expression"), ("'y'", "string"), (" ", "expression"), ("}}", "delimiter")]
    code = "def f():\n    if x:\n        y\n\n    z\nw\nclass A:\n"
    py = spark.createDataFrame([(1, code)], "key int, s string")
    assert {(r.start_line, r.end_line) for r in templates.indent_folds(py, "key", "s", templates.PYTHON_HEADER).collect()} == {(1, 5), (2, 3)}
    j = spark.createDataFrame([('{\n"a": [\n1]\n}',), ("{\n",)], "s string")
    assert [[tuple(x) for x in r[0]] for r in j.select(templates.json_folds("s")).collect()] == [[(2, 3), (1, 4)], []]
    n = spark.createDataFrame([("-0",), ("0.10",), ("1e4",), ("12345678901234567890",)], "s string")
    assert [r[0] for r in n.select(templates.number_text(F.col("s"))).collect()] == ["0", "0.1", "10000", "12345678901234567890"]


def test_nested_scopes(spark):
    inner = json.dumps({"b": json.dumps([1])})
    df = spark.createDataFrame([(1, json.dumps({"a": inner, "c": "[x"}))], "key int, s string")
    assert {(r.depth, r.path, r.text) for r in entries.nested_scopes(df, "key", "s").collect()} == {(1, "$ → $.a", inner), (2, "$ → $.a → $.b", "[1]")}


def test_text_chunks(spark):
    df = spark.createDataFrame([("aé😀b",)], "s string")
    assert [tuple(r[0]) for r in (df.select(entries.text_chunk(F.col("s"), *x)).first() for x in ((0, 2), (1, 5), (3, 100)))] == [("a", 1), ("é", 3), ("😀b", None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x: y", [1, 2]), (2, None, None)], "a int, b string, c array<int>").coalesce(1)
    sinks.write_json(df, str(tmp_path / "j"))
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_yaml(df, str(tmp_path / "y"))
    read = lambda d: next((tmp_path / d).glob("part-*")).read_text()
    assert [json.loads(x) for x in read("j").splitlines()] == [{"a": 1, "b": "x: y", "c": [1, 2]}, {"a": 2, "b": None, "c": None}]
    assert read("c").splitlines()[0] == "a,b,c"
    assert read("y").splitlines()[:3] == ["- a: 1", '  b: "x: y"', "  c: [1,2]"]
    assert [r.line for r in sinks.report(df.select("a"), "T").collect()] == ["T", "=", "a: 1", "a: 2"]
