"""Files that are one JSON array, at several sizes of splits, against Python's parser."""

import json
import random

import pytest

from tessera.sources import json_arrays, sinks

RNG = random.Random(3)


def value(depth=0):
    kind = RNG.randrange(7 if depth < 4 else 4)
    if kind == 0:
        return RNG.choice([None, True, -1.5e3, 12])
    if kind < 4:
        return RNG.choice(["a,b", 'q"uo,te', "back\\sl,ash\\", "[{", "]},", "é漢😀,", "", "\\\\\",", "plain"])
    return [value(depth + 1) for _ in range(RNG.randrange(4))] if kind < 5 else {f"k,{k}": value(depth + 1) for k in range(RNG.randrange(4))}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("arrays")
    texts = {
        "flat.json": json.dumps([value() for _ in range(400)]),
        "pretty.json": json.dumps([value() for _ in range(150)], indent=2, ensure_ascii=False),
        "deep.json": "[" + "[" * 3000 + "1,2" + "]" * 3000 + ", 5]",
        "long.json": json.dumps(["x" * 3000, ["y,z" * 900, 1], "w"]),
        "one.json": "[7]",
        "bom.json": "﻿ [ 1 , 2 ]\n",
        "empty.json": "[ \n ]",
        "marked_empty.json": "﻿[]",
        "object.json": '{"a": [1, 2, 3]}',
        "blank.json": " \n",
        "bad_item.json": '[1, nope, "x"]',
        "hole.json": "[1,,2]",
        "tail.json": "[1,2] 3",
        "open.json": '[1, {"a": 2}',
        "curly.json": "[1, 2}",
        "comma.json": "[1, 2,]",
    }
    for name, text in texts.items():
        (d / name).write_text(text, encoding="utf-8")
    return d, texts


def parsed(text):
    try:
        return json.loads(text.removeprefix("﻿"))
    except ValueError:
        return None


@pytest.mark.parametrize("size", ["97b", "1k", "64m"])
def test_items(spark, folder, size):
    d, texts = folder
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    open_cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        if size == "97b":
            assert json_arrays.lines(spark, f"{d}/flat.json").rdd.getNumPartitions() > 20
        items = {}
        for r in json_arrays.array_items(spark, str(d)).collect():
            items.setdefault(r["file"].rsplit("/", 1)[1], {})[r["ordinal"]] = bytes(r["raw"]).decode()
        counts = {r["file"].rsplit("/", 1)[1]: (r["root"], r["closed"], r["n_items"]) for r in json_arrays.array_counts(spark, str(d)).collect()}
        valid = {r["file"].rsplit("/", 1)[1]: (r["n_items"], r["valid"]) for r in json_arrays.array_documents(spark, str(d)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", open_cost)
    for name, text in texts.items():
        want = parsed(text) if name != "deep.json" else [None, 5]
        if isinstance(want, list):
            got = items.get(name, {})
            assert sorted(got) == list(range(len(want))), name
            if name != "deep.json":
                assert [json.loads(got[k]) for k in range(len(want))] == want, name
            assert counts[name] == ("[", True, len(want)), name
            assert valid[name] == (len(want), True), name
        elif name in ("object.json", "blank.json"):
            assert name not in items and name not in valid and counts[name] == ("{" if name == "object.json" else None, True, None)
        else:
            assert not valid[name][1], name
    assert items["deep.json"][0] == "[" * 3000 + "1,2" + "]" * 3000
    assert counts["open.json"][1] is False


def test_written_arrays(spark, tmp_path):
    rows = spark.range(10).selectExpr("concat('{\"i\":', id, '}') AS j").repartition(4)
    sinks.write_json_arrays(rows, "j", str(tmp_path / "a"))
    files = list((tmp_path / "a").glob("part-*"))
    assert sorted(x["i"] for f in files for x in json.loads(f.read_text())) == list(range(10))
    sinks.write_json_arrays(rows.where("length(j) > 99"), "j", str(tmp_path / "none"))
    assert all(json.loads(f.read_text()) == [] for f in (tmp_path / "none").glob("part-*"))
