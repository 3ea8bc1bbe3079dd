"""Structural joins, sparse indexes, byte search and token roles against brute force."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import entries, structure, vocabularies
from tessera.sources import jsonl_index


@pytest.mark.parametrize("width", [7, 100, 1 << 16])
def test_contained(spark, width):
    rng = random.Random(2)
    value = lambda d: rng.choice([1, "a", None]) if d > 4 or rng.random() < 0.3 else ({f"k{k}": value(d + 1) for k in range(rng.randrange(4))} if rng.random() < 0.5 else [value(d + 1) for _ in range(rng.randrange(4))])
    docs = [(k, json.dumps(value(0))) for k in range(40)] + [(100, "[" * 300 + "1" + "]" * 300), (101, None), (102, "{")]
    nodes = entries.json_nodes(spark.createDataFrame(docs, "doc long, j string"), "doc", "j").cache()
    got = structure.contained(nodes, "doc", F.col("kind").isin("Object", "Array"), F.col("kind") != "Object", width=width)
    pairs = sorted((r["doc"], r["ancestor"], r["descendant"], r["ancestor_shown"], r["descendant_shown"]) for r in got.collect())
    rows = nodes.collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc"], []).append(r)
    want = [(d, a["node_id"], b["node_id"], a["path"], b["path"]) for d, own in by.items() for a in own if a["kind"] in ("Object", "Array") for b in own if b["kind"] != "Object" and a["start"] < b["start"] and b["end"] <= a["end"]]
    assert pairs == sorted(want) and len(pairs) > 300


def lines_of(name, n, rng):
    return b"".join(rng.choice([b'{"i":%d,"f":"%s"}' % (k, name), b"[%d]" % k, b"x" * rng.randrange(300)]) + rng.choice([b"\n", b"\r\n", b"\n \t\n", b"\n\n"]) for k in range(n))


@pytest.mark.parametrize("size,most", [("300b", 10_000), ("1k", 20), ("64m", 3)])
def test_sparse_index(spark, tmp_path, size, most):
    rng = random.Random(7)
    texts = {"a.jsonl": lines_of(b"a", 150, rng), "b.jsonl": lines_of(b"b", 90, rng) + b"last\r", "empty.jsonl": b"", "blank.jsonl": b"\n \n", "one.jsonl": b"only"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t)
    want = {}
    for name, t in texts.items():
        lines = t.split(b"\n")
        full = [(k + 1, x.removesuffix(b"\r") if k + 1 < len(lines) else x) for k, x in enumerate(lines) if x.strip(b" \t\r")]
        want |= {(name, k): own for k, own in enumerate(full)}
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        index = jsonl_index.build(spark, str(tmp_path), most)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert index.entries == len(want) and index.stride == jsonl_index.stride_of(len(want), most)
    assert {r["ordinal"] % index.stride for r in index.checkpoints.collect()} == {0}
    names = {r["file"].rsplit("/", 1)[1]: r["file"] for r in index.files.collect()}
    wanted = spark.createDataFrame([(names[n], k) for n, k in want] + [(names["a.jsonl"], 10_000), (names["a.jsonl"], -1)], "file string, ordinal long")
    got = {(r["file"].rsplit("/", 1)[1], r["ordinal"]): (r["source_line"], bytes(r["raw"])) for r in jsonl_index.entries_at(index, wanted).collect()}
    assert got == want
    assert [r["ordinal"] for r in jsonl_index.page(index, names["a.jsonl"], 100, 30).collect()] == list(range(101, 131))


def test_an_entry_reads_a_stride(spark, tmp_path, monkeypatch):
    (tmp_path / "big.jsonl").write_bytes(b"".join(b'{"i":%06d}\n' % k for k in range(200_000)))  # 13 bytes a line, 2.6 MB
    index = jsonl_index.build(spark, str(tmp_path), 100)
    assert index.stride == 2048
    file = index.files.first()["file"]
    r = jsonl_index.entries_at(index, spark.createDataFrame([(file, 150_001)], "file string, ordinal long")).first()
    assert bytes(r["raw"]) == b'{"i":150001}' and r["source_line"] == 150_002
    assert r["bytes_read"] <= 256 << 10
    (tmp_path / "big.jsonl").write_bytes(b"{}\n")
    r = jsonl_index.entries_at(index, spark.createDataFrame([(file, 150_001)], "file string, ordinal long")).first()
    assert r["raw"] is None and "changed" in r["error"]


@pytest.mark.parametrize("width", [1, 3, 8, 64, 1 << 18])
@pytest.mark.parametrize("query", ["aa", "aba", "é", "\\E.", "a\nb", "aabaa", "x"])
def test_byte_matches(spark, query, width):
    rng = random.Random(len(query))
    texts = ["".join(rng.choice(["a", "b", "aa", "é", "\\E.", "\n", query]) for _ in range(rng.randrange(30))) for _ in range(12)] + ["a" * 50, "aba" * 20, "aabaabaa" * 5 + "a", "", query]
    if width < 8:
        texts = texts[:6] + texts[-5:]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "k long, t string")
    got = sorted((r["k"], r["start"]) for r in text.byte_matches(df, "k", "t", query, width).collect())
    assert got == sorted((k, m.start()) for k, t in enumerate(texts) for m in re.finditer(re.escape(query.encode()), t.encode()))


def roles(rendered, bodies, segments):
    spans, at = [], 0
    for role, body in bodies:
        k = rendered.find(body, at) if body else -1
        if k >= 0:
            spans.append((k, k + len(body), role))
            at = k + len(body)
    out, at = [], 0
    for s in segments:
        out.append(next((r for a, b, r in spans if a <= at and at + len(s) <= b), "template"))
        at += len(s)
    return out


def test_token_roles(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        bodies = [(rng.choice(["user", "assistant"]), "".join(rng.choice("ab ") for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(4))]
        rendered = "".join(f"<{b}>" if rng.random() < 0.8 else "<gone>" for _, b in bodies)
        cuts = sorted({0, len(rendered), *(rng.randrange(len(rendered) + 1) for _ in range(rng.randrange(9)))})
        segments = [rendered[a:b] for a, b in zip(cuts, cuts[1:])]
        rows.append((k % 50, rendered, bodies, segments, "Exact" if k % 5 else "Decoded only"))
    df = spark.createDataFrame(rows, "k long, text string, bodies array<struct<role string, body string>>, segments array<string>, mapping string")
    got = sorted((r["k"], r["position"], r["segment"], r["role"] or "") for r in vocabularies.attributed(df, "k").collect())
    want = [(k, i, s, r if mapping == "Exact" else "") for k, t, b, segs, mapping in rows for i, (s, r) in enumerate(zip(segs, roles(t, b, segs)))]
    assert got == sorted(want)


def test_index_of_many_splits(spark, tmp_path, monkeypatch):
    """Where splits are too many to give each task all of them, lines are dealt to their splits' tasks, in order."""
    monkeypatch.setattr(jsonl_index, "BROADCAST_SPLITS", 0)
    (tmp_path / "x.jsonl").write_bytes(b"".join(b'{"i":%d}\n' % k for k in range(5000)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        index = jsonl_index.build(spark, str(tmp_path), 50)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    rows = {r["ordinal"]: (r["source_line"], r["byte"]) for r in index.checkpoints.collect()}
    at = [0]
    for k in range(5000):
        at.append(at[-1] + len(b'{"i":%d}\n' % k))
    assert rows == {k: (k + 1, at[k]) for k in range(0, 5000, 128)}
