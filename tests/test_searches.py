"""Searches in steps, revisions that cancel the ones before, matches in rendered text with their source, files by exact ranges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import entries, markup, names, searches
from tessera.sources import model_files


def test_steps_end_where_a_whole_search_does(spark, monkeypatch):
    rows = [(k, (f'{{"a":"{"x" * (k % 50)}{k % 7}"}}' if k % 11 else "broken").encode()) for k in range(700)]
    df = spark.createDataFrame(rows, "id long, raw binary").repartition(5).cache()
    monkeypatch.setattr(searches, "STEP_BYTES", 3000)
    s = searches.Search(df, "id", "raw", "3")
    steps = 0
    while s.advance():
        steps += 1
    assert steps > 700 // 200
    want = entries.filtered_entries(df, "raw", "3")
    assert s.matches == sorted(r["id"] for r in want.where("outcome = 'matched'").collect())
    assert s.counts == {r["outcome"]: r["count"] for r in want.groupBy("outcome").count().collect()}
    assert s.page(5, 3) == s.matches[5:8]
    with pytest.raises(ValueError):
        s.page(0, 201)
    few = searches.Search(df, "id", "raw", "3", most=4)
    while few.advance():
        pass
    assert few.matches == s.matches[:4]


def test_a_later_revision_cancels(spark):
    own = searches.Revisions(spark)

    @F.udf("long")
    def slow(k):
        time.sleep(0.5)
        return k

    first = own.begin(lambda: spark.range(0, 400, 1, 4).select(slow("id").alias("k")).where("k < 0"))
    time.sleep(3)
    began = time.time()
    second = own.begin(lambda: spark.range(100).where("id % 10 = 3"))
    assert [r["id"] for r in second.result(60)] == [3 + 10 * k for k in range(10)]
    with pytest.raises(searches.Stale):
        first.result(30)
    first.thread.join(30)
    assert not first.thread.is_alive() and time.time() - began < 30  # 400 rows at half a second on four cores are 50 seconds
    assert first.rows is None and first.error is not None
    own.cancel()
    with pytest.raises(searches.Stale):
        second.result()
    assert own.begin(lambda: spark.range(3)).result(60)


def rendered(spark, s):
    return spark.createDataFrame([(s,)], "s string").select(markup.rendered_text("s")).first()[0]


def test_rendered_matches(spark):
    rng = random.Random(1)
    parts = ["a", "b", " ", "\n", "<b>", "</b>", "<p>", "</p>", "&amp;", "&#98;", "&eacute;", "<br>", "é", "<script>ab</script>", "<!-- ab -->", "&nbsp;"]
    texts = ["".join(rng.choice(parts) for _ in range(25)) for _ in range(120)] + ["<p>x a&amp;b</p>", "", "<p>a</p><p>b</p>"]
    for query in ("ab", "a b", "&", "éb", "a"):
        df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
        got = {r["k"]: r["m"] for r in df.select("k", markup.rendered_matches(F.col("s"), query).alias("m")).collect()}
        shown = {r["k"]: r["t"] for r in df.select("k", markup.rendered_text("s").alias("t")).collect()}
        for k, s in enumerate(texts):
            assert len(got[k]) == shown[k].replace("\n", " ").count(query), (query, s)
            for m in got[k]:
                piece = s[m["source_start"] : m["source_end"]]
                assert " ".join(rendered_once(piece).split()) == query, (query, s, piece)


def rendered_once(piece):
    p = markup.Text()
    p.feed(piece)
    p.close()
    return " ".join("".join(p.out).split())


def test_files_by_exact_ranges(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.json", b"0123456789"), ("b.txt", b"abc"), ("odd name/ü #1.txt", b"zz")], "path string, content binary")
    assert model_files.write_files(rows, str(tmp_path / "m")) == 3
    listed = model_files.manifest(spark, str(tmp_path / "m"))
    assert {(r["path"], r["size"]) for r in listed.select("path", "size").collect()} >= {("a/x.json", 10), ("b.txt", 3)}
    with pytest.raises(ValueError):
        model_files.manifest(spark, str(tmp_path / "m"), most=2)
    file = {r["path"]: r["file"] for r in listed.collect()}
    wanted = [("a/x.json", 10, 2, 5), ("a/x.json", 10, 0, 10), ("a/x.json", 10, 5, 11), ("b.txt", 4, 0, 2), ("b.txt", 3, 3, 3)]
    df = spark.createDataFrame([(p, file[p], size, a, b) for p, size, a, b in wanted], "path string, file string, size long, start long, stop long")
    got = [(r["path"], r["content"] and bytes(r["content"]), r["error"]) for r in model_files.ranges(df.coalesce(1)).collect()]
    assert got == [("a/x.json", b"234", None), ("a/x.json", b"0123456789", None), ("a/x.json", None, "outside"), ("b.txt", None, "changed"), ("b.txt", b"", None)]
    assert [r["error"] for r in model_files.ranges(df.limit(1), most=2).collect()] == ["tooLarge"]


def test_totals_of_files(spark):
    df = spark.createDataFrame([("f", "F32", 4, 16), ("f", "F16", 2, 4), ("f", "F32", 1, 4), ("g", None, None, None)], "path string, dtype string, parameters long, bytes long")
    assert [tuple(r) for r in names.file_totals(df).collect()] == [("f", 3, 7, 24, "F16 × 1 · F32 × 2")]
