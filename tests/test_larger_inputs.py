"""What larger inputs bring: many entries of one stride, equal rows, large files and texts."""

from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, near_dedup, packing, quality
from tessera.operators import entries, markup
from tessera.plans import catalog, derived, repositories  # noqa: F401
from tessera.sources import jsonl_index, model_files

SMALL = "/root/testdata/sf0.001"


def same(spark, name, d):
    """Whether a query's rows over the tables of a folder are those of its SQL; gives the rows."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in d.iterdir():
        con.execute(f"CREATE VIEW {f.name.removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    df = catalog.QUERIES[name](spark, str(d))
    rows = sorted(tuple(map(str, r)) for r in df.collect())
    got = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in got.description]
    assert rows == sorted(tuple(str(r[names.index(c)]) for c in df.columns) for r in got.fetchall())
    return rows


@pytest.mark.parametrize("name", ["entry_lookups", "jsonl_entries"])
def test_events_that_are_equal_but_for_their_id(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT e.* REPLACE (z * 2 AS event_id) FROM (SELECT * FROM '{SMALL}/events.parquet' LIMIT 1) e, (SELECT unnest(range(300)) AS z)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert len(same(spark, name, tmp_path)) == (4 if name == "entry_lookups" else 300)


def test_a_stride_is_read_once_for_all_its_entries(spark, tmp_path):
    data = b"".join(b'{"i":%06d}\n' % k for k in range(100_000)) + b" \n[1]\r"

    class Source:
        read = 0

        def read_at(self, n, at):
            self.read += n
            return data[at : at + n]

    source = Source()
    found = list(jsonl_index.entries_from(source, 13, len(data)))
    assert source.read == len(data) - 13 and len(found) == 100_000
    assert found[0][:2] == (b'{"i":000001}', 0) and found[-1][:2] == (b"[1]\r", 100_000)
    (tmp_path / "a.jsonl").write_bytes(data)
    (tmp_path / "empty.jsonl").write_bytes(b"")
    index = jsonl_index.build(spark, str(tmp_path), 64)
    assert sorted((r["n"], r["lines"]) for r in index.files.collect()) in ([(100_001, 100_002)], [(0, 0), (100_001, 100_002)])
    file = index.checkpoints.first()["file"]
    wanted = spark.createDataFrame([(file, k) for k in [*range(4096, 6144), 5000, 100_000, 100_001]], "file string, ordinal long")
    got = sorted((r["ordinal"], bytes(r["raw"]), r["source_line"]) for r in jsonl_index.entries_at(index, wanted).collect())
    assert got == sorted([(k, b'{"i":%06d}' % k, k + 1) for k in [*range(4096, 6144), 5000]] + [(100_000, b"[1]\r", 100_002)])


def test_a_brand_of_more_parts_than_one_importance_matrix_holds(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT p.* REPLACE (z AS p_partkey, (z % 7)::INTEGER AS p_size) FROM (SELECT * FROM '{SMALL}/part.parquet' LIMIT 1) p, (SELECT unnest(range(110000)) AS z)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    assert len(same(spark, "importance_matrices", tmp_path)) == 2 * 110_000 + 5


@pytest.mark.parametrize("name", ["safetensors_files", "safetensors_totals", "gguf_tensors", "gguf_overviews"])
def test_model_files_of_a_brand_in_many_ranges_of_keys(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT * REPLACE (p_partkey * 7919 AS p_partkey) FROM '{SMALL}/part.parquet') TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    assert repositories.parts_by_brand(spark, str(tmp_path)).count() > 100
    assert same(spark, name, tmp_path)


def test_model_files_are_made_once(spark):
    plan = lambda name: catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # Two passes, each over the whole and the damaged files, before.
    assert plan("importance_matrices").count("MapInPandas") == 0
    # One join places a file in its brand; tensors aren't joined to their files.
    assert plan("gguf_tensors").count("Join ") == 1
    for name in ("gguf_tensors", "safetensors_files"):
        assert "lambdafunction(concat" not in plan(name)


def test_few_values_have_the_range_of_many(monkeypatch):
    rng = np.random.default_rng(7)
    for n in range(1, model_files.FEW_VALUES):
        for scale in (1, 1e-30, 1e30):
            data = (rng.standard_normal(n) * scale ** rng.random(n)).astype("<f4").tobytes()
            few = model_files.value_range(data, n)
            with monkeypatch.context() as m:
                m.setattr(model_files, "FEW_VALUES", 0)
                assert model_files.value_range(data, n) == few
    for odd in (float("nan"), float("inf")):
        for n in (1, 3, 12):
            with pytest.raises(ValueError, match="values"):
                model_files.value_range(np.array([odd] * n, "<f4").tobytes(), n)


def test_nodes_are_given_away_in_bounded_frames():
    seen = []

    class Given:
        def mapInPandas(self, of, schema):
            seen.extend(len(f) for f in of(iter([pd.DataFrame({"k": range(5000), "t": ['{"a":[1,2,3]}'] * 5000})])))

        def select(self, *_):
            return self

        dtypes = [("k", "bigint")]

    entries.json_nodes(Given(), "k", "t")
    assert sum(seen) == 25_000 and max(seen) < entries.NODES_HELD + 5


def test_texts_are_taken_by_slices():
    live = [0]

    def of(s):
        live[0] += 1
        return s

    batches = [pa.array(["é" * 1000] * 3000 + [None]), pa.array([], pa.string())]
    got = [b.to_pylist() for b in markup.by_slices(iter(batches), of, pa.string())]
    assert got == [["é" * 1000] * 3000 + [None], []] and live[0] == 3001


def test_parts_of_a_card_are_worked_out_once(spark):
    cards = ["```\n<b>a</b>\n```\n<i>b</i>\n", "x<br>\n```\n<b>\n```\n<!-- c -->y\n```\n<u>", "", None, "---\na: 1\n---\n<p>z</p>"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(cards)], "k int, s string").select("k", markup.card_body(F.col("s")).alias("b"))
    assert [r["b"] for r in df.orderBy("k").collect()] == ["```\n<b>a</b>\n```\nb\n", "x\n\n```\n<b>\n```\ny\n```\n<u>", "", None, "z"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_texts_reach_the_packing_workers_in_small_batches(spark, monkeypatch):
    names = [c.split()[0] for c in packing.PIECES.split(", ")]

    def sizes(docs, *_):
        def of(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (b.num_rows, 0, 1, 0, b.column(1).nbytes, 0, 0)], names=names)

        return docs.mapInArrow(of, packing.PIECES)

    monkeypatch.setattr(packing, "pieces", sizes)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    got = packing.pack(spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 5000).alias("text"))).collect()
    assert sum(r["doc_id"] for r in got) == 3000
    assert max(r["doc_tokens"] for r in got) < 5 << 20
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("operator", [quality.keep_good, near_dedup.drop_near])
def test_texts_reach_the_workers_of_the_stages_in_small_batches(spark, tmp_path, monkeypatch, operator):
    spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat_ws(" ", F.lit("some words of text number"), F.col("id"), F.lit("")), 400).alias("text")).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    said = str(tmp_path / "said")

    def told(f, size):
        def of(batches):
            def seen():
                for b in batches:
                    with open(said, "a") as out:
                        out.write(f"{size(b)}\n")
                    yield b

            yield from f(seen())

        return of

    frame, udf = type(docs), F.pandas_udf
    arrow = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, schema: arrow(self, told(f, lambda b: b.nbytes), schema))

    def of_schema(schema):
        def of(f):
            def g(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
                yield from told(f, lambda s: int(s.str.len().sum()))(texts)

            return udf(g, schema)

        return of

    monkeypatch.setattr(quality.F, "pandas_udf", of_schema)
    operator(docs).collect()
    sizes = [int(x) for x in open(said)]
    assert sum(sizes) > 15_000_000 and max(sizes) < 5 << 20
    assert spark.conf.get(key) == before


def test_a_worker_keeps_the_vocabularies_of_one_operator():
    first, second = {"a": 1}, {"b": 2}
    common.alone(first)
    common.alone(second)
    assert not first and second == {"b": 2}


def test_operators_without_a_vocabulary_forget_the_one_before():
    first = {"a": 1}
    common.alone(first)
    list(common.chunks(iter([pa.RecordBatch.from_pydict({"text": ["a"]})])))
    assert not first


def test_tables_of_the_driver_start_no_python_workers(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    runs = packing.in_runs(docs, F.lit(None).cast("boolean"), 100)
    assert "ExistingRDD" not in runs._jdf.queryExecution().executedPlan().toString()
    schema = pa.schema([("a", pa.string()), ("b", pa.list_(pa.float64()))])
    got = common.small_table(spark, [("x", [0.5]), (None, [])], schema)
    assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("x", [0.5]), (None, [])]
    assert common.small_table(spark, [], schema).dtypes == got.dtypes and not common.small_table(spark, [], schema).collect()


def test_queries_reach_every_branch_of_their_operator(spark):
    rows = lambda name: catalog.QUERIES[name](spark, SMALL)
    values = lambda name, column: {r[0] for r in rows(name).select(column).distinct().collect()}
    assert values("conversation_candidates", "label") == {"messages", "conversation", "messages#2", "conversations"}
    assert values("anthropic_blocks", "category") == {"header", "role", "content", "text", "thinking", "redactedThinking", "toolUse", "toolResult", "unknown"}
    assert values("importance_matrices", "form") == {"full", "short", "nan", "twice", "none", "cut", "rest"}
    assert values("template_contexts", "name") == {"messages", "add_generation_prompt", "tools", "n", "s", "b", "z"}
    assert {"repeated", "said", "empty", "zero", "broken"} <= set(rows("pretty_sorted").columns)
