"""Ranked search, vector codes and word-run dedup against brute force, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard

pytest.importorskip("tessera.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import lexical_search, relative_lz, vector_codes  # noqa: E402

SCHEMA = "doc_id long, text string"
CLASH = ["id", "key", "marks", "spans", "hot", "n", "item", "part", "rank", "score", "cell", "payload", "vector", "code", "bare", "null", "value", "salt"]


def clashing(df):
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH))


def texts(seed=0):
    rng = random.Random(seed)
    words = ["the", "of", "and", "Ähn", "für", "élan", "ñu", "st.", "a,b", "x-y", "Été", "漢字"] + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, other = text(35), text(23)
    rows = [(i, text(rng.choice([1, 5, 19, 20, 21, 40, 150]))) for i in range(25)]
    rows += [(40 + i, f"{text(i)} {passage} {text(7)}") for i in range(9)]
    rows += [(60 + i, f"{other}\n{text(3)}\t{passage} {other}") for i in range(3)]
    rows += [(70, rows[6][1]), (71, rows[6][1]), (72, "ab " * 90), (73, "a b c " * 30), (74, "ab " * 50), (75, " ".join(f"u{k % 17}" for k in range(80)))]
    rows += [(80, None), (81, ""), (82, " \n\t "), (83, "x" * 4000 + " " + passage), (84, "\x0b\x0c" + other.replace(" ", "\r\n")), (85, text(30) + " nbsp joined " + other)]
    rows += [(None, passage), (None, None), (None, f"{other} {other}"), (41, rows[26][1]), (41, f"{passage} {passage}"), (41, None), (7, passage + " tail")]
    # One run of eight words in ever other surroundings.
    rows += [(100 + i, f"{text(15)} one two three four five six seven eight {text(15)}") for i in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(texts(), SCHEMA).repartition(3)).cache()


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def without_copies(rows):
    """(doc_id, n_words, n_removed, sha256) of each row, by comparing all windows."""
    at = collections.defaultdict(list)
    for k, (i, text) in enumerate(rows):
        w = words_of(text)
        for s in range(len(w) - 19):
            at[tuple(w[s : s + 20])].append((math.inf if i is None else i, k, s))
    gone = collections.defaultdict(set)
    for places in at.values():
        least = min(p[0] for p in places)
        first = {k: min(s for _, j, s in places if j == k) for _, k, _ in places}
        for i, k, s in places:
            if i > least or s > first[k]:
                gone[k].update(range(s, s + 20))
    out = []
    for k, (i, text) in enumerate(rows):
        w = words_of(text)
        out.append((i, len(w), len(gone[k]), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone[k])).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("change", [{}, {"OFTEN": 3}, {"BLOCK": 50, "PIECE": 13}, {"SEEN": 5, "CHUNK": 300, "SPANS_HELD": 10}, {"OFTEN": 4, "MOST_HOT": 2, "INNER": 1}])
def test_word_runs(docs, monkeypatch, change):
    """Whatever the sizes of chunks, pieces and blocks are, and whichever anchors count as hot. The module is shipped by value, so that workers have the changed sizes."""
    from pyspark import cloudpickle

    for name, value in change.items():
        monkeypatch.setattr(relative_lz, name, value)
    cloudpickle.register_pickle_by_value(relative_lz)
    try:
        got = relative_lz.without_copies(docs)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
        assert collections.Counter(map(tuple, got.collect())) == without_copies([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    finally:
        cloudpickle.unregister_pickle_by_value(relative_lz)


def test_word_runs_keep_text(spark):
    words = [f"w{k}" for k in range(30)]
    rows = relative_lz.without_copies(spark.createDataFrame([(1, " ".join(words)), (2, "new " + " ".join(words[5:27]) + "\nend")], SCHEMA), text_too=True).collect()
    assert {r["doc_id"]: bytes(r["kept_text"]).decode() for r in rows} == {1: " ".join(words), 2: "new end"}


def test_windows_across_factors():
    """A window that begins in a factor and ends behind it is found though neither factor has it."""
    a, b = list(range(40)), list(range(100, 140))
    source = [a, b, a[30:] + b[:10]]
    parsed = a[15:] + b[:30]
    word = np.array(sum(source, []) + parsed)
    size = np.array([*map(len, source), len(parsed)])
    p = relative_lz.Parser(np.arange(4), np.zeros(4, np.int32), size, np.zeros(4, np.int64), word)
    ids, _, start, end = p.spans()
    got = sorted((s, e) for i, s, e in zip(ids.tolist(), start.tolist(), end.tolist()) if i == 3)
    assert (0, 25) in got and (25, 55) in got
    assert (15, 35) in got


def test_hot_anchor_is_dealt_out(spark):
    """Stretches of one anchor in other surroundings each: no cell gets more than its share of them."""
    rng = random.Random(5)
    rows = [(k, 0, f"{' '.join(str(rng.random()) for _ in range(15))} one two three four five six seven eight {' '.join(str(rng.random()) for _ in range(15))}".encode()) for k in range(600)]
    begins, word, words = relative_lz.split_words(pa.array([r[2] for r in rows]))
    hashes = np.array([relative_lz.HASHES[w] for w in words], np.uint64)[word]
    anchors = relative_lz.stretches(begins, hashes)[4]
    counts = collections.Counter(anchors.tolist())
    hot, most = counts.most_common(1)[0]
    assert most >= 60
    share = lambda out: max(len(r["payload"]) for r in out.collect()) / sum(len(r["payload"]) for r in out.collect())
    marks = {r[0]: [] for r in rows}
    own, number = relative_lz.stretches(begins, hashes)[:2]
    for o, k, a in zip(own.tolist(), number.tolist(), anchors.tolist()):
        if a == hot:
            marks[o].append(k)
    full = spark.createDataFrame([(*r, zstandard.compress(np.array(marks[r[0]], "<u4").tobytes())) for r in rows if marks[r[0]]], "id long, key int, text binary, marks binary").coalesce(1)
    assert share(relative_lz.shipped(full, np.empty(0, np.uint64), 16)) == 1
    assert share(relative_lz.shipped(full, np.array([hot], np.uint64), 16)) < 0.05


def terms_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranked(rows, items, top=10):
    own = [(i, collections.Counter(terms_of(t))) for i, t in rows]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = collections.Counter(t for _, c, _ in own for t in c)
    out = collections.Counter()
    for item, text in items:
        asked = sorted(set(terms_of(text)))
        scored = []
        for i, c, n in own:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out.update((item, k + 1, None if null else i, -s) for k, (s, null, i) in enumerate(sorted(scored)[:top]))
    return out


@pytest.mark.parametrize("shard", [1, 700, 1 << 22])
def test_search(spark, docs, monkeypatch, shard):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    # (41, None) has no term; items: ties (copies of one text), unknown terms, capitals, null, blanks, a repeated identifier, a null one.
    items = [(1, rows[0][1]), (2, "THE für Été w3 W3"), (3, "nothing_here zzz"), (4, None), (5, " \t "), (6, "w1"), (6, "w2 w1"), (None, "ab one"), (7, "x" * 4000), (8, "st a b")]
    df = clashing(spark.createDataFrame(items, "item_id long, text string"))
    monkeypatch.setattr(lexical_search, "ITEMS", 4)
    idx = lexical_search.index(docs, shard=shard)
    got = lexical_search.search(idx, df)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert collections.Counter(map(tuple, got.collect())) == ranked(rows, items)
    assert idx.table.count() >= (40 if shard == 1 else 1)


def test_search_of_empty_tables(spark, docs):
    none, item = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(lexical_search.index(none), item).collect() == []
    assert lexical_search.search(lexical_search.index(docs), item.limit(0)).collect() == []
    assert relative_lz.without_copies(none).collect() == []


def test_a_task_of_the_search_holds_a_shard_at_a_time(spark, tmp_path, monkeypatch):
    """However large a task's part of the documents and of the index is: of what workers get, and of the index's row groups and their statistics."""
    spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat_ws(" ", F.lit("some words of text number"), F.col("id"), F.lit("")), 200).alias("text")).write.parquet(str(tmp_path / "docs"))
    docs, items = spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame([(k, f"number {k}") for k in range(0, 3000, 300)], "item_id long, text string")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    arrow = type(docs).mapInArrow

    def told(self, f, schema):
        def of(batches):
            def seen():
                for b in batches:
                    with open(said, "a") as out:
                        out.write(f"{b.num_rows} {b.nbytes}\n")
                    yield b

            yield from f(seen())

        return arrow(self, of, schema)

    said = str(tmp_path / "texts")
    monkeypatch.setattr(type(docs), "mapInArrow", told)
    idx = lexical_search.index(docs)
    batches = [tuple(map(int, line.split())) for line in open(said)]
    assert sum(n for n, _ in batches) == 2 * 3000 and max(size for _, size in batches) < 5 << 20
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in idx.table.inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert len(groups) == idx.table.count() > 3 and {g.num_rows for g in groups} == {1}
    assert all(g.column(k).statistics is None or not g.column(k).statistics.has_min_max for g in groups for k in range(g.num_columns))

    small = lexical_search.index(docs, shard=1 << 17)
    assert 100 < small.table.count() < 200
    said = str(tmp_path / "shards")
    monkeypatch.setattr("tessera.llm.common.BATCH", 1 << 17)
    got = lexical_search.search(small, items).collect()
    assert {(r["item_id"], r["doc_id"]) for r in got if r["rank"] == 1} == {(k, k) for k in range(0, 3000, 300)}
    batches = [tuple(map(int, line.split())) for line in open(said)]
    assert sum(n for n, _ in batches) == 2 * small.table.count() and max(size for _, size in batches) < 1 << 20
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("rows", [1, 7, 5000])
def test_shards_have_their_size_whatever_the_batches(rows):
    table = pa.table({"doc_id": range(5000), "text": pa.array([b"w" * (k % 40) for k in range(5000)])})
    got = list(lexical_search.shards(iter(table.to_batches(max_chunksize=rows)), 1, 4000))
    assert pa.Table.from_batches(got) == table
    assert all(4000 <= b.column(1).nbytes <= 5200 for b in got[:-1])


def test_best_keeps_ties():
    scores = np.array([5, 0, 7, 5, 5, 9, -1, 5])
    assert set(lexical_search.best(scores, 3).tolist()) == {0, 2, 3, 4, 5, 7}
    assert lexical_search.best(np.zeros(4, np.int64), 3).tolist() == []


def test_impacts_beyond_64_bits():
    assert lexical_search.times_by(np.array([3, 10**12]), 90 * 10**12, 10**13).tolist() == [3 * 90 * 10**12 // 10**13, 9 * 10**12]


def lloyd(rows):
    """The codes by full scans in Python's integers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 16))
    kept = [(i, v + [0] * (16 * width - len(v)), lab) for i, v, lab in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in first] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[near(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[p])]
    out, by = [], collections.Counter()
    for i, v, lab in kept:
        found = [near(part(v, p), books[p]) for p in range(16)]
        error = sum(d for d, _ in found)
        by[lab] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return collections.Counter((i, code, error, by[lab], sha) for i, code, error, lab in out)


@pytest.mark.parametrize("width,count", [(64, 400), (20, 150), (16, 30)])
def test_vector_codes(spark, width, count):
    rng = random.Random(width)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0]) if i % 3 else rng.gauss(0, 0.3) for _ in range(width)], rng.choice([0, 1, 1, None])) for i in range(count)]
    rows += [(rows[2][0], rows[5][1], 1), (rows[2][0], rows[2][1], 1), (None, rows[1][1], None), (9000, None, 1), (9001, [float("nan")] + [0.0] * (width - 1), 0), (9002, [None] * width, 0), (9003, [float("-inf")] * width, 2), (9004, [30.0] * (width - 3), 2), (9005, [], 5)]
    rng.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3))
    got = vector_codes.coded_vectors(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == lloyd(rows)


def test_vector_codes_of_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.coded_vectors(empty).collect() == []
    assert vector_codes.coded_vectors(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).collect() == []
    one = spark.createDataFrame([(5, [1.0] * 64, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r)[:4] for r in vector_codes.coded_vectors(one).collect()] == [(5, "00" * 16, 0, 0)]
    huge = spark.createDataFrame([(1, [1e300] * 64, 1), (2, [-1e300] * 64, 1), (3, [0.0] * 64, 2)], "vec_id long, embedding array<double>, label int")
    assert sorted(r["code"] for r in vector_codes.coded_vectors(huge).collect()) == ["00" * 16, "01" * 16, "02" * 16]


def test_bounds_agree_with_full_scans_and_spare_some():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (20, 4))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-9, 10, (3000, 4))).astype(np.int64)
    book = x[:20].copy()
    code, high, low, scans = vector_codes.coded(x, book, None, None)
    assert scans == 3000
    for _ in range(6):
        now = np.array([np.floor(x[code == k].mean(0)).astype(np.int64) if (code == k).any() else e for k, e in enumerate(book)])
        code, high, low, scans = vector_codes.coded(x, now, (code, high, low), vector_codes.moves(book, now))
        full, least, second = vector_codes.nearest(x, now)
        assert (code == full).all() and (high.astype(float) ** 2 >= least).all() and (np.maximum(low, 0).astype(float) ** 2 <= second).all()
        book = now
    assert scans < 1500


def test_ties_go_to_the_lower_index():
    x, book = np.array([[0, 0]]), np.array([[3, 0], [0, 3], [-3, 0]])
    assert vector_codes.coded(x, book, None, None)[0].tolist() == [0]
    # The bounds touch: they settle nothing, and the full scan finds the lower index.
    state = np.array([2]), vector_codes.up(np.array([3.0])), vector_codes.down(np.array([3.0]))
    assert vector_codes.coded(x, book, state, vector_codes.moves(book, book))[0].tolist() == [0]
