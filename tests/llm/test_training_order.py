"""The order of training is still there after packing."""

import collections

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import common, mixing, packing  # noqa: E402


def shares(sources, tokens, parts=5):
    """The share of each source's tokens in each fifth of the tokens."""
    at = np.minimum((np.cumsum(tokens) - 1) * parts // sum(tokens), parts - 1)
    return np.array([[sum(n for s, n, k in zip(sources, tokens, at, strict=True) if (s, k) == (own, part)) for own in ("s0", "s1", "s2")] for part in range(parts)]) / (sum(tokens) / parts)


def test_sequences_follow_the_schedules(spark, monkeypatch):
    rows = [(i, " ".join([f"word{i}"] * (5 + i % 7)), "en", f"s{i % 3}", 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    source = {r[0]: r[3] for r in rows}
    uses = sorted((p, r.doc_id, r.size) for r in mixing.mixed_rows(docs).collect() for p in r.positions)
    monkeypatch.setattr(packing.pack, "__defaults__", tuple(30 if d == packing.BUCKET_DOCS else 128 if d == 4096 else d for d in packing.pack.__defaults__))
    ordered = common.written(corpus_pipeline.mix(spark, docs, ""))
    got = corpus_pipeline.pack(spark, ordered, "").collect()
    assert collections.Counter(r.doc_id for r in got if r.start == 0) == collections.Counter(i for _, i, _ in uses)
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    mine = shares([source[r.doc_id] for r in got], [r.length for r in got])
    assert np.abs(mine - shares([source[i] for _, i, _ in uses], [n for *_, n in uses])).max() < 0.06
    assert mine[0, 0] > 1.3 * mine[-1, 0] and mine[-1, 1] > 1.3 * mine[0, 1]  # s0 fades out, s1 comes in
    # Both uses of a document lie apart.
    runs = collections.defaultdict(set)
    for r in got:
        runs[r.doc_id].add(r.sequence_id >> 32)
    twice = [i for i, n in collections.Counter(i for _, i, _ in uses).items() if n == 2]
    assert twice and all(len(runs[i]) == 2 for i in twice)


def test_order_of_rows_without_files(spark):
    rows = [(i, f"word{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.sequence_id >> 32 for r in packing.pack(docs, bucket_docs=20, ordered=True).collect()}
    assert got == {i: i // 20 for i in range(200)}
