"""The pipeline's stages against brute force, each on what the one before kept."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessera.llm import common, mixing, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["the", "ing", "er", "on", "at", "st", "re"]) for _ in range(rng.randrange(1, 4)))
    base = [" ".join(word() for _ in range(rng.choice([12, 40, 120, 300]))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].replace(" ", "\n", 2)) for i in range(6)]
    for i in range(10, 18):
        w = base[i].split(" ")
        w[3] = "other"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "too few words here"), (303, "again and again " * 30), (304, " ".join(word() + "***$$$" for _ in range(60)))]
    rng.shuffle(rows)
    return [(i, t, "en", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in rows]


def shingles(t):
    w = t.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    rows = corpus()
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "sf/documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "sf/documents.parquet"))
    own = {r["doc_id"]: tuple(r) for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, str(tmp_path / "sf")))
        steps[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
            assert all(own[r["doc_id"]] == tuple(r) for r in docs.collect())
    ids = lambda name: [r["doc_id"] for r in steps[name].collect()]
    verdict = {r.doc_id: r for r in quality.verdicts(spark.read.parquet(str(tmp_path / "sf/documents.parquet"))).collect()}
    assert sorted(ids("quality rules")) == sorted(i for i, r in verdict.items() if r.kept)
    assert not {300, 301, 302, 303, 304} & set(ids("quality rules")) and set(range(40)) <= set(ids("quality rules"))
    first = {}
    for i in sorted(ids("quality rules")):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", own[i][1]), i)
    assert sorted(ids("exact dedup")) == sorted(first.values())
    parent = {i: i for i in ids("exact dedup")}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {i: shingles(own[i][1]) for i in parent}
    for a in parent:
        for b in parent:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(ids("near dedup")) == sorted(i for i in parent if top(i) == i)
    assert len(ids("near dedup")) < len(parent)
    size = {i: len(own[i][1].split()) for i in ids("near dedup")}
    names = sorted({own[i][3] for i in size if own[i][3] is not None}) + [None]
    total = [sum(n for i, n in size.items() if own[i][3] == s) for s in names]
    used = collections.Counter(ids("mixing"))
    for s, t in zip(names, mixing.targets(total, [(3, 1, 2)[k % 3] for k in range(len(names))]), strict=True):
        mine = {i: n for i, n in size.items() if own[i][3] == s}
        assert abs(sum(used[i] * n for i, n in mine.items()) - t) <= max(mine.values())
    assert max(used.values()) <= 2
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_file("word_bpe_49k.json"))
    want = collections.Counter()
    for i, n in used.items():
        e = np.array([*t.encode(own[i][1], add_special_tokens=False).ids, 2], "<u4")
        want.update({(i, at, min(4096, len(e) - at), zlib.crc32(e[at : at + 4096].tobytes())): n for at in range(0, len(e), 4096)})
    got = steps["packing"].collect()
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want
    run = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    assert sorted(map(key, run)) == sorted(map(key, got))


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
