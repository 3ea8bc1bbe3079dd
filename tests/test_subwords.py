"""Encoding by the vocabularies' own models against the reference tokenizers, and unigram paths against every way to cut a word."""

import base64
import itertools
import os
import random

import pytest

P = pytest.importorskip("public_tokenizers")

from tessera.operators import subwords  # noqa: E402

ODD = ["", " ", "It's  the\n\n END\t", "don't DON'T 'llx", "x" * 300, "ab12 3.5,,,!? é É ñ 漢字 😀😀  a b ﬁ", "á İ ß Σας", "▁▁x ▁", "\x1c\x85 .", "naïve  co-op   2024-01-01", "ʼn½²x_y__", "​zero", "tab\tand  two"]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(ODD)] + [(20_000, None)], "doc_id long, text string")
    return own.union(more).repartition(3).cache()


def ids_of(docs, vocabulary, most=subwords.FREQUENT):
    return {r["doc_id"]: r["ids"] for r in subwords.encoded_ids(docs, "doc_id", "text", vocabulary, most).collect()}


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


@pytest.mark.parametrize("name,most", [("byte_bpe_50k.json", 1 << 16), ("byte_bpe_50k.json", 20), ("word_bpe_49k.json", 500)])
def test_merges_of_tokenizer_files(docs, name, most):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    got = ids_of(docs, subwords.from_json(P.path(name)), most)
    for key, text in texts(docs).items():
        assert got[key] == t.encode(text, add_special_tokens=False).ids, (key, text[:60])


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_merges_of_rank_files(docs, name):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    vocabulary = subwords.from_ranks(P.path(name))
    got = ids_of(docs, vocabulary)
    for key, text in texts(docs).items():
        assert got[key] == t.encode_ordinary(text), (key, text[:60])
    back = subwords.decoded(subwords.encoded_ids(docs, "doc_id", "text", vocabulary), "doc_id", "ids", vocabulary)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == texts(docs)


def test_pieces_with_byte_fallback(docs):
    import sentencepiece

    t = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    vocabulary = subwords.from_pieces(P.path("piece_bpe_32k.model"))
    got = ids_of(docs, vocabulary)
    for key, text in texts(docs).items():
        assert got[key] == t.encode(text), (key, text[:60])
    back = subwords.decoded(subwords.encoded_ids(docs, "doc_id", "text", vocabulary), "doc_id", "ids", vocabulary)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t.replace("▁", " ") for k, t in texts(docs).items()}  # the mark in a text is a blank


def test_unigram_best_paths():
    rng = random.Random(4)
    for _ in range(300):
        alphabet = "abc"
        score = {"".join(rng.choices(alphabet, k=rng.randint(1, 3))): -float(rng.randint(1, 40)) for _ in range(8)}
        word = "".join(rng.choices(alphabet + "d", k=rng.randint(1, 7)))
        cuts = []
        for marks in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for k, m in enumerate(marks, 1):
                if m:
                    parts.append(word[last:k])
                    last = k
            parts.append(word[last:])
            if all(p in score or len(p) == 1 for p in parts):
                cuts.append(sum(score.get(p, -99.0) for p in parts))
        got = subwords.best_path(word, score, 3, -99.0)
        assert "".join(got) == word
        assert sum(score.get(p, -99.0) for p in got) == max(cuts)


def test_unigram_file_and_bytes(spark, tmp_path):
    """A unigram vocabulary with bytes for what it lacks, against the reference library on the same file."""
    import json

    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), *((f"<0x{b:02X}>", -20.0) for b in range(256)), ("▁", -3.0), ("▁the", -2.0), ("▁th", -2.5), ("e", -3.5), ("n", -3.2), ("en", -4.1), ("t", -3.3), ("h", -3.7), ("▁a", -2.2), ("nt", -5.0), ("ent", -5.1), ("s", -2.9)]
    (tmp_path / "u.json").write_text(json.dumps({"model": {"type": "Unigram", "vocab": vocab, "unk_id": 0, "byte_fallback": True}}))
    t = Tokenizer(models.Unigram(vocab, 0, True))
    vocabulary = subwords.from_json(str(tmp_path / "u.json"))
    words = ["the then a", "tents hen", "é漢", "athens nth", "zzz the"]
    df = spark.createDataFrame(list(enumerate(words)), "k long, text string")
    got = {r["k"]: r["ids"] for r in subwords.encoded_ids(df, "k", "text", vocabulary).collect()}
    for k, text in enumerate(words):
        assert got[k] == t.encode("▁" + text.replace(" ", "▁")).ids, text
    assert os.path.exists(tmp_path / "u.json")


def test_a_word_is_encoded_once(monkeypatch):
    import pyarrow as pa

    calls = []
    own = subwords.Encoder.__call__
    monkeypatch.setattr(subwords.Encoder, "__call__", lambda self, w: calls.append(w) or own(self, w))
    e = subwords.Encoder(subwords.from_ranks(P.path("byte_bpe_50k.tiktoken")))
    distinct = pa.array(["the", " cat", "the", "the"]).dictionary_encode().dictionary.to_pylist()
    assert [e(w) for w in distinct] and calls == ["the", " cat"]
