"""Scores of language identification recomputed from the fitted tables, subword by subword."""

import math

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm.queries")

from tessera.llm import langid  # noqa: E402

M64 = 2**64 - 1


def scrambled(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def buckets(word):
    """The bucket of each string of one to four code points of <word>, hashed code point by code point."""
    s, out = f"<{word}>", []
    for n in langid.SUBWORDS:
        for at in range(len(s) - n + 1):
            h = 0
            for c in s[at : at + n]:
                h = scrambled((h * 0x9E3779B97F4A7C15 + ord(c)) & M64)
            out.append(h % langid.BUCKETS)
    return out


TEXTS = ["The cat sat on the mat", "ÉLAN über ñandú", "x", "😀 one-two  three\n\tFOUR", "a " * 500 + "Zebra"]


def test_scores_by_definition():
    rng = np.random.default_rng(1)
    model = langid.Classifier(["de", "en", "fr"], rng.normal(size=(langid.BUCKETS, 3)), rng.normal(size=3), 0.7, 0.5)
    got = model.logits(pa.array(TEXTS))
    best, p = model.predicted(pa.array(TEXTS))
    for k, text in enumerate(TEXTS):
        every = [b for word in text.lower().split() for b in buckets(word)]
        want = model.scores[every].sum(0) / len(every) + model.bias
        assert np.allclose(got[k], want, atol=1e-9)
        weight = [math.exp((x - want.max()) / 0.7) for x in want]
        assert best[k] == int(want.argmax()) and math.isclose(p[k], max(weight) / sum(weight), rel_tol=1e-9)


def test_a_fitted_model_scores_as_its_query_says(spark):
    """The query's answers are those of the fitted tables, text by text."""
    said = {"en": "the quick brown fox and the lazy dog", "fr": "le renard brun et le chien ainsi que", "es": "el zorro y los perros de la casa"}
    rows = [(i, " ".join(said[lang].split()[i % 4 :]) + f" {i}", lang) for i in range(240) for lang in [list(said)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    from pyspark.sql import functions as F

    from tessera.llm.common import id_remainder

    model = langid.fitted(df.where(id_remainder("doc_id", langid.FOLDS) != langid.HELD_OUT).select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in langid.languages(df.withColumn("extra", F.lit(1))).collect()}
    best, p = model.predicted(pa.array([t for _, t, _ in rows]))
    for k, (i, _, lang) in enumerate(rows):
        assert got[i]["lang_pred"] == model.languages[best[k]] and math.isclose(got[i]["score"], p[k], rel_tol=1e-6)
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held) > 0


def test_languages_beyond_the_bound(spark, monkeypatch):
    """Beyond MOST_LANGUAGES those with most rows are learned, first by name among equals; every text still gets one of them."""
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    rows = [(i, w, lang) for i, (w, lang) in enumerate([("aaa bbb", "aa"), ("ccc ddd", "bb"), ("eee fff", "cc")] * 20 + [("aaa", "aa")])]
    got = langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"aa", "bb"}
