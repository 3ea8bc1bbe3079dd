"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained by gradient descent, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, id_remainder, mixed, split_words

BUCKETS, DIM, SUBWORDS = 1 << 15, 16, (1, 2, 3, 4)
#: Labelled rows that the classifier is fitted on: about so many of each language, and so many in all, by a hash of doc_id.
ROWS_A_LANGUAGE, ROWS = 400, 4000
EPOCHS, BATCH, RATE, SEED = 12, 32, 4.0, 7
#: Words of the short piece that each fitted text also gives, so that short texts are learned from.
PIECE = 6
#: Words of a fitted text at most that the longer piece has, and languages at most.
MOST_WORDS, MOST_LANGUAGES = 1000, 1000
#: Share of right answers that accepted predictions have in calibration.
PRECISION = 0.99
FOLDS, HELD_OUT = 4, 2
CHUNK, BLOCK = 8 << 20, 40_000
UNKNOWN = "und"


def subword_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, its word's number): the strings of one to four code points of each word within < and >."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends, own = np.cumsum(sizes), np.repeat(np.arange(len(words)), sizes)
    found, where = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(SUBWORDS) + 1):
        h = mixed(h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]) if len(codes) >= n else h[:0]
        if n in SUBWORDS and len(h):
            at = np.flatnonzero(np.arange(len(h)) + n <= ends[own[: len(h)]])
            found.append((h[at] % np.uint64(BUCKETS)).astype(np.int64))
            where.append(own[at])
    return (np.concatenate(found), np.concatenate(where)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    at, ids, words = split_words(pc.utf8_lower(pc.fill_null(texts, "")))
    return at, ids, [w.decode("utf-8", "replace") for w in words]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a text's subwords."""
    found, count = np.unique(subword_buckets(words)[0], return_counts=True)
    return found.astype(np.int32), (count / max(count.sum(), 1)).astype(np.float32)


@dataclass
class Classifier:
    languages: list[str]
    scores: np.ndarray  # (BUCKETS, languages): embedding times weights, so that a word's part is a sum of rows
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        """One row a text, from all its words."""
        at, ids, words = lowered(texts)
        n = len(self.languages)
        part = np.zeros((len(words), n + 1))
        for k in range(0, len(words), BLOCK):
            bucket, own = subword_buckets(words[k : k + BLOCK])
            size = min(BLOCK, len(words) - k)
            part[k : k + size, n] = np.bincount(own, minlength=size)
            for j in range(n):
                part[k : k + size, j] = np.bincount(own, self.scores[bucket, j], minlength=size)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        sums = np.stack([np.bincount(doc, part[ids, j], minlength=len(texts)) for j in range(n + 1)], axis=1)
        return sums[:, :n] / np.maximum(sums[:, n:], 1) + self.bias

    def predicted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, calibrated probability)."""
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def descended(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, weights, bias) after stochastic gradient descent over (language, buckets, shares)."""
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, languages), np.float32), np.zeros(languages, np.float32)
    steps, step = EPOCHS * -(-len(rows) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            own = [rows[i] for i in order[k : k + BATCH] if len(rows[i][1])]
            if not own:
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            bucket, share = np.concatenate([r[1] for r in own]), np.concatenate([r[2] for r in own])
            size = np.array([len(r[1]) for r in own])
            mean = np.add.reduceat(embed[bucket] * share[:, None], np.cumsum(size) - size)
            off = softmax(mean @ weights + bias)
            off[np.arange(len(own)), [r[0] for r in own]] -= 1
            back = off @ weights.T
            weights -= rate / len(own) * mean.T @ off
            bias -= 0.1 * rate / len(own) * off.sum(axis=0)
            np.add.at(embed, bucket, -rate / len(own) * share[:, None] * np.repeat(back, size, axis=0))
    return embed, weights, bias


def calibrated(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """(temperature, threshold): the likeliest temperature, and the least probability from which on PRECISION of the answers are right."""
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    temperature = min((0.02 * 1.15**k for k in range(50)), key=loss)
    p = softmax(logits / temperature)
    best = p.argmax(axis=1)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = np.cumsum((best == truth)[order]) / np.arange(1, len(truth) + 1)
    good = np.flatnonzero(right >= PRECISION)
    return temperature, float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0


def fitted(docs: DataFrame) -> Classifier | None:
    """The classifier learned from ``docs`` (doc_id, text, lang), or None where no row has text and lang.

    A sample is learned from: about ROWS_A_LANGUAGE rows of a language, ROWS in all, whose doc_id has the least hashes, of
    each a stretch of MOST_WORDS words and one of PIECE; of languages the MOST_LANGUAGES with most rows. Executors
    make the features; the driver gets a bounded number of subword shares a row.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    found = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect())
    if not found:
        return None
    languages = [lang for lang, _ in found]
    most = max(1, min(ROWS_A_LANGUAGE, ROWS // len(found)))
    share = known.sparkSession.createDataFrame([(lang, most / n) for lang, n in found], "own string, share double")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text, mark in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.lower().split()
                for size in (MOST_WORDS, PIECE):
                    at = mark % max(1, len(words) - size)
                    piece = words[at : at + size]
                    bucket, part = features(piece)
                    rows.append((lang, mark, bucket.tobytes(), part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["lang", "mark", "buckets", "shares"])

    mark = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long")), 11)
    sample = known.withColumn("mark", mark).join(F.broadcast(share), F.col("own") == F.col("lang")).where(F.col("mark") / 2.0**53 < F.col("share")).select("lang", "text", "mark")
    got = sample.mapInArrow(of, "lang string, mark long, buckets binary, shares binary").toPandas().sort_values(["mark", "lang", "buckets"], kind="stable")
    number = {lang: k for k, lang in enumerate(languages)}
    rows = [(number[r.lang], np.frombuffer(r.buckets, np.int32), np.frombuffer(r.shares, np.float32)) for r in got.itertuples()]
    # One in five texts is for calibration; with very few, all are for both.
    apart = (got["mark"].to_numpy() % 5 == 0) if len(rows) >= 50 else np.zeros(len(rows), bool)
    embed, weights, bias = descended([r for r, a in zip(rows, apart, strict=True) if not a], len(languages))
    scores = embed @ weights
    held = [r for r, a in zip(rows, apart, strict=True) if a or not apart.any()]
    if not held:
        return Classifier(languages, scores.astype(float), bias.astype(float), 1.0, 1.0)
    logits = np.stack([part @ scores[bucket] if len(bucket) else 0 * bias for _, bucket, part in held]) + bias
    return Classifier(languages, scores.astype(float), bias.astype(float), *calibrated(logits.astype(float), np.array([r[0] for r in held])))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of each row of ``docs``.

    ``docs``: doc_id, text, lang; other columns don't matter. Only rows that aren't held out (crc32 of doc_id as text has
    remainder 2 by 4; a null doc_id counts as empty text) with text and lang are learned from; a prediction sees
    the whole text and nothing else. A text that is null or has no letter is ``und`` with score 0, and so is every
    text where nothing could be learned. ``accepted`` says whether the calibrated score reaches the threshold.
    Equal texts get equal answers; an empty table gives no rows.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"))
    model = spark.sparkContext.broadcast(fitted(own.where("NOT held_out").select("doc_id", "text", "lang")))

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = model.value
        for series in texts:
            text = pa.array(series, pa.string())
            named = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            lang, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
            if m is not None:
                step = max(1, int(len(text) * CHUNK / max(text.nbytes, 1)))
                for at in range(0, len(text), step):
                    best, p = m.predicted(text.slice(at, step))
                    lang[at : at + step], score[at : at + step] = np.array(m.languages, object)[best], p
                lang[~named], score[~named] = UNKNOWN, 0.0
            yield pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "accepted": named & (score >= (m.threshold if m else 1.0))})

    return own.select("doc_id", "held_out", of.asNondeterministic()("text").alias("own")).select("doc_id", "held_out", "own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))
