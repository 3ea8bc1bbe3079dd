"""Ranked lexical search over postings sharded by document.

A shard holds some successive documents: its terms, and for each term the documents that have it (compressed sparse rows)
with an integer impact that is worked out when the index is built. Items are scored a term at a time into one dense
array of a shard's documents; a shard's best are told by a partition that keeps all ties of the last place, then ordered.
Tasks merge their shards' best, Spark merges the tasks' in two steps.

Shards are cut by bytes of text, so a term that all documents have is no longer in one shard than in another, and
nothing is shuffled but best rows and the counts of the items' terms. Items are gone through in blocks.

A task holds a shard at a time, whatever its part of the documents or of the index is: texts and shards go to the workers
in small batches, and a shard is a row group of its own, so that Spark's writer and reader hold no more than one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, give_back, slices, small_batches, split_words, utf8, written

TOP = 10
#: Bytes of text in a shard; items, and bytes of their texts, that are searched for together.
SHARD, ITEMS, ITEM_BYTES = 4 << 20, 4096, 4 << 20
#: Parts that the tasks' best rows of an item are first merged in.
MERGE = 64
#: Bytes of terms, capitals made small; all others are blanks.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
#: Of a shard: its documents, its terms with blanks between, how many documents have each term, and these documents and impacts a term after the other. All but the first are compressed by the workers, so that Spark moves and keeps less.
INDEX = "doc_ids array<long>, terms binary, counts binary, docs binary, impacts binary"
#: How the index is written: a row group a shard. Dictionaries would save nothing; as statistics the writer would keep a shard's columns until the file is closed.
BY_SHARD = {"compression": "none", "parquet.block.row.count.limit": 1, "parquet.enable.dictionary": False, "parquet.column.statistics.enabled": False}


def folded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the texts with small letters and blanks between terms, their bytes one after the other, where each begins)."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].tobytes().translate(FOLDED), np.uint8)
    at = at - at[0]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(at), pa.py_buffer(flat)]), flat, at


def term_counts(texts: pa.Array) -> np.ndarray:
    """How many terms each text has, with repeats."""
    _, flat, at = folded(texts)
    term = flat != 0x20
    starts = term.copy()
    starts[1:] &= ~term[:-1]
    begins = at[:-1][np.diff(at) > 0]
    starts[begins] = term[begins]
    return np.diff(np.searchsorted(np.flatnonzero(starts), at))


class Index:
    """``table``: a row a shard, as INDEX says. ``docs``: documents with a term (N). ``terms``: all their terms with repeats (L)."""

    def __init__(self, table: DataFrame, docs: int, terms: int):
        self.table, self.docs, self.terms = table, docs, terms


def times_by(n: np.ndarray, factor: int, by: int) -> np.ndarray:
    """n * factor div by, whatever the product's size."""
    if len(n) and int(n.max()) * factor >= 2**63:
        return np.array([int(x) * factor // by for x in n], np.int64)
    return n * factor // max(by, 1)


def shards(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches anew in batches of ``size`` to 5/4 of ``size`` bytes of a column, however many the batches have. The last may be smaller, a row with more bytes makes larger ones."""
    own, held = [], 0
    for piece in slices(batches, column, size // 4):
        own.append(piece)
        held += piece.column(column).nbytes
        if held >= size:
            yield pa.concat_batches(own)
            own, held = [], 0
    if own:
        yield pa.concat_batches(own)
    give_back()


def index(docs: DataFrame, shard: int = SHARD) -> Index:
    """The index of ``docs`` (doc_id, text; other columns don't matter), written to the shared folder.

    A null text has no terms; documents without terms are in no shard. A null doc_id stays null. Rows that repeat are
    documents of their own. An empty table gives an empty index.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, every = 0, 0
        for batch in slices(batches, 0, shard):
            n = term_counts(batch.column(0))
            held, every = held + int((n > 0).sum()), every + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([every])], names=["docs", "terms"])

    with small_batches(docs.sparkSession):
        total = rows.select("text").mapInArrow(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = int(total[0] or 0), int(total[1] or 0)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, 1, shard):
            begins, ids, words = split_words(folded(batch.column(1))[0])
            n = np.diff(begins)
            real = np.flatnonzero(n)
            if not len(real):
                continue
            doc = np.repeat(np.arange(len(real)), n[real])
            key, tf = np.unique(ids.astype(np.int64) * len(real) + doc, return_counts=True)
            term, own = key // len(real), key % len(real)
            length = 10 + times_by(n[real], 90 * n_docs, n_terms)
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * length[own])
            counts = np.bincount(term, minlength=len(words))
            columns = (b" ".join(words), counts.astype("<u4"), own.astype("<u4"), impact.astype("<i4"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0).take(pa.array(real)).to_pylist()], pa.list_(pa.int64())), *(pa.array([zstandard.ZstdCompressor(level=1).compress(x)], pa.binary()) for x in columns)],
                names=["doc_ids", "terms", "counts", "docs", "impacts"],
            )

    with small_batches(docs.sparkSession):
        return Index(written(rows.mapInArrow(of, INDEX), **BY_SHARD), n_docs, n_terms)


def plain(column: pa.Array, row: int) -> bytes:
    """What a worker has compressed."""
    return zstandard.ZstdDecompressor().decompress(column[row].as_buffer())


def places(needed: pa.Array, terms: bytes) -> pa.Array:
    """The place of each term that is needed among those of a shard, else null."""
    return pc.index_in(needed, value_set=pa.array(terms.split(b" "), pa.binary()))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, and of all others that are as high as the last of them."""
    at = np.flatnonzero(scores > 0)
    if len(at) <= k:
        return at
    own = scores[at]
    return at[own >= own[np.argpartition(own, len(own) - k)[len(own) - k]]]


def ordered(ids: np.ndarray, null: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, rising identifier, nulls last."""
    return np.lexsort((ids, null, -scores))[:k]


def item_blocks(items: DataFrame) -> Iterator[tuple[list[int | None], list[list[bytes]]]]:
    """(identifiers, distinct terms) of the items, some at a time."""
    ids, terms, held = [], [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), utf8("text").alias("text")).toLocalIterator():
        ids.append(r["item_id"])
        terms.append(sorted(set(bytes(r["text"]).translate(FOLDED).split())))
        held += len(r["text"])
        if len(ids) >= ITEMS or held >= ITEM_BYTES:
            yield ids, terms
            ids, terms, held = [], [], 0
    if ids:
        yield ids, terms


def weights(idx: Index, needed: list[bytes]) -> np.ndarray:
    """floor(1000 ln((2N+2) / (2df+1))) of each term. The driver gets a row a term."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(needed), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                place = places(pa.array(needed, pa.binary()), plain(batch.column(0), row))
                known = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
                df[known] += np.frombuffer(plain(batch.column(1), row), "<u4")[place.drop_null().to_numpy()]
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen])], names=["term", "df"])

    df = dict.fromkeys(range(len(needed)), 0)
    df |= {r["term"]: r["df"] for r in idx.table.select("terms", "counts").mapInArrow(of, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return np.array([math.floor(1000 * math.log((2 * idx.docs + 2) / (2 * df[k] + 1))) for k in range(len(needed))], np.int64)


def block_best(idx: Index, ids: list[int | None], terms: list[list[bytes]], top: int, first_item: int) -> DataFrame:
    """item, item_id, doc_id, score: each task's best rows for the items of a block, which are numbered from ``first_item``."""
    needed = sorted({t for own in terms for t in own})
    number = {t: k for k, t in enumerate(needed)}
    own_terms = [np.array([number[t] for t in own], np.int64) for own in terms]
    weight = weights(idx, needed)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids = batch.column(0)[row].values
                counts, docs, impacts = (np.frombuffer(plain(batch.column(k), row), kind) for k, kind in ((2, "<u4"), (3, "<u4"), (4, "<i4")))
                starts = np.append(0, np.cumsum(counts, dtype=np.int64))
                place = places(pa.array(needed, pa.binary()), plain(batch.column(1), row)).fill_null(-1).to_numpy()
                null, real = doc_ids.is_null().to_numpy(zero_copy_only=False), doc_ids.fill_null(0).to_numpy()
                for item, own in enumerate(own_terms):
                    scores = np.zeros(len(real), np.int64)
                    for t in own[place[own] >= 0].tolist():
                        a, b = starts[place[t]], starts[place[t] + 1]
                        scores[docs[a:b]] += weight[t] * impacts[a:b]
                    at = best(scores, top)
                    if len(at):
                        new = real[at], null[at], scores[at]
                        both = tuple(map(np.concatenate, zip(held[item], new, strict=True))) if item in held else new
                        first = ordered(*both, top)
                        held[item] = tuple(x[first] for x in both)
        item = np.repeat(np.array(list(held), np.int64), [len(h[0]) for h in held.values()])
        real, null, scores = (np.concatenate([h[k] for h in held.values()] or [np.empty(0, kind)]) for k, kind in enumerate((np.int64, bool, np.int64)))
        named = pa.array([ids[k] for k in item], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(item + first_item), named, pa.array(real, mask=null), pa.array(scores)], names=["item", "item_id", "doc_id", "score"])

    return idx.table.mapInArrow(of, "item long, item_id long, doc_id long, score long")


def search(idx: Index, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` (item_id, text; other columns don't matter) the ``top`` documents of highest score above 0.

    Equal scores are in the order of doc_id, a null one last. An item with a null text, or without a term that a document
    has, has no rows. Rows that repeat an item_id are items of their own, each ranked from 1. An empty table gives no rows.
    """
    found, n = [], 0
    for ids, terms in item_blocks(items):
        with small_batches(items.sparkSession):  # which holds as long as the index is being read
            found.append(written(block_best(idx, ids, terms, top, n)))
        n += len(ids)
    if not found:
        return items.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = reduce(DataFrame.union, found).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return rows.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS terms FROM documents),
own AS (SELECT doc_id, r, len(terms) AS n, unnest(terms) AS term FROM words WHERE len(terms) > 0),
total AS (SELECT count(DISTINCT r) AS docs, count(*) AS terms FROM own),
postings AS (SELECT doc_id, r, n, term, count(*) AS tf FROM own GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM total) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
  SELECT a.item_id, p.doc_id, p.r, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * p.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM asked a JOIN weight w ON a.term = w.term JOIN postings p ON a.term = p.term, total t GROUP BY a.item_id, p.doc_id, p.r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
