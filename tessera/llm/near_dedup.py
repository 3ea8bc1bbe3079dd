"""MinHash near-dedup: SuperMinHash signatures, banding, verification on whole shingle sets, components.

Documents of one set are represented by one of them. Of the others, those that share a band are a bucket:

1. each document is compared to the smallest of its buckets' smallest documents, then to those of its other buckets
   that it isn't tied to yet: a bucket whose documents resemble its smallest is done with a row a document;
2. what is left are buckets whose other documents aren't all tied; they are compared in blocks, each pair of blocks
   in a task of its own.
"""

from __future__ import annotations

import hashlib

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, chunks, documents, fresh, looked_up, mixed, parts, small_batches, utf8, window_hashes, word_hashes, written
from tessera.llm.components import components

SHINGLE, BANDS, ROWS = 5, 32, 6
#: Members and shingles that one block of a group of candidates holds; larger groups are compared block by block.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 4_000_000
#: Documents that one task compares to one document.
STAR = 512
#: Shingles whose ranks are drawn together; bytes of text whose shingles a worker holds at once.
ELEMENTS, CHUNK = 50_000, 4 << 20


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles of five lower-cased words; of fewer words, one of them all."""
    hashes = word_hashes((text or b"").lower())
    if 0 < len(hashes) < SHINGLE:
        return window_hashes(np.concatenate([hashes, np.full(1, len(hashes), np.uint64)]), len(hashes) + 1)
    return np.unique(window_hashes(hashes, SHINGLE))


def superminhash(values: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The signatures (n, slots) of n sets: ``values`` are elements, ``owner`` the set of each.

    In step j an element goes to the j-th slot of a permutation of its own with a rank in [j, j+1). The ranks of
    an element are so spread over the slots that a signature varies less than with independent ranks. A set
    is done once no slot holds more than j+1: later steps can't lower any.
    """
    if n == 1 and len(values) > ELEMENTS:  # one long text, a part at a time: a signature is the least over its elements
        return np.minimum.reduce([superminhash(v, np.zeros(len(v), np.int64), 1, slots) for v in np.array_split(values, -(-len(values) // ELEMENTS))])
    out = np.full((n, slots), float(slots + 1))
    perm = np.tile(np.arange(slots, dtype=np.uint16), (len(values), 1))
    at = np.arange(len(values))
    for j in range(slots):
        own = values[at]
        draw = mixed(own + np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        rank = j + (draw >> np.uint64(11)).astype(float) / 2.0**53
        k = j + (mixed(draw + np.uint64(0xD1B54A32D192ED03)) % np.uint64(slots - j)).astype(np.int64)
        slot = perm[at, k]
        perm[at, k] = perm[at, j]
        np.minimum.at(out.reshape(-1), owner[at] * slots + slot, rank)
        at = at[(out.max(axis=1) > j + 1)[owner[at]]]
        if not len(at):
            break
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        key = mixed(key + bits[:, :, k])
    return key.view(np.int64)


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the SHA-256 of the sorted set, and its band keys."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, _ in chunks(batches, CHUNK):
            sets = [shingles(t) for t in got["text"]]
            sizes = np.array([len(s) for s in sets])
            keys = np.zeros((len(sets), bands), np.int64)
            at = 0
            while at < len(sets):
                to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), ELEMENTS, "right")))
                full = np.flatnonzero(sizes[at:to]) + at
                if len(full):
                    owner = np.repeat(np.arange(len(full)), sizes[full])
                    keys[full] = band_keys(superminhash(np.concatenate([sets[i] for i in full]), owner, len(full), bands * rows), bands, rows)
                at = to
            digests = [hashlib.sha256(s.tobytes()).digest() for s in sets]
            lists = pa.ListArray.from_arrays(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(got["doc_id"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists], names=["doc_id", "n_shingles", "digest", "bands"])

    return docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).mapInArrow(of, "doc_id long, n_shingles long, digest binary, bands array<long>")


def linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest position reachable over links: 100 * intersection >= percent * union."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    count = np.diff(np.append(new, len(every)))
    ids = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    ids, owner = ids[shared], owner[shared]
    common = np.zeros((n, n), np.float32)
    step = max(256, (8 << 20) // n)
    for at in range(0, int(ids[-1]) + 1 if len(ids) else 0, step):
        a, b = np.searchsorted(ids, [at, at + step])
        grid = np.zeros((n, step), np.float32)
        grid[owner[a:b], ids[a:b] - at] = 1
        common += grid @ grid.T
    common = common.astype(np.int64)
    link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        low = np.where(link, label[None, :], n).min(axis=1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b) or not len(a):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are alike. ``pairs``: a written table a, b without repeats.

    A task gets a document b and up to STAR or so of its partners, one after the other, so it holds two sets.
    """

    def set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, _ in chunks(batches, CHUNK):
            own = pa.array([shingles(t).tobytes() for t in got["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(got[k], pa.int64()) for k in ("doc_id", "b", "salt", "partner")] + [own], names=["doc_id", "b", "salt", "partner", "items"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            found = []
            for doc, b, salt, partner, item in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if (b, salt) != key:
                    key, own = (b, salt), []
                items = np.frombuffer(item, np.uint64)
                if not partner:
                    own.append(items)
                elif any(alike(items, o, percent) for o in own):
                    found.append((doc, b))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    tasks = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("long").alias("tasks")))
    partners = looked_up(pairs, tasks, ["b"], "inner").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), "tasks").alias("salt"), F.lit(1).cast("long").alias("partner"))
    centres = tasks.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"), F.lit(0).cast("long").alias("partner"))
    wanted = written(partners.union(centres))
    mine = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).join(bounded(wanted), F.col("doc_id") == F.col("id"))
    sets = mine.select("doc_id", "b", "salt", "partner", "text").mapInArrow(set_of, "doc_id long, b long, salt long, partner long, items binary")
    dealt = sets.repartition(parts(docs.sparkSession), "b", "salt").sortWithinPartitions("b", "salt", "partner")
    return dealt.mapInArrow(of, "a long, b long").distinct()


def verified(docs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that span the confirmed links within each group of candidates.

    ``groups``: doc_id, cluster, blocks. Groups over a block's size are dealt out in blocks; every pair of blocks
    meets in a task of its own, which compares whole shingle sets and returns at most an edge a member.
    """

    def set_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, _ in chunks(batches, CHUNK):
            own = pa.array([shingles(t).tobytes() for t in got["text"]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(got[k], pa.int64()) for k in ("doc_id", "cluster", "blocks")] + [own], names=["doc_id", "cluster", "blocks", "items"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(ids: list[int], items: list[bytes]) -> list[tuple[int, int]]:
            order = np.argsort(ids, kind="stable")
            ids = [ids[i] for i in order]
            root = linked([np.frombuffer(items[i], np.uint64) for i in order], percent)
            return [(ids[i], ids[r]) for i, r in enumerate(root) if ids[i] != ids[r]]

        key, ids, items = None, [], []
        for batch in batches:
            found = []
            for doc, *own, item in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if own != key:
                    found += edges(ids, items) if len(ids) > 1 else []
                    key, ids, items = own, [], []
                ids.append(doc)
                items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        if len(ids) > 1:
            found = edges(ids, items)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    spark = docs.sparkSession
    mine = docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")).join(bounded(groups), "doc_id")
    sets = mine.mapInArrow(set_of, "doc_id long, cluster long, blocks long, items binary")
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("doc_id", "cluster", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"), "items")
    return dealt.repartition(parts(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(of, "a long, b long")


def near_groups(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``docs``.

    ``docs``: doc_id, text; other columns don't matter. Two documents are linked when 100 times what their shingle
    sets share is at least ``percent`` times their union; a component's id is its smallest doc_id, and that
    document stays. A text without words (null, empty, blank) has no shingles and no links. Equal sets, which agree in
    a SHA-256 of the whole set, are represented by one document. Rows that repeat a doc_id are one node of the
    graph. A row without doc_id is in no component (null) and stays. A pair shares no band, and so isn't seen,
    with a probability of about 3e-7 at a similarity of just 0.85 and 6e-5 at 0.80. An empty table gives no rows.
    """
    with small_batches(docs.sparkSession):
        signs = written(signed(docs, bands, rows))
        sets = signs.where("n_shingles > 0 and doc_id is not null")
        classes = written(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).where("rep < top"))
        copies = looked_up(sets.select("doc_id", "digest"), classes, ["digest"], "inner").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        links = copies = written(copies.distinct())
        # One document of each class goes on to the bands.
        own = sets.join(bounded(copies.select(F.col("a").alias("doc_id"))), "doc_id", "left_anti").select("doc_id", F.explode("bands").alias("key"))
        low = own.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("key", "low")
        bucket = written(looked_up(own, written(low), ["key"], "inner").where("doc_id <> low"))
        stars = written(bucket.select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct())
        first = written(stars.groupBy("a").agg(F.min("b").alias("b")))
        found = components(links.union(confirmed(docs, first, percent)))
        tie = lambda doc, of: found.select(F.col("a").alias(doc), F.col("b").alias(of))
        rest = looked_up(looked_up(stars.join(first, ["a", "b"], "left_anti"), tie("a", "of_a"), ["a"]), tie("b", "of_b"), ["b"])
        rest = written(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"))
        found = extended(found, confirmed(docs, rest, percent)) if not rest.isEmpty() else found
        # Buckets whose documents, but for the smallest, aren't all tied; the smallest has been compared to each.
        labelled = looked_up(bucket, tie("doc_id", "of"), ["doc_id"]).withColumn("of", F.coalesce("of", "doc_id"))
        open_ = written(labelled.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("of").alias("x"), F.max("of").alias("y")).where("x < y").select("key", "least"))
        if not open_.isEmpty():
            loose = components(looked_up(bucket, open_, ["key"], "inner").where("doc_id <> least").select("doc_id", "least"))
            member = loose.select(F.col("a").alias("doc_id"), F.col("b").alias("cluster")).union(loose.select("b", "b").distinct())
            sized = member.join(sets.groupBy("doc_id").agg(F.max("n_shingles").alias("n")), "doc_id")
            size = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("long").alias("blocks"))
            groups = written(looked_up(member, written(size), ["cluster"], "inner").select("doc_id", "cluster", "blocks"))
            found = extended(found, verified(docs, groups, percent))
    out = signs.select("doc_id", "n_shingles").join(bounded(found.select(F.col("a").alias("doc_id"), F.col("b").alias("found"))), "doc_id", "left")
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components over those found before and more links."""
    more = written(links)
    return found if more.isEmpty() else components(found.union(more))


def drop_near(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stays by near_groups, with all their columns.

    Rows without a doc_id and texts without words stay. Rows that repeat a doc_id stay or go together. Other columns
    pass through, whatever their names; an empty table gives no rows.
    """
    (name,) = fresh(docs, "gone_id")
    gone = written(near_groups(docs, percent).where("not kept").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(bounded(gone), F.col(name) == docs["doc_id"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), percent=85)
