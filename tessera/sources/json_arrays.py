"""Files that are one JSON array each, however large: items by ordinal from byte splits, in two scans.

Spark reads a file in splits, as lines that end at commas. Whether a split begins in a string, and how deep, is not known to
its task; so the first scan gives of each split what holds for either start: whether its quotes change the state, and
for both states how the depth changes and how many commas it has at each depth relative to its start. These
summaries, a row a split, combine from left to right to each split's true state, depth and first ordinal. The second scan
cuts the splits into items with them. Only an item that a split's edge divides is put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import entries
from tessera.sources.scratch import written

QUOTE, BACKSLASH, COMMA, BLANKS = 34, 92, 44, b" \t\n\r"
CHANGE = np.zeros(256, np.int64)
CHANGE[list(b"[{")], CHANGE[list(b"]}")] = 1, -1
BLANK = np.isin(np.arange(256), list(BLANKS))
#: Rows, a split each, that are broadcast at most; beyond that the lines are dealt to their splits' tasks.
BROADCAST_SPLITS = 100_000
SUMMARY = "f long, block long, parity int, dense long, root int, change array<long>, depths array<array<long>>, commas array<array<long>>"
KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64())))
MARK = b"\xef\xbb\xbf"
ITEMS = "f long, block long, ordinal long, whole boolean, only boolean, item binary"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """f (the file's hash), block, value of what stands between the files' commas; a split's rows are in order in one partition."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep=",").select(F.xxhash64(meta["file_path"]).alias("f"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """f, file, length; no content is read."""
    meta = F.col("_metadata")
    return spark.read.format("binaryFile").load(path).select(F.xxhash64(meta["file_path"]).alias("f"), meta["file_path"].alias("file"), F.col("length"))


def within(text: np.ndarray, inside: int) -> np.ndarray:
    """For each byte whether it is in a string, its quotes apart: 1 or 0. ``inside``: the state before the first byte."""
    quote = text == QUOTE
    slash = text == BACKSLASH
    if slash.any():
        at = np.arange(len(text))
        last = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte so far that is no backslash
        before = np.append(-1, last[:-1])
        quote &= (at - 1 - before) % 2 == 0
    return (np.cumsum(quote) - quote + inside) & 1


def by_split(batches: Iterator[pa.RecordBatch], extra: int = 0) -> Iterator[tuple]:
    """((f, block, more columns of the first row), text, whether the split ends) of runs of a split's rows; each line is followed by its comma."""
    last = None
    for batch in batches:
        f, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero((f[1:] != f[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(f)], strict=True):
            if a == b:
                continue
            key = (int(f[a]), int(block[a]), *(batch.column(3 + k)[a].as_py() for k in range(extra)))
            if last is not None and last[:2] != key[:2]:
                yield last, b"", True
            last = key
            yield key, b",".join(batch.column(2).slice(a, b - a).to_pylist()) + b",", False
    if last is not None:
        yield last, b"", True


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """What each split does to a state that is not known yet, as SUMMARY says: pairs are for starts outside and inside of a string."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: (0, 0, None, [0, 0], [{}, {}])
        parity, dense, root, depth, count = new()
        begun = False
        for (f, block), text, ends in by_split(batches):
            if ends:
                row = f, block, parity, dense, root, depth, [list(c) for c in count], [list(c.values()) for c in count]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, KINDS, strict=True)], names=[c.split()[0] for c in SUMMARY.split(", ")])
                parity, dense, root, depth, count = new()
                begun = False
                continue
            if block == 0 and not begun:
                text = text.removeprefix(MARK)
            begun = True
            raw = np.frombuffer(text, np.uint8)
            bare = text.lstrip(BLANKS) if root is None and block == 0 else b""
            root = bare[0] if bare else root
            dense += int((~BLANK[raw]).sum())
            state = within(raw, parity)
            for start in (0, 1):
                out = state == start
                deep = depth[start] + np.cumsum(CHANGE[raw] * out)
                for d, n in zip(*np.unique(deep[out & (raw == COMMA)], return_counts=True), strict=True):
                    count[start][int(d)] = count[start].get(int(d), 0) + int(n)
                depth[start] = int(deep[-1])
            parity = int(state[-1])  # the last byte is a comma, so its state is the one after it too

    return lines(spark, path).mapInArrow(of, SUMMARY)


def starts(summary: DataFrame) -> DataFrame:
    """f, block, inside, depth, ordinal that each split begins with, and of its file: commas of the root, bytes that aren't blank, the root's first byte, whether all closes."""
    before = Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("f")
    sum_of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    own = summary.withColumn("inside", F.pmod(sum_of("parity"), F.lit(2)).cast("int"))
    own = own.withColumn("by", F.get("change", F.col("inside"))).withColumn("depth", sum_of("by"))
    at = F.array_position(F.get("depths", F.col("inside")), 1 - F.col("depth"))
    own = own.withColumn("own", F.when(at > 0, F.get(F.get("commas", F.col("inside")), (at - 1).cast("int"))).otherwise(0))
    closed = (F.pmod(F.sum("parity").over(whole), F.lit(2)) == 0) & (F.sum("by").over(whole) == 0)
    return own.select("f", "block", "inside", "depth", sum_of("own").alias("ordinal"), F.sum("own").over(whole).alias("commas"), F.sum("dense").over(whole).alias("dense"), F.max("root").over(whole).alias("root"), closed.alias("closed"))


def array_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, root (its first character; null for a blank file), closed, n_items: of the root array, null for other roots.

    One scan that parses nothing. That brackets and quotes close doesn't say yet that items are valid: see ``array_documents``.
    """
    own = starts(summaries(spark, path)).where("block = 0")
    # The brackets, and the comma that each file's last line is given, are all that an array without items has.
    empty = (F.col("commas") == 0) & (F.col("dense") <= 3)
    n = F.when(F.col("root") == ord("["), F.when(empty, 0).otherwise(F.col("commas") + 1))
    root = F.when(F.col("root") != COMMA, F.char("root"))
    found = own.select("f", root.alias("root"), "closed", n.alias("n_items"))
    return files(spark, path).join(found, "f", "left").select("file", "root", F.coalesce("closed", F.lit(True)).alias("closed"), "n_items")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Items and parts of items, as ITEMS says; what stands outside of the root, or closes it wrongly, has ordinal -1."""
    own = starts(summaries(spark, path)).select("f", "block", "inside", "depth", "ordinal", (F.col("commas") == 0).alias("only"), (F.col("root") == ord("[")).alias("is_array")).where("is_array").drop("is_array")
    own = written(own)
    text = lines(spark, path)
    if own.count() <= BROADCAST_SPLITS:
        both = text.join(F.broadcast(own), ["f", "block"])
    else:
        both = text.withColumn("at", F.monotonically_increasing_id()).join(own, ["f", "block"]).repartition("f", "block").sortWithinPartitions("f", "block", "at")
    both = both.select("f", "block", "value", "inside", "depth", "ordinal", "only")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held: list[bytes] | None = None
        for (f, block, inside, depth, ordinal, only), text, ends in by_split(batches, 4):
            if held is None:
                state, deep, at, held, whole = inside, depth, ordinal, [], False
            if ends:
                if any(held):
                    rows.append((f, block, at if deep else -1, False, only, b"".join(held)))
                held = None
            else:
                raw = np.frombuffer(text, np.uint8)
                now = within(raw, state)
                change = CHANGE[raw] * (now == 0)
                after = deep + np.cumsum(change)
                edges = np.flatnonzero(((raw == COMMA) & (now == 0) & (after == 1)) | ((change == 1) & (after == 1)) | ((change == -1) & (after == 0)))
                begin = 0
                for k in edges.tolist():
                    if change[k] == 1:
                        # The root opens: what was there is outside.
                        outside = b"".join([*held, text[begin:k]]).removeprefix(MARK if block == 0 else b"").strip(BLANKS)
                        if outside.strip(b",") or text[k : k + 1] != b"[":
                            rows.append((f, block, -1, True, only, outside + text[k : k + 1]))
                        whole = True
                    else:
                        rows.append((f, block, at, whole, only, b"".join([*held, text[begin:k]])))
                        whole, at = True, at + 1
                        if change[k] == -1 and text[k : k + 1] != b"]":
                            rows.append((f, block, -1, True, only, text[k : k + 1]))
                    held, begin = [], k + 1
                rest, state, deep = text[begin:], int(now[-1]), int(after[-1])
                if deep > 0 or rest.strip(BLANKS + b","):
                    held.append(rest)
            if len(rows) > 10_000 or (ends and rows):
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return both.mapInArrow(of, ITEMS)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ITEMS.split(", ")])


def joined(found: DataFrame) -> DataFrame:
    """f, ordinal, raw: items that splits divide put together, blanks around items gone, the blank item of an empty array left out."""
    text = F.col("item").cast("string")
    divided = found.where(~F.col("whole") & (F.col("ordinal") >= 0)).groupBy("f", "ordinal", "only").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", text.alias("t")))), lambda x: x["t"]), "").alias("t"))
    every = found.where("whole AND ordinal >= 0").select("f", "ordinal", "only", text.alias("t")).union(divided.select("f", "ordinal", "only", "t"))
    bare = F.regexp_replace(F.regexp_replace("t", r"^[ \t\n\r]+", ""), r"[ \t\n\r]+$", "")
    return every.select("f", "ordinal", "only", bare.cast("binary").alias("raw")).where(~(F.col("only") & (F.octet_length("raw") == 0))).drop("only")


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (from 0), raw (binary, without blanks around) of the items of files whose root is an array; other files have no rows."""
    own = joined(pieces(spark, path))
    return own.join(files(spark, path).select("f", "file"), "f").select("file", "ordinal", "raw")


def array_documents(spark: SparkSession, path: str) -> DataFrame:
    """file, n_items, valid of files whose root is an array: every item is valid JSON, all closes, and nothing else stands outside."""
    found = pieces(spark, path)
    stray = found.where("ordinal = -1").groupBy("f").agg(F.count("*").alias("stray"))
    own = entries.entry_status(joined(found), "raw").groupBy("f").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "Valid").alias("bad"))
    counts = array_counts(spark, path).where("root = '['")
    named = counts.join(files(spark, path).select("f", "file"), "file")
    both = named.join(own, "f", "left").join(stray, "f", "left")
    valid = F.col("closed") & (F.coalesce("bad", F.lit(0)) == 0) & (F.coalesce("n", F.lit(0)) == F.col("n_items")) & F.col("stray").isNull()
    return both.select("file", "n_items", valid.alias("valid"))
