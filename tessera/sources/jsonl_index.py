"""A sparse index of JSONL files: where every stride-th entry begins, so that one entry is read without its file.

Two scans in splits build it: the first counts each split's lines, entries and bytes, the second places the checkpoints. An entry is
found from the last checkpoint at or before it, and at most a stride of the file is read; entries of one stride are read together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.json_arrays import BROADCAST_SPLITS
from tessera.sources.scratch import written

#: Checkpoints of all files at most; strides are powers of two. Bytes that are read at once, and bytes of entries that a task holds before it gives them away.
CHECKPOINTS, CHUNK, HELD = 4_000_000, 256 << 10, 8 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """f, block, size, full of each line; a split's rows are in order in one partition."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="\n").select(F.xxhash64(meta["file_path"]).alias("f"), meta["file_block_start"].alias("block"), F.octet_length("value").cast("long").alias("size"), (~F.rlike("value", F.lit(r"^[ \t\r]*$"))).alias("full"))


def stride_of(entries: int, most: int) -> int:
    """The least power of two by which ``most`` checkpoints reach over all entries."""
    stride = 1
    while -(-entries // stride) > most:
        stride *= 2
    return stride


class Index:
    """``checkpoints``: file, ordinal, source_line, byte; of the files also ``length`` and ``modified``, as they were, ``n`` (entries) and ``lines``."""

    def __init__(self, checkpoints: DataFrame, listed: DataFrame, stride: int, entries: int):
        self.checkpoints, self.files, self.stride, self.entries = checkpoints, listed, stride, entries


def build(spark: SparkSession, path: str, most: int = CHECKPOINTS) -> Index:
    """The index of the files below ``path``. Blank lines have no ordinal; an empty file has no checkpoint."""
    text = lines(spark, path)
    counts = text.groupBy("f", "block").agg(F.count("*").alias("lines"), F.count_if("full").alias("full"), F.sum(F.col("size") + 1).alias("bytes"))
    before = Window.partitionBy("f").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select("f", "block", "lines", "full", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("lines", "full", "bytes"))))
    entries = starts.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0]
    stride = stride_of(entries, most)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, entry, byte = None, 0, 0, 0
        for batch in batches:
            f, block, size, full, *at = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
            edges = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(f)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if now != (f[a], block[a]):
                    now, line, entry, byte = (f[a], block[a]), int(at[0][a]), int(at[1][a]), int(at[2][a])
                begins = byte + np.cumsum(size[a:b] + 1) - size[a:b] - 1
                ordinal = entry + np.cumsum(full[a:b]) - full[a:b]
                hit = np.flatnonzero(full[a:b] & (ordinal % stride == 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), f[a])), pa.array(ordinal[hit]), pa.array(line + hit + 1), pa.array(begins[hit])], names=["f", "ordinal", "source_line", "byte"])
                line, entry, byte = line + b - a, entry + int(full[a:b].sum()), byte + int((size[a:b] + 1).sum())

    small = starts.drop("lines", "full")
    # A row a split: if they are few, each task has them, and rows keep their order.
    if small.count() <= BROADCAST_SPLITS:
        both = text.join(F.broadcast(small), ["f", "block"])
    else:
        both = text.withColumn("at", F.monotonically_increasing_id()).join(small, ["f", "block"]).repartition("f", "block").sortWithinPartitions("f", "block", "at")
    both = both.select("f", "block", "size", "full", "lines_before", "full_before", "bytes_before")
    found = both.mapInArrow(of, "f long, ordinal long, source_line long, byte long")
    meta = F.col("_metadata")
    found_files = spark.read.format("binaryFile").load(path).select(F.xxhash64(meta["file_path"]).alias("f"), meta["file_path"].alias("file"), "length", F.unix_millis("modificationTime").alias("modified"))
    sums = starts.groupBy("f").agg(F.sum("full").alias("n"), F.sum("lines").alias("lines"))
    listed = written(found_files.join(sums, "f", "left").na.fill(0, ["n", "lines"]))
    named = found.join(listed.select("f", "file"), "f").select("file", "ordinal", "source_line", "byte")
    return Index(written(named), listed, stride, entries)


def located(index: Index, wanted: DataFrame) -> DataFrame:
    """``wanted`` (file, ordinal) with the checkpoint before each: its byte and line, and how many entries are to be passed over. Ordinals that no file has are left out only when they are read."""
    base = F.col("ordinal") - F.col("ordinal") % index.stride
    marks = index.checkpoints.select("file", F.col("ordinal").alias("base"), "byte", F.col("source_line").alias("line"))
    return wanted.select("file", "ordinal").where("ordinal >= 0").withColumn("base", base).join(marks, ["file", "base"]).withColumn("skip", F.col("ordinal") - F.col("base")).drop("base")


class Changed(OSError):
    """A file is not what it was when its index was made."""


def opened(file: str, length: int, modified: int):
    """The file, for ranged reads, if its size and time are those of the index."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    info = store.get_file_info(path)
    if info.size != length or (info.mtime_ns is not None and info.mtime_ns // 1_000_000 != modified):
        raise Changed(f"{file} has changed since it was indexed")
    return store.open_input_file(path)


def entries_from(source, byte: int, length: int) -> Iterator[tuple[bytes, int, int]]:
    """(entry, lines passed, bytes read so far) of each entry from a byte on, in order. Each byte is read once."""
    held, at, passed, read = b"", byte, 0, 0
    while at < length or held:
        chunk = source.read_at(min(CHUNK, length - at), at) if at < length else b""
        at, read = at + len(chunk), read + len(chunk)
        *lines_, held = (held + chunk).split(b"\n")
        for line in lines_:
            line = line.removesuffix(b"\r")
            if line.strip(b" \t\r"):
                yield line, passed, read
            passed += 1
        if not chunk:  # the file's last line, without an end
            if held.strip(b" \t\r"):
                yield held, passed, read
            return


def entries_at(index: Index, wanted: DataFrame) -> DataFrame:
    """file, ordinal, source_line, raw, bytes_read, error of the wanted entries (file, ordinal) that there are; a stride at most is read for each, and once for all that are wanted of it.

    ``error`` says that a file has changed. Paths must be ones that Arrow opens by themselves (a local or shared folder, HDFS, an object store).
    """
    listed = index.files.select("file", "length", "modified")
    rows = located(index, wanted).join(listed, "file").select("file", "ordinal", "byte", "line", "skip", "length", "modified")
    rows = rows.repartition("file", "byte").sortWithinPartitions("file", "byte", "skip")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file", "ordinal", "source_line", "raw", "bytes_read", "error"]
        now, source, rest, passed, last, error, out, held = None, None, iter(()), 0, None, None, [], 0
        for frame in frames:
            for file, ordinal, byte, line, skip, length, modified in frame.itertuples(index=False):
                try:
                    if now != (file, byte):
                        if source is not None:
                            source.close()
                        now, source, rest, passed, last, error = (file, byte), None, iter(()), 0, None, None
                        source = opened(file, length, modified)
                        rest = entries_from(source, byte, length)
                    while error is None and passed <= skip:
                        last, passed = next(rest, None), passed + 1
                except OSError as e:
                    error = str(e)
                if error is not None:
                    out.append((file, ordinal, None, None, 0, error))
                elif last is not None:
                    out.append((file, ordinal, line + last[1], last[0], last[2], None))
                    held += len(last[0])
                if held > HELD:
                    yield pd.DataFrame(out, columns=names).astype({"source_line": "Int64"})
                    out, held = [], 0
        if source is not None:
            source.close()
        yield pd.DataFrame(out, columns=names).astype({"source_line": "Int64"})

    return rows.mapInPandas(of, "file string, ordinal long, source_line long, raw binary, bytes_read long, error string")


def page(index: Index, file: str, after: int = -1, limit: int = 200) -> DataFrame:
    """The next entries of a file, at most 200."""
    spark = index.checkpoints.sparkSession
    n = min(limit, 200)
    wanted = spark.range(after + 1, after + 1 + n).select(F.lit(file).alias("file"), F.col("id").alias("ordinal"))
    return entries_at(index, wanted).orderBy("ordinal")
