"""Headers of model files as rows: safetensors, GGUF, importance matrices. Spark's binaryFile reader lists the files.

A reader opens a file as a stream and reads on only as far as its header goes; weights are never read. A store that
the tasks can't open by themselves has its files' content read by Spark, which can't be more than CONTENT_MOST bytes.
"""

from __future__ import annotations

import io
import json
import math
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_LEAST, HEADER_MOST = 2, 25_000_000
MOST_DIMS, MOST_DEPTH, PREVIEW = 8, 4, 16
#: Most entries, tensors, array elements, bytes of a text, of a key and of a tensor's name of a GGUF file.
MOST_ENTRIES, MOST_TENSORS, MOST_ELEMENTS, MOST_TEXT, MOST_KEY, MOST_NAME = 100_000, 1_000_000, 1_000_000, 10 << 20, 65_535, 64
KEY = re.compile(r"[a-z0-9_]+(?:\.[a-z0-9_]+)*")
#: Most bytes, entries, bytes of a name and values of an importance matrix.
MATRIX_BYTES, MATRIX_ENTRIES, MATRIX_NAME, MATRIX_VALUES = 32 << 20, 100_000, 1024, 10_000_000
#: Fewer values than these numpy adds one after the other, as a loop does; an array costs more than they do.
FEW_VALUES = 8
#: Bytes that Spark holds of a file's content at most; bytes of a file that are read at once.
CONTENT_MOST, BLOCK = (1 << 31) - 1, 1 << 16
#: Rows that a task gives away at once.
ROWS = 20_000
#: Files of a folder's manifest, and bytes of a range, at most.
MANIFEST_MOST, RANGE_MOST = 100_000, 32 << 20
#: What a reader meets in a file that is damaged or can't be opened.
UNREADABLE = (ValueError, KeyError, TypeError, AttributeError, struct.error, OSError, NotImplementedError)
TENSORS = "path string, name string, dtype string, shape array<long>, parameters decimal(38,0), bytes decimal(20,0), offset decimal(20,0), error string"
# GGUF's scalar formats, and tensor types by number.
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
GGML = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 6: "Q5_0", 7: "Q5_1", 8: "Q8_0", 9: "Q8_1", 10: "Q2_K", 11: "Q3_K", 12: "Q4_K", 13: "Q5_K", 14: "Q6_K", 15: "Q8_K", 16: "IQ2_XXS", 17: "IQ2_XS", 18: "IQ3_XXS", 19: "IQ1_S", 20: "IQ4_NL", 21: "IQ3_S", 22: "IQ2_S", 23: "IQ4_XS", 24: "I8", 25: "I16", 26: "I32", 27: "I64", 28: "F64", 29: "IQ1_M", 30: "BF16"}


def files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path, length, content of each file; the content is null where the tasks can open the files by themselves."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    listed = found.select("path", "length", F.lit(None).cast("binary").alias("content"))

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            able = []
            for own in frame["path"]:
                try:
                    opened(own, None).close()
                    able.append(True)
                except UNREADABLE:
                    able.append(False)
            yield pd.DataFrame({"able": able})

    if all(r["able"] for r in listed.select("path").limit(1).mapInPandas(tried, "able boolean").collect()):
        return listed
    small = F.col("length") <= CONTENT_MOST
    return found.where(small).select("path", "length", "content").union(listed.where(~small))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path as Spark gives it, and the path there."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest, safe='/:@')}")


def opened(path: str, content: bytes | None):
    """A stream over a file's bytes, read in blocks as they are asked for."""
    if content is not None:
        return io.BytesIO(content)
    store, at = store_of(path)
    return store.open_input_stream(at, buffer_size=BLOCK)


def manifest(spark: SparkSession, folder: str, most: int = MANIFEST_MOST) -> DataFrame:
    """path (below the folder), file, size, modified of the files of a folder, at most ``most``; no content is read.

    Of more files there is an error. Spark lists no empty files.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    if listed.limit(most + 1).count() > most:
        raise ValueError(f"a folder has at most {most} files")
    return listed.select(F.element_at(F.split("file", re.escape(top), 2), -1).alias("path"), "file", "size", "modified")


def ranges(wanted: DataFrame, most: int = RANGE_MOST) -> DataFrame:
    """path, start, content, error of ranges of files (path, file, size, start, stop): just those bytes are read.

    Errors: changed (the file isn't of that size now), tooLarge (over ``most`` bytes), outside (of the file), unreadable. The whole file is its range from 0 to size.
    """

    def one(file: str, size: int, start: int, stop: int) -> tuple[bytes | None, str | None]:
        if not 0 <= start <= stop <= size:
            return None, "outside"
        if stop - start > most:
            return None, "tooLarge"
        store, at = store_of(file)
        if store.get_file_info(at).size != size:
            return None, "changed"
        with store.open_input_file(at) as source:
            own = source.read_at(stop - start, start)
        return (own, None) if len(own) == stop - start else (None, "changed")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, file, size, start, stop in frame.itertuples(index=False):
                try:
                    rows.append((path, start, *one(file, size, start, stop)))
                except UNREADABLE:
                    rows.append((path, start, None, "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "start", "content", "error"])

    return wanted.select("path", "file", "size", "start", "stop").mapInPandas(of, "path string, start long, content binary, error string")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row's content (path, content) to that path below a folder that tasks share, and gives their number. A file is there as a whole or not at all."""
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                store, at = store_of(f"{top}/{path}")
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                own = f"{at}.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(content)
                store.move(own, at)
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("path", "content").mapInPandas(of, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_by(of, path: str, length: int, content: bytes | None):
    """What ``of`` makes of a file, given as a Reader."""
    with opened(path, content) as stream:
        return of(Reader(stream, length))


def product(shape: list[int]) -> int:
    out = 1
    for n in shape:
        out *= n
    return out


def safetensors_rows(r: Reader) -> list[tuple]:
    size = r.take("Q")
    if not HEADER_LEAST <= size <= HEADER_MOST or 8 + size > r.length:
        raise ValueError("header size")
    out = []
    for name, t in json.loads(r.bytes(size)).items():
        if name == "__metadata__":
            continue
        start, end = t["data_offsets"]
        shape = [int(n) for n in t["shape"]]
        if start < 0 or end < start or min(shape, default=0) < 0:
            raise ValueError("offsets or shape")
        out.append((name, t["dtype"], shape, product(shape), end - start, start))
    return out


class Reader:
    """The values of a file in order. What the file is too short for is never asked of the stream."""

    def __init__(self, stream, length: int):
        self.stream, self.length, self.at, self.order, self.count, self.elements = stream, length, 0, "<", "Q", 0

    def bytes(self, n: int) -> bytes:
        if not 0 <= n <= min(self.length - self.at, CONTENT_MOST):
            raise ValueError("cut short")
        data = self.stream.read(n)
        if len(data) < n:
            raise ValueError("cut short")
        self.at += n
        return data

    def take(self, code: str):
        (value,) = struct.unpack(self.order + code, self.bytes(struct.calcsize(self.order + code)))
        return value

    def text(self, most: int = MOST_TEXT) -> str:
        n = self.take(self.count)
        if n > most:
            raise ValueError("text too long")
        return self.bytes(n).decode()

    def value(self, kind: int, depth: int = 0):
        if kind == 8:
            return self.text()
        if kind == 9:
            if depth >= MOST_DEPTH:
                raise ValueError("depth")
            inner, n = self.take("I"), self.take(self.count)
            self.elements += n
            if inner > 12 or self.elements > MOST_ELEMENTS:
                raise ValueError("array")
            found = []
            for k in range(n):
                v = self.value(inner, depth + 1)
                if k < PREVIEW:
                    found.append(v)
            return {"count": n, "first": found}
        if kind == 7:
            flag = self.take("B")
            if flag > 1:
                raise ValueError("boolean")
            return bool(flag)
        if kind > 9 and self.count == "I":
            raise ValueError("type")  # version 1 has no 64-bit values
        return self.take(SCALARS[kind])


def gguf_parts(r: Reader) -> tuple[list[tuple], list[tuple]]:
    """(metadata rows, tensor rows) of a GGUF directory; versions 1 to 3, the last also in big endian."""
    if r.bytes(4) != b"GGUF":
        raise ValueError("magic")
    four = r.bytes(4)
    (version,) = struct.unpack("<I", four)
    if not 1 <= version <= 3:
        r.order = ">"
        (version,) = struct.unpack(">I", four)
        if version != 3:
            raise ValueError("version")
    r.count = "I" if version == 1 else "Q"  # lengths, counts and dimensions
    tensors, entries = r.take(r.count), r.take(r.count)
    if tensors > MOST_TENSORS or entries > MOST_ENTRIES:
        raise ValueError("counts")
    meta: dict[str, object] = {}
    for _ in range(entries):
        key = r.text(MOST_KEY)
        kind = r.take("I")
        if key in meta or not KEY.fullmatch(key):
            raise ValueError("key")
        meta[key] = r.value(kind)
    alignment = meta.get("general.alignment", 32)
    alignment = alignment if type(alignment) is int and alignment >= 0 else 32
    if alignment == 0 or alignment % 8:
        raise ValueError("alignment")
    rows, names = [], set()
    for _ in range(tensors):
        name, dims = r.text(MOST_NAME), r.take("I")
        if dims > MOST_DIMS or not name or name in names:
            raise ValueError("dimensions or name")
        names.add(name)
        shape = [r.take(r.count) for _ in range(dims)]
        kind, offset = r.take("I"), r.take("Q")
        if offset % alignment:
            raise ValueError("offset")
        rows.append((name, GGML.get(kind, f"TYPE_{kind}"), shape, product(shape), None, offset))
    return [(k, json.dumps(v, ensure_ascii=False)) for k, v in meta.items()], rows


def value_range(data: bytes, n: int) -> tuple[float, float, float]:
    """(least, most, mean) of ``n`` little-endian floats."""
    if n >= FEW_VALUES:
        values = np.frombuffer(data, "<f4").astype(float)
        if not np.isfinite(values).all():
            raise ValueError("values")
        return float(values.min()), float(values.max()), float(values.mean())
    few = struct.unpack(f"<{n}f", data)
    if not all(map(math.isfinite, few)):
        raise ValueError("values")
    total = few[0]
    for v in few[1:]:
        total += v
    return min(few), max(few), total / n


def imatrix_parts(r: Reader) -> tuple[list[tuple], int | None, str | None]:
    """((name, calls, count, least, most, mean) of each entry, chunks, dataset) of a legacy importance matrix."""
    if r.length > MATRIX_BYTES:
        raise ValueError("file too large")
    entries = r.take("i")
    if not 1 <= entries <= MATRIX_ENTRIES:
        raise ValueError("entries")
    out, total = {}, 0
    for _ in range(entries):
        size = r.take("i")
        if not 1 <= size <= MATRIX_NAME:
            raise ValueError("name")
        name, (calls, n) = r.bytes(size).decode(), struct.unpack("<ii", r.bytes(8))
        if name in out or calls < 0 or not 1 <= n <= MATRIX_VALUES - total:
            raise ValueError("entry")
        total += n
        out[name] = name, calls, n, *value_range(r.bytes(4 * n), n)
    chunks = r.take("i") if r.at < r.length else None
    if chunks is not None and chunks < 0:
        raise ValueError("chunks")
    dataset = None
    if r.at < r.length:
        dataset = r.bytes(r.take("i")).decode() or None
        if r.at < r.length:
            raise ValueError("dataset")
    return [*out.values()], chunks, dataset


def read_files(frames: Iterator[pd.DataFrame], of, failed) -> Iterator[list[tuple]]:
    """What ``of`` makes of each file (path, length, content), or ``failed`` of a path and an error, ROWS rows at a time."""
    held: list[tuple] = []
    for frame in frames:
        for path, *own in zip(frame["path"], frame["length"], frame["content"], strict=True):
            try:
                held += of(path, *own)
            except UNREADABLE as e:
                held.append(failed(path, type(e).__name__ + ": " + str(e)))
            while len(held) >= ROWS:
                yield held[:ROWS]
                held = held[ROWS:]
    yield held


def tensors(binary: DataFrame, of=safetensors_rows) -> DataFrame:
    """A row for each tensor of each file, or one row with the error of a file that can't be read."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        whole = lambda v: None if v is None else Decimal(v)
        for rows in read_files(frames, lambda path, *own: [(path, *row, None) for row in read_by(of, path, *own)], lambda path, e: (path, *[None] * 6, e)):
            yield pd.DataFrame([(*r[:4], *map(whole, r[4:7]), r[7]) for r in rows], columns=[c.split()[0] for c in TENSORS.split(", ")])

    return binary.select("path", "length", "content").mapInPandas(each, TENSORS)


def gguf_tensors(binary: DataFrame) -> DataFrame:
    return tensors(binary, lambda r: gguf_parts(r)[1])


def gguf_metadata(binary: DataFrame) -> DataFrame:
    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in read_files(frames, lambda path, *own: [(path, k, v, None) for k, v in read_by(gguf_parts, path, *own)[0]], lambda path, e: (path, None, None, e)):
            yield pd.DataFrame(rows, columns=["path", "key", "value", "error"])

    return binary.select("path", "length", "content").mapInPandas(each, "path string, key string, value string, error string")


def imatrix(binary: DataFrame) -> DataFrame:
    """A row for each entry of each file, with the file's chunks and dataset, or one row with the error of a file that can't be read."""

    def entries_of(path: str, *own) -> list[tuple]:
        entries, chunks, dataset = read_by(imatrix_parts, path, *own)
        return [(path, *row, chunks, dataset, None) for row in entries]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in read_files(frames, entries_of, lambda path, e: (path, *[None] * 8, e)):
            yield pd.DataFrame(rows, columns=["path", "name", "calls", "n", "least", "most", "mean", "chunks", "dataset", "error"]).astype({c: "Int32" for c in ("calls", "n", "chunks")})

    return binary.select("path", "length", "content").mapInPandas(each, "path string, name string, calls int, n int, least double, most double, mean double, chunks int, dataset string, error string")
