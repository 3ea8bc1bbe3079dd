"""Helpers that the corpus operators share: words, memo tables, shared folders, joins with a size check.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split()`` gives.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker's memo of words holds before it is emptied; words longer than LONG_WORD aren't kept.
MEMO_ENTRIES, LONG_WORD = 200_000, 64
#: A side of a join is broadcast only if it has at most this many rows and its files this many bytes; beyond that Spark joins by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
#: Bytes of text that a worker is sent at once: 10,000 texts, Spark's measure of a batch, are there several times, in Spark's own memory and in the worker's.
BATCH = 4 << 20
#: Tasks that the rows of one key are dealt to where both sides of a join are shuffled.
SALTS = 16


class Memo(dict):
    """What ``of`` makes of a word, kept for the words seen lately. Holds a bounded number of short words."""

    def __init__(self, of: Callable[[bytes], object], entries: int = MEMO_ENTRIES):
        super().__init__()
        self.of, self.entries = of, entries

    def __missing__(self, word):
        value = self.of(word)
        if len(word) <= LONG_WORD:
            if len(self) >= self.entries:
                self.clear()
            self[word] = value
        return value


#: 64-bit hash of a word, kept in each worker.
HASHES = Memo(xxhash.xxh64_intdigest)


def word_hashes(text: bytes) -> np.ndarray:
    """The 64-bit hash of each word of a text, in order."""
    words = text.split()
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(where each text's words begin, each word's number, the distinct words) of an Arrow array of strings or bytes without nulls."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string(), safe=False) if pa.types.is_binary(texts.type) or pa.types.is_string(texts.type) else texts)
    flat = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy().astype(np.int64)
    at, ids = at - at[0], flat.indices.to_numpy()
    words = flat.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in words:  # what stands before a leading blank or after a trailing one
        real = ids != words.index(b"")
        at, ids = np.concatenate([[0], np.cumsum(real)])[at], ids[real]
    return at, ids, words


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` successive values; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def utf8(text: Column | str) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def id_remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the identifier written as text, modulo ``modulus``; a null identifier counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names. Where that is unset, a local master gets a temporary folder; a cluster, whose machines share none, gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session has ended; the folder is the cluster's to clean
            pass

    atexit.register(remove)


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and a lost executor loses none of it. ``options``: of the writer."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def set_for_now(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession):
    """As long as this holds, workers of the jobs that run are sent BATCH bytes at once."""
    return set_for_now(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH)})


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of rows that the driver holds. It is handed over in Arrow's form: of tuples Spark makes rows in Python workers of their own, which stay in each executor beside those of the operators."""
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes of files, else as it is. ``df`` is a written table: its footers and its folder are looked at."""
    return F.broadcast(df) if is_bounded(df, rows, size) else df


def is_bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength() > size:
            return False
    return df.count() <= rows


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with what ``right``, a written table with a row a key, has of each key.

    ``right`` is broadcast if it is bounded; else both are shuffled, a key's rows of ``left`` going to SALTS tasks.
    """
    if is_bounded(right):
        return left.join(F.broadcast(right), keys, how)
    (salt,) = fresh(left, "salt")
    salted = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*keys, salt], how).drop(salt)


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` if its rows come straight from files, else written: its rows and partitions are the same whenever they are read."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return docs if plan.getClass().getSimpleName() == "LogicalRelation" else written(docs)


def numbered(docs: DataFrame, file: str, row: str) -> DataFrame:
    """``docs`` with two more columns that tell its rows apart, the same whenever they are read: the path of a row's file and its number there.

    Rows that don't come straight from files are written first.
    """
    docs = stable(docs)
    place = docs.metadataColumn("_metadata")
    return docs.withColumns({file: place.getField("file_path"), row: place.getField("row_index")})


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What operators keep in a worker beyond a task: vocabularies by name.
KEPT: list[dict] = []


def alone(own: dict | None = None) -> None:
    """At the start of a task: forgets the vocabularies that other operators have left in this worker."""
    for other in KEPT:
        if other is not own:
            other.clear()
    if own is not None and not any(own is x for x in KEPT):
        KEPT.append(own)


def give_back(*known: dict) -> None:
    """At the end of a task: forgets the words that a worker knows and hands its memory back to the system, as workers outlive their tasks."""
    for words in (HASHES, *known):
        words.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of a column, and memory given back at the end."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(batch.column(column).nbytes, 1)))
        yield from (batch.slice(at, step) for at in range(0, batch.num_rows, step))
    give_back()


def chunks(batches: Iterator, size: int = 32 << 20, column: str = "text") -> Iterator[tuple[dict[str, list], int]]:
    """The rows of Arrow batches as lists by column, gathered until ``size`` bytes of ``column`` are there. Vocabularies that other operators have left in this worker are forgotten."""
    alone()
    rows: dict[str, list] = {}
    held = 0
    for batch in batches:
        nbytes = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, int(batch.num_rows * size / max(nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            piece = batch.slice(at, step)
            for name, values in piece.to_pydict().items():
                rows.setdefault(name, []).extend(values)
            held += sum(map(len, filter(None, rows[column][-piece.num_rows :])))
            if held >= size:
                yield rows, held
                rows, held = {}, 0
    if rows and next(iter(rows.values())):
        yield rows, held
    give_back()


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is: ``name`` itself if it is a path, else the place the package public_tokenizers gives."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
