"""Exact deduplication over keyed streaming state without expiry, with full bytes compared on hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, documents, fresh, looked_up, numbered, remove_at_exit, set_for_now, shared_dir, written

#: Settings of the keyed state: on disk in RocksDB, with small buffers, a bound on the memory of all stores of an
#: executor, and stores that are closed soon after their query has ended.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}
ENTRY = "digest binary, check long, n_bytes long, doc_id long, file long, row long"
KEY = ["digest", "check", "n_bytes"]
#: Stands for a null identifier, after all others.
LAST = 2**63 - 1


def normalised(text: Column | str) -> Column:
    """Each run of [\\x20\\x09-\\x0D] becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def entries(docs: DataFrame) -> DataFrame:
    """A small row for each document: digest, a second hash and length, stable identifier and content locator (a print of its file's path, its row there)."""
    path, row = fresh(docs, "path", "row")
    norm = F.col("norm")
    own = numbered(docs, path, row).select(F.col("doc_id").cast("long").alias("doc_id"), normalised("text").alias("norm"), F.xxhash64(path).alias("file"), F.col(row).alias("row"))
    return own.select(F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest"), F.xxhash64(norm).alias("check"), F.octet_length(norm).cast("long").alias("n_bytes"), "doc_id", "file", "row")


def feed(spark: SparkSession, source: str, state: str, files_a_batch: int) -> None:
    """Runs all files of entries below ``source`` that the state hasn't seen yet into the keyed state at ``state``.

    The state has of each digest, for ever, the smallest identifier with its locator and the number of rows. Rows of
    one digest are combined within each task before the shuffle, so a hot digest sends one row a task. A stopped
    or failed run goes on where the checkpoint left off.
    """
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "file", "row")).alias("first")
    keyed = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_a_batch).parquet(source).groupBy(*KEY).agg(first, F.count("*").alias("n"))
    with set_for_now(spark, STATE_CONF):
        keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def seen(spark: SparkSession, state: str) -> DataFrame:
    """The keyed state as a table: digest, check, n_bytes, first (id, file, row), n."""
    with set_for_now(spark, STATE_CONF):
        kept = spark.read.format("statestore").load(state)
    # By position: the state names its fields after the functions that fill them.
    return kept.select(F.col("key").cast("struct<digest:binary,check:long,n_bytes:long>").alias("k"), F.col("value").cast("struct<first:struct<id:long,file:long,row:long>,n:long>").alias("v")).select("k.*", "v.*")


def groups(docs: DataFrame, batches: int = 2) -> tuple[DataFrame, DataFrame]:
    """(entries, hits): a row for each document; a row for each group of two or more documents of the same bytes, with the one that stays."""
    spark = docs.sparkSession
    source, state = f"{shared_dir(spark)}/entries", f"{shared_dir(spark)}/state"
    entries(docs).write.parquet(source)
    remove_at_exit(spark, source)
    remove_at_exit(spark, state)
    own = spark.read.schema(ENTRY).parquet(source)
    files = len(own.inputFiles())
    if not files:
        return own, own.selectExpr(*KEY, "0L AS size", "named_struct('id', doc_id, 'file', file, 'row', row) AS first")
    feed(spark, source, state, max(1, -(-files // batches)))
    hits = written(seen(spark, state).where("n > 1"))
    # On hits the full bytes are compared: all rows of a state's key must be of one text.
    norm = docs.select(normalised("text").alias("norm")).select("norm", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"))
    same = norm.join(bounded(hits.select("digest")), "digest", "left_semi").groupBy("digest", "norm").agg(F.count("*").alias("size"))
    agreed = same.select("digest", F.xxhash64("norm").alias("check"), F.octet_length("norm").cast("long").alias("n_bytes"), "size")
    sure = F.when(F.col("n") == F.col("size"), F.col("size")).otherwise(F.raise_error(F.lit("texts of one digest differ")).cast("long"))
    return own, written(agreed.join(bounded(hits), KEY).select(*KEY, sure.alias("size"), "first"))


def placed(docs: DataFrame, batches: int) -> DataFrame:
    """The entries of ``docs`` with keep_id, size and kept."""
    own, hits = groups(docs, batches)
    both = looked_up(own, hits, KEY)
    keep_id = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("first.id"), F.lit(LAST)))
    kept = F.col("first").isNull() | ((F.col("first.file") == F.col("file")) & (F.col("first.row") == F.col("row")))
    return both.select(*own.columns, keep_id.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("size"), kept.alias("kept"))


def exact_groups(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs``, also of those that go.

    ``docs``: doc_id, text; other columns don't matter. Texts are equal when identical after each run of blanks
    became one space; a null text is the empty one. Of equal texts the row with the smallest doc_id stays, a null
    doc_id after all others; of rows that also repeat the doc_id, the first by content locator, so exactly one
    row of a group stays. Which row stays is read from the keyed state. An empty table gives no rows.
    """
    return placed(docs, batches).select("doc_id", "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, of one text as for exact_groups.

    Rows are told apart by their locators, so of repeated rows one stays, too. A null text is the empty one; other
    columns pass through, whatever their names; an empty table gives no rows.
    """
    path, row, gone_file, gone_row = fresh(docs, "path", "row", "gone_file", "gone_row")
    own = numbered(docs, path, row)
    # Read from files, or else written once for both uses.
    gone = written(placed(own.drop(path, row), 2).where("not kept").select(F.col("file").alias(gone_file), F.col("row").alias(gone_row)))
    return own.join(bounded(gone), (F.xxhash64(path) == F.col(gone_file)) & (F.col(row) == F.col(gone_row)), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size::bigint AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
