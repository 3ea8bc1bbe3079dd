"""JSONL files as entries with the numbers of their lines, and routing of files by name and content."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import strict_json
from tessera.functions.text import SURROGATE, is_json, n_json_texts, surely_json

UNSUPPORTED = ["jsonc", "json5", "gz", "zst"]
#: Lines and bytes that unknown files are judged by.
SAMPLE_LINES, SAMPLE_BYTES = 200, 8 << 20


def entries(spark: SparkSession, path: str) -> DataFrame:
    """file, source_line (from 1), ordinal (from 0, blank lines left out), raw (binary) of each entry.

    Bytes stay as they are, also those that aren't UTF-8. A CR before a line feed goes; one at the end of a file stays.
    A last line has no line feed if the lines and one each are a byte more than the file. Rows of a split are read in order by one task, so their running ids, before and after blank lines are dropped, less
    the split's first ones are their places in it. What is shuffled is a row a split; the lines stay where they are.
    """
    text = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_size").alias("file_size"), F.octet_length("value").alias("size"), "value")
    full = text.where(~F.rlike("value", F.lit(r"^[ \t\r]*$"))).withColumn("full_at", F.monotonically_increasing_id())
    lines = text.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.sum(F.col("size").cast("long") + 1).alias("bytes"), F.first("file_size").alias("file_size"))
    entries_ = full.groupBy("file", "block").agg(F.count("*").alias("n_full"), F.min("full_at").alias("first_full"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    open_end = (F.sum("bytes").over(whole) == F.col("file_size") + 1) & (F.col("block") == F.max("block").over(whole))
    offsets = lines.join(entries_, ["file", "block"], "left").select("file", "block", "first", "first_full", F.when(open_end, F.col("last")).alias("unended"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"), F.coalesce(F.sum("n_full").over(before), F.lit(0)).alias("full"))
    both = full.join(offsets, ["file", "block"])
    raw = F.col("value").cast("binary")
    returned = (F.expr("substring(cast(value AS binary), -1, 1)") == F.unhex(F.lit("0D"))) & (F.col("unended").isNull() | (F.col("at") != F.col("unended")))
    own = F.when(returned, F.expr("substring(cast(value AS binary), 1, size - 1)")).otherwise(raw)
    return both.select("file", (F.col("lines") + F.col("at") - F.col("first") + 1).alias("source_line"), (F.col("full") + F.col("full_at") - F.col("first_full")).alias("ordinal"), own.alias("raw"))


def oversized_preview(df: DataFrame, raw: str, most: int, preview: int = 64 << 10) -> DataFrame:
    """``df`` with the first and last bytes of entries of more than ``most`` bytes; nulls for the others."""
    big = F.octet_length(raw) > most
    return df.withColumns({"head": F.when(big, F.substring(raw, 1, preview)), "tail": F.when(big, F.expr(f"substring(`{raw}`, -{preview}, {preview})"))})


def page(df: DataFrame, after: int = -1, limit: int = 200) -> DataFrame:
    return df.where(F.col("ordinal") > after).orderBy("file", "ordinal").limit(min(limit, 200))


@F.pandas_udf(T.BooleanType())
def concatenated(samples: pd.Series) -> pd.Series:
    """Whether a line has a JSON value right after another."""

    def of(lines) -> bool | None:
        for line in lines if lines is not None else ():
            try:
                strict_json.nodes(line)
            except strict_json.Bad as e:
                if e.code == "trailing_data" and line[e.at] in '{["-0123456789tfn':
                    return True
        return None if lines is None else False

    return pd.Series([of(lines) for lines in samples], dtype="object")


def routes(files: DataFrame) -> DataFrame:
    """path, route of files (path, content): Document, Collection, Entry or Unsupported, by name, else by content; Choice where neither says."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.substring("content", 1, SAMPLE_BYTES)
    wide = F.rlike(F.hex(F.substring("content", 1, 4)), F.lit("^(FFFE|FEFF|0000FEFF)"))
    framed = F.rlike(head.cast("string"), F.lit(r"(?md)^\x1E"))
    text = F.try_validate_utf8(head.cast("string"))
    whole = F.coalesce(is_json(text), F.lit(False))
    array = F.rlike(text, F.lit(r"^\x{FEFF}?\s*\["))
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), 1, SAMPLE_LINES)
    sure = F.forall(lines, lambda x: surely_json(x) & ~F.rlike(x, F.lit(SURROGATE)))
    document = F.when(array, "Collection").otherwise("Document")
    open_ = ~(ext.isin(*UNSUPPORTED, "jsonl", "ndjson", "json") | wide | framed | whole)
    # Lines of which Spark's parser is not sure go to the strict reader.
    good = F.when(sure, F.size(lines)).otherwise(n_json_texts(F.when(open_ & ~sure, lines)))
    looks_lines = (F.size(lines) >= 2) & (good * 10 >= F.size(lines) * 9)
    joined = F.coalesce(concatenated(F.when(open_, lines)), F.lit(False))
    route = F.when(ext.isin(UNSUPPORTED) | wide | framed, "Unsupported").when(ext.isin("jsonl", "ndjson"), "Entry").when(ext == "json", document).when(whole, document).when(joined, "Unsupported").when(looks_lines, "Entry").otherwise("Choice")
    return files.select("path", route.alias("route"))


def chosen(routes_: DataFrame, mode: str | None) -> DataFrame:
    """``routes_`` with the route that a wanted mode (Document or Entry) gives, and an error where it can't be had.

    What is unsupported stays so. A name that says a mode can't get another; a mode can be chosen only where
    name and content leave it open, that is for files of other names whose content is neither.
    """
    if mode is None:
        return routes_.withColumn("error", F.lit(None).cast("string"))
    if mode not in ("Document", "Collection", "Entry"):
        raise ValueError("mode is Document, Collection or Entry")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    named = F.when(ext.isin("jsonl", "ndjson"), "Entry").when(ext == "json", "Document")
    wanted = F.lit(mode)
    refused = F.when(F.col("route") == "Unsupported", F.lit(None)).when(named.isNotNull(), F.when(named != wanted, "conflict")).when((F.col("route") != "Choice") | F.lit(mode == "Collection"), "not allowed")
    return routes_.withColumns({"route": F.when((F.col("route") == "Choice") & refused.isNull(), wanted).otherwise(F.col("route")), "error": refused})


def unchanged(files: DataFrame, before: DataFrame) -> DataFrame:
    """path, current of the files listed before (path, length, modificationTime): whether each is still of that size and time."""
    now = files.select("path", F.col("length").alias("length_now"), F.col("modificationTime").alias("time_now"))
    return before.join(now, "path", "left").select("path", F.coalesce((F.col("length") == F.col("length_now")) & (F.col("modificationTime") == F.col("time_now")), F.lit(False)).alias("current"))


def many_invalid(df: DataFrame, raw: str) -> DataFrame:
    """One row: entries, those that aren't UTF-8, and whether these are over a fifth."""
    got = df.agg(F.count("*").alias("n"), F.count_if(~F.is_valid_utf8(F.col(raw).cast("string"))).alias("invalid"))
    return got.withColumn("many", F.col("invalid") * 5 > F.col("n"))
