"""Documents to training sequences: quality rules, exact dedup, near dedup, mixing, packing.

Each stage reads what the one before wrote. All but the last return the columns of documents; the mixing stage
returns a document as often as the mix takes it, in the order of training, and the packing stage keeps that order
between runs of documents. Columns other than doc_id, text and source pass through, whatever their names; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, mixing, near_dedup, packing, quality
from tessera.llm.common import written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null, empty or blank text fails; rows that repeat have one verdict."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of one text (runs of blanks are one space, null is empty) the one with the smallest doc_id, a null one last; of rows that repeat it, one."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links of a Jaccard similarity of 0.80 or more the one with the smallest doc_id. Rows without a doc_id or without words stay."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training. A null source is one, the last; texts without words are never taken."""
    return mixing.training_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens. A null or empty text is the end id alone; rows that repeat are documents of their own."""
    return packing.pack(docs, ordered=True)


STAGES = [("quality rules", good), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: The tokenisers, the mix and the packing have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
