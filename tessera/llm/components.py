"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import looked_up, written


def stars(directed: DataFrame, larger: bool) -> DataFrame:
    """Ties neighbours of each node to the smallest of them (or the node): the larger ones, or the smaller ones and the node itself."""
    low = written(directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
    both = looked_up(directed, low, ["u"], "inner")
    tied = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if larger else both.where("v < u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.where("m < u").select("u", "m"))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) for each node ``a`` that isn't the smallest of its component ``b``.

    ``edges``: two long columns; loops and repeats are allowed. Every round is two aggregations by node with map-side
    combining, and joins with their results by broadcast or salted, written to the shared folder; no node's
    neighbours meet in one task.
    """
    a, b = edges.columns
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = print_of(now)
    for _ in range(rounds):
        if not last[0]:
            return now
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = stars(both, True)
        now = written(stars(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False))
        mark = print_of(now)
        if mark == last:
            return now
        last = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
