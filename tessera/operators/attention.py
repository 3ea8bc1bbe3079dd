"""Attention statistics over long rows: layer, batch, head, q, k, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stats import EPSILON

W = "weight"


def diagonal_cell():
    return F.col("q") == F.col("k")


def ratio(a, b):
    return F.when(b != 0, a / b)


def mean_pattern(att: DataFrame) -> DataFrame:
    return att.groupBy("layer", "q", "k").agg(F.avg("weight").alias("weight"))


def row_entropies(att: DataFrame) -> DataFrame:
    """The entropy of each row of weights over k; a second pass over the grouped rows gives the sum that makes them add to 1."""
    row = ["layer", "batch", "head", "q"]
    p = F.col(W) + EPSILON
    # -sum(p/s ln(p/s)) = ln s - sum(p ln p) / s, in one aggregation.
    got = att.groupBy(*row).agg(F.sum(p).alias("s"), F.sum(p * F.log(p)).alias("t"))
    return got.select(*row, (F.log("s") - F.col("t") / F.col("s")).alias("entropy"))


def head_statistics(att: DataFrame) -> DataFrame:
    by = ["layer", "head"]
    own = att.groupBy(*by).agg(F.avg(W).alias("mean"), F.stddev_pop(W).alias("std"), F.max(W).alias("max"))
    return own.join(row_entropies(att).groupBy(*by).agg(F.avg("entropy").alias("entropy")), by)


def entropy_distribution(att: DataFrame) -> DataFrame:
    return row_entropies(att).groupBy("layer").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("std"), F.min("entropy").alias("min"), F.max("entropy").alias("max"))


def sparsity(att: DataFrame, threshold: float = 0.1) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0).cast("double"))
    return att.groupBy("layer").agg(share(F.col(W) < F.lit(threshold)).alias("below"), share(F.col(W) > F.lit(threshold)).alias("above"))


def diagonal(att: DataFrame) -> DataFrame:
    """Both measures of dominance: over all weights, and over those off the diagonal (infinite where these are none)."""
    own, off = F.when(diagonal_cell(), F.col(W)), F.when(~diagonal_cell(), F.col(W))
    got = att.groupBy("layer").agg(F.avg(own).alias("mean"), F.stddev_pop(own).alias("std"), F.avg(W).alias("of_all"), F.avg(off).alias("off"))
    infinite = F.when(F.coalesce("off", F.lit(0.0)) > 0, F.col("mean") / F.col("off")).otherwise(F.lit(float("inf")))
    return got.select("layer", "mean", "std", ratio(F.col("mean"), F.col("of_all")).alias("dominance_vs_all"), infinite.alias("dominance_vs_offdiag"))


def locality(att: DataFrame, reach: int = 2) -> DataFrame:
    near = F.sum(F.when(F.abs(F.col("q") - F.col("k")) <= reach, F.col(W)).otherwise(0.0))
    return att.groupBy("layer").agg(ratio(near, F.sum(W)).alias("locality"))


def head_similarity(att: DataFrame) -> DataFrame:
    """Mean and deviation of the correlations of each two heads' weights (batch 0), and the number of pairs.

    No pair of heads is made: with z the standardised weights of a head of n cells, the correlation of two heads is z.z'/n.
    Over all pairs the sum of these follows from the sum of the z, and the sum of their squares from the sum of
    the products of each two cells, which every task adds up for its own heads. Heads without variance have none.
    """
    head = att.where("batch = 0").groupBy("layer", "head").agg(F.array_sort(F.collect_list(F.struct("q", "k", "weight"))).alias("cells"), F.avg(W).alias("mean"), F.stddev_pop(W).alias("std")).where("std > 0")
    z = head.select("layer", F.size("cells").alias("n"), F.transform("cells", lambda c: (c["weight"] - F.col("mean")) / F.col("std")).alias("z"))
    each = z.select("layer", "n", "z", F.posexplode("z").alias("i", "a")).select("layer", "n", "i", "a", F.posexplode("z").alias("j", "b")).where("i <= j")
    products = each.groupBy("layer", "n", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"), F.sum(F.when(F.col("i") == F.col("j"), F.col("a"))).alias("s"), F.count("*").alias("heads"))
    square = F.col("g") * F.col("g") * F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    whole = products.groupBy("layer", "n").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum(square).alias("g2"), F.max("heads").alias("heads"))
    # A head's correlation with itself is 1; the others are there twice.
    heads, n = F.col("heads"), F.col("n")
    pairs = whole.withColumns({"pairs": heads * (heads - 1) / 2, "sum": (F.col("s2") / n - heads) / 2, "squares": (F.col("g2") / (n * n) - heads) / 2}).where("pairs > 0")
    got = pairs.groupBy("layer").agg(F.sum("sum").alias("sum"), F.sum("squares").alias("squares"), F.sum("pairs").alias("pairs"))
    mean = F.col("sum") / F.col("pairs")
    return got.select("layer", mean.alias("mean"), F.sqrt(F.greatest(F.col("squares") / F.col("pairs") - mean * mean, F.lit(0.0))).alias("std"), F.col("pairs").cast("long").alias("pairs"))


def token_attribution(att: DataFrame) -> DataFrame:
    """By position of the mean pattern: attention to itself, coming in (column) and going out (row); one pass."""
    ends = F.explode(F.array(F.struct(F.col("q").alias("position"), F.lit(True).alias("row")), F.struct(F.col("k").alias("position"), F.lit(False).alias("row"))))
    long = mean_pattern(att).select("layer", "q", "k", "weight", ends.alias("e"))
    at = F.col("e.position")
    return long.groupBy("layer", at.alias("position")).agg(F.sum(F.when(diagonal_cell() & F.col("e.row"), F.col(W)).otherwise(0.0)).alias("itself"), F.sum(F.when(~F.col("e.row"), F.col(W)).otherwise(0.0)).alias("incoming"), F.sum(F.when(F.col("e.row"), F.col(W)).otherwise(0.0)).alias("outgoing"))
