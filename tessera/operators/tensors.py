"""Analytics of logits and hidden states: a row for each position, with the values as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats


def last_position(df: DataFrame, key: str, position: str, logits: str) -> DataFrame:
    """The logits of the last position of each sequence."""
    return df.groupBy(key).agg(F.max_by(logits, position).alias(logits))


def logit_statistics(df: DataFrame, key: str, logits: str) -> DataFrame:
    x, p = F.col(logits), F.col("p")
    with_p = df.select(key, logits, stats.softmax(x).alias("p"))
    h = stats.entropy(p)
    return with_p.select(key, stats.mean(x).alias("mean"), stats.std_pop(x).alias("std"), F.array_min(x).alias("min"), F.array_max(x).alias("max"), h.alias("entropy"), F.exp(h).alias("perplexity"), F.array_max(p).alias("max_prob"), stats.top_mass(p).alias("top5_prob_sum"))


def confidence(df: DataFrame, key: str, logits: str, method: str = "all") -> DataFrame:
    with_p = df.select(key, logits, stats.softmax(F.col(logits)).alias("p"))
    return with_p.select(key, *(c.alias(n) for n, c in stats.confidence(F.col(logits), F.col("p"), method).items()))


def top_tokens(df: DataFrame, key: str, logits: str, k: int = 10) -> DataFrame:
    """The k likeliest tokens of each row, ties by token. The array is ranked within its row, so nothing is shuffled."""
    with_p = df.select(key, logits, stats.softmax(F.col(logits)).alias("p"))
    entry = F.transform("p", lambda p, i: F.struct((-p).alias("minus"), i.alias("token_id"), F.element_at(logits, i + 1).alias("logit")))
    best = F.slice(F.array_sort(entry), 1, k)
    return with_p.select(key, F.posexplode(best).alias("rank", "t")).select(key, (F.col("rank") + 1).alias("rank"), "t.token_id", (-F.col("t.minus")).alias("prob"), "t.logit")


def token_surprisal(df: DataFrame, key: str, logits: str, target: str) -> DataFrame:
    return df.select(key, target, stats.surprisal(F.col(logits), F.col(target)).alias("surprisal"))


def perplexity(df: DataFrame, by: str, logits: str, target: str) -> DataFrame:
    return df.groupBy(by).agg(F.exp(F.avg(stats.surprisal(F.col(logits), F.col(target)))).alias("perplexity"), F.count("*").alias("n"))


def hidden_statistics(df: DataFrame, key: str, values: str) -> DataFrame:
    x = F.col(values)
    return df.select(key, F.size(x).alias("size"), stats.mean(x).alias("mean"), stats.std_samp(x).alias("std"), stats.norm2(x).alias("norm"), F.array_min(x).alias("min"), F.array_max(x).alias("max"))


def layer_progression(df: DataFrame, layer: str, logits: str, method: str = "all") -> DataFrame:
    """Confidence by layer; layers whose size isn't the last layer's go."""
    size = df.agg(F.max_by(F.size(logits), layer).alias("of_last"))
    return confidence(df.crossJoin(F.broadcast(size)).where(F.size(logits) == F.col("of_last")), layer, logits, method)


def trends(df: DataFrame, order: str, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """How each metric runs over ``order``: only with two values or more; no rise is ``decreasing``."""
    by = by or []
    long = df.unpivot([*by, order], metrics, "metric", "value").where("value IS NOT NULL")
    got = long.groupBy(*by, "metric").agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.stddev_pop("value").alias("std"), (F.max("value") - F.min("value")).alias("range"), F.count("*").alias("n")).where("n >= 2")
    ratio = F.when(F.col("first") == 0, F.lit(float("inf"))).otherwise(F.col("last") / F.when(F.col("first") != 0, F.col("first")))
    return got.select(*by, "metric", F.when(F.col("last") > F.col("first"), "increasing").otherwise("decreasing").alias("trend"), ratio.alias("change_ratio"), "std", "range")


def first_of(preferred: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All rows of ``preferred``, and those of ``other`` whose key it lacks."""
    return preferred.unionByName(other.join(preferred.select(key), key, "left_anti"))


# What names of transformer layers contain.
LAYER_PATTERNS = ["transformer.h", "transformer.layers", "encoder.layer", "decoder.layers", "model.layers", "blocks", "encoder.layers"]


def transformer_layers(modules: DataFrame, name: str) -> DataFrame:
    """Modules named like layers that hold attention, or both a feed-forward part and a norm; by the first number in the name."""
    parts = F.split(name, r"\.")
    at = F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("k")
    inner = modules.select(parts.alias("parts")).select("parts", at).select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ".").alias("of"), F.lower(F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), ".")).alias("rest"))
    has = inner.groupBy("of").agg(F.bool_or(F.col("rest").rlike("attention|attn")).alias("attention"), F.bool_or(F.col("rest").rlike("mlp|ffn|feed_forward")).alias("mlp"), F.bool_or(F.col("rest").contains("norm")).alias("norm"))
    number = F.regexp_extract("of", r"(?:^|\.)(\d+)(?:\.|$)", 1)
    named = F.arrays_overlap(F.array(F.lit(True)), F.array(*(F.col("of").contains(p) for p in LAYER_PATTERNS)))
    own = has.join(modules.select(F.col(name).alias("of")).distinct(), "of", "left_semi").where(named & (F.col("attention") | (F.col("mlp") & F.col("norm"))) & (number != ""))
    return own.select(F.col("of").alias(name), number.cast("int").alias("layer"))


# Architecture kinds by what a class name contains, in order.
ARCHITECTURES = (("gpt|causal", "causal_lm"), ("bert|encoder", "encoder"), ("t5|seq2seq", "seq2seq"), ("vit|vision", "vision_transformer"), ("clip", "multimodal"), ("blip", "vision_language"))


def architecture(class_name: Column) -> Column:
    lower = F.lower(class_name)
    return F.coalesce(*(F.when(lower.rlike(part), F.lit(kind)) for part, kind in ARCHITECTURES), F.lit("unknown"))


def full_analysis(logits: DataFrame, key: str, x: str, hidden: DataFrame | None = None, attention: DataFrame | None = None, k: int = 10) -> dict[str, DataFrame]:
    """By name the tables of a whole analysis: top tokens, statistics and confidence of logits, statistics of hidden states, patterns of attention, and a summary of one row.

    ``hidden``: layer, values; ``attention``: layer, batch, head, q, k, weight. Nothing runs until a table is used.
    """
    from tessera.operators import attention as att

    out = {"top_tokens": top_tokens(logits, key, x, k), "logit_statistics": logit_statistics(logits, key, x), "confidence": confidence(logits, key, x)}
    spark = logits.sparkSession
    layers = heads = spark.range(1).select(F.lit(0).cast("long").alias("n"))
    if hidden is not None:
        out["hidden"] = hidden_statistics(hidden, "layer", "values")
        layers = hidden.agg(F.count_distinct("layer").alias("n"))
    if attention is not None:
        out |= {"attention_heads": att.head_statistics(attention), "attention_entropy": att.entropy_distribution(attention), "sparsity": att.sparsity(attention), "diagonal": att.diagonal(attention), "locality": att.locality(attention), "head_similarity": att.head_similarity(attention)}
        heads = attention.agg(F.count_distinct("layer").alias("n"))
    number = lambda df, name: df.select(F.col("n").alias(name))
    out["summary"] = number(layers, "analyzed_layers").crossJoin(number(heads, "attention_layers")).withColumn("has_confidence_analysis", F.lit(True))
    return out


def layer_logits(hidden: DataFrame) -> DataFrame:
    """layer, logits: a layer's hidden values as they are, as no head for layers is given."""
    return hidden.select("layer", F.col("values").alias("logits"))


def each_or_none(df: DataFrame, key: str, column: str, of, kind: str) -> DataFrame:
    """key, output, error: ``of`` of each value, in Arrow batches; a value for which it fails has no output, and the others go on."""
    import pandas as pd

    key_kind = dict(df.select(key).dtypes)[key]

    def each(frames):
        for frame in frames:
            rows = []
            for own, value in zip(frame[key], frame[column], strict=True):
                try:
                    rows.append((own, of(value), None))
                except Exception as e:  # noqa: BLE001  whatever fails is that item's error
                    rows.append((own, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "output", "error"])

    return df.select(key, column).mapInPandas(each, f"{key} {key_kind}, output {kind}, error string")
