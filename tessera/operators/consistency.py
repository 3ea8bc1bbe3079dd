"""Rules over the materials of model repositories: identity, findings, coverage, badge.

Materials are rows (repo, kind, state, value, reason): kind is one of KINDS, state missing, available, skipped or
failed, value JSON. One aggregation makes a wide row for each repository; rules are columns over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Materials in order, what the badge needs, and which fields identify a model by which keys.
KINDS = ["config", "generationConfig", "tokenizerConfig", "tokenizer", "adapterConfig", "processorConfig", "chatTemplates", "gguf"]
NEEDED = ["config", "tokenizerConfig", "tokenizer", "chatTemplates"]
IDENTITY = {"layers": ["num_hidden_layers", "n_layer", "num_layers"], "hidden_size": ["hidden_size", "n_embd", "d_model"], "vocab_size": ["vocab_size"], "context": ["max_position_embeddings", "max_sequence_length", "n_positions"], "num_experts": ["num_experts"], "num_experts_per_tok": ["num_experts_per_tok"]}


def wide(materials: DataFrame) -> DataFrame:
    """repo and, for each kind, its value (where available) and state; a kind without a row is missing."""
    cols = [c for k in KINDS for c in (F.max(F.when((F.col("kind") == k) & (F.col("state") == "available"), F.col("value"))).alias(k), F.coalesce(F.max(F.when(F.col("kind") == k, F.col("state"))), F.lit("missing")).alias(f"{k}_state"))]
    return materials.groupBy("repo").agg(*cols)


def unsigned(json: Column, *keys: str) -> Column:
    """The first of the keys that is a whole number of 0 or more."""
    values = [F.get_json_object(json, f"$.{k}") for k in keys]
    return F.coalesce(*(F.when(F.rlike(v, F.lit(r"^\d{1,18}$")), v.try_cast("long")) for v in values))


def ids(json: Column, key: str) -> Column:
    """A token id or an array of them as a sorted set; null if it isn't that."""
    v = F.get_json_object(json, f"$.{key}")
    one = F.when(F.rlike(v, F.lit(r"^\d{1,18}$")), F.array(v.try_cast("long")))
    many = F.when(F.rlike(v, F.lit(r"^\[\s*\d{1,18}(\s*,\s*\d{1,18})*\s*\]$")), F.from_json(v, "array<bigint>"))
    return F.array_sort(F.array_distinct(F.coalesce(one, many)))


def identity(materials: DataFrame) -> DataFrame:
    """repo, field, value in the order of the fields."""
    config, w = F.col("config"), wide(materials)
    architecture = F.coalesce(F.get_json_object(config, "$.architectures[0]"), F.nullif(F.get_json_object(config, "$.model_type"), F.lit("")))
    rows = [F.struct(F.lit(0).alias("place"), F.lit("architecture").alias("field"), architecture.alias("value"))]
    rows += [F.struct(F.lit(k + 1).alias("place"), F.lit(name).alias("field"), unsigned(config, *keys).cast("string").alias("value")) for k, (name, keys) in enumerate(IDENTITY.items())]
    rows += [F.struct(F.lit(10 + k).alias("place"), F.lit(key).alias("field"), F.nullif(F.get_json_object("adapterConfig", f"$.{key}"), F.lit("")).alias("value")) for k, key in enumerate(("peft_type", "base_model_name_or_path"))]
    return w.select("repo", F.explode(F.array(*rows)).alias("f")).select("repo", "f.*").where("value IS NOT NULL")


def findings(materials: DataFrame) -> DataFrame:
    """repo, place, id, severity, left, right of each rule that a repository breaks, in the order of the rules."""
    w = wide(materials)
    vocab, tok_vocab = unsigned(F.col("config"), "vocab_size"), unsigned(F.col("tokenizer"), "vocab_count")
    read = F.col("tokenizerConfig").isNotNull()
    class_ = F.get_json_object("tokenizerConfig", "$.tokenizer_class")
    template = F.get_json_object("chatTemplates", "$.active")
    eos, tok_eos = ids(F.col("generationConfig"), "eos_token_id"), F.coalesce(ids(F.col("tokenizerConfig"), "eos_token_id"), ids(F.col("tokenizer"), "eos_token_id"))
    context, tok_context = unsigned(F.col("config"), *IDENTITY["context"]), unsigned(F.col("tokenizerConfig"), "model_max_length")
    gguf_context, gguf_vocab = unsigned(F.col("gguf"), "context_length"), unsigned(F.col("gguf"), "vocabulary")
    rules = [
        ("vocab-mismatch", "warning", vocab != tok_vocab, vocab, tok_vocab),
        ("missing-tokenizer-class", "warning", read & (F.coalesce(F.trim(class_), F.lit("")) == ""), F.lit(None), F.lit(None)),
        ("missing-chat-template", "info", F.col("chatTemplates").isNotNull() & (F.coalesce(F.trim(template), F.lit("")) == ""), F.lit(None), F.lit(None)),
        ("eos-mismatch", "warning", eos != tok_eos, F.array_join(eos.cast("array<string>"), ","), F.array_join(tok_eos.cast("array<string>"), ",")),
        ("context-info", "info", context != tok_context, context, tok_context),
        ("gguf-context-mismatch", "warning", context != gguf_context, context, gguf_context),
        ("gguf-vocab-mismatch", "warning", tok_vocab != gguf_vocab, gguf_vocab, tok_vocab),
        ("missing-config", "info", F.col("config_state") == "missing", F.lit(None), F.lit(None)),
    ]
    rows = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(k).alias("place"), F.lit(name).alias("id"), F.lit(severity).alias("severity"), a.cast("string").alias("left"), b.cast("string").alias("right"))) for k, (name, severity, broken, a, b) in enumerate(rules)]
    return w.select("repo", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("repo", "f.*")


def coverage(materials: DataFrame) -> DataFrame:
    """repo, place, kind, state (checked for available) of all kinds."""
    rows = [F.struct(F.lit(k).alias("place"), F.lit(name).alias("kind"), F.when(F.col(f"{name}_state") == "available", "checked").otherwise(F.col(f"{name}_state")).alias("state")) for k, name in enumerate(KINDS)]
    return wide(materials).select("repo", F.explode(F.array(*rows)).alias("f")).select("repo", "f.*")


def badge(materials: DataFrame) -> DataFrame:
    """repo, warnings, badge: warnings if there are some, consistent if all needed materials were read, else insufficient."""
    warned = findings(materials).where("severity = 'warning'").groupBy("repo").agg(F.count("*").alias("warnings"))
    whole = F.lit(True)
    for k in NEEDED:
        whole = whole & (F.col(f"{k}_state") == "available")
    own = wide(materials).select("repo", whole.alias("whole")).join(warned, "repo", "left")
    return own.select("repo", F.coalesce("warnings", F.lit(0)).cast("long").alias("warnings"), F.when(F.coalesce("warnings", F.lit(0)) > 0, "warnings").when(F.col("whole"), "consistent").otherwise("insufficient").alias("badge"))
