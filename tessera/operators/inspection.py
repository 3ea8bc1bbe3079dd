"""Inspection of tokenizer and configuration files (JSON texts), node tables and GGUF metadata; pages by keyset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import bounded_value


def tokenizer_structure(df: DataFrame, key: str, tokenizer: str) -> DataFrame:
    """key, version, model_type, vocab_count, merge_count, added_count of tokenizer.json texts."""
    get = lambda path: F.get_json_object(tokenizer, path)
    vocab = get("$.model.vocab")
    count = F.coalesce(F.size(F.json_object_keys(vocab)), F.json_array_length(vocab))
    size = lambda path: F.coalesce(F.json_array_length(get(path)), F.lit(0))
    return df.select(key, get("$.version").alias("version"), get("$.model.type").alias("model_type"), count.cast("long").alias("vocab_count"), size("$.model.merges").cast("long").alias("merge_count"), size("$.added_tokens").cast("long").alias("added_count"))


def vocabulary_rows(df: DataFrame, key: str, tokenizer: str) -> DataFrame:
    """key, token_id, token, scalar_length of either form of vocabulary: ids by piece, or pieces with scores in order."""
    vocab = F.get_json_object(tokenizer, "$.model.vocab")
    by_piece = F.transform(F.map_entries(F.from_json(F.when(F.startswith(vocab, F.lit("{")), vocab), "map<string,bigint>")), lambda e: F.struct(e["value"].alias("token_id"), e["key"].alias("token")))
    in_order = F.transform(F.from_json(F.when(F.startswith(vocab, F.lit("[")), vocab), "array<array<string>>"), lambda e, i: F.struct(i.cast("long").alias("token_id"), e[0].alias("token")))
    return df.select(key, F.explode(F.coalesce(by_piece, in_order)).alias("t")).select(key, "t.token_id", "t.token", F.length("t.token").alias("scalar_length"))


def vocabulary_errors(rows: DataFrame, key: str) -> DataFrame:
    """key, token_id, error of ids that are negative or that two pieces share."""
    n = rows.groupBy(key, "token_id").agg(F.count("*").alias("n"))
    error = F.when(F.col("token_id").isNull() | (F.col("token_id") < 0), "negative").when(F.col("n") > 1, "repeated")
    return n.select(key, "token_id", error.alias("error")).where("error IS NOT NULL")


def chat_messages(df: DataFrame, key: str, messages: str) -> DataFrame:
    """key, turn, role, content, error of the array of messages: content that isn't text is kept as JSON."""
    each = F.from_json(messages, "array<string>")
    long = df.select(key, F.posexplode(each).alias("turn", "m"))
    role, has = F.get_json_object("m", "$.role"), F.array_contains(F.json_object_keys("m"), "content")
    error = F.when(role.isNull(), "role missing").when(~F.coalesce(has, F.lit(False)), "content missing")
    return long.select(key, "turn", role.alias("role"), F.coalesce(F.get_json_object("m", "$.content"), F.when(has, F.lit("null"))).alias("content"), error.alias("error"))


def shard_summary(df: DataFrame, key: str, index: str) -> DataFrame:
    """key, tensors, shards, total_size of weight index texts."""
    weights = F.from_json(F.get_json_object(index, "$.weight_map"), "map<string,string>")
    return df.select(key, F.size(weights).cast("long").alias("tensors"), F.size(F.array_distinct(F.map_values(weights))).cast("long").alias("shards"), F.get_json_object(index, "$.metadata.total_size").try_cast("long").alias("total_size"))


# Rows of the summaries of configuration files: group, label, field.
CONFIG_ROWS = {
    "config": [("scale", "hidden_size"), ("scale", "intermediate_size"), ("scale", "vocab_size"), ("attention", "num_attention_heads"), ("attention", "num_key_value_heads"), ("attention", "head_dim"), ("context", "max_position_embeddings"), ("context", "rope_theta")],
    "generation": [("sampling", "do_sample"), ("sampling", "temperature"), ("sampling", "top_p"), ("sampling", "top_k"), ("stop", "eos_token_id"), ("stop", "pad_token_id"), ("stop", "max_new_tokens"), ("stop", "repetition_penalty")],
    "tokenizerConfig": [("core", "model_max_length"), ("core", "padding_side"), ("core", "bos_token"), ("core", "eos_token"), ("core", "unk_token")],
}


def config_title(json: str) -> Column:
    """The first of the architectures if all are texts, else the model type."""
    get = lambda path: F.get_json_object(json, path)
    return F.coalesce(F.get(F.from_json(get("$.architectures"), "array<string>"), F.lit(0)), get("$.model_type"))


def config_subtitle(json: str) -> Column:
    get = lambda path: F.get_json_object(json, path)
    return F.concat_ws(" · ", get("$.model_type"), get("$.torch_dtype"), F.concat(get("$.num_hidden_layers"), F.lit(" layers")))


def config_summary(df: DataFrame, key: str, json: str, kind: str) -> DataFrame:
    """key, place, part, field, value of the fields that a configuration, generation or tokenizer configuration file has; nothing for what isn't an object."""
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(part).alias("part"), F.lit(field).alias("field"), F.get_json_object(json, f"$.{field}").alias("value")) for k, (part, field) in enumerate(CONFIG_ROWS[kind])))
    return df.select(key, F.explode(F.filter(rows, lambda r: r["value"].isNotNull())).alias("r")).select(key, "r.*")


def shard_mapping(df: DataFrame, key: str, index: str, most: int = 80) -> DataFrame:
    """key, tensor, shard: the first tensors by name of weight index texts."""
    weights = F.from_json(F.get_json_object(index, "$.weight_map"), "map<string,string>")
    own = F.slice(F.array_sort(F.map_entries(weights)), 1, most)
    return df.select(key, F.explode(own).alias("e")).select(key, F.col("e.key").alias("tensor"), F.col("e.value").alias("shard"))


def gguf_overview(metadata: DataFrame) -> DataFrame:
    """path, architecture, name, context_length of GGUF metadata rows (path, key, value): the architecture's own length, else the first of any."""
    get = lambda k: F.max(F.when(F.col("key") == k, F.regexp_replace("value", '^"|"$', "")))
    lengths = F.array_sort(F.collect_list(F.when(F.endswith("key", F.lit(".context_length")), F.struct("key", "value"))))
    got = metadata.groupBy("path").agg(get("general.architecture").alias("architecture"), get("general.name").alias("name"), lengths.alias("lengths"))
    own = F.filter("lengths", lambda x: x["key"] == F.concat("architecture", F.lit(".context_length")))
    return got.select("path", "architecture", "name", F.coalesce(F.get(own, F.lit(0))["value"], F.get("lengths", F.lit(0))["value"]).try_cast("long").alias("context_length"))


def imatrix_entries(tensors: DataFrame) -> DataFrame:
    """path, entries: stems of tensor names that have both parts of an importance matrix."""
    stem = F.regexp_extract("name", r"^(.*)\.(in_sum2|counts)$", 1)
    both = tensors.where(stem != "").groupBy("path", stem.alias("stem")).agg(F.count_distinct("name").alias("n")).where("n = 2")
    return both.groupBy("path").agg(F.count("*").alias("entries"))


def projected(nodes: DataFrame) -> DataFrame:
    """Node rows as a tree shows them: a label and a preview of at most 256 characters, containers without one."""
    label = F.coalesce(F.concat(F.col("key"), F.when(F.col("occurrence") > 1, F.concat(F.lit("#"), F.col("occurrence").cast("string"))).otherwise("")), F.concat(F.lit("["), F.col("index").cast("string"), F.lit("]")), F.lit("$"))
    leaf = ~F.col("kind").isin("Object", "Array")
    return nodes.select("*", bounded_value(label).alias("label"), F.when(leaf, bounded_value(F.coalesce("value", "lexeme"))).alias("preview"))


def copied(value: Column, mode: str) -> Column:
    """Bytes as hex, or as text in which what isn't UTF-8 is replaced."""
    if mode not in ("hex", "lossy"):
        raise ValueError("mode is hex or lossy")
    return F.lower(F.hex(value)) if mode == "hex" else F.make_valid_utf8(value.cast("string"))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, limit: int, most: int = 200) -> DataFrame:
    """The next rows after a cursor (the order columns of the last row seen): a filter and a top-k, no offset."""
    if limit <= 0:
        raise ValueError("limit is positive")
    if after is not None:
        beyond = F.lit(False)
        for k in range(len(order)):
            same = F.lit(True)
            for j in range(k):
                same = same & (F.col(order[j]) == F.lit(after[j]))
            beyond = beyond | (same & (F.col(order[k]) > F.lit(after[k])))
        df = df.where(beyond)
    return df.orderBy(*order).limit(min(limit, most))


def bundles(files: DataFrame, by: str, path: str, size: str, most: int = 32 << 20) -> DataFrame:
    """Tokenizer bundles: by repository and folder the tokenizer file and the files beside it, and whether all fit the limit."""
    folder, name = F.regexp_extract(path, r"^(.*?)/?[^/]*$", 1), F.element_at(F.split(path, "/"), -1)
    own = files.select(by, folder.alias("folder"), name.alias("name"), F.col(size).alias("size")).where(F.col("name").isin("tokenizer.json", "tokenizer_config.json", "special_tokens_map.json", "tokenizer.model", "chat_template.jinja"))
    got = own.groupBy(by, "folder").agg(F.sort_array(F.collect_list("name")).alias("names"), F.bool_and(F.col("size") <= most).alias("fits"))
    return got.where(F.arrays_overlap("names", F.array(F.lit("tokenizer.json"), F.lit("tokenizer.model"))))
