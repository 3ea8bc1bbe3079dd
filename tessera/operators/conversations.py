"""Conversations: protocol, roles, blocks, probes for token counts, an index of rendered templates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import strict_json
from tessera.operators.entries import json_nodes

# Roles, what they are called elsewhere, and what shows a protocol.
ROLES = ["system", "developer", "user", "assistant", "tool", "function", "human", "gpt", "bot", "model"]
NORMAL = {"system": "system", "developer": "developer", "user": "user", "assistant": "assistant", "tool": "tool", "human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "function": "tool"}
OPENAI_ROLES = ["developer", "tool", "function"]
ANTHROPIC_BLOCKS = ["tool_use", "tool_result", "thinking", "redacted_thinking"]


def normal_role(role: Column) -> Column:
    return F.coalesce(*(F.when(role == a, F.lit(b)) for a, b in NORMAL.items()), F.lit("unknown"))


def required(count: Column) -> Column:
    """Four fifths, rounded up."""
    return count - F.floor(count / 5)


def profile(messages: DataFrame, by: str, role: str, content: str) -> DataFrame:
    """By conversation: messages, recognised roles, and whether it is generic."""
    known = F.col(role).isin(ROLES)
    got = messages.groupBy(by).agg(F.count("*").alias("n_messages"), F.count_if(known).alias("n_recognised"), F.count_if(F.col(role).isNotNull()).alias("n_role"), F.count_if(F.col(content).isNotNull()).alias("n_content"))
    need = required(F.col("n_messages"))
    generic = (F.col("n_messages") >= 2) & (F.col("n_recognised") >= need) & (F.col("n_role") >= need) & (F.col("n_content") >= need)
    return got.select(by, "n_messages", "n_recognised", generic.alias("generic"))


# What a typed block must have once at most.
ONCE = {"thinking": ["thinking"], "redacted_thinking": ["data"], "tool_use": ["id", "name", "input"], "tool_result": ["tool_use_id", "content", "is_error"]}
SHOWN_ONCE = ["type", "text"]


@F.pandas_udf(T.BooleanType())
def has_typed_block(messages: pd.Series) -> pd.Series:
    """Whether an array that is a message's content has an object of an Anthropic type, with nothing that it depends on there twice; null for null."""

    def of(s: str | None) -> bool | None:
        if s is None:
            return None
        try:
            nodes = strict_json.nodes(s)
        except strict_json.Bad:
            return False
        inner: dict[int, list[dict]] = {}
        for n in nodes[1:]:
            inner.setdefault(n["parent"], []).append(n)
        of_ = lambda n: inner.get(n["id"], [])
        twice = lambda n, names: any(c["key"] in names and c["occurrence"] > 1 for c in of_(n))
        for content in (n for n in of_(nodes[0]) if n["key"] == "content" and n["kind"] == "Array"):
            for block in (b for b in of_(content) if b["kind"] == "Object"):
                type_ = next((c["value"] for c in of_(block) if c["key"] == "type" and c["kind"] == "String"), None)
                if type_ not in ONCE or twice(block, ["type", *ONCE[type_]]):
                    continue
                shown = [c for c in of_(block) if c["key"] == "content"] if type_ == "tool_result" else []
                if not any(item["kind"] == "Object" and twice(item, SHOWN_ONCE) for c in shown for item in of_(c)):
                    return True
        return False

    return pd.Series([of(s) for s in messages], dtype="object")


def kinds(messages: DataFrame, by: str, message: str) -> DataFrame:
    """By conversation the protocol of its messages (JSON): openai, anthropic, mixed, generic, possible or none.

    A message with a repeated key that its style depends on gives no signal of that style.
    """
    m = F.col(message)
    keys = F.json_object_keys(m)
    once = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda k: F.size(F.filter(keys, lambda x: x == k)) <= 1)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    get = lambda path: F.get_json_object(m, path)
    role = get("$.role")
    openai = once("role", "tool_calls", "function_call", "tool_call_id") & (has("tool_calls") | has("function_call") | has("tool_call_id") | F.coalesce(role.isin(OPENAI_ROLES), F.lit(False)))
    likely = F.rlike(m, F.lit("|".join(f'"{b}"' for b in ANTHROPIC_BLOCKS))) & keys.isNotNull()
    anthropic = once("role", "content") & F.coalesce(has_typed_block(F.when(likely, m)), F.lit(False))
    role_key = has("role") | has("from")
    recognised = F.coalesce(F.coalesce(role, get("$.from")).isin(ROLES), F.lit(False))
    content = has("content") | has("value") | has("tool_calls") | has("function_call")
    one = lambda c, n: F.count_if(F.coalesce(c, F.lit(False))).alias(n)
    got = messages.groupBy(by).agg(F.count("*").alias("n"), one(keys.isNotNull(), "objects"), one(openai, "openai"), one(anthropic, "anthropic"), one(role_key, "roles"), one(recognised, "recognised"), one(content, "contents"), one(recognised & content, "possible"))
    need = required(F.col("n"))
    generic = (F.col("n") >= 2) & F.least("objects", "roles", "recognised", "contents").__ge__(need)
    kind = F.when((F.col("openai") > 0) & (F.col("anthropic") > 0), "mixed").when(F.col("openai") > 0, "openai").when(F.col("anthropic") > 0, "anthropic").when(generic, "generic").when(F.col("possible") > 0, "possible").otherwise("none")
    return got.select(by, F.col("n").alias("n_messages"), kind.alias("kind"))


def blocks(messages: DataFrame, by: str, turn: str, role: str, content: str) -> DataFrame:
    """A header row for each message and a row for each of its fields, numbered by conversation."""
    rows = F.array(F.struct(F.lit(0).alias("field"), F.lit("header").alias("category"), normal_role(F.col(role)).alias("text")), F.struct(F.lit(1).alias("field"), F.lit("text").alias("category"), F.col(content).alias("text")))
    long = messages.select(by, turn, F.explode(rows).alias("b")).select(by, turn, "b.*").where("field = 0 OR text IS NOT NULL")
    return long.withColumn("block", F.row_number().over(Window.partitionBy(by).orderBy(turn, "field")) - 1)


def openai_blocks(messages: DataFrame, by: str, turn: str, message: str) -> DataFrame:
    """Typed blocks of OpenAI-style messages (JSON): text, image, toolCall, toolResult."""
    get = lambda path: F.get_json_object(message, path)
    block = "array<struct<kind:string,text:string>>"
    parts = F.from_json(get("$.content"), "array<struct<type:string,text:string,image_url:struct<url:string>>>")
    tool = get("$.role") == "tool"
    content = F.when(parts.isNotNull(), F.transform(parts, lambda p: F.struct(F.when(p["image_url"]["url"].isNotNull(), "image").otherwise("text").alias("kind"), F.coalesce(p["image_url"]["url"], p["text"]).alias("text")))).when(get("$.content").isNotNull(), F.array(F.struct(F.when(tool, "toolResult").otherwise("text").alias("kind"), get("$.content").alias("text"))))
    calls = F.from_json(get("$.tool_calls"), "array<struct<function:struct<name:string,arguments:string>>>")
    made = F.transform(F.filter(calls, lambda c: c["function"]["name"].isNotNull() & c["function"]["arguments"].isNotNull()), lambda c: F.struct(F.lit("toolCall").alias("kind"), F.concat(c["function"]["name"], F.lit(" "), c["function"]["arguments"]).alias("text")))
    none = F.array().cast(block)
    all_ = F.concat(F.coalesce(content.cast(block), none), F.coalesce(made.cast(block), none))
    return messages.select(by, turn, F.posexplode(all_).alias("element", "b")).select(by, turn, "element", "b.kind", "b.text")


# Fields that may hold a conversation; categories of a message's fields; what a typed block of an
# Anthropic-style message needs: its category, the fields with the kinds each may be of, and the one that is shown.
CANDIDATES = ["messages", "conversation", "conversations"]
FIELD_CATEGORIES = {"role": "role", "from": "role", "content": "content", "value": "value", "tool_calls": "tool", "function_call": "tool", "tool_call_id": "tool"}
BLOCK_FIELDS = {
    "text": ("text", {"text": ["String"]}, "text"),
    "thinking": ("thinking", {"thinking": ["String"]}, "thinking"),
    "redacted_thinking": ("redactedThinking", {"data": ["String"]}, "data"),
    "tool_use": ("toolUse", {"id": ["String"], "name": ["String"], "input": ["Object"]}, "name"),
    "tool_result": ("toolResult", {"tool_use_id": ["String"], "content": ["String", "Array"]}, "tool_use_id"),
}


def candidates(documents: DataFrame, key: str, json: str) -> DataFrame:
    """key, scope, node_id, label, path of the arrays that may be conversations: fields of the root or of a direct item of a root array.

    ``label`` is the field's name, with #n for the n-th of equal names; ``scope`` is the node of the object that has it.
    """
    nodes = json_nodes(documents, key, json)
    arrays = nodes.where((F.col("kind") == "Array") & F.col("key").isin(CANDIDATES))
    holder = nodes.where("kind = 'Object'").select(F.col(key).alias("own"), F.col("node_id").alias("holder"), F.col("parent").alias("above"))
    top = nodes.where("node_id = 0 AND kind = 'Array'").select(F.col(key).alias("own")).withColumn("listed", F.lit(True))
    both = arrays.join(holder, (F.col(key) == F.col("own")) & (F.col("parent") == F.col("holder"))).drop("own").join(top, F.col(key) == F.col("own"), "left").drop("own")
    inside = F.col("above").isNull() | ((F.col("above") == 0) & F.coalesce("listed", F.lit(False)))
    label = F.concat("key", F.when(F.col("occurrence") > 1, F.concat(F.lit("#"), F.col("occurrence").cast("string"))).otherwise(""))
    return both.where(inside).select(key, F.col("holder").alias("scope"), "node_id", label.alias("label"), "path")


def fields_of(nodes: DataFrame) -> DataFrame:
    """id, at, kids: of each object the map of its fields, with how often each is there, and the kind and text of the first."""
    each = nodes.where("key IS NOT NULL").groupBy("id", "parent", "key").agg(F.count("*").alias("n"), F.min_by(F.struct("kind", "value"), "node_id").alias("first"))
    entry = F.struct("key", F.struct("n", F.col("first.kind").alias("kind"), F.col("first.value").alias("value")))
    return each.groupBy("id", F.col("parent").alias("at")).agg(F.map_from_entries(F.collect_list(entry)).alias("kids"))


def has_kind(kids: Column, name: str, kinds_: list[str]) -> Column:
    return F.coalesce(kids[name]["kind"].isin(kinds_), F.lit(False))


def often(kids: Column, *names: str) -> Column:
    """Whether one of the fields is there twice or more."""
    out = F.lit(False)
    for name in names:
        out = out | (F.coalesce(kids[name]["n"], F.lit(0)) > 1)
    return out


def typed_block(kids: Column) -> tuple[Column, Column]:
    """(category, text) of an element of Anthropic-style content, from its fields."""
    type_ = F.when(has_kind(kids, "type", ["String"]) & ~often(kids, "type"), kids["type"]["value"])
    category, text = F.when(type_.isNull(), "unknown"), None
    for name, (own, needs, shown) in BLOCK_FIELDS.items():
        names = [*needs, "is_error"] if name == "tool_result" else [*needs]
        good = ~often(kids, *names)
        for field, kinds_ in needs.items():
            good = good & has_kind(kids, field, kinds_)
        category = category.when((type_ == name) & good, own)
        text = F.when((type_ == name) & good, kids[shown]["value"]) if text is None else text.when((type_ == name) & good, kids[shown]["value"])
    return category.otherwise("unknown"), text


def message_blocks(messages: DataFrame, by: str, turn: str, message: str, style: str) -> DataFrame:
    """by, turn, block, field, element, category, text of messages (JSON): a header, a row a field, a row an element.

    ``style``: generic, openai or anthropic. Arrays of ``content`` and ``value``, and in OpenAI style of ``tool_calls``,
    have a row for each element after their own. A block that lacks what its type needs, or has it twice, is unknown.
    """
    if style not in ("generic", "openai", "anthropic"):
        raise ValueError("style is generic, openai or anthropic")
    id_ = F.to_json(F.struct(F.col(by).alias("by"), F.col(turn).alias("turn")))
    nodes = json_nodes(messages.select(id_.alias("id"), F.col(message).alias("text")), "id", "text")
    # All that follows is by message: one partitioning serves it.
    nodes = nodes.repartition("id")
    kids = fields_of(nodes)
    root = kids.where("at = 0").select("id", F.col("kids").alias("own"))
    role = F.when(has_kind(F.col("own"), "role", ["String"]), normal_role(F.col("own")["role"]["value"])).when(has_kind(F.col("own"), "from", ["String"]), normal_role(F.col("own")["from"]["value"])).otherwise("unknown")
    expanded = ["content", "value"] + (["tool_calls"] if style == "openai" else [])
    fields = nodes.where("parent = 0 AND key IS NOT NULL").select("id", F.col("node_id").alias("at"), F.col("key").alias("name"), "kind", "value", F.lit(None).cast("int").alias("element"), F.col("node_id").alias("order"))
    arrays = fields.where(F.col("name").isin(expanded) & (F.col("kind") == "Array")).select("id", F.col("at").alias("array"), "name", F.col("order"))
    items = nodes.where("index IS NOT NULL").select(F.col("id").alias("i"), F.col("parent").alias("p"), F.col("node_id").alias("at"), "kind", "value", F.col("index").alias("element"))
    elements = arrays.join(items, (F.col("id") == F.col("i")) & (F.col("array") == F.col("p"))).select("id", "at", "name", "kind", "value", "element", "order")
    rows = fields.unionByName(elements).join(kids, ["id", "at"], "left").join(root, "id", "left").withColumn("role", role)
    k, kind, name = F.col("kids"), F.col("kind"), F.col("name")
    usual = F.coalesce(*(F.when(name == a, F.lit(b)) for a, b in FIELD_CATEGORIES.items()), F.lit("unknown"))
    text = F.col("value")
    is_element = F.col("element").isNotNull()
    if style == "generic":
        category = usual
    elif style == "anthropic":
        own, shown = typed_block(k)
        category = F.when(name != "content", usual).when(is_element, F.when(kind == "Object", own).otherwise("unknown")).when(kind == "String", "text").when(kind == "Array", "content").otherwise("unknown")
        text = F.when(is_element & (name == "content"), shown).otherwise(text)
    else:
        tool = F.col("role") == "tool"
        type_ = F.when(has_kind(k, "type", ["String"]), k["type"]["value"])
        part = F.when(often(k, "type"), "unknown").when((type_ == "text") & has_kind(k, "text", ["String"]) & ~often(k, "text"), F.when(tool, "toolResult").otherwise("text"))
        # What is inside of a field's object is a node of its own: its fields are looked up by the path.
        image = (type_ == "image_url") & has_kind(k, "image_url", ["Object"]) & ~often(k, "image_url")
        call_type = ~often(k, "type", "id", "function") & (k["type"].isNull() | F.coalesce(type_ == "function", F.lit(False))) & has_kind(k, "function", ["Object"])
        called = lambda c: has_kind(c, "name", ["String"]) & has_kind(c, "arguments", ["String", "Object"]) & ~often(c, "name", "arguments")
        objects = nodes.where("kind = 'Object' AND key IN ('function', 'image_url')").select(F.col("id").alias("i"), F.col("parent").alias("p"), F.col("node_id").alias("n"))
        inner = objects.join(kids, (F.col("i") == F.col("id")) & (F.col("n") == F.col("at"))).groupBy(F.col("i").alias("id"), F.col("p").alias("at")).agg(F.min_by("kids", "n").alias("inner"))
        rows = rows.join(inner, ["id", "at"], "left")
        inner_ = F.col("inner")
        category = (
            F.when((name == "content") & is_element, part.when(image & has_kind(inner_, "url", ["String"]) & ~often(inner_, "url"), "image").otherwise("unknown"))
            .when((name == "content") & tool, "toolResult")
            .when((name == "content") & (kind == "String"), "text")
            .when((name == "tool_calls") & is_element, F.when(call_type & called(inner_), "toolCall").otherwise("unknown"))
            .when((name == "tool_calls") & (kind != "Array"), "unknown")
            .when(name == "function_call", F.when((kind == "Object") & called(k), "toolCall").otherwise("unknown"))
            .when((name == "tool_call_id") & tool, "toolResult")
            .otherwise(usual)
        )
        text = F.coalesce(text, F.when(is_element & (name == "content"), F.coalesce(inner_["url"]["value"], k["text"]["value"])).when(F.col("name") == "tool_calls", inner_["name"]["value"]).when(F.col("name") == "function_call", k["name"]["value"]))
    header = nodes.where("node_id = 0").select("id", "kind").join(root, "id", "left").select("id", F.lit(-1).alias("order"), F.lit(None).cast("int").alias("element"), F.lit(None).cast("string").alias("name"), F.lit("header").alias("category"), F.coalesce(role, F.lit("unknown")).alias("text"))
    both = header.unionByName(rows.select("id", "order", "element", "name", category.alias("category"), text.alias("text")))
    types = dict(messages.select(F.col(by).alias("by"), F.col(turn).alias("turn")).dtypes)
    at = F.from_json("id", f"by {types['by']}, turn {types['turn']}")
    number = F.row_number().over(Window.partitionBy("id").orderBy("order", F.col("element").asc_nulls_first())) - 1
    return both.select(at.alias("at"), number.alias("block"), F.col("name").alias("field"), "element", "category", "text").select(F.col("at.by").alias(by), F.col("at.turn").alias(turn), "block", "field", "element", "category", "text")


def system_blocks(documents: DataFrame, key: str, json: str) -> DataFrame:
    """key, element, category, text of the ``system`` field of Anthropic-style documents: a text, or a row for each element of an array."""
    nodes = json_nodes(documents.select(F.col(key).alias("id"), F.col(json).alias("text")), "id", "text").repartition("id")
    kids = fields_of(nodes)
    system = nodes.where("parent = 0 AND key = 'system'").select("id", F.col("node_id").alias("at"), "kind", "value")
    one = system.where("kind <> 'Array'").select("id", F.lit(None).cast("int").alias("element"), F.when(F.col("kind") == "String", "text").otherwise("unknown").alias("category"), F.when(F.col("kind") == "String", F.col("value")).alias("text"))
    items = nodes.where("index IS NOT NULL").select(F.col("id").alias("i"), F.col("parent").alias("p"), F.col("node_id").alias("at"), F.col("index").alias("element"))
    each = system.where("kind = 'Array'").select("id", F.col("at").alias("array")).join(items, (F.col("id") == F.col("i")) & (F.col("array") == F.col("p"))).select("id", "at", "element").join(kids, ["id", "at"], "left")
    k = F.col("kids")
    good = has_kind(k, "type", ["String"]) & (k["type"]["value"] == "text") & has_kind(k, "text", ["String"]) & ~often(k, "type", "text")
    own = each.select("id", "element", F.when(F.coalesce(good, F.lit(False)), "text").otherwise("unknown").alias("category"), F.when(good, k["text"]["value"]).alias("text"))
    return one.unionByName(own).withColumnRenamed("id", key)


def content_probe(messages: DataFrame, by: str, turn: str, content: str) -> DataFrame:
    """Each conversation's texts that aren't empty, in order, joined by line ends; with bytes and characters."""
    own = messages.where(F.length(content) > 0).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(turn, content))).alias("all"))
    text = F.array_join(F.transform("all", lambda m: m[content]), "\n")
    return own.select(by, text.alias("probe")).select(by, "probe", F.octet_length("probe").cast("long").alias("bytes"), F.length("probe").cast("long").alias("chars"))


def rendered(messages: DataFrame, by: str, turn: str, role: str, content: str) -> DataFrame:
    """Each conversation in a fixed template: <|role|>, a line end, the text, <|end|>, a line end."""
    own = messages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(turn, role, content))).alias("all"))
    return own.select(by, F.array_join(F.transform("all", lambda m: F.concat(F.lit("<|"), m[role], F.lit("|>\n"), F.coalesce(m[content], F.lit("")), F.lit("<|end|>\n"))), "").alias("text"))


def template_overhead(probes: DataFrame, renderings: DataFrame, by: str, count) -> DataFrame:
    """Tokens of the rendering less those of the texts alone; ``count`` makes a column of counts from one of text."""
    return renderings.join(probes, by).select(by, count(F.col("text")).alias("total_tokens"), count(F.col("probe")).alias("content_tokens"), (count(F.col("text")) - count(F.col("probe"))).alias("overhead"))


def rendered_index(renderings: DataFrame, by: str) -> DataFrame:
    """The <|name|> marks of each rendering: number, name, and the first 40 characters up to the next mark."""
    mark = r"<\|([^|\r\n]+)\|>"
    names, parts = F.regexp_extract_all("text", F.lit(mark), F.lit(1)), F.split("text", mark, -1)
    rows = F.arrays_zip(names.alias("name"), F.slice(parts, F.lit(2), F.size(parts)).alias("rest"))
    return renderings.select(by, F.posexplode(rows).alias("position", "m")).select(by, "position", F.col("m.name").alias("name"), F.left(F.trim(F.translate("m.rest", "\n", " ")), F.lit(40)).alias("detail"))
