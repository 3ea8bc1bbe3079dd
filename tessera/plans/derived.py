"""More queries over the given tables: files, entries, trees, conversations and token lists that Spark makes from them, each with SQL that works out the same rows from the tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import conversations, entries, inspection, markup, searches, structure, templates, vocabularies
from tessera.plans.catalog import broken, event_json, query, table
from tessera.sources import json_arrays, jsonl, jsonl_index, scratch, sinks
from tessera.streaming import events


def event_arrays(spark, d: str) -> str:
    """A folder with the events, in their order, as files that are one JSON array each."""
    path = scratch.folder(spark)
    own = event_json(spark, d).repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    sinks.write_json_arrays(own, "json", path)
    return path


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::bigint AS ordinal, event_type AS type, user_id AS session_id FROM events")
def array_items(spark, d):
    """Items of array files, found over byte splits; their ordinals go on from file to file."""
    path = event_arrays(spark, d)
    counts = json_arrays.array_counts(spark, path)
    before = counts.alias("a").join(counts.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy(F.col("a.file").alias("file")).agg(F.coalesce(F.sum("b.n_items"), F.lit(0)).alias("before"))  # a row a file
    got = json_arrays.array_items(spark, path).join(F.broadcast(before), "file")
    item = F.from_json(F.col("raw").cast("string"), "type string, session_id long")
    ids = event_json(spark, d).select("event_id", "json")
    own = got.select((F.col("ordinal") + F.col("before")).alias("ordinal"), F.col("raw").cast("string").alias("json"), item.alias("item"))
    return own.join(ids, "json").select("event_id", "ordinal", F.col("item.type").alias("type"), F.col("item.session_id").alias("session_id"))


@query("SELECT '[' AS root, true AS closed, true AS valid, count(*) AS n_items FROM events")
def array_counts(spark, d):
    """Items of array files counted without parsing, and whether the files are valid."""
    path = event_arrays(spark, d)
    both = json_arrays.array_counts(spark, path).join(json_arrays.array_documents(spark, path).select("file", "valid"), "file")
    return both.groupBy("root", "closed", "valid").agg(F.sum("n_items").alias("n_items"))


def varied_json(e: DataFrame) -> DataFrame:
    """Events as entries some of which lack a type, a time, a place in a sequence or a session; sessions are numbers or strings."""
    k = F.col("event_id")
    part = lambda when, name, value: F.when(when, F.concat(F.lit(f'"{name}":'), value))
    number = (k % 5).cast("string")
    parts = F.array_compact(F.array(part(k % 4 != 0, "type", F.to_json(F.struct("event_type"))), part(k % 3 != 0, "ts", k.cast("string")), part(k % 7 == 0, "seq", F.lit("1")), part(k % 2 == 0, "session_id", number), part(k % 10 == 1, "sessionId", F.concat(F.lit('"'), number, F.lit('"')))))
    return e.withColumn("json", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


VERDICTS = """WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
s AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN concat('i', event_id % 5) WHEN event_id % 10 = 1 THEN concat('s', event_id % 5) END AS g FROM o WHERE r <= 200),
m AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY user_id, g) > 1 AS again FROM s),
c AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 4 <> 0) AS type, count(*) FILTER (event_id % 3 <> 0) AS time, count(*) FILTER (event_id % 7 = 0) AS sequence, count(g) AS "grouping", count(*) FILTER (again) AS repeated FROM m GROUP BY user_id),
v AS (SELECT *, "grouping" > 0 AND repeated * 2 >= "grouping" AS most FROM c),
w AS (SELECT *, n >= 10 AND ((type * 10 >= n * 7 AND (time * 10 >= n * 4 OR ("grouping" * 2 >= n AND most) OR sequence * 10 >= n * 4)) OR (time * 10 >= n * 7 AND "grouping" * 10 >= n * 7 AND most)) AS is_event_stream FROM v)
"""


@query(VERDICTS + 'SELECT user_id, n, type, time, sequence, "grouping", repeated, is_event_stream FROM w')
def stream_verdicts(spark, d):
    """A verdict for each user's entries, from samples that no single task sorts whole streams for."""
    own = varied_json(table(spark, d, "events"))
    return entries.event_verdict(entries.event_samples_by(own, "user_id", "event_id", "json"), "event_id", "json", ["user_id"])


@query(VERDICTS + ", t AS (SELECT user_id, count(*) AS entries FROM events GROUP BY user_id) SELECT user_id, entries, n::int AS samples, is_event_stream AS hint FROM w JOIN t USING (user_id)")
def keyed_stream_verdicts(spark, d):
    """The same verdicts from a stream over the table, as keyed state read back."""
    path = scratch.folder(spark)
    stream = varied_json(events.table_stream(spark, f"{d}/events.parquet"))
    found = events.run_keyed_verdicts(stream, "user_id", "event_id", "json", path)
    return found.select(F.col("key").alias("user_id"), "entries", "samples", "hint")


# ---- trees of conversations


def conversation_json(spark, d: str) -> DataFrame:
    """conv_id, json: each conversation as an object with its number and its messages in order."""
    one = F.struct("turn", F.struct("role", "text").alias("m"))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return own.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("conv"), F.transform("all", lambda x: x["m"]).alias("messages"))).alias("json"))


MESSAGES = "WITH m AS (SELECT conv_id, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS i FROM conversations), c AS (SELECT conv_id, count(*)::int AS n FROM m GROUP BY conv_id) "


@query(MESSAGES + """SELECT conv_id, '$' AS path, 'Object' AS kind, '$' AS label, NULL AS preview, NULL AS more, 2 AS children FROM c
UNION ALL SELECT conv_id, '$.conv', 'Number', 'conv', conv_id::varchar, false, 0 FROM c UNION ALL SELECT conv_id, '$.messages', 'Array', 'messages', NULL, NULL, n FROM c
UNION ALL SELECT conv_id, concat('$.messages[', i, ']'), 'Object', concat('[', i, ']'), NULL, NULL, 2 FROM m
UNION ALL SELECT conv_id, concat('$.messages[', i, '].role'), 'String', 'role', role, false, 0 FROM m
UNION ALL SELECT conv_id, concat('$.messages[', i, '].text'), 'String', 'text', left(text, 256), length(text) > 256, 0 FROM m""")
def projected_tree(spark, d):
    """All values of conversations as a tree shows them."""
    nodes = inspection.projected(entries.json_nodes(conversation_json(spark, d), "conv_id", "json"))
    return nodes.select("conv_id", "path", "kind", F.col("label.value").alias("label"), F.col("preview.value").alias("preview"), F.col("preview.has_more").alias("more"), "children")


@query(MESSAGES + "SELECT conv_id, concat('$.messages[', i, ']') AS path FROM m WHERE i > 1 ORDER BY conv_id, i LIMIT 200")
def children_pages(spark, d):
    """The next 200 messages after each conversation's second, by keyset."""
    nodes = entries.json_nodes(conversation_json(spark, d), "conv_id", "json")
    return entries.children_page(nodes, "conv_id", 2, 8).select("conv_id", "path")


@query(MESSAGES + """SELECT conv_id, '$' AS ancestor, concat('$.messages[', i, '].text') AS descendant FROM m WHERE contains(text, 'the')
UNION ALL SELECT conv_id, concat('$.messages[', i, ']'), concat('$.messages[', i, '].text') FROM m WHERE contains(text, 'the')""")
def contained_nodes(spark, d):
    """Every object around every text that matches, by a structural join."""
    nodes = entries.json_nodes(conversation_json(spark, d), "conv_id", "json")
    got = structure.contained(nodes, "conv_id", F.col("kind") == "Object", F.contains("value", F.lit("the")))
    return got.select("conv_id", F.col("ancestor_shown").alias("ancestor"), F.col("descendant_shown").alias("descendant"))


@query(MESSAGES + """SELECT conv_id, '$' AS labels, false AS truncated FROM c UNION ALL SELECT conv_id, '$|conv', false FROM c UNION ALL SELECT conv_id, '$|messages', false FROM c
UNION ALL SELECT conv_id, concat('$|messages|[', i, ']', f), false FROM m, (VALUES (''), ('|role'), ('|text')) AS t(f)""")
def path_labels(spark, d):
    got = entries.path_labels(conversation_json(spark, d), "conv_id", "json")
    return got.select("conv_id", F.array_join("labels", "|").alias("labels"), "truncated")


OCCURRENCES = MESSAGES + """, p AS (SELECT conv_id, i, string_split(text, 'the') AS s FROM m WHERE contains(text, 'the')),
o AS (SELECT conv_id, i, k, list_sum(list_transform(s[1:k], lambda x: length(x)))::bigint + (k - 1) * 3 AS start FROM p, LATERAL (SELECT unnest(range(1, len(s))) AS k)) """


@query(OCCURRENCES + "SELECT conv_id, concat('$.messages[', i, '].text') AS path, start FROM o WHERE conv_id > 3 ORDER BY conv_id, i, start LIMIT 50")
def search_pages(spark, d):
    """A page of 50 matches after a cursor."""
    found = entries.search_nodes(entries.json_nodes(conversation_json(spark, d), "conv_id", "json"), "conv_id", "the")
    return inspection.keyset_page(found, ["conv_id", "node_id", "phase", "start"], (3, 1 << 30, 0, 0), 50).select("conv_id", "path", "start")


@query(OCCURRENCES + """, f AS (SELECT conv_id, min(i) AS i FROM o GROUP BY conv_id), g AS (SELECT f.conv_id, f.i, min(start)::int AS hit FROM f JOIN o USING (conv_id, i) GROUP BY ALL)
SELECT conv_id, concat('$.messages[', i, '].text') AS path, 'value' AS field, concat(CASE WHEN hit > 80 THEN '…' ELSE '' END, substr(text, greatest(hit - 80, 0) + 1, least(hit, 80) + 3 + 80), CASE WHEN hit + 83 < length(text) THEN '…' ELSE '' END) AS snippet,
(least(hit, 80) + CASE WHEN hit > 80 THEN 1 ELSE 0 END)::int AS match_start, (least(hit, 80) + CASE WHEN hit > 80 THEN 1 ELSE 0 END + 3)::int AS match_end FROM g JOIN m USING (conv_id, i)""")
def evidence_snippets(spark, d):
    """The first match of each conversation with its path, surroundings and place."""
    return entries.evidence_snippets(entries.json_nodes(conversation_json(spark, d), "conv_id", "json"), "conv_id", "the")


@query(MESSAGES + """SELECT conv_id, i AS turn, role, text AS content, NULL::varchar AS error FROM m WHERE i % 3 <> 2 UNION ALL SELECT conv_id, i, NULL, NULL, 'role missing' FROM m WHERE i % 3 = 2""")
def chat_messages(spark, d):
    """Messages of chat files; every third lacks both fields."""
    one = F.struct("turn", F.when(F.col("i") % 3 != 2, F.struct("role", F.col("text").alias("content"))).alias("m"))
    own = table(spark, d, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    files = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all")).select("conv_id", F.to_json(F.transform("all", lambda x: F.coalesce(F.to_json(x["m"]), F.lit("{}")))).alias("quoted"))
    # An array of texts of objects becomes one of objects.
    texts = files.select("conv_id", F.concat(F.lit("["), F.array_join(F.from_json("quoted", "array<string>"), ","), F.lit("]")).alias("json"))
    return inspection.chat_messages(texts, "conv_id", "json")


@query(MESSAGES + """SELECT conv_id, form, (CASE WHEN k = 5 THEN 3 + 3 * n ELSE scope END)::int AS scope, label, path FROM c, (VALUES (0, 0, 0, 'messages', '$.messages'), (1, 1, 0, 'messages', '$.messages'), (2, 1, 0, 'conversation', '$.conversation'), (3, 1, 0, 'messages#2', '$.messages#2'), (4, 2, 1, 'conversations', '$[0].conversations'), (5, 2, 3, 'messages', '$[1].messages')) AS t(k, form, scope, label, path)""")
def conversation_candidates(spark, d):
    """Each conversation in files of five forms: fields of the root, repeated ones, items of a root array, an object in place of the array, and one too deep."""
    one = F.struct("turn", F.struct("role", "text").alias("m"))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all")).select("conv_id", F.to_json(F.transform("all", lambda x: x["m"])).alias("m"))
    forms = ['{"conv":1,"messages":M}', '{"messages":M,"conversation":M,"meta":{"messages":M},"messages":[1]}', '[{"conversations":M},{"messages":M},[[]]]', '{"messages":{"messages":M}}', '{"a":[{"messages":M}]}']
    files = own.select("conv_id", F.posexplode(F.array(*(F.concat(*(F.col("m") if x == "M" else F.lit(x) for x in re.split("(M)", form) if x)) for form in forms))).alias("form", "json"))
    # An identifier of one column: the conversation's and the form's.
    got = conversations.candidates(files.select((F.col("conv_id") * 5 + F.col("form")).alias("file"), "json"), "file", "json")
    return got.select(F.floor(F.col("file") / 5).cast("long").alias("conv_id"), F.pmod("file", F.lit(5)).cast("int").alias("form"), "scope", "label", "path")


def typed_messages(spark, d: str, style: str) -> DataFrame:
    """conv_id, turn, m: messages with typed content of a style."""
    text, call = F.col("text"), F.concat_ws("-", "conv_id", "turn")
    if style == "openai":
        calls = F.array(F.struct(call.alias("id"), F.lit("function").alias("type"), F.struct(F.concat(F.lit("f"), F.col("turn")).alias("name"), F.lit("{}").alias("arguments")).alias("function")))
        m = F.to_json(F.struct("role", F.col("text").alias("content"), calls.alias("tool_calls")))
    else:
        m = F.to_json(F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("from"), F.array(text, F.lit("x")).alias("value")))
    return table(spark, d, "conversations").select("conv_id", "turn", m.alias("m"))


SHOWN = "SELECT conv_id, turn, {} AS block, {} AS field, {} AS element, {} AS category, {} AS text FROM conversations"
union = lambda *rows: " UNION ALL ".join(SHOWN.format(*(f"{v}" for v in r)) for r in rows)


ELEMENTS = [("'text'", "text"), ("'thinking'", "text"), ("'redactedThinking'", "role"), ("'toolUse'", "role"), ("'toolResult'", "concat(conv_id, '-', turn)"), *[("'unknown'", "NULL")] * 5]
HEAD = [(0, "NULL", "NULL::int", "'header'", "role"), (1, "'role'", "NULL::int", "'role'", "role")]
TYPED = union(*HEAD, (2, "'content'", "NULL::int", "'content'", "NULL"), *((3 + k, "'content'", k, *e) for k, e in enumerate(ELEMENTS))).replace("conv_id, turn,", "conv_id, turn * 2 AS turn,")
PLAIN = union(*HEAD, (2, "'content'", "NULL::int", "'text'", "text"), (3, "'id'", "NULL::int", "'unknown'", "concat(conv_id, '-', turn)")).replace("conv_id, turn,", "conv_id, turn * 2 + 1 AS turn,")


@query(TYPED + " UNION ALL " + PLAIN)
def anthropic_blocks(spark, d):
    """Each message twice: with an element of every type and of every way to be none, and with a plain text and a field that isn't known."""
    said, call, lit = F.col("text"), F.concat_ws("-", "conv_id", "turn"), F.lit
    of = lambda *fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields)))
    typed = lambda name, *fields: of(("type", lit(name)), *fields)
    elements = [
        typed("text", ("text", said)), typed("thinking", ("thinking", said)), typed("redacted_thinking", ("data", F.col("role"))),
        typed("tool_use", ("id", call), ("name", F.col("role")), ("input", F.struct(lit(1).alias("a")))), typed("tool_result", ("tool_use_id", call), ("content", F.array(said))),
        typed("tool_use", ("id", call), ("name", F.col("role")), ("input", lit("x"))), lit('{"type":"text","text":"a","text":"b"}'), lit('"bare"'), of(("text", said)), lit('{"type":"tool_use"}'),
    ]
    role = F.concat(lit('{"role":"'), "role", lit('","content":'))
    own = table(spark, d, "conversations")
    first = own.select("conv_id", (F.col("turn") * 2).alias("turn"), F.concat(role, lit("["), F.concat_ws(",", *elements), lit("]}")).alias("m"))
    plain = own.select("conv_id", (F.col("turn") * 2 + 1).alias("turn"), of(("role", F.col("role")), ("content", said), ("id", call)).alias("m"))
    return conversations.message_blocks(first.union(plain), "conv_id", "turn", "m", "anthropic")


@query(union((0, "NULL", "NULL::int", "'header'", "role"), (1, "'role'", "NULL::int", "'role'", "role"), (2, "'content'", "NULL::int", "'text'", "text"), (3, "'tool_calls'", "NULL::int", "'tool'", "NULL"), (4, "'tool_calls'", 0, "'toolCall'", "concat('f', turn)")))
def openai_blocks(spark, d):
    return conversations.message_blocks(typed_messages(spark, d, "openai"), "conv_id", "turn", "m", "openai")


@query(union((0, "NULL", "NULL::int", "'header'", "role"), (1, "'from'", "NULL::int", "'role'", "CASE role WHEN 'user' THEN 'human' ELSE role END"), (2, "'value'", "NULL::int", "'value'", "NULL"), (3, "'value'", 0, "'value'", "text"), (4, "'value'", 1, "'value'", "'x'")))
def generic_blocks(spark, d):
    return conversations.message_blocks(typed_messages(spark, d, "generic"), "conv_id", "turn", "m", "generic")


@query("WITH b AS (SELECT conv_id, turn, unnest(range(0, 5))::int AS block FROM conversations) SELECT conv_id, turn, block FROM b WHERE conv_id > 2 OR (conv_id = 2 AND (turn > 1 OR (turn = 1 AND block > 3))) ORDER BY conv_id, turn, block LIMIT 100")
def block_pages(spark, d):
    """A page of 100 blocks after a cursor."""
    own = conversations.message_blocks(typed_messages(spark, d, "generic"), "conv_id", "turn", "m", "generic")
    return inspection.keyset_page(own, ["conv_id", "turn", "block"], (2, 1, 3), 100, 100).select("conv_id", "turn", "block")


@query("SELECT conv_id, count(*) AS n_messages, CASE conv_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN CASE WHEN count(*) >= 2 THEN 'generic' ELSE 'possible' END WHEN 3 THEN CASE WHEN bool_or(turn = 0) AND bool_or(turn = 1) THEN 'mixed' WHEN bool_or(turn = 0) THEN 'openai' WHEN bool_or(turn = 1) THEN 'anthropic' WHEN count(*) >= 2 THEN 'generic' ELSE 'possible' END ELSE 'none' END AS kind FROM conversations GROUP BY conv_id")
def protocol_kinds(spark, d):
    """Conversations of every protocol, each known by what its messages hold."""
    own = table(spark, d, "conversations")
    plain = F.to_json(F.struct("role", F.col("text").alias("content")))
    openai = F.concat(F.lit('{"role":"tool","content":"'), F.lit("done"), F.lit('"}'))
    anthropic = F.concat(F.lit('{"role":"user","content":["x",{"type":"thinking","thinking":"'), F.col("conv_id").cast("string"), F.lit('"}]}'))
    k = F.col("conv_id") % 5
    m = F.when(k == 0, openai).when(k == 1, anthropic).when(k == 2, plain).when(k == 3, F.when(F.col("turn") == 0, openai).when(F.col("turn") == 1, anthropic).otherwise(plain)).otherwise('{"other":1}')
    return conversations.kinds(own.select("conv_id", m.alias("m")), "conv_id", "m")


@query("SELECT conv_id, element::int AS element, category, CASE WHEN category = 'text' THEN said END AS text FROM (SELECT conv_id, NULL AS element, 'text' AS category, min_by(text, turn) AS said FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id UNION ALL SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, CASE WHEN turn % 2 = 0 THEN 'text' ELSE 'unknown' END, text FROM conversations WHERE conv_id % 2 = 1)")
def system_fields(spark, d):
    """System fields: the first text of some conversations, an array of typed blocks of others."""
    block = F.when(F.col("turn") % 2 == 0, F.struct(F.lit("text").alias("type"), "text")).otherwise(F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b"), "text"))).alias("all"))
    json = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("all")[0]["text"].alias("system")))).otherwise(F.to_json(F.struct(F.transform("all", lambda x: x["b"]).alias("system"))))
    return conversations.system_blocks(own.select("conv_id", json.alias("json")), "conv_id", "json")


ROLES = """WITH m AS (SELECT conv_id, turn, concat('<|', role, '|>', chr(10)) AS a, role, text, concat('<|end|>', chr(10)) AS z FROM conversations),
p AS (SELECT *, coalesce(sum(length(a) + length(text) + length(z)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(a) AS begin FROM m),
r AS (SELECT conv_id, string_agg(concat(a, text, z), '' ORDER BY turn) AS t FROM m GROUP BY conv_id),
s AS (SELECT conv_id, regexp_extract_all(t, '[^ \\n]+|[ \\n]+') AS s FROM r),
u AS (SELECT conv_id, unnest(s) AS segment, unnest(range(0, len(s))) AS position FROM s),
e AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY position) AS stop FROM u)
SELECT e.conv_id, position::int AS position, segment, coalesce(p.role, 'template') AS role FROM e LEFT JOIN p ON e.conv_id = p.conv_id AND stop - length(segment) >= begin AND stop <= begin + length(text)"""


@query(ROLES)
def token_roles(spark, d):
    """Whose message each piece of a rendered conversation is from."""
    own = table(spark, d, "conversations")
    bodies = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("body")))).alias("bodies"))
    rendered = conversations.rendered(own, "conv_id", "turn", "role", "text")
    both = rendered.join(bodies, "conv_id").select("conv_id", "text", F.transform("bodies", lambda b: F.struct(b["role"].alias("role"), b["body"].alias("body"))).alias("bodies"), F.regexp_extract_all("text", F.lit(r"[^ \n]+|[ \n]+"), F.lit(0)).alias("segments"))
    return vocabularies.attributed(both, "conv_id")


# ---- JSON texts of events

BROKEN = "CASE event_id % 8 WHEN 0 THEN {} WHEN 1 THEN {} WHEN 2 THEN {} WHEN 3 THEN {} WHEN 4 THEN {} WHEN 5 THEN {} WHEN 6 THEN {} END"


@query("SELECT event_id, " + ", ".join(BROKEN.format(*v) + f" AS {name}" for name, v in {
    "code": ("'expected_object_value_separator'", "'trailing_data'", "'expected_scalar_json_value'", "'expected_object_key'", "'unpaired_high_surrogate'", "'leading_zero_not_allowed'", "'unterminated_string'"),
    '"at"': ("length(props) - 1", "length(props) + 1", "length(props) + 2", "2", "7", "2", "length(props) + 6"),
    '"line"': ("1", "1", "1", "2", "1", "1", "1"), '"column"': ("length(props)", "length(props) + 2", "length(props) + 3", "2", "8", "3", "length(props) + 7"),
}.items()) + " FROM events")
def json_error_places(spark, d):
    """Kinds and places of the first errors of texts that are broken in turn in seven ways; every eighth is valid."""
    p = F.col("props")
    quoted = F.concat(F.lit('{"x":"'), F.regexp_replace(p, '"', "."))
    ways = [F.left(p, F.length(p) - 1), F.concat(p, F.lit(" x")), F.concat(F.lit("["), p, F.lit(",]")), F.lit("\n{1}"), F.lit('"\\ud800"'), F.concat(F.lit("[0"), F.col("event_id").cast("string"), F.lit("]")), quoted]
    text_ = p
    for k, way in enumerate(ways):
        text_ = F.when(F.col("event_id") % 8 == k, way).otherwise(text_)
    return table(spark, d, "events").select("event_id", entries.strict_error(text_).alias("e")).select("event_id", "e.*")


@query("""SELECT event_id, 1 AS depth, '$ → $.outer' AS path, concat('{"inner":"', replace(props, '"', '\\"'), '"}') AS text FROM events UNION ALL SELECT event_id, 2, '$ → $.outer → $.inner', props FROM events""")
def nested_scopes(spark, d):
    """JSON in strings of JSON in strings."""
    inner = F.to_json(F.struct(F.col("props").alias("inner")))
    own = table(spark, d, "events").select("event_id", F.to_json(F.struct(inner.alias("outer"))).alias("json"))
    return entries.nested_scopes(own, "event_id", "json")


@query("""WITH e AS (SELECT event_id, props->>'k' AS k, chr(10) AS n, format('{:.17g}', (event_id * 2 + 1) / 2.0) AS half FROM events)
SELECT event_id, concat('{', n, '  "a" : [', n, '    ', k, ',', n, '    ', half, n, '  ],', n, '  "a\\/b" : [', n, '    1,', n, '    0.10000000000000001,', n, '    1e+30', n, '  ],', n, '  "b" : {', n, n, '  },', n, '  "e" : [', n, n, '  ],', n, '  "k" : ', k, ',', n, '  "s" : "\\"é', k, '"', n, '}') AS pretty,
concat('{', n, '  "k" : ', k, n, '}') AS repeated, concat('"\\"é', k, '"') AS said, concat('[', n, n, ']') AS empty, '0' AS zero, NULL::varchar AS broken FROM e""")
def pretty_sorted(spark, d):
    """Objects of events with keys out of order, escapes, empty values and numbers in many forms; repeated keys; texts, empty arrays and numbers by themselves; what is cut short."""
    k, lit = F.get_json_object("props", "$.k"), F.lit
    half = F.concat((F.col("event_id") * 10 + 5).cast("string"), lit("e-1"))
    said = F.concat(lit('"\\u0022\\u00e9'), k, lit('"'))
    own = F.concat(lit('{"s":'), said, lit(',"k":'), k, lit(',"e":[],"b":{},"a/b":[1,0.1,1e30],"a":['), k, lit(","), half, lit("]}"))
    forms = {"pretty": own, "repeated": F.concat(lit('{"k":1,"k":'), k, lit("}")), "said": said, "empty": F.substring(F.concat(lit("[]"), k), 1, 2), "zero": F.substring(F.concat(lit("-0"), k), 1, 2), "broken": F.concat(lit('{"k":'), k)}
    return table(spark, d, "events").select("event_id", *(entries.sorted_pretty(v).alias(c) for c, v in forms.items()))


@query("""SELECT event_id, key, start::int AS start, (start + length(key) + 2)::int AS "end" FROM (SELECT event_id, 'first' AS key, 1 AS start FROM events UNION ALL SELECT event_id, 'k', length(event_id::varchar) + 11 FROM events)""")
def root_key_ranges(spark, d):
    own = F.concat(F.lit('{"first":'), F.col("event_id").cast("string"), F.lit(",\n"), F.expr("substring(props, 2)"))
    return table(spark, d, "events").select("event_id", F.explode(entries.key_ranges(own)).alias("r")).select("event_id", "r.*")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id::varchar ELSE format('{:.16g}', round(value * 100)::bigint / 100.0::double) END AS shown FROM events")
def number_texts(spark, d):
    cents = F.concat(F.round(F.col("value") * 100).cast("bigint").cast("string"), F.lit("e-2"))
    lexeme = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") == 0, F.lit("-0")).otherwise(F.col("event_id").cast("string"))).otherwise(cents)
    return table(spark, d, "events").select("event_id", templates.number_text(lexeme).alias("shown"))


@query("SELECT count(*) AS entries, count(*) FILTER (event_id % 7 <> 0 AND (event_id % 13 <> 0 OR event_id % 11 = 0) AND contains(concat('k', CASE WHEN event_id % 11 = 0 THEN '1' ELSE '' END, props->>'k'), '7')) AS matched, count(*) FILTER (event_id % 7 = 0 OR (event_id % 13 = 0 AND event_id % 11 <> 0)) AS skipped_invalid_json, 0::bigint AS skipped_invalid_utf8, 0::bigint AS skipped_oversized FROM events")
def entry_filter(spark, d):
    """Entries whose decoded values hold a digit, and those that are skipped for being broken."""
    own = table(spark, d, "events").select("event_id", broken(F.col("props")).cast("binary").alias("raw"))
    return entries.filter_counts(entries.filtered_entries(own, "raw", "7"))


# ---- files of entries


def event_lines(spark, d: str) -> str:
    """A folder with the events as JSONL files, each with its identifier, in their order, a blank line after every fifth and a carriage return after every third."""
    path = scratch.folder(spark)
    known = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(","), F.expr("substring(json, 2)")).alias("json")
    own = event_json(spark, d).select("event_id", known).repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    line = F.concat("json", F.when(F.col("event_id") % 3 == 0, "\r").otherwise(""), F.when(F.col("event_id") % 5 == 0, "\n \t").otherwise(""))
    own.select(line.alias("value")).write.text(path)
    return path


def event_of(raw: str) -> Column:
    """The identifier that an entry has: other fields of two events may be the same."""
    return F.get_json_object(F.col(raw).cast("string"), "$.id").cast("long")


LINES = "WITH l AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1)::bigint AS ordinal, (row_number() OVER (ORDER BY event_id) + count(*) FILTER (event_id % 5 = 0) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::bigint AS source_line FROM events) "


def in_a_row(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` with ordinals and lines that go on from file to file. ``counts``: file, n, lines."""
    before = counts.alias("a").join(counts.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy(F.col("a.file").alias("file")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"), F.coalesce(F.sum("b.lines"), F.lit(0)).alias("lines_before"))  # a row a file
    return found.join(F.broadcast(before), "file").withColumns({"ordinal": F.col("ordinal") + F.col("before"), "source_line": F.col("source_line") + F.col("lines_before")})


@query(LINES + "SELECT event_id, ordinal, source_line, 'Valid' AS status FROM l")
def jsonl_entries(spark, d):
    """Entries of JSONL files with the numbers of their lines."""
    own = jsonl.entries(spark, event_lines(spark, d))
    counts = own.groupBy("file").agg(F.count("*").alias("n"), F.max("source_line").alias("last"), F.max_by(event_of("raw"), "source_line").alias("event_id"))
    # Behind a file's last entry a blank line may follow.
    counts = counts.select("file", "n", (F.col("last") + (F.col("event_id") % 5 == 0).cast("int")).alias("lines"))
    got = in_a_row(entries.entry_status(own, "raw"), counts)
    return got.select(event_of("raw").alias("event_id"), "ordinal", "source_line", "status")


@query(LINES + "SELECT event_id, ordinal FROM l WHERE ordinal % 97 = 0")
def entry_lookups(spark, d):
    """Single entries by ordinal, through a sparse index, those of a stride by one read of it."""
    index = jsonl_index.build(spark, event_lines(spark, d), most=64)
    counts = index.files.select("file", "n", "lines")
    before = counts.alias("a").join(counts.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy(F.col("a.file").alias("file"), F.col("a.n").alias("n")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    first = F.pmod(97 - F.col("before") % 97, F.lit(97))
    wanted = before.where(first < F.col("n")).select("file", F.explode(F.sequence(first, F.col("n") - 1, F.lit(97))).alias("ordinal"))
    got = in_a_row(jsonl_index.entries_at(index, wanted), counts)
    return got.select(event_of("raw").alias("event_id"), "ordinal")


ROUTES = {0: (".json", "Collection"), 1: (".json", "Document"), 2: (".jsonl", "Entry"), 3: (".txt", "Entry"), 4: (".txt", "Choice"), 5: (".txt", "Unsupported"), 6: (".json5", "Unsupported"), 7: ("", "Document")}
by_eight = lambda values: "CASE c_custkey % 8 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


@query(f"SELECT concat('c', c_custkey, {by_eight({k: repr(e) for k, (e, _) in ROUTES.items()})}) AS path, {by_eight({k: repr(r if k != 4 else 'Entry') for k, (_, r) in ROUTES.items()})} AS route, {by_eight({0: repr('conflict'), 1: repr('conflict'), 2: 'NULL', 3: repr('not allowed'), 4: 'NULL', 5: 'NULL', 6: 'NULL', 7: repr('not allowed')})} AS error FROM customer")
def file_routes(spark, d):
    """Files of eight kinds routed by name and content, then with a wish for entries."""
    k, name = F.col("c_custkey") % 8, F.to_json(F.struct(F.col("c_name").alias("n")))
    content = F.when(k == 0, F.concat(F.lit(" ["), name, F.lit("]"))).when(k == 1, name).when(k == 3, F.concat(name, F.lit("\n\n"), F.lit('{"a":1,"a":2}\n'))).when(k == 5, F.concat(name, F.lit(" {}\n"))).when(k == 7, F.col("c_custkey").cast("string")).otherwise(F.concat(F.lit("words "), "c_name"))
    path = F.concat(F.lit("c"), "c_custkey", F.element_at(F.create_map(*(F.lit(x) for k, (e, _) in ROUTES.items() for x in (k, e))), k.cast("int")))
    routed = jsonl.routes(table(spark, d, "customer").select(path.alias("path"), content.cast("binary").alias("content")))
    return jsonl.chosen(routed, "Entry")


@query("SELECT count(*) AS n, count(*) FILTER (doc_id % 4 = 0) AS invalid, count(*) FILTER (doc_id % 4 = 0) * 5 > count(*) AS many FROM documents")
def many_invalid(spark, d):
    raw = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("C3")))).otherwise(F.col("text").cast("binary"))
    return jsonl.many_invalid(table(spark, d, "documents").select(raw.alias("raw")), "raw")


@query("SELECT concat('f', c_custkey) AS path, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AS current FROM customer")
def files_unchanged(spark, d):
    """Which files are as they were: of some the size has changed, of some the time, and some are gone."""
    k = F.col("c_custkey")
    own = table(spark, d, "customer").select(k, F.concat(F.lit("f"), k).alias("path"), F.lit(100).cast("long").alias("length"), F.lit("t").alias("modificationTime"))
    now = own.where(k % 7 != 0).withColumns({"length": F.when(k % 3 == 0, 101).otherwise(100).cast("long"), "modificationTime": F.when(k % 5 == 0, "u").otherwise("t")})
    return jsonl.unchanged(now.drop("c_custkey"), own.drop("c_custkey"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 3000 THEN hex(encode(text))[1:40] END AS head, CASE WHEN strlen(text) > 3000 THEN right(hex(encode(text)), 40) END AS tail FROM documents")
def oversized_previews(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    return jsonl.oversized_preview(own, "raw", 3000, 20).select("doc_id", F.hex("head").alias("head"), F.hex("tail").alias("tail"))


@query("SELECT n_nationkey, n_name, n_regionkey, 'json' AS kind FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'csv' FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey, 'yaml' FROM nation")
def written_results(spark, d):
    """Results written as JSON, CSV and YAML, and read back."""
    own, path = table(spark, d, "nation"), scratch.folder(spark)
    sinks.write_json(own, f"{path}/json")
    sinks.write_csv(own, f"{path}/csv")
    sinks.write_yaml(own, f"{path}/yaml")
    schema = own.schema
    lines = spark.read.text(f"{path}/yaml", lineSep="- ").where("value <> ''")
    field = lambda c: F.regexp_extract("value", rf'{c}: "?([^"\n]*)', 1)
    yaml = lines.select(*(field(f.name).cast(f.dataType).alias(f.name) for f in schema), F.lit("yaml").alias("kind"))
    json = spark.read.schema(schema).json(f"{path}/json").withColumn("kind", F.lit("json"))
    return json.union(spark.read.schema(schema).option("header", "true").csv(f"{path}/csv").withColumn("kind", F.lit("csv"))).union(yaml)


# ---- texts


@query("""SELECT doc_id, strlen(left(text, k::int))::int AS size, left(text, k::int) AS chunk, CASE WHEN strlen(left(text, k::int)) < strlen(text) THEN strlen(left(text, k::int))::int END AS next FROM (SELECT doc_id, text, list_max(list_filter(range(0, 42), lambda k: strlen(left(text, k::int)) <= 41)) AS k FROM documents)""")
def text_chunks(spark, d):
    """The first 41 bytes of each text, cut back to whole characters, and where the next ones begin."""
    got = table(spark, d, "documents").select("doc_id", entries.text_chunk(F.col("text"), 0, 41).alias("c"))
    return got.select("doc_id", F.octet_length("c.text").alias("size"), F.col("c.text").alias("chunk"), F.col("c.next").alias("next"))


@query("WITH p AS (SELECT doc_id, string_split(text, 'an') AS s FROM documents WHERE contains(text, 'an')), o AS (SELECT doc_id, k, list_sum(list_transform(s[1:k], lambda x: strlen(x)))::bigint + (k - 1) * 2 AS start FROM p, LATERAL (SELECT unnest(range(1, len(s))) AS k)) SELECT doc_id, start FROM o")
def byte_matches(spark, d):
    """Where a literal stands in each text, in bytes, found in windows of a KiB."""
    return text.byte_matches(table(spark, d, "documents"), "doc_id", "text", "an", 1024)


@query("SELECT doc_id, (len(regexp_extract_all(left(text, 500), '\\r\\n|\\r|\\n')) + 1)::bigint AS line FROM documents")
def lines_at(spark, d):
    return table(spark, d, "documents").select("doc_id", text.line_at(F.col("text"), 500).alias("line"))


@query("SELECT doc_id, lower(hex(encode(left(text, 9)))) AS hex, left(text, 9) AS lossy FROM documents")
def copied_bytes(spark, d):
    own = F.left("text", F.lit(9)).cast("binary")
    return table(spark, d, "documents").select("doc_id", inspection.copied(own, "hex").alias("hex"), inspection.copied(own, "lossy").alias("lossy"))


MADE = {0: "markdown", 1: "markdown", 2: "code", 3: "json", 4: "markdown", 5: "html", 6: "plain", 7: "markdown", 8: "plain", 9: "code"}


@query("SELECT doc_id, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MADE.items()) + " END AS kind FROM documents")
def detected_made(spark, d):
    """Headings, fences, code, JSON, tables, HTML, plain text, lists, broken JSON and named code, each made around a document's number."""
    k, i = F.col("doc_id") % 10, F.col("doc_id").cast("string")
    ways = [F.concat(F.lit("# title "), i), F.concat(F.lit("```py\nx "), i, F.lit("\n```")), F.concat(F.lit("def f(x):\n    return "), i), F.concat(F.lit('{"a":'), i, F.lit(',"a":1}')), F.concat(F.lit("| a | b |\n| --- | :---: |\n| 1 | "), i), F.concat(F.lit("\n<p>"), i, F.lit("</p>")), F.concat(F.lit("word "), i), F.concat(F.lit("- a\n- "), i), F.concat(F.lit('{"a":'), i), F.concat(F.lit("let x = "), i)]
    own = ways[0]
    for n, way in enumerate(ways):
        own = F.when(k == n, way).otherwise(own)
    df = table(spark, d, "documents").select("doc_id", own.alias("s"), F.when(k == 9, "Source").alias("key"))
    return df.select("doc_id", text.detected(F.col("s"), F.col("key"), markup.looks_html(F.col("s"))).alias("kind"))


@query("SELECT doc_id, concat(lang, ' (http://x/', doc_id, ') [image: ', source, '] (i.png)') AS safe FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def safe_markdown(spark, d):
    s = F.concat(F.lit("["), "lang", F.lit("](http://x/"), F.col("doc_id").cast("string"), F.lit(") !["), "source", F.lit("](i.png)"))
    return table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", markup.safe_markdown(s).alias("safe"))


@query("SELECT doc_id, concat('# ', doc_id, chr(10), left(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 50), chr(10), '```', chr(10), '<b>', doc_id, '</b>', chr(10), '```', chr(10), 'end') AS body FROM documents")
def model_cards(spark, d):
    """Cards made around documents: front matter, tags and comments go, fences stay."""
    i, said = F.col("doc_id").cast("string"), F.left(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit(50))
    s = F.concat(F.lit("---\nlicense: x\n---\n# "), i, F.lit("<!-- c -->\n<p>"), said, F.lit("</p>\n```\n<b>"), i, F.lit("</b>\n```\n<i>end</i>"))
    return table(spark, d, "documents").select("doc_id", markup.card_body(s).alias("body"))


@query("SELECT conv_id, (2 * i + 1)::int AS start_line, (2 * i + 2)::int AS end_line FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)")
def python_folds(spark, d):
    """Folds of source files with a function for each message."""
    part = F.concat(F.lit("def f"), F.col("turn").cast("string"), F.lit("():\n    return '"), "role", F.lit("'"))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))), lambda x: x["p"]), "\n").alias("s"))
    return templates.indent_folds(own, "conv_id", "s", templates.PYTHON_HEADER)


@query("WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, 1 AS start_line, (n + 3)::int AS end_line FROM n UNION ALL SELECT conv_id, 2, (n + 3)::int FROM n")
def json_folds(spark, d):
    """Folds of JSON files that have an array with a line for each message."""
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.lit('{\n"a":[\n'), F.array_join(F.transform(F.sort_array(F.collect_list("turn")), lambda x: x.cast("string")), ",\n"), F.lit("\n]}")).alias("s"))
    return own.select("conv_id", F.explode(templates.json_folds("s")).alias("f")).select("conv_id", "f.*")


@query("SELECT n_nationkey, start::int AS start, stop::int AS \"end\", kind FROM (SELECT n_nationkey, length(n_name) AS n FROM nation), LATERAL (VALUES (n, n + 2, 'delimiter'), (n + 2, n + 3, 'statement'), (n + 3, n + 5, 'keyword'), (n + 5, 2 * n + 7, 'statement'), (2 * n + 7, 2 * n + 9, 'delimiter')) AS t(start, stop, kind)")
def jinja_spans(spark, d):
    s = F.concat("n_name", F.lit("{% if "), "n_name", F.lit(" %}"))
    return table(spark, d, "nation").select("n_nationkey", F.explode(templates.jinja_spans(s)).alias("r")).select("n_nationkey", "r.*")


# ---- searches


@query("SELECT event_id, CASE WHEN contains(concat('k', props->>'k'), '7') THEN 'matched' ELSE 'unmatched' END AS outcome FROM events ORDER BY event_id LIMIT 600")
def search_steps(spark, d):
    """Three steps of a search over entries, each from where the one before ended."""
    own, after, out = table(spark, d, "events").select("event_id", F.col("props").cast("binary").alias("raw")), None, None
    for _ in range(3):
        now = searches.step(own, "event_id", "raw", "7", after).select("event_id", "outcome")
        after = now.agg(F.max("event_id")).first()[0]
        out = now if out is None else out.union(now)
    return out


@query("""WITH p AS (SELECT page_id, string_split(html, '<') AS s FROM pages), t AS (SELECT page_id, k, s[k] AS x, list_sum(list_transform(s[1:k - 1], lambda y: length(y) + 1))::bigint AS base FROM p, LATERAL (SELECT unnest(range(2, len(s) + 1)) AS k)),
n AS (SELECT page_id, base + instr(x, '>') AS base, substr(x, instr(x, '>') + 1) AS txt FROM t WHERE NOT starts_with(x, 'script') AND NOT starts_with(x, 'style') AND NOT starts_with(x, '!--')),
q AS (SELECT page_id, base, string_split(txt, 'eau') AS s FROM n WHERE contains(txt, 'eau')),
o AS (SELECT page_id, base + list_sum(list_transform(s[1:k], lambda y: length(y)))::bigint + (k - 1) * 3 AS source_start FROM q, LATERAL (SELECT unnest(range(1, len(s))) AS k))
SELECT page_id, source_start::int AS source_start, (source_start + 3)::int AS source_end FROM o""")
def rendered_matches(spark, d):
    """Where in the source of pages what a reader sees matches."""
    got = table(spark, d, "pages").select("page_id", F.explode(markup.rendered_matches(F.col("html"), "eau")).alias("m"))
    return got.select("page_id", "m.source_start", "m.source_end")
