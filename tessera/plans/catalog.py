"""Queries of the library's own operators over the given tables, by name, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.operators import attention, consistency, conversations, entries, markup, names, subwords, tensors, vocabularies

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def logits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


X = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::double) AS x FROM embeddings),
e AS (SELECT *, list_transform(x, lambda a: exp(a - list_max(x))) AS e FROM v),
s AS (SELECT *, list_transform(e, lambda a: a / list_sum(e)) AS p FROM e),
h AS (SELECT *, list_transform(p, lambda a: (a + 1e-12) / (1 + len(p) * 1e-12)) AS q, list_reverse_sort(p) AS b FROM s)
"""
ENTROPY = "(-list_sum(list_transform(q, lambda a: a * ln(a))))"


@query(X + f"SELECT vec_id, round(list_avg(x), 6) AS mean, round(list_stddev_pop(x), 6) AS std, round(list_min(x), 6) AS min, round(list_max(x), 6) AS max, round({ENTROPY}, 6) AS entropy, round(exp({ENTROPY}), 6) AS perplexity, round(list_max(p), 6) AS max_prob, round(list_sum(b[1:5]), 6) AS top5_prob_sum FROM h")
def logit_statistics(spark, d):
    return rounded(tensors.logit_statistics(logits(spark, d), "vec_id", "x"))


@query(X + f", t AS (SELECT vec_id, list_transform(x, lambda a: exp((a - list_max(x)) / 1.5)) AS t FROM v) SELECT vec_id, round(list_max(p), 6) AS max_prob, round({ENTROPY}, 6) AS entropy, round({ENTROPY} / ln(len(p)), 6) AS normalised_entropy, round(list_sum(b[1:5]), 6) AS top_5_prob_sum, round(list_max(p), 6) AS top_1_prob, round(b[1] - b[2], 6) AS margin, round(list_max(t) / list_sum(t), 6) AS temperature_scaled_max, round(list_var_samp(p), 6) AS prob_variance, round(list_stddev_samp(p), 6) AS prob_std FROM h JOIN t USING (vec_id)")
def confidence_all(spark, d):
    return rounded(tensors.confidence(logits(spark, d), "vec_id", "x"))


@query(X + ", u AS (SELECT vec_id, unnest(p) AS prob, unnest(x) AS logit, generate_subscripts(p, 1) - 1 AS token_id FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, token_id) AS rank FROM u) SELECT vec_id, rank::int AS rank, token_id::int AS token_id, round(prob, 6) AS prob, round(logit, 6) AS logit FROM r WHERE rank <= 10")
def top_tokens(spark, d):
    return rounded(tensors.top_tokens(logits(spark, d), "vec_id", "x"))


@query(X + "SELECT vec_id, label, round(list_max(x) + ln(list_sum(e)) - x[label + 1], 6) AS surprisal FROM h")
def token_surprisal(spark, d):
    return rounded(tensors.token_surprisal(logits(spark, d), "vec_id", "x", "label"))


@query(X + "SELECT label, round(exp(avg(list_max(x) + ln(list_sum(e)) - x[label + 1])), 6) AS perplexity, count(*) AS n FROM h GROUP BY label")
def perplexity(spark, d):
    return rounded(tensors.perplexity(logits(spark, d), "label", "x", "label"))


@query("WITH v AS (SELECT label, arg_max(list_transform(embedding, lambda x: x::double), vec_id) AS x FROM embeddings GROUP BY label) SELECT label, round(list_avg(x), 6) AS mean, len(x)::int AS size FROM v")
def last_position(spark, d):
    own = tensors.last_position(logits(spark, d), "label", "vec_id", "x")
    return rounded(own.select("label", stats.mean(F.col("x")).alias("mean"), F.size("x").alias("size")))


@query(X + "SELECT vec_id, len(x)::int AS size, round(list_avg(x), 6) AS mean, round(list_stddev_samp(x), 6) AS std, round(sqrt(list_sum(list_transform(x, lambda a: a * a))), 6) AS norm, round(list_min(x), 6) AS min, round(list_max(x), 6) AS max FROM v")
def hidden_statistics(spark, d):
    return rounded(tensors.hidden_statistics(logits(spark, d), "vec_id", "x"))


SHARP = X.replace("x::double", "x::double * 20")


@query(SHARP + "SELECT CASE WHEN list_max(p) > 0.8 THEN 'high' WHEN list_max(p) > 0.5 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM h GROUP BY 1")
def confidence_levels(spark, d):
    own = logits(spark, d).select(F.array_max(stats.softmax(F.transform("x", lambda a: a * 20))).alias("p"))
    return own.groupBy(stats.confidence_level(F.col("p")).alias("level")).agg(F.count("*").alias("n"))


@query(X + f", c AS (SELECT label, vec_id, list_max(p) AS max_prob, {ENTROPY} AS entropy FROM h), l AS (SELECT label, vec_id, 'max_prob' AS metric, max_prob AS value FROM c UNION ALL SELECT label, vec_id, 'entropy', entropy FROM c), g AS (SELECT label, metric, arg_min(value, vec_id) AS a, arg_max(value, vec_id) AS b, stddev_pop(value) AS std, max(value) - min(value) AS range FROM l GROUP BY ALL HAVING count(*) >= 2) SELECT label, metric, CASE WHEN b > a THEN 'increasing' ELSE 'decreasing' END AS trend, round(b / a, 6) AS change_ratio, round(std, 6) AS std, round(range, 6) AS range FROM g")
def confidence_trends(spark, d):
    own = logits(spark, d).select("label", "vec_id", stats.softmax(F.col("x")).alias("p")).select("label", "vec_id", F.array_max("p").alias("max_prob"), stats.entropy(F.col("p")).alias("entropy"))
    return rounded(tensors.trends(own, "vec_id", ["max_prob", "entropy"], ["label"]))


def attention_rows(spark, d):
    """Each vector as a head's 8 x 8 weights, rows through a softmax; the label is the layer."""
    cells = logits(spark, d).select(F.col("label").alias("layer"), F.col("vec_id").alias("head"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: stats.softmax(F.slice(F.transform("x", lambda a: a * 10), i * 8 + 1, F.lit(8))))).alias("q", "row"))
    return cells.select("layer", F.lit(0).alias("batch"), "head", "q", F.posexplode("row").alias("k", "weight"))


ATT = """WITH c AS (SELECT label AS layer, vec_id AS head, unnest(embedding)::double * 10 AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
r AS (SELECT layer, head, i // 8 AS q, i % 8 AS k, x, max(x) OVER (PARTITION BY head, i // 8) AS m FROM c),
a AS (SELECT layer, head, q, k, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY head, q) AS weight FROM r),
z AS (SELECT layer, head, q, sum(weight + 1e-12) AS s, sum((weight + 1e-12) * ln(weight + 1e-12)) AS t FROM a GROUP BY ALL),
n AS (SELECT layer, head, ln(s) - t / s AS entropy FROM z)
"""


@query(ATT + "SELECT layer, q::int AS q, k::int AS k, round(avg(weight), 6) AS weight FROM a GROUP BY ALL")
def attention_mean(spark, d):
    return rounded(attention.mean_pattern(attention_rows(spark, d)))


@query(ATT + ", w AS (SELECT layer, head, avg(weight) AS mean, stddev_pop(weight) AS std, max(weight) AS max FROM a GROUP BY ALL), e AS (SELECT layer, head, avg(entropy) AS entropy FROM n GROUP BY ALL) SELECT layer, head, round(mean, 6) AS mean, round(std, 6) AS std, round(max, 6) AS max, round(entropy, 6) AS entropy FROM w JOIN e USING (layer, head)")
def attention_heads(spark, d):
    return rounded(attention.head_statistics(attention_rows(spark, d)))


@query(ATT + "SELECT layer, round(avg(entropy), 6) AS mean, round(stddev_pop(entropy), 6) AS std, round(min(entropy), 6) AS min, round(max(entropy), 6) AS max FROM n GROUP BY layer")
def attention_entropy(spark, d):
    return rounded(attention.entropy_distribution(attention_rows(spark, d)))


@query(ATT + "SELECT layer, round(avg(CASE WHEN weight < 0.1::double THEN 1.0::double ELSE 0 END), 6) AS below, round(avg(CASE WHEN weight > 0.1::double THEN 1.0::double ELSE 0 END), 6) AS above FROM a GROUP BY layer")
def attention_sparsity(spark, d):
    return rounded(attention.sparsity(attention_rows(spark, d)))


@query(ATT + "SELECT layer, round(avg(weight) FILTER (q = k), 6) AS mean, round(stddev_pop(weight) FILTER (q = k), 6) AS std, round(avg(weight) FILTER (q = k) / avg(weight), 6) AS dominance_vs_all, round(avg(weight) FILTER (q = k) / avg(weight) FILTER (q <> k), 6) AS dominance_vs_offdiag FROM a GROUP BY layer")
def attention_diagonal(spark, d):
    return rounded(attention.diagonal(attention_rows(spark, d)))


@query(ATT + "SELECT layer, round(sum(weight) FILTER (abs(q - k) <= 2) / sum(weight), 6) AS locality FROM a GROUP BY layer")
def attention_locality(spark, d):
    return rounded(attention.locality(attention_rows(spark, d)))


@query(ATT + ", p AS (SELECT x.layer, x.head, y.head AS head2, corr(x.weight, y.weight) AS r FROM a x JOIN a y USING (layer, q, k) WHERE x.head < y.head GROUP BY ALL) SELECT layer, round(avg(r), 5) AS mean, round(stddev_pop(r), 5) AS std, count(*) AS pairs FROM p GROUP BY layer")
def head_similarity(spark, d):
    return rounded(attention.head_similarity(attention_rows(spark, d)), 5)


@query(ATT + ", m AS (SELECT layer, q, k, avg(weight) AS w FROM a GROUP BY ALL), i AS (SELECT layer, k AS position, sum(w) AS incoming FROM m GROUP BY ALL), o AS (SELECT layer, q AS position, sum(w) AS outgoing, sum(w) FILTER (q = k) AS itself FROM m GROUP BY ALL) SELECT layer, position::int AS position, round(itself, 6) AS itself, round(incoming, 6) AS incoming, round(outgoing, 6) AS outgoing FROM i JOIN o USING (layer, position)")
def attention_attribution(spark, d):
    return rounded(attention.token_attribution(attention_rows(spark, d)))


@query("SELECT c_custkey, CASE WHEN p >= 1e9 THEN printf('%.1fB', p / 1e9) WHEN p >= 1e6 THEN printf('%.1fM', p / 1e6) WHEN p >= 1e3 THEN printf('%.1fK', p / 1e3) ELSE p::bigint::varchar END AS size, round(p * 4 / 1048576, 6) AS params_mb, round(2.0::double * 512 * 768 * 12 * 8 / 1048576, 6) AS activations_mb, round(p * 4 / 1048576 + 2.0::double * 512 * 768 * 12 * 8 / 1048576, 6) AS total_mb FROM (SELECT c_custkey, pow(7::double, c_custkey % 13) AS p FROM customer)")
def model_sizes(spark, d):
    p = F.pow(F.lit(7.0), F.col("c_custkey") % 13)
    own = table(spark, d, "customer").select("c_custkey", p.alias("p"))
    return rounded(own.select("c_custkey", stats.model_size(F.col("p")).alias("size"), *(c.alias(n) for n, c in stats.memory_mb(F.col("p"), F.lit(2), F.lit(512), F.lit(768), F.lit(12)).items())))


@query("SELECT CASE WHEN n LIKE '%gpt%' OR n LIKE '%causal%' THEN 'causal_lm' WHEN n LIKE '%bert%' OR n LIKE '%encoder%' THEN 'encoder' WHEN n LIKE '%t5%' OR n LIKE '%seq2seq%' THEN 'seq2seq' WHEN n LIKE '%vit%' OR n LIKE '%vision%' THEN 'vision_transformer' WHEN n LIKE '%clip%' THEN 'multimodal' WHEN n LIKE '%blip%' THEN 'vision_language' ELSE 'unknown' END AS kind, count(*) AS n FROM (SELECT lower(concat(p_name, p_brand, p_type)) AS n FROM part) GROUP BY 1")
def architectures(spark, d):
    return table(spark, d, "part").groupBy(tensors.architecture(F.concat("p_name", "p_brand", "p_type")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, strlen(text)::bigint AS bytes, length(text)::bigint AS chars, len(regexp_split_to_array(text, '\\r\\n|\\r|\\n'))::bigint AS lines FROM documents")
def string_metrics(spark, d):
    s = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.octet_length(s).cast("long").alias("bytes"), F.length(s).cast("long").alias("chars"), text.n_lines(s).alias("lines"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'thing')")
def literal_search(spark, d):
    return table(spark, d, "documents").where(F.contains("text", F.lit("thing"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, 'of.*?ing.the', 's')")
def glob_search(spark, d):
    return table(spark, d, "documents").where(F.rlike("text", F.lit(text.glob_pattern("of*ing?the")))).select("doc_id")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)token'))::bigint AS n FROM documents")
def find_count(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(text.find_pattern("token"))).cast("long").alias("n"))


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: x = 'the'))::bigint AS n FROM documents")
def find_whole_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(text.find_pattern("the", "fullWord"))).cast("long").alias("n"))


@query("WITH f AS (SELECT doc_id, text, instr(text, 'token =') AS p FROM documents WHERE contains(text, 'token =')) SELECT doc_id, concat(CASE WHEN greatest(p - 80, 1) > 1 THEN '…' ELSE '' END, substr(text, greatest(p - 80, 1), (p - greatest(p - 80, 1))::int), 'token =', substr(text, p + 7, 80), CASE WHEN p + 6 + 80 < length(text) THEN '…' ELSE '' END) AS snippet FROM f")
def search_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", text.find_snippet(F.col("text"), "token =").alias("snippet")).where("snippet IS NOT NULL")


@query()
def detected_kinds(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("source"), "text")
    pages = table(spark, d, "pages").select(F.lit("pages").alias("source"), F.col("html").alias("text"))
    props = table(spark, d, "events").select(F.lit("props").alias("source"), F.col("props").alias("text"))
    own = docs.union(pages).union(props)
    html = markup.looks_html(F.col("text"))
    return own.groupBy("source", text.detected(F.col("text"), None, html).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN regexp_matches(html, '(?i)^\\s*(?:SELECT|WITH)\\b') THEN 'sql' WHEN contains(html, 'var t=') THEN 'javascript' END AS language, count(*) AS n FROM pages GROUP BY 1")
def code_languages(spark, d):
    return table(spark, d, "pages").groupBy(text.code_language(F.col("html")).alias("language")).agg(F.count("*").alias("n"))


TAGS = """WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![A-Za-z][^>]*>', '', 'g'), '(?is)(<script\\b[^>]*>).*?(</script\\s*>)', '\\1\\2', 'g'), '(?is)(<style\\b[^>]*>).*?(</style\\s*>)', '\\1\\2', 'g') AS h FROM pages),
t AS (SELECT page_id, unnest(regexp_extract_all(h, '<(/?)([A-Za-z][A-Za-z0-9-]*)(?:"[^"]*"|''[^'']*''|[^>"''])*?(/?)>', 0)) AS t FROM b),
n AS (SELECT page_id, lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS tag, t LIKE '</%' AS closing FROM t),
c AS (SELECT page_id, tag, count(*) FILTER (NOT closing) AS opens, count(*) FILTER (closing) AS closes FROM n WHERE tag NOT IN ('area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr') GROUP BY ALL)
"""


@query(TAGS + "SELECT page_id, tag, opens, closes FROM c")
def html_tags(spark, d):
    return markup.tag_counts(table(spark, d, "pages"), "page_id", "html")


@query(TAGS + ", e AS (SELECT page_id, bool_and(opens = closes) AS even FROM c GROUP BY page_id) SELECT page_id, coalesce(even, true) AS balanced FROM pages LEFT JOIN e USING (page_id)")
def html_balance(spark, d):
    return markup.balanced(table(spark, d, "pages"), "page_id", "html")


@query()
def html_sanitised(spark, d):
    return table(spark, d, "pages").select("page_id", markup.sanitised("html").alias("safe"))


@query()
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", markup.rendered_text("html").alias("text"))


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role IN ('system','developer','user','assistant','tool','function','human','gpt','bot','model')) AS n_recognised, count(*) >= 2 AND count(*) FILTER (role IN ('system','developer','user','assistant','tool','function','human','gpt','bot','model')) >= count(*) - count(*) // 5 AND count(role) >= count(*) - count(*) // 5 AND count(text) >= count(*) - count(*) // 5 AS generic FROM conversations GROUP BY conv_id")
def conversation_profile(spark, d):
    return conversations.profile(table(spark, d, "conversations"), "conv_id", "role", "text")


@query("SELECT CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' WHEN 'function' THEN 'tool' WHEN 'system' THEN 'system' WHEN 'developer' THEN 'developer' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'tool' THEN 'tool' ELSE 'unknown' END AS role, count(*) AS n FROM conversations GROUP BY 1")
def normal_roles(spark, d):
    return table(spark, d, "conversations").groupBy(conversations.normal_role(F.col("role")).alias("role")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, count(*) AS n_messages, CASE WHEN count(*) >= 2 THEN 'generic' ELSE 'possible' END AS kind FROM conversations GROUP BY conv_id")
def conversation_kinds(spark, d):
    own = table(spark, d, "conversations").select("conv_id", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("m"))
    return conversations.kinds(own, "conv_id", "m")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS probe, strlen(string_agg(text, chr(10) ORDER BY turn))::bigint AS bytes, length(string_agg(text, chr(10) ORDER BY turn))::bigint AS chars FROM conversations WHERE length(text) > 0 GROUP BY conv_id")
def content_probe(spark, d):
    return conversations.content_probe(table(spark, d, "conversations"), "conv_id", "turn", "text")


BLOCKS = "WITH b AS (SELECT conv_id, turn, 0 AS field, 'header' AS category, role AS text FROM conversations UNION ALL SELECT conv_id, turn, 1, 'text', text FROM conversations WHERE text IS NOT NULL) "


@query(BLOCKS + "SELECT conv_id, turn, field, category, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, field) - 1)::int AS block FROM b")
def conversation_blocks(spark, d):
    return conversations.blocks(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


RENDERED = "WITH r AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY turn) AS t, string_agg(text, chr(10) ORDER BY turn) FILTER (length(text) > 0) AS p FROM conversations GROUP BY conv_id) "


@query(RENDERED + "SELECT conv_id, len(regexp_extract_all(t, '[^ \\t\\n\\r]+'))::bigint AS total_tokens, len(regexp_extract_all(p, '[^ \\t\\n\\r]+'))::bigint AS content_tokens, (len(regexp_extract_all(t, '[^ \\t\\n\\r]+')) - len(regexp_extract_all(p, '[^ \\t\\n\\r]+')))::bigint AS overhead FROM r WHERE p IS NOT NULL")
def chat_overhead(spark, d):
    own = table(spark, d, "conversations")
    count = lambda c: F.regexp_count(c, F.lit(r"[^ \t\n\r]+")).cast("long")
    return conversations.template_overhead(conversations.content_probe(own, "conv_id", "turn", "text"), conversations.rendered(own, "conv_id", "turn", "role", "text"), "conv_id", count)


@query(RENDERED + ", m AS (SELECT conv_id, regexp_extract_all(t, '<[|]([^|\\r\\n]+)[|]>', 1) AS n, regexp_split_to_array(t, '<[|][^|\\r\\n]+[|]>') AS s FROM r), u AS (SELECT conv_id, unnest(n) AS name, unnest(s[2:]) AS rest, generate_subscripts(n, 1) - 1 AS position FROM m) SELECT conv_id, position::int AS position, name, left(trim(replace(rest, chr(10), ' '), ' '), 40) AS detail FROM u")
def rendered_index(spark, d):
    return conversations.rendered_index(conversations.rendered(table(spark, d, "conversations"), "conv_id", "turn", "role", "text"), "conv_id")


def event_json(spark, d):
    """Events as entries: one object each, with a type, a time and a session."""
    e = table(spark, d, "events")
    return e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("user_id").alias("session_id"), F.get_json_object("props", "$.k").alias("note"))).alias("json"))


FIRST = "WITH f AS (SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 200), g AS (SELECT user_id FROM f GROUP BY user_id HAVING count(*) > 1) "


@query(FIRST + "SELECT count(*) AS n, count(*) AS type, count(*) AS time, 0::bigint AS sequence, count(*) AS \"grouping\", count(*) FILTER (user_id IN (SELECT user_id FROM g)) AS repeated, count(*) >= 10 AS is_event_stream FROM f")
def event_verdict(spark, d):
    return entries.event_verdict(entries.event_samples(event_json(spark, d), "event_id", "json"), "event_id", "json")


@query("SELECT event_id, event_type AS type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, user_id::varchar AS \"group\", false AS more FROM events")
def event_summary(spark, d):
    own = entries.event_summary(event_json(spark, d), "json")
    more = F.coalesce("event_type.has_more", F.lit(False)) | F.coalesce("grouping.has_more", F.lit(False))
    return own.select("event_id", F.col("event_type.value").alias("type"), F.col("timestamp.value").alias("time"), F.col("grouping.value").alias("group"), more.alias("more"))


def broken(json):
    """Every seventh entry is cut short, every eleventh repeats a key, every thirteenth has a lone surrogate."""
    k = F.col("event_id")
    return F.when(k % 7 == 0, F.left(json, F.length(json) - 1)).when(k % 11 == 0, F.concat(F.lit('{"k":1,'), F.substring(json, F.lit(2), F.length(json)))).when(k % 13 == 0, F.lit('{"k":"\\ud800"}')).otherwise(json)


@query("SELECT CASE WHEN event_id % 7 = 0 OR (event_id % 13 = 0 AND event_id % 11 <> 0) THEN 'InvalidJson' ELSE 'Valid' END AS status, count(*) AS n FROM events GROUP BY 1")
def entry_status(spark, d):
    own = table(spark, d, "events").select("event_id", broken(F.col("props")).cast("binary").alias("raw"))
    return entries.entry_status(own, "raw").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_id, 0 AS node_id, NULL::int AS parent, 'Object' AS kind, NULL AS key, '$' AS path, NULL AS lexeme, 1 AS children FROM events UNION ALL SELECT event_id, 1, 0, 'Number', 'k', '$.k', props->>'k', 0 FROM events")
def json_nodes(spark, d):
    return entries.json_nodes(table(spark, d, "events"), "event_id", "props").select("event_id", "node_id", "parent", "kind", "key", "path", "lexeme", "children")


@query("SELECT event_id, '$.k' AS path, 'value' AS field, (instr(props->>'k', '7') - 1)::bigint AS start FROM events WHERE contains(props->>'k', '7')")
def node_search(spark, d):
    return entries.first_evidence(entries.search_nodes(entries.json_nodes(table(spark, d, "events"), "event_id", "props"), "event_id", "7"), "event_id")


def words(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("word"))


WORDS = "WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents) "


@query(WORDS + "SELECT lang, count(*) AS n, round(avg(length(word)), 6) AS mean, quantile_disc(length(word), 0.5)::bigint AS p50, quantile_disc(length(word), 0.9)::bigint AS p90, quantile_disc(length(word), 0.95)::bigint AS p95, quantile_disc(length(word), 0.99)::bigint AS p99, max(length(word))::bigint AS longest FROM w GROUP BY lang")
def token_lengths(spark, d):
    return rounded(vocabularies.length_statistics(words(spark, d), "word", "lang"))


@query(WORDS + ", v AS (SELECT DISTINCT word FROM w), b AS (SELECT * FROM (VALUES (0,'0',0,0),(1,'1',1,1),(2,'2',2,2),(3,'3-4',3,4),(4,'5-8',5,8),(5,'9-16',9,16),(6,'17-32',17,32),(7,'33-64',33,64),(8,'65+',65,999999)) t(place,bucket,low,high)) SELECT place, bucket, count(word) AS n FROM b LEFT JOIN v ON length(word) BETWEEN low AND high GROUP BY ALL HAVING place > 0 OR count(word) > 0")
def length_buckets(spark, d):
    return vocabularies.length_buckets(words(spark, d).select("word").distinct(), "word")


def vocabulary(spark, d):
    return words(spark, d).groupBy("word").agg(F.min("doc_id").alias("token_id"))


VOCAB = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents), v AS (SELECT word, min(doc_id) AS token_id FROM w GROUP BY word) "


@query(VOCAB + "SELECT token_id, word, length(word)::bigint AS length FROM v ORDER BY length(word) DESC, token_id, word LIMIT 50")
def longest_tokens(spark, d):
    return vocabularies.longest(vocabulary(spark, d), "word", "token_id")


@query(VOCAB + "SELECT word, token_id FROM v WHERE contains(lower(word), 'entre') OR contains(token_id::varchar, 'entre') ORDER BY token_id LIMIT 1000")
def vocabulary_search(spark, d):
    return vocabularies.searched(vocabulary(spark, d), "word", "token_id", " ENTRE ")


@query(WORDS + ", e AS (SELECT DISTINCT word FROM w WHERE lang = 'en'), f AS (SELECT DISTINCT word FROM w WHERE lang = 'fr') SELECT CASE WHEN f.word IS NULL THEN 'leftOnly' WHEN e.word IS NULL THEN 'rightOnly' ELSE 'shared' END AS side, count(*) AS n FROM e FULL JOIN f USING (word) GROUP BY 1")
def vocabulary_difference(spark, d):
    w = words(spark, d)
    return vocabularies.difference(w.where("lang = 'en'").select("word"), w.where("lang = 'fr'").select("word"), "word").groupBy("side").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT item_id, list_transform(string_split(b.text, ' '), lambda x: length(x)) AS a, list_transform(string_split(d.text, ' '), lambda x: length(x)) AS b FROM benchmark b JOIN documents d ON b.item_id = d.doc_id), f AS (SELECT *, list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS NOT DISTINCT FROM b[i]), false) AS p FROM t) SELECT item_id, len(a)::bigint AS left_count, len(b)::bigint AS right_count, (len(b) - len(a))::bigint AS delta, a = b AS ids_match, CASE WHEN a <> b THEN p - 1 END::bigint AS first_difference, CASE WHEN a <> b THEN a[p] END::int AS left_id, CASE WHEN a <> b THEN b[p] END::int AS right_id FROM f")
def tokenization_comparison(spark, d):
    sizes = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x))
    own = table(spark, d, "benchmark").select("item_id", sizes("text").alias("a")).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), sizes("text").alias("b")), "item_id")
    return own.select("item_id", *(c.alias(n) for n, c in vocabularies.comparison(F.col("a"), F.col("b")).items()))


@query("SELECT item_id, text AS decoded, text AS joined, 'Exact' AS mapping FROM benchmark")
def benchmark_encoded(spark, d):
    """Items encoded by byte-pair merges, decoded again, and cut into segments of whole characters: nothing is lost. Tests hold the ids to a reference tokenizer."""
    import public_tokenizers

    vocabulary = subwords.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return vocabularies.encoded(table(spark, d, "benchmark"), "item_id", "text", vocabulary).select("item_id", "decoded", F.array_join("segments", "").alias("joined"), "mapping")


PATHS = "WITH p AS (SELECT r_name || '.' || n_name || '.' || c_mktsegment || '.' || c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), q AS (SELECT name, string_split(name, '.') AS s FROM p), x AS (SELECT name, s, unnest(range(1, len(s) + 1)) AS depth FROM q), z AS (SELECT name, depth, array_to_string(s[1:depth], '.') AS path FROM x) "


def paths(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    own = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return own.select(F.concat_ws(".", "r_name", "n_name", "c_mktsegment", "c_name").alias("name"))


@query(PATHS + "SELECT path, depth::int AS depth, count(*) AS descendants, bool_or(path = name) AS is_tensor FROM z GROUP BY ALL")
def name_hierarchy(spark, d):
    return names.hierarchy(paths(spark, d), "name")


@query(PATHS + "SELECT DISTINCT path, depth::int AS depth FROM z WHERE contains(lower(name), '#000000001') AND path <> name")
def hierarchy_opened(spark, d):
    return names.opened(paths(spark, d), "name", "#000000001", "name")


@query("SELECT string_agg(p_type || ' × ' || n, ' · ' ORDER BY p_type) AS summary, sum(n)::bigint AS tensors, count(*) AS dtypes FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)")
def dtype_summary(spark, d):
    return names.dtype_summary(table(spark, d, "part"), "p_type")


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type AS dtype, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c) WHERE r = 1")
def dominant_dtype(spark, d):
    return names.dominant_dtype(table(spark, d, "part"), "p_brand", "p_type")


@query("SELECT c_custkey, c_name, lower(regexp_extract(c_name, '^[^0-9]*')) || lpad(ltrim(regexp_extract(c_name, '[0-9]+'), '0'), 20, '0') AS key FROM customer")
def natural_order(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", text.natural_key(F.col("c_name")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'configuration' WHEN p_partkey % 4 = 1 THEN 'weights' WHEN p_partkey % 4 = 2 THEN 'tokenizer' ELSE 'documentation' END AS category FROM part")
def file_categories(spark, d):
    ends = F.element_at(F.array(*map(F.lit, ("config.json", "model.safetensors", "tokenizer_config.json", "README.md"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", names.file_category(F.concat(F.lit("models/"), F.col("p_brand"), F.lit("/"), ends)).alias("category"))


@query("SELECT o_custkey, max(o_orderkey) AS at FROM orders GROUP BY o_custkey")
def history(spark, d):
    own = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("name"), "o_orderkey")
    return names.history(own, "name", "o_orderkey").select(F.col("name").cast("long").alias("o_custkey"), "at")


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, sum(user_id)::bigint AS codes, 2 AS exit_code FROM events")
def batch_summary(spark, d):
    return names.batch_summary(table(spark, d, "events"), F.col("event_type") == "error", F.col("user_id"))


@query("WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT event_id, user_id FROM events LEFT JOIN f USING (user_id) WHERE first IS NULL OR event_id <= first")
def until_failure(spark, d):
    return names.until_failure(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id")


@query("WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n')) AS said, generate_subscripts(regexp_split_to_array(text, '\\n'), 1) - 1 AS line FROM documents) SELECT doc_id, line // 400 AS chunk, min(line)::int AS first_line, count(*) AS n_lines, sum(length(said))::bigint AS n_chars FROM l GROUP BY ALL")
def source_chunks(spark, d):
    return names.source_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("WITH j AS (SELECT doc_id, toxic = 1 AS actual, contains(text, '***') AS predicted, lang FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM j GROUP BY lang) SELECT lang, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) END, 6) AS recall, round((tp + fp)::double / (tp + fp + fn + tn), 6) AS coverage FROM c")
def detection_quality(spark, d):
    own = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rounded(markup.detection_quality(own, "lang", F.contains("text", F.lit("***")), F.col("toxic") == 1))


def materials(spark, d):
    """One repository a supplier; which materials there are, and what they say, follows from its key."""
    k = F.col("s_suppkey")
    say = lambda **v: F.to_json(F.struct(*(c.alias(n) for n, c in v.items())))
    rows = [
        ("config", k % 5 != 0, say(vocab_size=F.lit(100), model_type=F.lit("m"), max_position_embeddings=k % 3 + 10)),
        ("tokenizerConfig", k % 2 == 0, say(tokenizer_class=F.when(k % 4 == 0, "T"), model_max_length=F.lit(10), eos_token_id=k % 6)),
        ("tokenizer", F.lit(True), say(vocab_count=F.lit(100) + k % 2)),
        ("generationConfig", F.lit(True), say(eos_token_id=F.array(F.lit(2), F.lit(2)))),
        ("chatTemplates", k % 7 != 0, say(active=F.when(k % 2 == 0, "x"))),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.when(there, "available").otherwise("missing").alias("state"), F.when(there, v).alias("value"), F.lit(None).cast("string").alias("reason")) for n, there, v in rows))).alias("m")
    return table(spark, d, "supplier").select(k.alias("repo"), each).select("repo", "m.*")


RULES = "WITH s AS (SELECT s_suppkey AS k FROM supplier), f AS (SELECT k AS repo, 0 AS place, 'vocab-mismatch' AS id, 'warning' AS severity FROM s WHERE k % 5 <> 0 AND k % 2 <> 0 UNION ALL SELECT k, 1, 'missing-tokenizer-class', 'warning' FROM s WHERE k % 2 = 0 AND k % 4 <> 0 UNION ALL SELECT k, 2, 'missing-chat-template', 'info' FROM s WHERE k % 7 <> 0 AND k % 2 <> 0 UNION ALL SELECT k, 3, 'eos-mismatch', 'warning' FROM s WHERE k % 2 = 0 AND k % 6 <> 2 UNION ALL SELECT k, 4, 'context-info', 'info' FROM s WHERE k % 5 <> 0 AND k % 2 = 0 AND k % 3 <> 0 UNION ALL SELECT k, 7, 'missing-config', 'info' FROM s WHERE k % 5 = 0) "


@query(RULES + "SELECT * FROM f")
def consistency_findings(spark, d):
    return consistency.findings(materials(spark, d)).select("repo", "place", "id", "severity")


@query(RULES + ", w AS (SELECT repo, count(*) AS n FROM f WHERE severity = 'warning' GROUP BY repo) SELECT k AS repo, coalesce(n, 0)::bigint AS warnings, CASE WHEN coalesce(n, 0) > 0 THEN 'warnings' WHEN k % 5 <> 0 AND k % 2 = 0 AND k % 7 <> 0 THEN 'consistent' ELSE 'insufficient' END AS badge FROM s LEFT JOIN w ON repo = k")
def consistency_badge(spark, d):
    return consistency.badge(materials(spark, d))


@query("SELECT k.kind, CASE WHEN k.kind = 'config' AND s % 5 = 0 OR k.kind = 'tokenizerConfig' AND s % 2 <> 0 OR k.kind = 'chatTemplates' AND s % 7 = 0 OR k.kind IN ('adapterConfig', 'processorConfig', 'gguf') THEN 'missing' ELSE 'checked' END AS state, count(*) AS n FROM (SELECT s_suppkey AS s FROM supplier), (VALUES ('config'),('generationConfig'),('tokenizerConfig'),('tokenizer'),('adapterConfig'),('processorConfig'),('chatTemplates'),('gguf')) k(kind) GROUP BY ALL")
def consistency_coverage(spark, d):
    return consistency.coverage(materials(spark, d)).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query("SELECT k AS repo, field, value FROM (SELECT s_suppkey AS k, 'architecture' AS field, 'm' AS value FROM supplier UNION ALL SELECT s_suppkey, 'vocab_size', '100' FROM supplier UNION ALL SELECT s_suppkey, 'context', (s_suppkey % 3 + 10)::varchar FROM supplier) WHERE k % 5 <> 0")
def model_identity(spark, d):
    return consistency.identity(materials(spark, d)).select("repo", "field", "value")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    from tessera.streaming import events

    return rounded(events.windowed_counts(table(spark, d, "events"), "ts", "event_type"), 4)
