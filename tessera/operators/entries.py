"""JSON entries: status, nodes, event summaries, event-stream verdicts, search over decoded values."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import strict_json
from tessera.functions.text import SURROGATE, bounded_value, is_json, surely_json

OVERSIZED = 16 << 20
# Keys of events in order of rank, and the families of grouping keys.
TYPE_KEYS = ["type", "event", "event_type", "kind"]
TIME_KEYS = ["timestamp", "time", "ts", "created_at", "createdAt"]
GROUP_KEYS = ["session_id", "sessionId", "trace_id", "traceId", "run_id", "runId", "conversation_id", "conversationId", "request_id", "requestId", "case_id", "caseId"]
SEQUENCE_KEYS = ["seq", "sequence", "step", "step_index", "index"]
SAMPLES, SAMPLE_BYTES = 200, 8 << 20
#: Rows that are sorted for a sample without looking for a smaller part first; quantiles by which one is looked for.
SPAN_ROWS, BOUNDS = 100_000, 32
NODE = "node_id int, parent int, kind string, key string, index int, occurrence int, start long, end long, path string, lexeme string, value string, children int"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


@F.pandas_udf(T.StructType([T.StructField("code", T.StringType()), T.StructField("at", T.LongType()), T.StructField("line", T.LongType()), T.StructField("column", T.LongType())]))
def strict_error(values: pd.Series) -> pd.DataFrame:
    """The first error of each text, with its byte, line and column; nulls where it is valid."""

    def of(s: str) -> tuple:
        try:
            strict_json.nodes(s)
        except strict_json.Bad as e:
            return e.code, *strict_json.place(s, e.at)
        return (None,) * 4

    names = ["code", "at", "line", "column"]
    return pd.DataFrame([of(s) if s is not None else (None,) * 4 for s in values], columns=names).astype(dict.fromkeys(names[1:], "Int64"))


def entry_status(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with ``status`` (Oversized, InvalidUtf8, InvalidJson, Valid, in this order) and ``error`` of binary entries.

    Spark's parser decides nearly all rows. Those that it refuses though they may be valid (repeated keys, great
    depth), and those with surrogate escapes, which it takes too easily, go to the strict reader.
    """
    text = F.try_validate_utf8(F.col(raw).cast("string"))
    size = F.octet_length(raw)
    own, sure_, found = fresh(df, "own_text", "sure", "found")
    sized = df.withColumn(own, F.when(size <= OVERSIZED, text))
    sure = surely_json(F.col(own)) & ~F.coalesce(F.rlike(own, F.lit(SURROGATE)), F.lit(False))
    marked = sized.withColumn(sure_, sure)
    # Rows that need no reader are null to it, and cost it nothing.
    got = marked.withColumn(found, strict_error(F.when(~F.col(sure_), F.col(own))))
    bad = F.col(found)["code"].isNotNull()
    status = F.when(size > OVERSIZED, "Oversized").when(F.col(own).isNull(), "InvalidUtf8").when(bad, "InvalidJson").otherwise("Valid")
    return got.withColumn("status", status).withColumn("error", F.when(bad, F.col(found))).drop(own, sure_, found)


def byte_places(s: str | None):
    """What gives the bytes before each character of a text: one table for all of its values."""
    if not s or s.isascii():
        return lambda k: k
    points = np.frombuffer(s.encode("utf-32-le"), np.uint32)
    table = np.concatenate([[0], np.cumsum(1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))]).tolist()
    return table.__getitem__


#: Nodes that a task holds before it gives them away.
NODES_HELD = 10_000


def json_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each value of each valid text, in order, with its path, span in bytes, lexeme and decoded string."""
    kind = dict(df.select(key).dtypes)[key]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [key, *(c.split()[0] for c in NODE.split(", "))]
        given = lambda rows: pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("parent", "index", "occurrence")})
        rows: list[tuple] = []
        for frame in frames:
            for own, s in zip(frame[key], frame[text], strict=True):
                if len(rows) >= NODES_HELD:
                    yield given(rows)
                    rows = []
                try:
                    found = strict_json.nodes(s) if s is not None else []
                except strict_json.Bad:
                    continue
                path: dict[int, str] = {}
                at = byte_places(s)
                for n in found:
                    path[n["id"]] = "$" if n["parent"] is None else path[n["parent"]] + strict_json.path_part(n)
                    leaf = n["kind"] not in ("Object", "Array")
                    rows.append((own, n["id"], n["parent"], n["kind"], n["key"], n["index"], n["occurrence"], at(n["start"]), at(n["end"]), path[n["id"]], s[n["start"] : n["end"]] if leaf else None, n["value"], n["n"]))
        yield given(rows)

    return df.select(key, text).mapInPandas(of, f"{key} {kind}, {NODE}")


def children_page(nodes: DataFrame, key: str, parent: int, after: int = -1, limit: int = 200) -> DataFrame:
    """The next children of a node, by keyset."""
    return nodes.where((F.col("parent") == parent) & (F.col("node_id") > after)).orderBy(key, "node_id").limit(min(limit, 200))


def subtree(nodes: DataFrame, key: str, node_id: int) -> DataFrame:
    """A node and what is inside it: the nodes whose spans its span holds."""
    top = nodes.where(F.col("node_id") == node_id).select(F.col(key).alias("own"), F.col("start").alias("low"), F.col("end").alias("high"))
    return nodes.join(top, (F.col(key) == F.col("own")) & (F.col("start") >= F.col("low")) & (F.col("end") <= F.col("high"))).select(*nodes.columns)


def search_nodes(nodes: DataFrame, key: str, query: str) -> DataFrame:
    """Matches of a literal in keys and in values of leaves: a node's key before its value, then by position."""
    if not query or len(query.encode()) > 4096:
        raise ValueError("a query has 1 to 4096 bytes")
    text = F.coalesce("value", "lexeme")
    fields = F.array(F.struct(F.lit(0).alias("phase"), F.lit("key").alias("field"), F.col("key").alias("text")), F.struct(F.lit(1).alias("phase"), F.lit("value").alias("field"), text.alias("text")))
    long = nodes.select(key, "node_id", "path", F.explode(fields).alias("f")).select(key, "node_id", "path", "f.*").where(F.contains("text", F.lit(query)))
    gaps = F.transform(F.split("text", "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda g: F.length(g))
    return long.select(key, "node_id", "path", "phase", "field", F.posexplode(gaps).alias("k", "gap"), F.size(gaps).alias("n")).withColumn("start", F.sum("gap").over(Window.partitionBy(key, "node_id", "phase").orderBy("k")) + F.col("k") * len(query)).where("k < n - 1").select(key, "node_id", "path", "field", "phase", "start")


def first_evidence(matches: DataFrame, key: str) -> DataFrame:
    return matches.groupBy(key).agg(F.min(F.struct("node_id", "phase", "start", "path", "field")).alias("m")).select(key, "m.path", "m.field", "m.start")


def evidence_snippets(nodes: DataFrame, key: str, query: str, around: int = 80, most: int = 160) -> DataFrame:
    """key, path, field, snippet, match_start, match_end: the first match of each entry with what surrounds it.

    Marks show what is cut, of a match over 160 characters the rest too; the offsets are in UTF-16 units of the snippet.
    """
    fields = F.array(F.struct(F.lit(0).alias("phase"), F.lit("key").alias("field"), F.col("key").alias("text")), F.struct(F.lit(1).alias("phase"), F.lit("value").alias("field"), F.coalesce("value", "lexeme").alias("text")))
    long = nodes.select(F.col(key).alias("_own"), "node_id", "path", F.explode(fields).alias("f")).where(F.contains("f.text", F.lit(query)))
    first = long.groupBy("_own").agg(F.min_by(F.struct("path", "f.field", "f.text"), F.struct("node_id", "f.phase")).alias("m")).select("_own", "m.*")
    at, size = F.locate(query, F.col("text")) - 1, len(query)
    start = F.greatest(at - around, F.lit(0))
    shown = min(size, most)
    end = F.least(at + size + around, F.length("text")) if shown == size else at + shown
    part = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    units = lambda c: (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")
    before = F.concat(F.when(start > 0, "…").otherwise(""), part(start, at))
    snippet = F.concat(before, part(at, end), F.when(end < F.length("text"), "…").otherwise(""))
    return first.select(F.col("_own").alias(key), "path", "field", snippet.alias("snippet"), units(before).alias("match_start"), (units(before) + units(part(at, at + shown))).alias("match_end"))


def as_written(json: Column, key: str, value: Column) -> Column:
    """``value``, or, if it is a number with a fraction or an exponent, the number of the same value that the text gives the key."""
    said = F.regexp_extract(json, rf'"{key}"\s*:\s*(-?[0-9][0-9.eE+-]*)', 1)
    same = F.rlike(value, F.lit(r"^-?[0-9.]+(?:[eE][+-]?[0-9]+)?$")) & F.rlike(value, F.lit("[.eE]")) & (said.try_cast("double") == value.try_cast("double"))
    return F.when(F.coalesce(same, F.lit(False)), said).otherwise(value)


def by_rank(json: Column, fields: Column, keys: list[str]) -> Column:
    """The value, in a map of an object's fields, of the first key that it has: strings decoded, others as written, null as ``null``."""
    value = lambda k: as_written(json, k, F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("null")))
    return F.coalesce(*(F.when(F.map_contains_key(fields, k), value(k)) for k in keys))


FIRSTS = T.StructType([T.StructField(n, T.StringType()) for n in "abc"])


@F.pandas_udf(FIRSTS)
def written_fields(values: pd.Series) -> pd.DataFrame:
    """Of each valid object the values of its first keys by rank: strings decoded, others as they are written."""

    def of(s: str | None) -> list:
        try:
            found = strict_json.nodes(s) if s is not None else []
        except strict_json.Bad:
            found = []
        out = []
        for keys in (TYPE_KEYS, TIME_KEYS, GROUP_KEYS):
            best = min((n for n in found if n["parent"] == 0 and n["key"] in keys), key=lambda n: (keys.index(n["key"]), n["id"]), default=None)
            out.append(None if best is None else best["value"] if best["kind"] == "String" else s[best["start"] : best["end"]])
        return out

    return pd.DataFrame([of(s) for s in values], columns=list("abc"))


def event_summary(df: DataFrame, json: str) -> DataFrame:
    """``df`` with event_type, timestamp and grouping of valid objects, each at most 256 characters and whether there were more.

    An entry is parsed once. Where a key could be there twice, a value is a container or a surrogate is escaped, the strict reader
    gives the values as they are written.
    """
    name, odd_ = fresh(df, "fields", "odd")
    # An aggregate over the one object makes the map a variable, so that not every use of it parses anew.
    found = lambda m: F.struct(*(by_rank(F.col(json), m, keys).alias(name) for name, keys in (("a", TYPE_KEYS), ("b", TIME_KEYS), ("c", GROUP_KEYS))))
    starts = F.rlike(json, F.lit(r"^\x{FEFF}?[ \t\r\n]*\{"))
    plain = starts & F.try_parse_json(json).isNotNull() & surely_json(F.col(json)) & ~F.rlike(json, F.lit(SURROGATE)) & ~F.startswith(json, F.lit("\ufeff"))
    object_ = F.when(plain, F.from_json(json, "map<string,string>"))
    contained = lambda c: F.coalesce(F.rlike(c, F.lit(r"^[{\[]")), F.lit(False))
    cut = lambda c: F.when(c.isNotNull(), bounded_value(c))
    own = df.withColumn(name, F.get(F.transform(F.array(object_), found), F.lit(0)))
    odd = starts & (~F.coalesce(plain, F.lit(False)) | contained(F.col(name)["a"]) | contained(F.col(name)["b"]) | contained(F.col(name)["c"]))
    own = own.withColumn(odd_, written_fields(F.when(odd, F.col(json))))
    value = lambda k: F.when(odd, F.col(odd_)[k]).otherwise(F.col(name)[k])
    return own.withColumns({"event_type": cut(value("a")), "timestamp": cut(value("b")), "grouping": cut(value("c"))}).drop(name, odd_)


def family(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(key, "Id$", "_id")), "_id$", "")


def first_part(df: DataFrame, order: str, size: Column, is_object: Column, enough: int = SPAN_ROWS) -> DataFrame:
    """The rows up to some value of ``order`` beyond which no sample reaches, if they are more than ``enough``; ``df`` is scanned a few times, nothing is sorted.

    Each scan adds up bytes and objects below BOUNDS quantiles of what is left, and keeps what is below the first that holds a whole sample.
    """
    cut = None
    while True:
        own = df if cut is None else df.where(F.col(order) <= F.lit(cut))
        bounds = own.agg(F.percentile_approx(order, [k / BOUNDS for k in range(1, BOUNDS)], 1000).alias("q"), F.count("*").alias("n")).first()
        if bounds["n"] <= enough or not bounds["q"]:
            return own
        marks = sorted(set(bounds["q"]))
        below = [F.col(order) <= F.lit(m) for m in marks]
        sums = own.agg(*(F.sum(F.when(c, size)).alias(f"s{k}") for k, c in enumerate(below)), *(F.count_if(c & is_object).alias(f"o{k}") for k, c in enumerate(below)), *(F.count_if(c).alias(f"n{k}") for k, c in enumerate(below))).first()
        full = next((k for k in range(len(marks)) if (sums[f"s{k}"] or 0) > SAMPLE_BYTES or sums[f"o{k}"] >= SAMPLES), None)
        if full is None or sums[f"n{full}"] >= bounds["n"]:
            return own
        cut = marks[full]


def event_samples(df: DataFrame, order: str, json: str) -> DataFrame:
    """The first 200 objects within the first 8 MiB of all entries' bytes, a line end each; an entry that these cut is left out.

    ``first_part`` finds how far they can reach; only rows up to there are sorted.
    """
    size, is_object = F.octet_length(json).cast("long") + 1, F.json_object_keys(json).isNotNull()
    bytes_, nth = fresh(df, "bytes", "nth")
    by = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    near = first_part(df.where(F.col(order).isNotNull()), order, size, is_object)
    sized = near.withColumns({bytes_: F.sum(size).over(by), nth: F.sum(is_object.cast("int")).over(by)})
    return sized.where((F.col(bytes_) <= SAMPLE_BYTES) & (F.col(nth) <= SAMPLES) & is_object).drop(bytes_, nth)


def event_samples_by(df: DataFrame, by: str, order: str, json: str, salts: int = 16) -> DataFrame:
    """The samples of each stream, which ``by`` tells apart, with all columns of ``df``.

    Rows are first dealt to parts of their stream; a row before which its part alone has a whole sample is in no sample, so what meets in
    a stream's window is bounded, whatever the stream's size.
    """
    size, is_object = F.octet_length(F.coalesce(json, F.lit(""))).cast("long") + 1, F.json_object_keys(json).isNotNull()
    part, bytes_, nth = fresh(df, "part", "bytes", "nth")
    dealt = df.withColumn(part, F.pmod(F.xxhash64(order), F.lit(salts)))
    for keys, whole in (([by, part], False), ([by], True)):
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        sized = dealt.withColumns({bytes_: F.sum(size).over(window), nth: F.sum(is_object.cast("int")).over(window)})
        # The row that exceeds a part's share stays, so that the whole's sums end where they should.
        inside = (F.col(bytes_) <= SAMPLE_BYTES) & (F.col(nth) <= SAMPLES) & is_object if whole else (F.col(bytes_) - size <= SAMPLE_BYTES) & (F.col(nth) - is_object.cast("int") <= SAMPLES)
        dealt = sized.where(inside).drop(bytes_, nth)
    return dealt.drop(part)


def event_signals(df: DataFrame, key: str, json: str, by: list[str] = ()) -> DataFrame:
    keys = F.json_object_keys(json)
    has = lambda names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    return df.select(*by, key, json, has(TYPE_KEYS).alias("has_type"), has(TIME_KEYS).alias("has_time"), has(SEQUENCE_KEYS).alias("has_sequence"), has(GROUP_KEYS).alias("has_grouping"))


def repeated_groupings(df: DataFrame, key: str, json: str, by: list[str] = ()) -> DataFrame:
    """The rows of which a (family, typed value) is also in another row, of the same stream if ``by`` names what tells streams apart."""
    each = df.select(*by, key, json, F.explode(F.array_intersect(F.json_object_keys(json), F.array(*map(F.lit, GROUP_KEYS)))).alias("k"))
    raw = F.variant_get(F.try_parse_json(json), "$", "map<string,variant>")[F.col("k")]
    typed = F.concat(F.schema_of_variant(raw), F.lit(":"), F.coalesce(F.from_json(json, "map<string,string>")[F.col("k")], F.lit("null")))
    long = each.select(*by, key, family(F.col("k")).alias("family"), typed.alias("value")).distinct()
    many = long.groupBy(*by, "family", "value").agg(F.count("*").alias("n")).where("n > 1")
    return long.join(many, [*by, "family", "value"], "left_semi").select(*by, key).distinct()


def event_verdict(df: DataFrame, key: str, json: str, by: list[str] = ()) -> DataFrame:
    """Counts of the signals, and whether these are events: one row, or one for each stream, of at most 200 samples each."""
    s = event_signals(df, key, json, by)
    again = repeated_groupings(df, key, json, by).withColumn("again", F.lit(True))
    n = s.join(again, [*by, key], "left").groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(c).alias(c[4:]) for c in ("has_type", "has_time", "has_sequence", "has_grouping")), F.count_if(F.coalesce("again", F.lit(False))).alias("repeated"))
    share = lambda c, pct, of="n": (F.col(of) > 0) & (F.col(c) * 100 >= F.col(of) * pct)
    typed = share("type", 70) & (share("time", 40) | (share("grouping", 50) & share("repeated", 50, "grouping")) | share("sequence", 40))
    timed = share("time", 70) & share("grouping", 70) & share("repeated", 50, "grouping")
    return n.withColumn("is_event_stream", (F.col("n") >= 10) & (typed | timed))


def nested_scopes(df: DataFrame, key: str, text: str, depth: int = 5, most: int = 2 << 20, in_all: int = 8 << 20) -> DataFrame:
    """key, depth, path, text of the JSON containers that strings of JSON hold, level by level down to ``depth``.

    A container is at most ``most`` bytes, and it and those that it is in are ``in_all`` together. A text is read once
    and what it holds right after it, so no level is read again for the next.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth is 1 to 10")
    kind, begins = dict(df.select(key).dtypes)[key], re.compile(r"\s*[{\[]")

    def inside(s: str, level: int, path: str, held: int) -> Iterator[tuple]:
        try:
            found = strict_json.nodes(s)
        except strict_json.Bad:
            return
        if level:
            yield level, path, s
        if level == depth:
            return
        where: dict[int, str] = {}
        for n in found:
            where[n["id"]] = "$" if n["parent"] is None else where[n["parent"]] + strict_json.path_part(n)
            size = len(n["value"].encode()) if n["kind"] == "String" and begins.match(n["value"]) else 0
            if size and size <= most and held + size <= in_all:
                yield from inside(n["value"], level + 1, f"{path} → {where[n['id']]}", held + size)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(own, *row) for own, s in zip(frame[key], frame[text], strict=True) if s is not None for row in inside(s, 0, "$", 0)]
            yield pd.DataFrame(rows, columns=[key, "depth", "path", "text"])

    return df.select(key, text).mapInPandas(of, f"{key} {kind}, depth int, path string, text string")


def path_labels(df: DataFrame, key: str, text: str, most_chars: int = 256, most_bytes: int = 2048) -> DataFrame:
    """key, node_id, labels, truncated: the path of each value of each valid text as a list, keys cut at 256 characters and the whole at 2048 bytes.

    A key that is the first of its name, isn't empty and doesn't begin with a bracket stands as it is, another one as
    ["key"], with #n for the n-th of equal keys. Labels are made while a text is read; no path is held but for the values around the one at hand.
    """
    kind = dict(df.select(key).dtypes)[key]

    def label(n: dict) -> tuple[str, bool]:
        name = n["key"]
        if name is None:
            return ("$" if n["index"] is None else f"[{n['index']}]"), False
        cut, again = name[:most_chars], n["occurrence"]
        plain = again == 1 and name and not name.startswith("[")
        return (cut if plain else f"[{json.dumps(cut, ensure_ascii=False)}]") + (f"#{again}" if again > 1 else ""), len(name) > most_chars

    def shortened(parts: list[tuple[str, bool]]) -> tuple[list[str], bool]:
        out, room, cut = [], most_bytes, any(c for _, c in parts)
        for k, (part, _) in enumerate(parts):
            raw = part.encode()
            own = raw[:room].decode(errors="ignore") if k else part
            if not own:
                return out, True
            out.append(own)
            room = max(0, room - len(own.encode()))
            cut |= len(own.encode()) < len(raw)
            if not room and k + 1 < len(parts):
                return out, True
        return out, cut

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for own, s in zip(frame[key], frame[text], strict=True):
                try:
                    found = strict_json.nodes(s) if s is not None else []
                except strict_json.Bad:
                    continue
                around: list[tuple[int, tuple[str, bool]]] = []  # the values around the one at hand, with their labels
                for n in found:
                    while around and around[-1][0] != n["parent"]:
                        around.pop()
                    around.append((n["id"], label(n)))
                    rows.append((own, n["id"], *shortened([part for _, part in around])))
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=[key, "node_id", "labels", "truncated"])
                        rows = []
            yield pd.DataFrame(rows, columns=[key, "node_id", "labels", "truncated"])

    return df.select(key, text).mapInPandas(of, f"{key} {kind}, node_id int, labels array<string>, truncated boolean")


def filtered_entries(df: DataFrame, raw: str, query: str, mode: str = "decoded") -> DataFrame:
    """``df`` with ``outcome``: matched, unmatched, or why an entry is skipped (Oversized, InvalidUtf8, InvalidJson).

    In mode decoded a valid entry matches if a key or the value of a leaf holds the query; in mode raw the bytes of every
    entry are looked at, also of oversized ones, and only entries that aren't UTF-8 are skipped.
    """
    if mode not in ("decoded", "raw") or not query or len(query.encode()) > 4096:
        raise ValueError("mode is decoded or raw, a query has 1 to 4096 bytes")
    if mode == "raw":
        text = F.try_validate_utf8(F.col(raw).cast("string"))
        return df.withColumn("outcome", F.when(text.isNull(), "InvalidUtf8").when(F.contains(text, F.lit(query)), "matched").otherwise("unmatched"))

    @F.pandas_udf("boolean")
    def holds(values: pd.Series) -> pd.Series:
        def of(s: str | None):
            if s is None:
                return None
            try:
                return any(query in part for n in strict_json.nodes(s) for part in (n["key"] or "", n["value"] if n["value"] is not None else "" if n["kind"] in ("Object", "Array") else s[n["start"] : n["end"]]))
            except strict_json.Bad:
                return None

        return pd.Series([of(s) for s in values], dtype="object")

    own = entry_status(df, raw)
    hit = holds(F.when(F.col("status") == "Valid", F.col(raw).cast("string")))
    return own.withColumn("outcome", F.when(F.col("status") != "Valid", F.col("status")).when(hit, "matched").otherwise("unmatched")).drop("status", "error")


def filter_counts(filtered: DataFrame) -> DataFrame:
    """One row: entries, matched, and skipped by reason."""
    count = lambda name: F.count_if(F.col("outcome") == name)
    return filtered.agg(F.count("*").alias("entries"), count("matched").alias("matched"), count("InvalidJson").alias("skipped_invalid_json"), count("InvalidUtf8").alias("skipped_invalid_utf8"), count("Oversized").alias("skipped_oversized"))


@F.pandas_udf(T.StringType())
def sorted_pretty(values: pd.Series) -> pd.Series:
    """Valid JSON with sorted keys, indented; null where it isn't JSON."""

    def of(s):
        try:
            return strict_json.sorted_pretty(s)
        except (strict_json.Bad, TypeError):
            return None

    return values.map(of)


RANGES = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(RANGES)
def key_ranges(values: pd.Series) -> pd.Series:
    """The keys of root objects with the characters they stand at, in order of their places; empty for others."""

    def of(s):
        try:
            return sorted(({"key": k, "start": a, "end": b} for k, (a, b) in strict_json.key_ranges(s).items()), key=lambda r: r["start"])
        except (strict_json.Bad, TypeError):
            return []

    return values.map(of)


def text_chunk(s: Column, offset: int, size: int, most: int = 128 << 10) -> Column:
    """The bytes of a text from an offset on, at most ``size``, cut back to a whole character, and where the next begin."""
    raw = F.substring(F.encode(s, "UTF-8"), offset + 1, min(size, most))
    # At the end at most three bytes of a character that is cut belong to the next chunk.
    options = [F.substring(raw, F.lit(1), F.octet_length(raw) - k) for k in range(4)]
    text = F.coalesce(*(F.try_validate_utf8(o.cast("string")) for o in options))
    end = F.lit(offset) + F.octet_length(text)
    return F.struct(text.alias("text"), F.when(end < F.octet_length(s), end).alias("next"))
