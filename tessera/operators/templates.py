"""Chat templates: catalogue, choice, variables, checks of a request, spans of Jinja source; folds of source files."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import strict_json

ENTRY = "array<struct<name:string,body:string>>"


def catalogue(df: DataFrame, key: str, template: str, jinja: str | None = None) -> DataFrame:
    """key, place, id, name, source, body, usable, error of each template.

    ``template``: the JSON of a tokenizer's chat_template: a string, an object of bodies by name (sorted), or an array
    of {name, template}; ``jinja``: the text of a file of its own, which comes first.
    """
    j = F.col(template)
    text = F.when(F.rlike(j, F.lit(r'^\s*"')), F.from_json(F.concat(F.lit('{"v":'), j, F.lit("}")), "v string")["v"])
    by_name = F.from_json(F.when(F.rlike(j, F.lit(r"^\s*\{")), j), "map<string,string>")
    of_map = F.transform(F.array_sort(F.map_keys(by_name)), lambda k: F.struct(k.alias("name"), by_name[k].alias("body")))
    named = F.from_json(F.when(F.rlike(j, F.lit(r"^\s*\[")), j), "array<struct<name:string,template:string>>")
    of_list = F.transform(named, lambda x: F.struct(x["name"].alias("name"), x["template"].alias("body")))
    bad = F.exists(of_list, lambda x: x["name"].isNull() | (x["name"] == "") | x["body"].isNull())
    error = F.when(j.isNotNull() & text.isNull() & by_name.isNull() & named.isNull(), "unsupported value").when(F.coalesce(bad, F.lit(False)), "item without name or template")
    single = F.when(text.isNotNull(), F.array(F.struct(F.lit("default").alias("name"), text.alias("body"))))
    own = F.coalesce(single.cast(ENTRY), of_map.cast(ENTRY), of_list.cast(ENTRY), F.array().cast(ENTRY))
    tag = lambda a, source: F.transform(a, lambda x: F.struct(F.lit(source).alias("source"), x["name"].alias("name"), x["body"].alias("body")))
    first = F.array().cast(ENTRY) if jinja is None else F.when(F.col(jinja).isNotNull(), F.array(F.struct(F.lit("default").alias("name"), F.col(jinja).alias("body"))).cast(ENTRY)).otherwise(F.array().cast(ENTRY))
    all_ = F.when(error.isNull(), F.concat(tag(first, "jinjaFile"), tag(own, "tokenizerConfig")))
    long = df.select(key, error.alias("error"), F.posexplode_outer(all_).alias("place", "t"))
    return long.select(key, "place", F.concat_ws(":", "t.source", "t.name").alias("id"), F.col("t.name").alias("name"), F.col("t.source").alias("source"), F.col("t.body").alias("body"), F.rlike("t.body", F.lit(r"(?U)\S")).alias("usable"), "error").where("name IS NOT NULL OR error IS NOT NULL")


def active(catalogue_: DataFrame, key: str, requested: str | None = None) -> DataFrame:
    """key, id of the template in use: the requested if usable, else the next usable one, else an earlier one; without a request the file's own, the default, the first."""
    usable = F.col("usable")
    if requested is None:
        rank = F.when(F.col("source") == "jinjaFile", 0).when(F.col("name") == "default", 1).otherwise(2)
        order = F.struct(rank.alias("rank"), "place", "id")
        return catalogue_.where(usable).groupBy(key).agg(F.min(order).alias("best")).select(key, "best.id")
    at = catalogue_.where(F.col("id") == requested).groupBy(key).agg(F.min("place").alias("at"))
    both = catalogue_.where(usable).join(at, key, "left")
    rank = F.when(F.col("at").isNull(), F.when(F.col("name") == "default", 0).otherwise(1)).when(F.col("place") >= F.col("at"), 0).otherwise(1)
    return both.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), "place", "id")).alias("best")).select(key, "best.id")


# Tokens that templates name.
TOKENS = ["bos_token", "eos_token", "pad_token", "unk_token"]


def initial_variables(df: DataFrame, key: str, template: str, config: str) -> DataFrame:
    """key, place, name, kind, value: the special tokens that the configuration has, and switches that the template mentions."""
    has = F.json_object_keys(config)
    value = lambda n: F.get_json_object(config, f"$.{n}")
    row = lambda k, n, kind, v, when: F.when(when, F.struct(F.lit(k).alias("place"), F.lit(n).alias("name"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), v.alias("value")))
    rows = [row(k, n, F.when(value(n).isNull(), "null").otherwise("string"), value(n), F.array_contains(has, n)) for k, n in enumerate(TOKENS)]
    rows += [row(4, "enable_thinking", "boolean", F.lit("true"), F.contains(template, F.lit("enable_thinking"))), row(5, "documents", "json", F.lit("[]"), F.contains(template, F.lit("documents")))]
    return df.select(key, F.explode(F.array_compact(F.array(*rows))).alias("v")).select(key, "v.*")


def variable_errors(df: DataFrame, key: str) -> DataFrame:
    """key, place, name, error of variables (key, place, name, kind, value) that a request can't have."""
    from pyspark.sql import Window

    name, value = F.trim("name"), F.col("value")
    again = F.row_number().over(Window.partitionBy(key, "own").orderBy("place")) > 1
    bad = (
        F.when(F.col("own") == "", "name required")
        .when(F.col("own").isin("messages", "add_generation_prompt", "tools"), "reserved")
        .when(again, "repeated")
        .when((F.col("kind") == "integer") & ~F.rlike(value, F.lit(r"^[+-]?\d{1,18}$")), "integer required")
        .when((F.col("kind") == "decimal") & value.try_cast("double").isNull(), "number required")
        .when((F.col("kind") == "json") & F.try_parse_json(value).isNull(), "json required")
    )
    return df.withColumn("own", name).withColumn("error", bad).where("error IS NOT NULL").select(key, "place", "name", "error")


def request_context(messages: DataFrame, tools: DataFrame, variables: DataFrame, key: str, with_tools: bool = True, prompt: bool = True) -> DataFrame:
    """key, place, name, value (JSON) of what a template is given: messages, whether the answer begins, tools, then the variables that a request can have.

    ``messages``: key, turn, role, kind (text or json), content; ``tools``: key, place, name, description, parameters (a
    JSON object); ``variables``: as for variable_errors. A name or value that is refused has no entry.
    """
    said = F.when(F.col("kind") == "text", F.to_json(F.struct(F.col("content").alias("v")))).otherwise(F.concat(F.lit('{"v":'), F.col("content"), F.lit("}")))
    value = lambda wrapped: F.regexp_extract(wrapped, r'(?s)^\{"v":(.*)\}$', 1)
    quoted = lambda c: value(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))))
    one = F.concat(F.lit('{"role":'), quoted(F.col("role")), F.lit(',"content":'), value(said), F.lit("}"))
    listed = lambda df, order, item: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("item")))).alias("all")).select(key, F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["item"]), ","), F.lit("]")).alias("value"))
    tool = F.concat(F.lit('{"type":"function","function":{"name":'), quoted(F.trim("name")), F.lit(',"description":'), quoted(F.col("description")), F.lit(',"parameters":'), F.col("parameters"), F.lit("}}"))
    good = tools.where((F.trim("name") != "") & F.json_object_keys("parameters").isNotNull())
    row = lambda df, place, name: df.select(key, F.lit(place).alias("place"), F.lit(name).alias("name"), "value")
    spoken = listed(messages, "turn", one)
    out = row(spoken, 0, "messages").union(row(spoken.select(key, F.lit("true" if prompt else "false").alias("value")), 1, "add_generation_prompt"))
    if with_tools:
        out = out.union(row(listed(good, "place", tool), 2, "tools"))
    kind = F.col("kind")
    typed = F.when(kind == "string", quoted(F.col("value"))).when(kind == "boolean", F.when(F.col("value") == "false", "false").otherwise("true")).when(kind == "null", "null").otherwise(F.trim("value"))
    sound = variables.join(variable_errors(variables, key).select(key, "place"), [key, "place"], "left_anti")
    return out.union(sound.select(key, (F.col("place") + 3).alias("place"), F.trim("name").alias("name"), typed.alias("value")))


# What Jinja's tags begin and end with and what each is, and its keywords.
TAGS = {"{{": ("}}", "expression"), "{%": ("%}", "statement"), "{#": ("#}", "comment")}
KEYWORDS = frozenset("if else elif endif for in endfor set true false none and or not is macro endmacro call endcall filter endfilter".split())
WORD = re.compile(r"[A-Za-z0-9_]+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def jinja_tokens(s: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the parts of Jinja source in order, from left to right; text between tags has none.

    A tag ends with the first of its closing marks, also inside quotes. Keywords count inside quotes, too, and any mark
    of two characters is a delimiter wherever it stands.
    """
    marks = {*TAGS, *(end for end, _ in TAGS.values())}
    out: list[tuple[int, int, str]] = []

    def put(start: int, end: int, kind: str) -> None:
        if start >= end:
            return
        if out and out[-1][1:] == (start, kind):
            out[-1] = (out[-1][0], end, kind)
        else:
            out.append((start, end, kind))

    def plain(start: int, end: int, kind: str | None) -> None:
        """A stretch of one kind but for the marks in it."""
        k = start
        while k < end:
            if s[k : k + 2] in marks and k + 2 <= end:
                put(k, k + 2, "delimiter")
                k += 2
            else:
                if kind:
                    put(k, k + 1, kind)
                k += 1

    def words(start: int, end: int, kind: str) -> None:
        """A stretch of a tag: keywords, and the rest of its kind."""
        at = start
        for word in WORD.finditer(s, start, end):
            if word.group() in KEYWORDS:
                plain(at, word.start(), kind)
                put(*word.span(), "keyword")
                at = word.end()
        plain(at, end, kind)

    def quoted(start: int, end: int) -> int:
        """Where the quoted text from ``start`` on ends, or ``start`` if it doesn't before ``end``."""
        k = start + 1
        while k < end:
            if s[k] == "\\":
                k += 2
            elif s[k] == s[start]:
                return k + 1
            else:
                k += 1
        return start

    at = 0
    while at < len(s):
        opening = min((k for k in (s.find(mark, at) for mark in TAGS) if k >= 0), default=-1)
        close, kind = TAGS[s[opening : opening + 2]] if opening >= 0 else ("", "")
        stop = s.find(close, opening + 2) + 2 if opening >= 0 else 1
        if stop == 1:  # no tag from here on, or one that isn't closed
            plain(at, opening + 2 if opening >= 0 else len(s), None)
            at = opening + 2 if opening >= 0 else len(s)
            continue
        plain(at, opening, None)
        k = from_ = opening
        while k < stop and kind != "comment":
            to = quoted(k, stop) if s[k] in "'\"" else k
            if to > k:
                words(from_, k, kind)
                words(k, to, "string")
                k = from_ = to
            else:
                k += 1
        plain(from_, stop, kind) if kind == "comment" else words(from_, stop, kind)
        at = stop
    return out


@F.pandas_udf(SPAN)
def jinja_spans(values: pd.Series) -> pd.Series:
    """Runs of comment, expression, statement, string, keyword and delimiter."""
    return values.map(lambda s: [{"start": a, "end": b, "kind": kind} for a, b, kind in jinja_tokens(s or "")])


def indent_folds(df: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """key, start_line, end_line: each line that ``header`` matches and that deeper lines follow, up to the last of these.

    A fold ends before the next line (blank ones aside) that is no deeper. One pass over a document's lines keeps the
    headers that are still open, each deeper than the one before.
    """
    kind, blank, head = dict(df.select(key).dtypes)[key], re.compile(r"\s*"), re.compile(header)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for own, s in zip(frame[key], frame[text], strict=True):
                open_: list[tuple[int, int]] = []
                last = 0
                for no, line in enumerate(re.split(r"\r\n|\r|\n", s or ""), 1):
                    if blank.fullmatch(line):
                        continue
                    indent = len(line) - len(line.lstrip(" \t"))
                    while open_ and open_[-1][1] >= indent:
                        start, _ = open_.pop()
                        if last > start:
                            rows.append((own, start, last))
                    if head.search(line):
                        open_.append((no, indent))
                    last = no
                rows += [(own, start, last) for start, _ in reversed(open_) if last > start]
            yield pd.DataFrame(rows, columns=[key, "start_line", "end_line"])

    return df.select(key, text).mapInPandas(of, f"{key} {kind}, start_line int, end_line int")


FOLDS = T.ArrayType(T.StructType([T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType())]))


@F.pandas_udf(FOLDS)
def json_folds(values: pd.Series) -> pd.Series:
    """Lines of containers that span several; none where the text isn't JSON."""

    def of(s):
        try:
            found = strict_json.nodes(s)
        except (strict_json.Bad, TypeError):
            return []
        ends = [m.start() for m in re.finditer("\n", s)]
        line = lambda k: bisect_left(ends, k) + 1
        spans = ((line(n["start"]), line(n["end"] - 1), n["end"]) for n in found if n["kind"] in ("Object", "Array"))
        return [{"start_line": a, "end_line": b} for a, b, _ in sorted(spans, key=lambda x: x[2]) if b > a]

    return values.map(of)


PYTHON_HEADER = r"^\s*(?:async\s+def|def|class|if|elif|else|for|while|try|except|finally|with|match|case)\b.*:\s*(?:#.*)?$"
YAML_HEADER = r"^\s*(?:- )?[^\s#:][^:]*:\s*(?:#.*)?$"


def number_text(lexeme: Column) -> Column:
    """A JSON number as %.16g prints it; whole numbers as they are, -0 as 0."""
    return F.when(F.rlike(lexeme, F.lit(r"^-?\d+$")), F.when(lexeme == "-0", "0").otherwise(lexeme)).otherwise(shortest(lexeme))


@F.pandas_udf(T.StringType())
def shortest(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else f"{float(s):.16g}")
