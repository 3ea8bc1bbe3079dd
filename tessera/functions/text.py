"""Columns over strings: sizes, trimming, patterns, natural order, detection of what a string holds."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import strict_json

BREAKS = r"\r\n|\r|\n"


def n_lines(s: Column) -> Column:
    """CR, LF and CRLF each break a line; an empty string has one."""
    return F.size(F.split(s, BREAKS, -1)).cast("long")


def line_at(s: Column, offset: Column | int) -> Column:
    """The number, from 1, of the line that the character at ``offset`` (from 0) is in. Offsets outside count as the ends."""
    own = F.lit(offset) if isinstance(offset, int) else offset
    end = F.greatest(F.least(own, F.length(s)), F.lit(0))
    # A CR before the offset breaks a line even if its LF is not before it.
    return (F.regexp_count(F.substring(s, F.lit(1), end.cast("int")), F.lit(BREAKS)) + 1).cast("long")


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long")


def trimmed(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def bounded_value(s: Column, most: int = 256) -> Column:
    return F.struct(F.left(s, F.lit(most)).alias("value"), (F.length(s) > most).alias("has_more"))


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob: * and ?, with \\ before either or itself for the character."""
    if len(glob.encode()) > 4096:
        raise ValueError("a pattern has at most 4096 bytes")
    tokens: list[str] = []
    for escaped, char in re.findall(r"(?s)(\\[*?\\])|(.)", glob):
        if escaped:
            tokens.append(re.escape(escaped[1]))
        elif char != "*":
            tokens.append("." if char == "?" else re.escape(char))
        elif tokens[-1:] != [".*?"]:
            tokens.append(".*?")
    if len(tokens) > 256 or all(t == ".*?" for t in tokens):
        raise ValueError("a pattern has at most 256 parts, and one that isn't *")
    return "(?s)" + "".join(tokens)


def find_pattern(query: str, mode: str = "contains", ignore_case: bool = True) -> str:
    own = "\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    word = r"[\p{L}\p{M}\p{N}_]"
    own = {"contains": own, "startsWith": f"(?<!{word}){own}", "fullWord": f"(?<!{word}){own}(?!{word})"}[mode]
    return ("(?iu)" if ignore_case else "") + own


def natural_key(s: Column, width: int = 20) -> Column:
    """Sorts runs of digits by their number, and letters without case."""
    padded = F.regexp_replace(F.lower(s), r"(\d+)", "0" * width + "$1")
    return F.regexp_replace(padded, rf"0*(\d{{{width}}})(?!\d)", "$1")


def find_snippet(s: Column, needle: str, around: int = 80, most: int = 160) -> Column:
    """The first match with what surrounds it; a mark shows what is cut. Null without a match."""
    at = F.locate(needle, s)
    start = F.greatest(at - around, F.lit(1))
    end = at + len(needle) - 1
    body = F.concat(F.substring(s, start, at - start), F.left(F.lit(needle), F.lit(most)), F.substring(s, end + 1, F.lit(around)))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end + around < F.length(s), "…").otherwise("")))


def borders(query: bytes) -> bool:
    """Whether a match can begin inside another one: whether a beginning of the query is also its end."""
    return any(query.startswith(query[k:]) for k in range(1, len(query)))


def byte_matches(df: DataFrame, key: str, text: str, query: str, width: int = 256 << 10) -> DataFrame:
    """key, start: the byte, from 0, that each match of a literal begins at; matches don't overlap, the leftmost counts.

    Texts are searched in windows of ``width`` bytes, each with as many more as a match can reach beyond it; a match is the
    window's that it begins in. Where matches can overlap, those that do so in a row are gone through in order. A null text
    has none. Rows that repeat a key give their matches each.
    """
    raw = query.encode()
    if not raw or len(raw) > 4096:
        raise ValueError("a query has 1 to 4096 bytes")
    size, latin = len(raw), raw.decode("latin-1")
    own = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("own"), F.encode(text, "UTF-8").alias("raw")).where(F.contains("raw", F.lit(raw)))
    windows = own.select("row", "own", F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / width).cast("int"))).alias("w"), "raw")
    chunk = F.decode(F.substring("raw", F.col("w") * width + 1, F.lit(width + size - 1)), "ISO-8859-1")
    pattern = "(?=\\Q" + latin.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
    # Cut before each match, overlapping ones too: a piece begins at a match, but for the first one if the chunk doesn't.
    pieces = windows.select("row", "own", "w", chunk.alias("chunk")).where(F.contains("chunk", F.lit(latin))).select("row", "own", "w", F.startswith("chunk", F.lit(latin)).alias("at_once"), F.transform(F.split("chunk", pattern, -1), lambda p: F.length(p)).alias("n"))
    each = pieces.select("row", "own", "w", "at_once", F.posexplode("n").alias("k", "n"))
    end = F.sum("n").over(Window.partitionBy("row", "w").orderBy("k"))
    starts = each.withColumn("local", end - F.col("n")).where((F.col("k") > 0) | F.col("at_once")).where((F.col("local") < width) & (F.col("n") > 0)).select("row", "own", (F.col("w").cast("long") * width + F.col("local")).alias("start"))
    if not borders(raw):
        return starts.select(F.col("own").alias(key), "start")
    by = Window.partitionBy("row").orderBy("start")
    new = F.coalesce(F.col("start") - F.lag("start").over(by) >= size, F.lit(True))
    islands = starts.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(by)).groupBy("row", "own", "island").agg(F.array_sort(F.collect_list("start")).alias("s"))
    first = F.struct(F.lit(-1).cast("long").alias("free"), F.array().cast("array<long>").alias("out"))
    gaps = F.transform(F.slice("s", F.lit(2), F.size("s") - 1), lambda x, i: x - F.get("s", i))
    # A run with one period, however long, is counted through; others are gone through match by match.
    even = F.filter("s", lambda x, i: i % F.ceil(F.lit(size) / F.coalesce(F.get(gaps, F.lit(0)), F.lit(size))) == 0)
    greedy = F.aggregate("s", first, lambda acc, x: F.when(x >= acc["free"], F.struct((x + size).alias("free"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc))["out"]
    taken = F.when(F.coalesce(F.array_min(gaps) == F.array_max(gaps), F.lit(True)), even).otherwise(greedy)
    return islands.select(F.col("own").alias(key), F.explode(taken).alias("start"))


# What a line of code begins with or holds; a parenthesis too for those of CALLS; what starts an assignment.
STARTS, HOLDS, CALLS, ASSIGNS = ["#!/", "package main"], ["#include <", "public static"], ["fn ", "def ", "function "], ["const ", "let ", "var "]
CODE_KEYS = ["code", "source", "script"]
LIMIT_BYTES, HTML_LIMIT = 2 << 20, 64 << 10


def lines(s: Column) -> Column:
    return F.split(s, r"\r?\n", -1)


def any_of(test, line: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | test(line, F.lit(word))
    return out


def table_cells(line: Column) -> Column:
    """What bars part, without the empty parts outside of those at the ends."""
    own = trimmed(line)
    first = F.when(F.startswith(own, F.lit("|")), 2).otherwise(1)
    parts = F.split(own, r"\|", -1)
    size = F.size(parts) - first + 1 - F.when(F.endswith(own, F.lit("|")), 1).otherwise(0)
    return F.slice(parts, first, F.greatest(size, F.lit(0)))


def has_markdown(s: Column) -> Column:
    """A heading, a quoted line, two items of a list, or a table: the line after the first that isn't blank parts as many cells."""
    block = F.rlike(s, F.lit(r"(?md)^(?U:\s*)#{1,6}(?:[ \t\f]|\r|$)")) | F.rlike(s, F.lit(r"(?md)^(?U:\s*)>"))
    items = F.regexp_count(s, F.lit(r"(?md)^(?U:\s*)(?:[-+*] |[0-9]+\.(?:[ \t\f]|\r(?!\n)))")) >= 2
    own = lines(s)
    first = F.array_min(F.transform(own, lambda x, i: F.when(trimmed(x) != "", i)))
    head, rule = F.get(own, first), F.get(own, first + 1)
    table = (F.size(table_cells(head)) >= 2) & (F.size(table_cells(head)) == F.size(table_cells(rule))) & F.forall(table_cells(rule), lambda c: F.rlike(trimmed(c), F.lit(r"^:?-{3,}:?$")))
    return block | items | F.coalesce(F.contains(s, F.lit("|")) & table, F.lit(False))


def has_fence(s: Column) -> Column:
    """A line of three or more backticks or tildes, whatever follows, and a later one of at least as many of the same and nothing else."""
    mark = lambda x: F.regexp_extract(x, r"(?U)^\s*(`{3,}|~{3,})", 1)
    opening = F.filter(lines(s), lambda x: mark(x) != "")
    state = F.struct(F.lit("").alias("open"), F.lit(False).alias("done"))
    closes = lambda acc, x: (F.left(acc["open"], F.lit(1)) == F.left(mark(x), F.lit(1))) & (F.length(mark(x)) >= F.length(acc["open"])) & F.rlike(x, F.lit(r"(?U)^\s*(?:`+|~+)\s*$"))
    step = lambda acc, x: F.struct(F.when(acc["open"] == "", mark(x)).otherwise(acc["open"]).alias("open"), (acc["done"] | ((acc["open"] != "") & closes(acc, x))).alias("done"))
    marked = F.contains(s, F.lit("```")) | F.contains(s, F.lit("~~~"))
    return marked & F.aggregate(opening, state, step)["done"]


def certain_code(line: Column) -> Column:
    """Whether a trimmed line is code for itself."""
    return any_of(F.startswith, line, STARTS) | any_of(F.contains, line, HOLDS) | (any_of(F.contains, line, CALLS) & F.contains(line, F.lit("(")))


def code_line(line: Column) -> Column:
    """Whether a trimmed line looks like code. A ``def`` must end with a colon here."""
    has = lambda word: F.contains(line, F.lit(word))
    calls = (any_of(F.contains, line, [c for c in CALLS if c != "def "]) | (has("def ") & F.endswith(line, F.lit(":")))) & has("(")
    return any_of(F.startswith, line, STARTS) | any_of(F.contains, line, HOLDS) | calls | (any_of(F.startswith, line, ASSIGNS) & has("=")) | (has("(") & has(")") & has(";")) | (has("=>") & (has("{") | has(";")))


def is_code(s: Column, key: Column | None = None) -> Column:
    own = F.transform(lines(s), lambda x: trimmed(x))
    syntax = F.size(F.filter(own, code_line))
    named = F.lit(False) if key is None else F.coalesce(F.lower(key).isin(CODE_KEYS), F.lit(False))
    return (syntax >= 1) & (named | (syntax >= 2) | F.exists(own, certain_code))


SURROGATE = r"\\u[dD][89a-fA-F]"


def surely_json(s: Column) -> Column:
    """Whether Spark's parser takes the string as one value: two wrappers must both parse, which trailing data fails. It refuses repeated keys and great depth, and takes lone surrogates."""
    body = F.regexp_replace(s, "^\ufeff", "")
    return F.coalesce(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull(), F.lit(False))


def strictly(read) -> Callable:
    def of(values: pd.Series) -> pd.Series:
        def one(s) -> bool | None:
            if s is None:
                return None
            try:
                read(s)
            except (ValueError, RecursionError):
                return False
            return True

        return pd.Series([one(s) for s in values], dtype="object")

    return of


def not_a_number(_: str):
    raise ValueError


@F.pandas_udf(T.BooleanType())
def strict_json_text(values: pd.Series) -> pd.Series:
    """Whether each text is one JSON value by the strict reader; null for null."""
    return strictly(strict_json.nodes)(values)


@F.pandas_udf(T.BooleanType())
def loose_json_text(values: pd.Series) -> pd.Series:
    """Likewise by a reader that takes lone surrogates."""
    return strictly(lambda s: json.loads(s.removeprefix("\ufeff"), parse_constant=not_a_number))(values)


@F.pandas_udf(T.LongType())
def n_json_texts(values: pd.Series) -> pd.Series:
    """How many texts of each list are one JSON value; null for null."""
    valid = strictly(strict_json.nodes)
    return pd.Series([None if own is None else sum(valid(pd.Series(list(own), dtype="object"))) for own in values], dtype="object")


def json_start(s: Column) -> Column:
    return F.rlike(s, F.lit(r'^\x{FEFF}?[ \t\r\n]*[{\["0-9tfn-]'))


def is_json(s: Column) -> Column:
    """Whether the string is one JSON value. Spark's parser decides nearly all; the strict reader what that refuses or takes too easily, if it starts like JSON."""
    odd = F.rlike(s, F.lit(SURROGATE))
    sure = surely_json(s)
    return F.when(s.isNull(), F.lit(None)).when(sure & ~odd, True).when(json_start(s), F.coalesce(strict_json_text(F.when(json_start(s) & (~sure | odd), s)), F.lit(False))).otherwise(False)


def detected(s: Column, key: Column | None = None, html: Column | None = None) -> Column:
    """json, html, markdown, code or plain. What starts like JSON is JSON or plain, never something else."""
    body = trimmed(s)
    starts = F.rlike(body, F.lit(r"^[{\[]"))
    looks_html = F.lit(False) if html is None else html & (F.octet_length(s) <= HTML_LIMIT)
    return F.when(F.octet_length(s) > LIMIT_BYTES, "plain").when(starts, F.when(is_json(body), "json").otherwise("plain")).when(looks_html, "html").when(has_fence(s) | has_markdown(s), "markdown").when(is_code(s, key), "code").otherwise("plain")


# Patterns of programming languages, all of a row needed (those of a tuple: any), none of the last.
LANGUAGES = (
    ("shell", (r"(?i)^\s*#![^\r\n]*(?:\b(?:ba|z)?sh|\benv\s+(?:ba|z)?sh)\b",)),
    ("json", ()),
    ("sql", (r"(?i)^\s*(?:SELECT|WITH|INSERT\s+INTO|UPDATE\s+\w+\s+SET|DELETE\s+FROM)\b[\s\S]*\b(?:FROM|VALUES|SET|WHERE)\b",)),
    ("python", (r"(?m)^\s*(?:def\s+[A-Za-z_]\w*\s*\(|from\s+\w+\s+import\s+|import\s+\w+\s*(?:\r?\n|$))", r"(?m)(?:\b(?:def|return|None|True|False|print|elif|self)\b|:\s*$)")),
    ("rust", (r"\bfn\s+[A-Za-z_]\w*\s*\(", r"(?:->\s*[A-Za-z_]|let\s+mut|impl\s+\w+|use\s+std::|println!\s*\()", r"[{};]")),
    ("typescript", ((r"\b(?:interface|type\s+[A-Z]\w*\s*=|as\s+(?:const|[A-Z])|enum\s+[A-Z]\w*)\b", r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*:\s*[A-Za-z_$][\w$<>\[\]| ]*\s*="),)),
    ("javascript", (r"\b(?:const|let|var)\s+[A-Za-z_$][\w$]*\s*=|\b(?:function|async|await)\b|=>", r"[{}();]")),
    ("cpp", ((r"#include\s*[<\"](?:iostream|string|vector|algorithm)", r"\bstd::\w+|\busing\s+namespace\s+std\b"),)),
    ("c", (r"#include\s*[<\"](?:stdio|stdlib|string|stdint)\.h[>\"]", r"\b(?:int|void|char|size_t)\s+\w+\s*\(")),
    ("java", (r"\bpublic\s+(?:static\s+)?class\s+\w+|\bpublic\s+static\s+void\s+main\s*\(", r"(?:\bnew\b|\bSystem\.out\b|String\[\])")),
    ("go", (r"(?m)^\s*package\s+main\b", r"\bfunc\s+main\s*\(")),
)
# Fixed value: a field of YAML.
YAML_FIELD = r"(?m)^[\t ]*[A-Za-z_][\w.-]*\s*:\s+\S.*$"
DETECT_LIMIT = 256 << 10


def code_language(s: Column) -> Column:
    """The first language whose patterns the source has; null for none and beyond DETECT_LIMIT."""
    rlike = lambda p: F.rlike(s, F.lit(p)) if isinstance(p, str) else rlike(p[0]) | rlike(p[1])
    out = None
    for name, patterns in LANGUAGES:
        if name == "json":
            rule = F.rlike(s, F.lit(r"^\s*[{\[]")) & F.rlike(s, F.lit(r"[}\]]\s*$")) & (surely_json(s) | F.coalesce(loose_json_text(F.when(F.rlike(s, F.lit(r"^\s*[{\[]")) & ~surely_json(s), s)), F.lit(False)))
        else:
            rule = F.lit(True)
            for p in patterns:
                rule = rule & rlike(p)
        out = F.when(rule, name) if out is None else out.when(rule, name)
    yaml = F.rlike(s, F.lit(r"^---\s*(?:\r?\n|$)")) | ((F.regexp_count(s, F.lit(YAML_FIELD)) >= 2) & ~F.rlike(s, F.lit("[{};]")))
    return F.when((F.octet_length(s) <= DETECT_LIMIT) & (s != ""), out.when(yaml, "yaml"))
