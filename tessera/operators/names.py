"""Model files by name: hierarchies of tensor names, data types, repository files, histories, batch results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import natural_key, trimmed


def name_parts(name: Column) -> Column:
    return F.filter(F.split(name, r"\."), lambda p: p != "")


def prefixes(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """A row for each prefix of each name, the name itself included."""
    parts = df.select(name, *keep, name_parts(F.col(name)).alias("_parts")).where(F.size("_parts") > 0)
    return parts.select(name, *keep, "_parts", F.explode(F.sequence(F.lit(1), F.size("_parts"))).alias("depth")).withColumn("path", F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), ".")).drop("_parts")


def hierarchy(df: DataFrame, name: str) -> DataFrame:
    """Each prefix with its depth, the number of names below it (its own included), and whether it is a name itself."""
    own = F.array_join(name_parts(F.col(name)), ".")
    return prefixes(df.withColumn("_own", own), name, "_own").groupBy("path", "depth").agg(F.count("*").alias("descendants"), F.bool_or(F.col("path") == F.col("_own")).alias("is_tensor"))


def matching(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows of which a column contains the query, without case; a blank query takes all."""
    own = query.strip().lower()
    hit = F.lit(own == "")
    for c in columns:
        hit = hit | F.contains(F.lower(c), F.lit(own))
    return df.where(hit)


def opened(df: DataFrame, name: str, query: str, *columns: str) -> DataFrame:
    """The groups that hold a match: the proper prefixes of matching names."""
    own = prefixes(matching(df, query, *columns), name)
    return own.where(F.col("path") != F.array_join(name_parts(F.col(name)), ".")).select("path", "depth").distinct()


def shown(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """The nodes all of whose ancestors are in ``expanded``, with a key that sorts them depth first in natural order."""
    up = nodes.select("path", F.explode(F.sequence(F.lit(1), F.size(F.split("path", r"\.")))).alias("k"), F.split("path", r"\.").alias("p")).select("path", F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), ".").alias("above"))
    closed = up.where("above <> ''").join(expanded.select(F.col("path").alias("above")).distinct(), "above", "left_anti").select("path").distinct()
    return nodes.join(closed, "path", "left_anti").withColumn("sort_key", F.transform(F.split("path", r"\."), lambda p: natural_key(p)))


def dtype_summary(df: DataFrame, dtype: str) -> DataFrame:
    """One row: ``A × n · B × m`` by data type, with totals."""
    own = df.groupBy(dtype).agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(dtype, "n"))), lambda x: F.concat(x[dtype], F.lit(" × "), x["n"].cast("string")))
    return own.agg(F.array_join(parts, " · ").alias("summary"), F.sum("n").alias("tensors"), F.count("*").alias("dtypes"))


def file_totals(tensors: DataFrame) -> DataFrame:
    """path, tensors, parameters, bytes, summary of each file's tensors (path, dtype, parameters, bytes): ``A × n · B × m`` by data type, by name."""
    own = tensors.where("dtype IS NOT NULL").groupBy("path", "dtype").agg(F.count("*").alias("n"), F.sum("parameters").alias("parameters"), F.sum("bytes").alias("bytes"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("dtype", "n"))), lambda x: F.concat(x["dtype"], F.lit(" × "), x["n"].cast("string")))
    return own.groupBy("path").agg(F.sum("n").alias("tensors"), F.sum("parameters").cast("long").alias("parameters"), F.sum("bytes").cast("long").alias("bytes"), F.array_join(parts, " · ").alias("summary"))


def dominant_dtype(df: DataFrame, by: str, dtype: str) -> DataFrame:
    """The commonest type by group; ties go to the first by name."""
    return df.groupBy(by, dtype).agg(F.count("*").alias("n")).groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(dtype).alias("dtype"))).alias("best")).select(by, "best.dtype", (-F.col("best.minus")).alias("n"))


# Units of bytes and the most digits after the point of each.
BYTE_UNITS = [("KB", 0), ("MB", 1), ("GB", 2), ("TB", 2), ("PB", 2)]


def format_bytes(n: Column) -> Column:
    """Base 1000; whole KB, one decimal for MB, two from GB on, zeros at the end left out. The unit is picked after rounding."""
    out = F.when(n == 0, "Zero bytes").when(n == 1, "1 byte").when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes")))
    for k, (unit, digits) in enumerate(BYTE_UNITS, 1):
        value = F.floor(n / F.lit(1000.0**k) * 10**digits + 0.5) / 10**digits
        shown = F.concat(F.regexp_replace(F.format_number(value, digits), r"\.?0+$", "") if digits else F.format_number(value, 0), F.lit(f" {unit}"))
        out = out.when(value < 1000, shown) if unit != "PB" else out.otherwise(shown)
    return out


# Languages by extension, image types by extension.
LANGUAGES = {
    "python": ["py", "pyw"], "javascript": ["js", "javascript", "mjs", "cjs"], "jsx": ["jsx"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "bash": ["sh", "bash", "zsh"],
    "swift": ["swift"], "rust": ["rs"], "go": ["go"], "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "hpp"], "java": ["java"], "kotlin": ["kt", "kts"], "ruby": ["rb"], "php": ["php"],
    "lua": ["lua"], "yaml": ["yaml", "yml"], "json": ["json"], "toml": ["toml"], "sql": ["sql"], "css": ["css"], "scss": ["scss"], "sass": ["sass"], "less": ["less"], "markup": ["html", "htm", "xml", "svg"],
}
IMAGES = {"image/svg+xml": ["svg"], "image/png": ["png"], "image/jpeg": ["jpg", "jpeg"], "image/gif": ["gif"], "image/webp": ["webp"], "image/bmp": ["bmp"], "image/x-icon": ["ico"], "image/avif": ["avif"], "image/tiff": ["tif", "tiff"]}


def extension(path: Column) -> Column:
    """What follows the last point of a file's name, in lower case; empty without a point."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def by_extension(path: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*(F.when(extension(path).isin(all_), F.lit(name)) for name, all_ in table.items()))


def syntax_language(path: Column) -> Column:
    return by_extension(path, LANGUAGES)


def image_type(path: Column) -> Column:
    """The type of an image's name, else application/octet-stream."""
    return F.coalesce(by_extension(path, IMAGES), F.lit("application/octet-stream"))


def is_image(path: Column) -> Column:
    return by_extension(path, IMAGES).isNotNull()


# Categories of repository files and the names that come first.
BLOCKED = ["safetensors", "bin", "pt", "pth", "ckpt", "onnx", "h5", "msgpack", "tflite", "pb"]
ORDER = ["configuration", "tokenizer", "templates", "weightMetadata", "documentation", "other", "weights"]
PREFERRED = ["config.json", "configuration.json", "generation_config.json", "adapter_config.json", "preprocessor_config.json", "processor_config.json", "tokenizer_config.json", "tokenizer.json", "vocab.json", "merges.txt", "special_tokens_map.json", "model.safetensors.index.json", "pytorch_model.bin.index.json", "readme.md", "license"]


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def file_category(path: Column) -> Column:
    name, lower = base_name(path), F.lower(path)
    is_ = lambda pattern: F.rlike(name, F.lit(pattern))
    return (
        F.when(is_(r"imatrix"), "weightMetadata")
        .when(is_(r"\.gguf(_file)?$"), "weights")
        .when(is_(r"(safetensors|pytorch_model).*\.index\.json$"), "weightMetadata")
        .when(F.element_at(F.split(name, r"\."), -1).isin(BLOCKED), "weights")
        .when(name.isin("adapter_config.json", "preprocessor_config.json", "processor_config.json", "config.json", "configuration.json", "generation_config.json"), "configuration")
        .when(is_(r"_config\.json$") & ~is_("tokenizer|processor"), "configuration")
        .when(is_(r"tokenizer|^vocab\.json$|^merges\.txt$|^special_tokens_map\.json$|^added_tokens|\.model$"), "tokenizer")
        .when(is_(r"\.pdf$"), "documentation")
        .when(is_(r"\.jinja$") | lower.contains("template"), "templates")
        .when(is_(r"^license$|^license\.|^notice$|\.md$|\.rst$"), "documentation")
        .otherwise("other")
    )


def ordered_files(files: DataFrame, path: str) -> DataFrame:
    """``files`` with the three keys that order them: category, preferred name, natural path."""
    place = lambda names, c: F.coalesce(*(F.when(c == n, F.lit(k)) for k, n in enumerate(names)), F.lit(len(names)))
    return files.withColumns({"category": file_category(F.col(path)), "name_rank": place(PREFERRED, base_name(F.col(path))), "natural": natural_key(F.col(path))}).withColumn("category_rank", place(ORDER, F.col("category")))


def picked(files: DataFrame, by: str, path: str, names: list[str], reference: Column) -> DataFrame:
    """By repository the file with one of the names: at the root, else in the reference's folder, else elsewhere; short paths first."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    rank = F.when(folder == "", 0).when(folder == reference, 1).otherwise(2)
    own = files.where(base_name(F.col(path)).isin(names))
    return own.groupBy(by).agg(F.min(F.struct(rank.alias("rank"), F.length(path).alias("size"), F.col(path).alias("path"))).alias("best")).select(by, "best.path")


# Hosts whose addresses name models, and what an id looks like.
MODEL_HOSTS = ("huggingface.co", "www.huggingface.co")
MODEL_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*/[A-Za-z0-9][A-Za-z0-9._-]*$"


def model_id(url: Column, hosts: tuple[str, ...] = MODEL_HOSTS) -> Column:
    """owner/name of a model's id or of an address at one of the hosts, whose path begins with it; null for anything else."""
    own = trimmed(url)
    address = F.rlike(own, F.lit(r"^(?i)https?://"))
    host = F.lower(F.try_parse_url(own, F.lit("HOST")))
    parts = F.filter(F.split(F.try_parse_url(own, F.lit("PATH")), "/"), lambda x: x != "")
    found = F.when(address, F.when(host.isin(*hosts) & (F.size(parts) >= 2), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))).otherwise(own)
    return F.when(F.rlike(found, F.lit(MODEL_ID)), found)


def history(df: DataFrame, name: str, at: str) -> DataFrame:
    """The latest of each name, without case."""
    return df.groupBy(F.lower(name).alias("key")).agg(F.max(F.struct(F.col(at).alias("at"), F.col(name).alias("name"))).alias("m")).select("m.name", "m.at")


def batch_summary(df: DataFrame, failed: Column, codes: Column) -> DataFrame:
    got = df.agg(F.count("*").alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.coalesce(F.sum(codes), F.lit(0)).alias("codes"))
    return got.withColumn("exit_code", F.when((F.col("failed") > 0) | (F.col("succeeded") == 0), 2).otherwise(0))


def until_failure(df: DataFrame, by: str, order: str, failed: Column) -> DataFrame:
    """The rows up to the first failure of each group, it included."""
    first = df.groupBy(by).agg(F.min(F.when(failed, F.col(order))).alias("_first"))
    return df.join(first, by).where(F.col("_first").isNull() | (F.col(order) <= F.col("_first"))).drop("_first")


def source_chunks(df: DataFrame, key: str, text: str, lines: int = 400) -> DataFrame:
    """A row for every 400 lines: number, first line, characters."""
    own = df.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("line", "said"))
    return own.groupBy(key, F.floor(F.col("line") / lines).alias("chunk")).agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines"), F.sum(F.length("said")).alias("n_chars"))


def source_cuts(df: DataFrame, key: str, text: str, lines: int = 400, chars: int = 64 << 10, piece: int = 4 << 10) -> DataFrame:
    """key, start, end, first_line, n_lines of the stretches that a source is shown in, in UTF-16 units.

    A stretch ends before a line that would make it more than ``lines`` lines or ``chars`` units, and inside of a line
    after ``piece`` units; the next then begins on the same line. No cut parts a surrogate pair or a CR from its LF.
    """
    kind, cut = dict(df.select(key).dtypes)[key], min(chars, piece)

    def stretches(s: str) -> Iterator[tuple[int, int, int, int]]:
        units = np.frombuffer(s.encode("utf-16-le", "surrogatepass"), np.uint16)
        high, low = (units >> 10) == 0x36, (units >> 10) == 0x37
        ends = np.flatnonzero(((units == 13) & (np.append(units[1:], 0) != 10)) | (units == 10)) + 1
        if not len(ends) or ends[-1] < len(units):
            ends = np.append(ends, len(units))
        start, first, held = 0, 1, 0
        for number, end in enumerate(ends.tolist() if len(units) else [], 1):
            if held and (held >= lines or end - start > chars):
                yield start, start + sum_held, first, held
                start, first, held = start + sum_held, number, 0
            while end - start > cut:
                at = start + cut
                at += bool((low[at] and high[at - 1]) or (units[at - 1] == 13 and units[at] == 10))
                yield start, at, first, held + 1
                start, first, held = at, number, 0
            if start == end:
                first = number + 1
            else:
                held += 1
            sum_held = end - start
        if start < len(units) or not len(units):
            yield start, len(units), first, max(held, 1)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(own, *row) for own, s in zip(frame[key], frame[text], strict=True) if s is not None for row in stretches(s)]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "first_line", "n_lines"])

    return df.select(key, text).mapInPandas(of, f"{key} {kind}, start long, end long, first_line long, n_lines long")


def newest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
