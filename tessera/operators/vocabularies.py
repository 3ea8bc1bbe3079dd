"""Vocabularies and tokenizations: length statistics, differences, comparison, segments, token ids."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import trimmed
from tessera.operators import subwords

# Buckets of lengths.
BUCKETS = (("0", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3-4", 3, 4), ("5-8", 5, 8), ("9-16", 9, 16), ("17-32", 17, 32), ("33-64", 33, 64), ("65+", 65, None))
PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def length_statistics(tokens: DataFrame, token: str, *by: str) -> DataFrame:
    """Count, mean, nearest-rank percentiles and maximum of lengths in code points."""
    n = F.length(token)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY length(`{token}`))").cast("long").alias(f"p{round(p * 100)}")
    own = tokens.groupBy(*by) if by else tokens.groupBy()
    return own.agg(F.count("*").alias("n"), F.avg(n).alias("mean"), *map(rank, PERCENTILES), F.max(n).cast("long").alias("longest"))


def length_buckets(tokens: DataFrame, token: str) -> DataFrame:
    """All buckets, those without tokens too; the one of empty tokens only if there are some."""
    n = F.length(token)
    name = F.coalesce(*(F.when((n >= low) & (n <= high if high is not None else F.lit(True)), F.lit(label)) for label, low, high in BUCKETS))
    got = tokens.groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))
    every = tokens.sparkSession.createDataFrame([(k, label) for k, (label, *_) in enumerate(BUCKETS)], "place int, bucket string")
    return every.join(got, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n")).where("place > 0 OR n > 0")


def longest(tokens: DataFrame, token: str, token_id: str, k: int = 50) -> DataFrame:
    return tokens.select(token_id, token, F.length(token).cast("long").alias("length")).orderBy(F.desc("length"), token_id, token).limit(k)


def difference(left: DataFrame, right: DataFrame, token: str) -> DataFrame:
    """Each distinct piece and where it is: leftOnly, rightOnly or shared; one aggregation over both."""
    both = left.select(token, F.lit(1).alias("side")).union(right.select(token, F.lit(2).alias("side")))
    sides = both.groupBy(token).agg(F.bit_or("side").alias("sides"))
    return sides.select(token, F.when(F.col("sides") == 1, "leftOnly").when(F.col("sides") == 2, "rightOnly").otherwise("shared").alias("side"))


def searched(tokens: DataFrame, token: str, token_id: str, query: str, most: int = 1000) -> DataFrame:
    """Pieces that contain the query without case, or whose id does; none for a blank query."""
    own = query.strip().lower()
    if not own:
        return tokens.limit(0)
    return tokens.where(F.contains(F.lower(token), F.lit(own)) | F.contains(F.col(token_id).cast("string"), F.lit(own))).orderBy(token_id).limit(most)


def difference_search(differences: DataFrame, token: str, side: str, query: str, most: int = 1000) -> DataFrame:
    """total, piece: the pieces on one side that contain the query without case (a blank one: all), the first 1000 in order, each with how many there are."""
    own = query.strip().lower()
    found = differences.where((F.col("side") == side) & F.contains(F.lower(token), F.lit(own)))
    total = found.agg(F.count("*").alias("total"))
    return found.select(F.col(token).alias("piece")).orderBy("piece").limit(most).crossJoin(F.broadcast(total)).select("total", "piece")


def vocabulary_entries(vocabulary: DataFrame, token: str, token_id: str, query: str) -> DataFrame:
    """Entries whose piece holds the query without case or whose id's digits do, sorted by id; all for an empty query."""
    own = query.lower()
    return vocabulary.where(F.contains(F.lower(token), F.lit(own)) | F.contains(F.col(token_id).cast("string"), F.lit(own))).orderBy(token_id)


def comparison(a: Column, b: Column) -> dict[str, Column]:
    """Counts, difference, whether two arrays of ids are equal, and where they first differ (from 0)."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    first = F.when(a == b, F.lit(None)).otherwise(at - 1).cast("long")
    return {"left_count": F.size(a).cast("long"), "right_count": F.size(b).cast("long"), "delta": (F.size(b) - F.size(a)).cast("long"), "ids_match": a == b, "first_difference": first, "left_id": F.get(a, first.cast("int")), "right_id": F.get(b, first.cast("int"))}


#: The largest id, and the most bytes of a list of them.
MOST_ID, MOST_LIST = 2**53 - 1, 65536


def token_ids(text: Column) -> Column:
    """A struct of ids, or an error and the number from 1 of the item that has it, of a JSON array or a list by commas or blanks.

    Errors: tooLarge, jsonInvalid, empty, negative, invalid, overflow; of several items the first counts.
    """
    own = trimmed(text)
    is_array = F.startswith(own, F.lit("["))
    parsed = F.try_parse_json(F.when(is_array, own))
    values = F.try_variant_get(parsed, "$", "array<variant>")

    def said(x: Column) -> Column:
        kind, number = F.schema_of_variant(x), F.try_variant_get(x, "$", "double")
        whole = (number == F.floor(number)) & (F.abs(number) < 1e18)
        return F.when(kind == "BIGINT", F.try_variant_get(x, "$", "string")).when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))).otherwise(F.lit("?"))

    items = F.when(is_array, F.transform(values, said)).otherwise(F.filter(F.split(text, r"(?U)[,\s]+", -1), lambda x: x != ""))

    def fault(x: Column) -> Column:
        number = x.try_cast("decimal(38,0)")
        integer = F.rlike(x, F.lit(r"^[+-]?[0-9]+$"))
        return F.when(~integer, "invalid").when(number < 0, "negative").when(number > MOST_ID, "overflow").when(number.isNull(), F.when(F.startswith(x, F.lit("-")), "negative").otherwise("overflow"))

    faults = F.transform(items, fault)
    first = F.array_min(F.filter(F.transform(faults, lambda e, i: F.when(e.isNotNull(), F.struct((i + 1).alias("at"), e.alias("error")))), lambda f: f.isNotNull()))
    error = F.when(F.octet_length(text) > MOST_LIST, "tooLarge").when(is_array & values.isNull(), "jsonInvalid").when(F.size(items) == 0, "empty").otherwise(first["error"])
    return F.struct(F.when(error.isNull(), F.transform(items, lambda x: x.try_cast("long"))).alias("ids"), error.alias("error"), F.when(error == first["error"], first["at"].cast("long")).alias("item"))


# The named fields of special tokens, in order.
NAMED = ["bos_token", "eos_token", "pad_token", "unk_token", "cls_token", "sep_token", "mask_token"]


def special_tokens(fields: DataFrame, added: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(tokenizer, token_id, piece, name, by_id): what a token is called by its id, if ``by_id``, and by its piece.

    ``fields``: tokenizer, name, piece, of the named fields and of additional ones, whose name is their piece; of one piece the
    first name counts. ``added``: tokenizer, token_id, content, special. ``vocabulary``: tokenizer, piece, token_id, if there is one. A named piece has an id if the vocabulary and
    the added tokens give it just one. Added tokens that are special are called by their piece's name, else by their content, and
    override by id.
    """
    place = F.array_position(F.array(*map(F.lit, NAMED)), F.col("name"))
    named = fields.where("piece <> ''").groupBy("tokenizer", "piece").agg(F.min_by("name", F.struct(F.when(place > 0, place).otherwise(len(NAMED) + 1), "name")).alias("name"))
    ids = added.select("tokenizer", F.col("content").alias("piece"), "token_id")
    ids = ids if vocabulary is None else ids.union(vocabulary.select("tokenizer", "piece", "token_id"))
    one = ids.where("token_id >= 0").groupBy("tokenizer", "piece").agg(F.collect_set("token_id").alias("ids")).where(F.size("ids") == 1).select("tokenizer", "piece", F.col("ids")[0].alias("token_id"))
    own = added.where("special AND content <> '' AND token_id >= 0").select("tokenizer", "token_id", F.col("content").alias("piece")).join(named, ["tokenizer", "piece"], "left").select("tokenizer", "token_id", "piece", F.coalesce("name", "piece").alias("name"))
    with_id = named.join(one, ["tokenizer", "piece"]).select("tokenizer", "token_id", "piece", "name", F.lit(1).alias("rank")).union(own.withColumn("rank", F.lit(0)))
    by_id = with_id.groupBy("tokenizer", "token_id").agg(F.min_by(F.struct("piece", "name"), F.struct("rank", "piece")).alias("b")).select("tokenizer", "token_id", "b.piece", "b.name", F.lit(True).alias("by_id"))
    by_piece = named.select("tokenizer", "piece", "name").union(own.select("tokenizer", "piece", "name")).distinct().select("tokenizer", F.lit(None).cast("long").alias("token_id"), "piece", "name", F.lit(False).alias("by_id"))
    return by_id.union(by_piece)


def flagged(tokens: DataFrame, special: DataFrame) -> DataFrame:
    """Tokens (tokenizer, pos, token_id, piece, if there is one also cold) with the special name found by id, else by piece, else, for tokens without a piece, by what their id alone decodes to (cold)."""
    ids = special.where("by_id").select("tokenizer", "token_id", F.col("name").alias("of_id"))
    pieces = special.where("NOT by_id").select("tokenizer", F.col("piece").alias("looked"), F.col("name").alias("of_piece"))
    cold = F.col("cold") if "cold" in tokens.columns else F.lit(None).cast("string")
    own = tokens.withColumn("looked", F.when(F.coalesce(F.col("piece"), F.lit("")) != "", F.col("piece")).otherwise(cold))
    return own.join(ids, ["tokenizer", "token_id"], "left").join(pieces, ["tokenizer", "looked"], "left").withColumn("flag", F.coalesce("of_id", "of_piece")).drop("of_id", "of_piece", "looked")


def encoded(df: DataFrame, key: str, text: str, vocabulary: subwords.Vocabulary) -> DataFrame:
    """key, ids, pieces, decoded, segments, mapping of each text.

    A segment is a run of tokens whose bytes are whole characters, of which there is one at least; ``mapping`` is Exact where segments give the text.
    A piece of bytes is shown with a letter for each.
    """
    kind = dict(df.select(key).dtypes)[key]
    raw, show = subwords.piece_bytes(vocabulary), subwords.shown_pieces(vocabulary)
    joined = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = subwords.encoded_ids(joined.select(F.struct(key, "text").alias("own"), "text"), "own", "text", vocabulary)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, s, own in zip(frame["key"], frame["text"], frame["ids"], strict=True):
                segments, run = [], b""
                for i in own:
                    run += raw.get(int(i), b"")
                    try:
                        said = run.decode()
                    except UnicodeDecodeError:
                        continue
                    if said and "\ufffd" not in said:
                        segments.append(said)
                        run = b""
                decoded = subwords.text_of(b"".join(raw.get(int(i), b"") for i in own), vocabulary.kind)
                segments = subwords.trimmed_segments(segments, vocabulary.kind)
                if run or "".join(segments) != decoded:
                    segments = [decoded] if len(own) else []
                exact = "".join(segments) == s and decoded == s
                rows.append((name, own, [show.get(int(i), "") for i in own], decoded, segments, "Exact" if exact else "Decoded only"))
            yield pd.DataFrame(rows, columns=[key, "ids", "pieces", "decoded", "segments", "mapping"])

    return ids.select(F.col("own")[key].alias("key"), "own.text", "ids").mapInPandas(of, f"{key} {kind}, ids array<long>, pieces array<string>, decoded string, segments array<string>, mapping string")


def attributed(df: DataFrame, key: str) -> DataFrame:
    """key, position, segment, role from columns text, bodies (array of role and body) and segments.

    Bodies are looked for one after the other in the text, each from the last one's end on; one that isn't there is passed
    over. A segment that lies in a body as a whole has its role, any other ``template``. A sweep over the starts of
    bodies and segments tells which body was opened last. With a column ``mapping`` rows have a role only where it is Exact.
    """
    exact = F.col("mapping") == "Exact" if "mapping" in df.columns else F.lit(True)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,role:string>>").alias("spans"))

    def opened(acc: Column, b: Column) -> Column:
        place = F.when(F.length(b["body"]) > 0, F.call_function("locate", b["body"], F.col("text"), acc["at"] + 1)).otherwise(0)
        end = place - 1 + F.length(b["body"])
        span = F.array(F.struct((place - 1).alias("start"), end.alias("end"), b["role"].cast("string").alias("role")))
        return F.when(place > 0, F.struct(end.alias("at"), F.concat(acc["spans"], span).alias("spans"))).otherwise(acc)

    bodies = F.transform("bodies", lambda b: F.struct(b["role"].alias("role"), b["body"].alias("body")))
    spans = F.aggregate(bodies, start, opened)["spans"]
    body_rows = F.transform(spans, lambda x: F.struct(F.lit(0).alias("kind"), F.lit(0).alias("position"), x["start"].alias("start"), F.lit(0).alias("size"), x["end"].alias("end"), x["role"].alias("label")))
    segment_rows = F.transform("segments", lambda x, i: F.struct(F.lit(1).alias("kind"), i.alias("position"), F.lit(None).cast("int").alias("start"), F.length(x).alias("size"), F.lit(None).cast("int").alias("end"), x.alias("label")))
    given = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("own"), F.coalesce(exact, F.lit(False)).alias("exact"), F.concat(body_rows, segment_rows).alias("x"))
    each = given.select("row", "own", "exact", F.explode("x").alias("x")).select("row", "own", "exact", "x.*")
    is_segment = F.col("kind") == 1
    ends = F.sum("size").over(Window.partitionBy("row", "kind").orderBy("position")).cast("int")
    placed = each.withColumn("end", F.when(is_segment, ends).otherwise(F.col("end"))).withColumn("start", F.when(is_segment, F.col("end") - F.col("size")).otherwise(F.col("start")))
    # Of what begins at one place a body comes first.
    sweep = Window.partitionBy("row").orderBy("start", "kind", "position").rowsBetween(Window.unboundedPreceding, 0)
    body = F.last(F.when(~is_segment, F.struct("end", "label")), ignorenulls=True).over(sweep)
    found = placed.withColumn("body", body).where(is_segment)
    role = F.when(F.col("exact"), F.when(F.col("end") <= F.col("body.end"), F.col("body.label")).otherwise("template"))
    return found.select(F.col("own").alias(key), "position", F.col("label").alias("segment"), role.alias("role"))
