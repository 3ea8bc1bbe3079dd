"""Encoding and decoding by public vocabularies: byte-pair merges by rank, by score, and the best path of a unigram model.

A text is cut into words by Spark; a table of the frequent words' ids, of bounded size, is made once, with each distinct word
encoded once by whichever task has it. Where texts are encoded, words that the table has are looked up, and a batch's other
distinct words are encoded there. So a word's merges are worked out once, not once a row.
"""

from __future__ import annotations

import base64
import heapq
import json
import math
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in the table of frequent ones, and the most bytes of one there.
FREQUENT, LONGEST = 1 << 16, 64
# How texts are cut into words, in Java's syntax, and the mark of a blank in pieces.
BLANK = r"\t\n\x0B\f\r \x85\p{Z}"
PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
LOWER_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"
MARK = "▁"


class Vocabulary(NamedTuple):
    """``kind``: ranks (merges of bytes by rank), ends (of lower-case words with a mark of their end), scores (merges of characters by score, bytes for what has no piece), unigram (the best sum of scores, bytes likewise).

    ``ids``: of pieces, bytes for ranks and ends, else text. ``weight``: a piece's rank or score; of ends a pair's rank.
    """

    kind: str
    ids: dict
    weight: dict


def letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in vocabularies of text: itself if it can be seen, else the next one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


def from_ranks(path: str) -> Vocabulary:
    """Of a file with a piece in base64 and its rank a line; ids are ranks."""
    with open(path, "rb") as f:
        ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Vocabulary("ranks", ids, ids)


def from_json(path: str) -> Vocabulary:
    """Of a tokenizer file whose model is byte-level BPE, with or without ends of words."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] == "Unigram":
        return Vocabulary("unigram", {p: k for k, (p, _) in enumerate(model["vocab"])}, {p: s for p, s in model["vocab"]})
    byte, end = letters_of_bytes(), model.get("end_of_word_suffix") or ""
    raw = lambda p: bytes(byte[c] for c in p.removesuffix(end)) + (b"\x00" if end and p.endswith(end) else b"")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    known = lambda p: all(c in byte for c in p.removesuffix(end))
    ids = {raw(p): k for p, k in model["vocab"].items() if known(p)}
    if end:
        return Vocabulary("ends", ids, {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)})
    return Vocabulary("ranks", ids, {raw(a) + raw(b): k for k, (a, b) in enumerate(pairs)})


def from_pieces(path: str, unigram: bool = False) -> Vocabulary:
    """Of a file of pieces with scores; ``unigram`` reads the scores as logarithms of probabilities, whatever the file was made for."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(own.get_piece_size())
    ids = {own.id_to_piece(k): k for k in every if not own.is_control(k) and not own.is_unknown(k) and not own.is_unused(k)}
    return Vocabulary("unigram" if unigram else "scores", ids, {p: own.get_score(k) for p, k in ids.items()})


def merged(parts: list, weight: Callable[[object, object], float | None]) -> list:
    """``parts`` with neighbours joined, those of the least weight first and of equal ones the leftmost, until none has a weight."""
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list[tuple] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < len(parts):
            w = weight(parts[a], parts[b])
            if w is not None:
                heapq.heappush(heap, (w, a, b, parts[a], parts[b]))

    for k in range(len(parts) - 1):
        offer(k)
    while heap:
        _, a, b, left, right = heapq.heappop(heap)
        if parts[a] is not left or b >= len(parts) or after[a] != b or parts[b] is not right:
            continue  # one of the two was joined meanwhile
        parts[a] = left + right
        parts[b] = None
        after[a] = after[b]
        if after[b] < len(parts):
            before[after[b]] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [p for p in parts if p is not None]


def best_path(text: str, score: dict[str, float], longest: int, unknown: float) -> list[str]:
    """The pieces of the highest sum of scores; a character that no piece begins with is one of its own, for ``unknown``. Of equal sums the longer last piece."""
    total, back = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
    for k in range(len(text)):
        found = False
        for end in range(k + 1, min(len(text), k + longest) + 1):
            s = score.get(text[k:end])
            if s is not None:
                found = found or end == k + 1
                if total[k] + s > total[end]:
                    total[end], back[end] = total[k] + s, k
        if not found and total[k] + unknown > total[k + 1]:
            total[k + 1], back[k + 1] = total[k] + unknown, k
    out, k = [], len(text)
    while k:
        out.append(text[back[k] : k])
        k = back[k]
    return out[::-1]


class Encoder:
    """Ids of words by a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.kind, self.ids, self.weight = vocabulary
        if self.kind in ("scores", "unigram"):
            self.longest = max(map(len, self.ids), default=1)
            self.unknown = min(self.weight.values(), default=0.0) - 10
            self.bytes = [self.ids.get(f"<0x{b:02X}>") for b in range(256)]

    def __call__(self, word: str) -> list[int]:
        if self.kind == "ranks":
            raw = word.encode("utf-8", "surrogatepass")
            if raw in self.ids:
                return [self.ids[raw]]
            return [self.ids[p] for p in merged([raw[k : k + 1] for k in range(len(raw))], lambda a, b: self.weight.get(a + b))]
        if self.kind == "ends":
            raw = word.encode()
            parts = [raw[k : k + 1] for k in range(len(raw))]
            parts[-1] += b"\x00"
            return [self.ids[p] for p in merged(parts, lambda a, b: self.weight.get((a, b)))]
        if self.kind == "scores":
            lower = lambda a, b: -self.weight[a + b] if a + b in self.ids else None
            parts = merged(list(word), lower)
        else:
            parts = best_path(word, self.weight, self.longest, self.unknown)
        out = []
        for p in parts:
            out.extend([self.ids[p]] if p in self.ids else (self.bytes[b] for b in p.encode()))
        return out


def words(text: Column, kind: str) -> Column:
    """The words that a vocabulary of a kind encodes one by one, in order."""
    s = F.coalesce(text, F.lit(""))
    if kind == "ranks":
        return F.regexp_extract_all(s, F.lit(PRETOKENS), F.lit(0))
    if kind == "ends":
        return F.regexp_extract_all(composed_lower(s), F.lit(LOWER_WORDS), F.lit(0))
    # A mark for each blank, one before the first word; a word is what such marks begin and go on to.
    marked = F.when(s == "", "").otherwise(F.concat(F.lit(MARK), F.replace(s, F.lit(" "), F.lit(MARK))))
    return F.regexp_extract_all(marked, F.lit(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), F.lit(0))


@F.pandas_udf(T.StringType())
def composed_lower(texts: pd.Series) -> pd.Series:
    """Composed (NFC), runs of blanks as one, each character in lower case by itself."""
    return texts.map(lambda s: "".join(c.lower() for c in unicodedata.normalize("NFC", s)))


def frequent_words(df: DataFrame, text: str, vocabulary: Vocabulary, most: int = FREQUENT) -> tuple[list[str], list[list[int]]]:
    """The most frequent words and their ids, encoded where Spark has them; the driver gets ``most`` of LONGEST bytes at most."""
    counts = df.select(F.explode(words(F.col(text), vocabulary.kind)).alias("word")).groupBy("word").count()
    often = counts.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("count"), "word").limit(most)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Encoder(vocabulary)
        for frame in frames:
            yield pd.DataFrame({"word": frame["word"], "ids": [own(w) for w in frame["word"]]})

    rows = often.select("word").repartition(F.xxhash64("word")).mapInPandas(of, "word string, ids array<int>").collect()
    return [r["word"] for r in rows], [r["ids"] for r in rows]


def encoded_ids(df: DataFrame, key: str, text: str, vocabulary: Vocabulary, most: int = FREQUENT) -> DataFrame:
    """key, ids (array of int) of each text. A null text has none; texts without words have none."""
    known, ids = frequent_words(df, text, vocabulary, most)
    sizes, flat = np.array([len(x) for x in ids], np.int64), np.concatenate([np.array(x, np.int32) for x in ids]) if ids else np.empty(0, np.int32)
    kind = dict(df.select(key).dtypes)[key]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(vocabulary)
        table = pa.array(known, pa.string())
        begins = np.append(0, np.cumsum(sizes))
        for batch in batches:
            lists = batch.column(1)
            every = lists.flatten().dictionary_encode()
            place = pc.index_in(every.dictionary, value_set=table)
            # What the table has is taken from it; the batch's other distinct words are encoded here.
            found = place.is_valid().to_numpy(zero_copy_only=False)
            new = [own(w) for w in every.dictionary.filter(pa.array(~found)).to_pylist()]
            at = np.empty(len(found), np.int64)
            at[found] = place.drop_null().to_numpy()
            at[~found] = len(sizes) + np.arange(len(new))
            size = np.append(sizes, [len(x) for x in new]).astype(np.int64)
            values = np.concatenate([flat, *(np.array(x, np.int32) for x in new)])
            start = np.append(begins[:-1], begins[-1] + np.cumsum(size[len(sizes) :]) - size[len(sizes) :])
            word = at[every.indices.to_numpy()]
            n = size[word]
            ends = np.cumsum(n)
            out = values[np.repeat(start[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            offsets = np.append(0, ends)[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.int32()))], names=[key, "ids"])

    return df.select(key, words(F.col(text), vocabulary.kind).alias("words")).mapInArrow(of, f"{key} {kind}, ids array<int>")


def piece_bytes(vocabulary: Vocabulary) -> dict[int, bytes]:
    """What each id stands for: bytes, a blank for the mark of one, and one after a word's end."""

    def raw(p) -> bytes:
        if isinstance(p, bytes):
            return p.removesuffix(b"\x00") + b" " if vocabulary.kind == "ends" and p.endswith(b"\x00") else p
        if len(p) == 6 and p.startswith("<0x"):
            return bytes([int(p[3:5], 16)])
        return p.replace(MARK, " ").encode()

    return {k: raw(p) for p, k in vocabulary.ids.items()}


def shown_pieces(vocabulary: Vocabulary) -> dict[int, str]:
    """Each id's piece as text; a letter stands for each byte of pieces of bytes."""
    letter = {b: c for c, b in letters_of_bytes().items()}
    return {k: p if isinstance(p, str) else "".join(letter[b] for b in p) for p, k in vocabulary.ids.items()}


def text_of(raw: bytes, kind: str) -> str:
    """The text of ids' bytes, without the blank that encoding puts before the first word, or the one behind the last."""
    t = raw.decode("utf-8", "replace")
    return t.removeprefix(" ") if kind in ("scores", "unigram") else t.removesuffix(" ") if kind == "ends" else t


def trimmed_segments(segments: list[str], kind: str) -> list[str]:
    """Likewise of a text's segments."""
    if segments and kind in ("scores", "unigram"):
        return [segments[0].removeprefix(" "), *segments[1:]]
    if segments and kind == "ends":
        return [*segments[:-1], segments[-1].removesuffix(" ")]
    return segments


def decoded(df: DataFrame, key: str, ids: str, vocabulary: Vocabulary) -> DataFrame:
    """key, text of lists of ids: bytes that aren't whole characters become replacement marks; an unknown id is nothing."""
    column = dict(df.select(key).dtypes)[key]
    pieces, kind = piece_bytes(vocabulary), vocabulary.kind

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "text": [None if own is None else text_of(b"".join(pieces.get(int(k), b"") for k in own), kind) for own in frame[ids]]})

    return df.select(key, ids).mapInPandas(of, f"{key} {column}, text string")
