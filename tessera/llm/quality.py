"""Quality rules by tokeniser fertility: characters per token, byte-fallback share and token entropy, with bands by script."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import alone, documents, fresh, give_back, small_batches, split_words, tokenizer_file, utf8, window_hashes, written

SYMBOLS, BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"
#: Bytes that aren't the first of a code point.
FOLLOWING = bytes(range(0x80, 0xC0))
REPEAT = 5
#: Bytes of text whose words are looked up together.
SLICE = 1 << 20
#: Words that a worker remembers before it forgets them all.
WORDS_KEPT = 150_000
#: Scripts by the Unicode blocks of their letters; the first with most letters is a text's script.
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏḀ-ỿ",
    "cyrillic": "Ѐ-ԯ",
    "greek": "Ͱ-Ͽἀ-῿",
    "arabic": "؀-ۿݐ-ݿ",
    "hebrew": "֐-׿",
    "indic": "ऀ-෿",
    "thai": "฀-๿",
    "hangul": "ᄀ-ᇿ가-힯",
    "han": "぀-ヿ㐀-䶿一-鿿",
}
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
LETTERS = {name: re.compile(f"[{chars}]") for name, chars in SCRIPTS.items()}
#: By script: least and most characters a token in the piece vocabulary, least ratio of the byte-level vocabulary's
#: characters a token to it, most share of byte-fallback tokens, least entropy of the tokens as a share of the most
#: that so many tokens can have. Bands are wide: they are for what no vocabulary fits. The ratio falls where words
#: carry runs of symbols, which the two vocabularies break up differently.
BANDS = {
    "latin": (1.2, 8.0, 0.88, 0.10, 0.35),
    "cyrillic": (1.0, 8.0, 0.40, 0.20, 0.35),
    "greek": (0.7, 8.0, 0.30, 0.50, 0.35),
    "arabic": (0.7, 8.0, 0.30, 0.50, 0.35),
    "hebrew": (0.6, 8.0, 0.30, 0.60, 0.30),
    "indic": (0.2, 8.0, 0.20, 0.95, 0.25),
    "thai": (0.2, 8.0, 0.20, 0.95, 0.25),
    "hangul": (0.2, 4.0, 0.20, 0.95, 0.30),
    "han": (0.2, 4.0, 0.20, 0.95, 0.35),
    "none": (0.7, 8.0, 0.40, 0.50, 0.30),
}
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, n_tokens_other long, chars_per_token double, chars_per_token_other double, byte_share double, token_entropy double, kept boolean"
_VOCABULARIES: dict[tuple[str, str], tuple] = {}


def looked_up(words: list[bytes], pieces: str, ranks: str) -> list[tuple[int, bytes, int]]:
    """Of each word: a 64-bit hash, its ids in the piece vocabulary as unsigned 32-bit bytes, its number of tokens in the byte-level one."""
    if (pieces, ranks) not in _VOCABULARIES:
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(pieces))
        with open(tokenizer_file(ranks), "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        _VOCABULARIES[pieces, ranks] = own, other, {}
    own, other, known = _VOCABULARIES[pieces, ranks]
    if len(known) > WORDS_KEPT:
        known.clear()
    new = [w for w in words if w not in known]
    said = [w.decode("utf-8", "replace") for w in new]
    ids = (array("I", x).tobytes() for x in own.encode(said, num_threads=1)) if said else ()
    found = zip(new, map(xxhash.xxh64_intdigest, new), ids, (len(other.encode_ordinary(" " + w)) for w in said), strict=True)
    known.update((w, (h, i, n)) for w, h, i, n in found)
    return [known[w] for w in words]


def forget() -> None:
    """A function of the module, as what Spark ships of a closure has no part in the worker's own tables."""
    give_back(*(v[2] for v in _VOCABULARIES.values()))


def begin() -> None:
    alone(_VOCABULARIES)


def byte_pieces(pieces: str, ranks: str) -> np.ndarray:
    """Which ids of the piece vocabulary stand for single bytes that no piece has."""
    looked_up([], pieces, ranks)
    own = _VOCABULARIES[pieces, ranks][0]
    return np.array([own.is_byte(i) for i in range(own.vocab_size())])


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside a window of five words that the text has twice or more."""
    windows = window_hashes(hashes, REPEAT)
    _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1) if len(windows) else np.empty(0, int)
    if not len(at):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + REPEAT, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def script_of(text: bytes) -> str:
    if text.isascii():
        return "latin" if LETTERS["latin"].search(text.decode()) else "none"
    chars = text.decode("utf-8", "replace")
    if not BEYOND_LATIN.search(chars):
        return "latin" if LETTERS["latin"].search(chars) else "none"
    count = {name: len(letters.findall(chars)) for name, letters in LETTERS.items() if letters.search(chars)}
    return max(count, key=count.get) if count else "none"


def entropy_share(ids: np.ndarray) -> float:
    """Entropy of the ids over the logarithm of their number; 1 for fewer than two."""
    if len(ids) < 2:
        return 1.0
    count = np.unique(ids, return_counts=True)[1] if len(ids) < 4000 else np.bincount(ids)
    p = count[count > 0] / len(ids)
    return float(-(p * np.log(p)).sum() / np.log(len(ids)))


def measured(pieces: str, ranks: str, bands: dict[str, tuple]) -> Column:
    """A struct column of FIELDS over a binary column."""

    def measured_words(texts: list[bytes]) -> Iterator[tuple]:
        """Each text with its words' hashes, ids and number of tokens of the other vocabulary; a distinct word is looked up once."""
        at, own, words = split_words(pa.array(texts, pa.binary()))
        found = looked_up(words, pieces, ranks)
        hashes, others = (np.fromiter((f[k] for f in found), kind, len(found)) for k, kind in ((0, np.uint64), (2, np.int64)))
        ids = [f[1] for f in found]
        for k, text in enumerate(texts):
            mine = own[at[k] : at[k + 1]]
            yield text, hashes[mine], np.frombuffer(b"".join(map(ids.__getitem__, mine.tolist())), "<u4"), int(others[mine].sum())

    def measure(is_byte: np.ndarray, text: bytes, hashes: np.ndarray, ids: np.ndarray, other: int) -> tuple:
        n = len(hashes)
        chars = len(text.translate(None, BLANKS + FOLLOWING))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        repeated = repeated_words(hashes)
        failed = n < 10 or 100 * repeated > 20 * n
        script = script_of(text)
        rate, rate_other = (chars / len(ids) if len(ids) else 0.0), (chars / other if other else 0.0)
        share, spread = (float(is_byte[ids].mean()) if len(ids) else 0.0), entropy_share(ids)
        least, most, ratio, fallback, even = bands.get(script, bands["none"])
        good = least <= rate <= most and rate_other >= ratio * rate and share <= fallback and spread >= even
        return n, chars, symbols, duplicate_lines(text), repeated, failed, script, len(ids), other, rate, rate_other, share, spread, not failed and good

    @F.pandas_udf(FIELDS)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        begin()
        is_byte = byte_pieces(pieces, ranks)
        for series in texts:
            rows, some, held = [], [], 0
            for text in (*(t or b"" for t in series), None):
                if some and (text is None or held >= SLICE):
                    rows += [measure(is_byte, *own) for own in measured_words(some)]
                    some, held = [], 0
                if text is not None:
                    some.append(text)
                    held += len(text)
            yield pd.DataFrame(rows, columns=names)
        forget()

    return of.asNondeterministic()  # so that it runs once where both a filter and a projection need it


def judged(docs: DataFrame, name: str, pieces: str = "piece_bpe_32k.model", ranks: str = "byte_bpe_multi_50k.tiktoken", bands: dict[str, tuple] = BANDS) -> DataFrame:
    """``docs`` with a struct column ``name``: the measures of each text, and whether it is kept.

    ``docs``: text; other columns pass through, whatever their names. A null text has no words and so fails; so does
    one of blanks. Fertility is measured a word at a time, over the whole text. Every row is judged by itself:
    repeated rows and ties get the same verdict, an empty table gives no rows, and no document's verdict depends
    on the others.
    """
    return docs.withColumn(name, measured(pieces, ranks, bands)(utf8(docs["text"])))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id and the measures and verdict of each row, as columns."""
    return judged(docs.select("doc_id", "text"), "quality").select("doc_id", "quality.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever their names. They are written, so that texts go to the workers in small batches.

    A null, empty or blank text fails. Rows that repeat have one verdict; an empty table gives no rows.
    """
    (name,) = fresh(docs, "quality")
    good = judged(docs, name).where(f"`{name}`.kept").select(*docs.columns)
    with small_batches(docs.sparkSession):
        return written(good)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir))
