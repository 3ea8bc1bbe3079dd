"""Packing by vector bin packing: the dot-product heuristic under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import alone, documents, fresh, give_back, numbered, slices, small_batches, small_table, tokenizer_file, written

#: Documents that one packer places at a time. It searches its own remaining pieces for each place, so work a document is bounded.
BUCKET_DOCS = 1536
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long, bucket long"
#: Chunks that the vocabulary's rules lower-case letter by letter and leave as they are otherwise, and how its pattern cuts them.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"
CUTS = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
#: Bytes of text that are split at once.
SLICE = 1 << 20
#: Cuts a worker remembers before it forgets those that the slice at hand doesn't have.
CUTS_KEPT = 150_000
#: The character that the vocabulary writes for each byte: itself if it is printable, else the next from 256 on.
BYTES = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
SHOWN = {b: chr(b) for b in BYTES} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*BYTES}))}
_TOKENIZERS: dict[str, tuple] = {}


def cut_up(chunks: pa.Array) -> pa.Array:
    """The cuts of each plain chunk, and an empty one at its end."""
    return pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(chunks), CUTS, r"\1 "), " ")


def chunk_ids(chunks: pa.Array, file: str) -> list[bytes]:
    """The ids of chunks of text without blanks, as little-endian unsigned 32-bit bytes.

    The vocabulary's own rules drop white space before merging, and no rule reaches across it, so a text's
    ids are its chunks' ids put together. Nor does a merge reach across a cut, so a plain chunk's ids are its cuts';
    other chunks, such as those with marks that combine or with names of special tokens, are encoded whole.
    """
    if file not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(tokenizer_file(file))
        _TOKENIZERS[file] = own, own.model, {"": b""}
    own, model, known = _TOKENIZERS[file]
    plain = pc.and_(pc.match_substring_regex(chunks, PLAIN), pc.invert(pc.match_substring(chunks, "<|")))
    other = pc.invert(plain)
    lists = cut_up(chunks.filter(plain))
    cuts = lists.flatten().dictionary_encode()
    words = cuts.dictionary.to_numpy(zero_copy_only=False).tolist()
    if len(known) > CUTS_KEPT:
        again = {word: known[word] for word in words if word in known}
        known.clear()
        known.update(again, **{"": b""})
    for word in words:
        if word not in known:
            # ASCII stands for itself in the vocabulary; of other letters the bytes are shown as characters.
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
            known[word] = array("I", [piece.id for piece in model.tokenize(shown)]).tobytes()
    ids = [known[word] for word in words]
    order, at = cuts.indices.to_numpy().tolist(), (lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]).tolist()
    out = np.empty(len(chunks), object)
    out[plain.to_numpy(zero_copy_only=False)] = [b"".join([ids[i] for i in order[a:b]]) if b - a > 2 else ids[order[a]] for a, b in zip(at[:-1], at[1:], strict=True)]
    out[other.to_numpy(zero_copy_only=False)] = [array("I", own.encode(c, add_special_tokens=False).ids).tobytes() for c in chunks.filter(other).to_pylist()]
    return out.tolist()


def forget() -> None:
    """A function of the module, as what Spark ships of a closure has no part in the worker's own tables."""
    give_back(*(t[2] for t in _TOKENIZERS.values()))


def begin() -> None:
    alone(_TOKENIZERS)


def cut(total: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences from its start, then the rest."""
    return [(at, min(most, total - at)) for at in range(0, total, most)]


def place(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The bin of each piece. ``demand``: a row a piece, a column a limit.

    One bin is open at a time. It takes the fitting piece whose demand has the largest dot product with what is
    left of the bin, each limit weighted by the mean demand on it, until none fits. A piece over a limit by
    itself is refused. Ties: the first in the given order.
    """
    share = demand / limits
    if (share > 1).any():
        raise ValueError("a piece exceeds a limit by itself")
    out = np.full(len(demand), -1, np.int64)
    left, weight = np.arange(len(demand)), share.mean(axis=0) if len(demand) else None
    n = 0
    while len(left):
        room, own = np.ones(demand.shape[1]), share[left]
        open_, eps = np.ones(len(left), bool), 1e-12
        while True:
            open_ &= (own <= room + eps).all(axis=1)
            if not open_.any():
                break
            # Only fitting pieces are looked at again: what doesn't fit now doesn't fit later.
            fit = np.flatnonzero(open_)
            k = fit[np.argmax(own[fit] @ (weight * room))]
            out[left[k]], open_[k] = n, False
            room = room - own[k]
        left = left[out[left] < 0]
        n += 1
    return out


def hashed(docs: DataFrame, loss: Column, bucket_docs: int) -> DataFrame:
    """doc_id, text, loss, bucket of each row, the buckets dealt by a hash of the row's number, so that repeated rows are dealt out too."""
    buckets = max(1, -(-docs.count() // bucket_docs))
    at = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(buckets))
    return docs.select(F.col("doc_id").cast("long"), "text", loss.alias("loss"), at.alias("bucket"))


def in_runs(docs: DataFrame, loss: Column, bucket_docs: int) -> DataFrame:
    """doc_id, text, loss, bucket of each row, the buckets being successive runs of the rows in the order of their files."""
    file, index = fresh(docs, "file", "index")
    rows = numbered(docs, file, index).select(F.col("doc_id").cast("long"), "text", loss.alias("loss"), F.col(file).alias("file"), F.col(index).alias("index"))
    # Part files are numbered with five digits or more; the table has a row a file.
    found = sorted(((r["file"], r["count"]) for r in rows.groupBy("file").count().collect()), key=lambda r: (len(r[0]), r[0]))
    ends = np.cumsum([0, *(n for _, n in found)]).tolist()
    begins = small_table(docs.sparkSession, [(f, a) for (f, _), a in zip(found, ends, strict=False)], pa.schema([("own_file", pa.string()), ("begin", pa.int64())]))
    buckets = max(1, -(-ends[-1] // bucket_docs))
    run = F.floor((F.col("begin") + F.col("index")) * F.lit(buckets) / F.lit(max(1, ends[-1])))
    return rows.join(F.broadcast(begins), F.col("file") == F.col("own_file")).select("doc_id", "text", "loss", run.alias("bucket"))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int) -> DataFrame:
    """The pieces of each row of ``docs``: doc_id, text, loss, bucket."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1, SLICE):
            split = pc.split_pattern(pc.replace_substring(pc.fill_null(batch.column(1), ""), "\n", " "), " ")
            chunks = split.flatten().dictionary_encode()
            ids = chunk_ids(chunks.dictionary, tokenizer)
            at, order = split.offsets.to_numpy() - split.offsets[0].as_py(), chunks.indices.to_numpy()
            rows: list[tuple] = []
            for k, (doc, bears, bucket) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                own = memoryview(b"".join([*map(ids.__getitem__, order[at[k] : at[k + 1]].tolist()), end]))
                total = len(own) // 4
                for start, n in cut(total, most):
                    # Without a column that says otherwise, all but a document's first token bear loss.
                    lossy = (n - (start == 0)) if bears is None else n * bool(bears)
                    rows.append((doc, start, n, zlib.crc32(own[4 * start : 4 * (start + n)]), total, lossy, bucket))
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)
        forget()

    return docs.mapInArrow(of, PIECES)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, max_tokens: int = 4096, max_segments: int = 1024, max_loss: int | None = None, loss: Column | None = None, bucket_docs: int = BUCKET_DOCS, ordered: bool = False) -> DataFrame:
    """A row for each piece of a document: where it begins and ends in the document, and its sequence and offset there.

    ``docs``: doc_id, text; other columns don't matter, whatever their names. A null or empty text is the end id
    alone. A null doc_id packs as any other; repeated rows are documents of their own. An empty table gives no
    rows. A document over ``max_tokens`` (or ``max_loss``) is cut into pieces of just that and a rest; the rests of some 1,500 documents,
    dealt by a hash, share a packer, so no task grows with the corpus and only numbers are shuffled. ``loss``
    says whether a row's tokens bear loss (in conversations, the assistant's turns); a sequence holds at most
    ``max_segments`` pieces and ``max_loss`` loss-bearing tokens. Without ``loss`` all tokens but a document's first
    bear loss; then ``max_loss`` only binds if it is below ``max_tokens``.

    With ``ordered`` the packers get successive runs of the rows instead, in the order of the files that ``docs`` was
    read from, as a sorted table leaves them: sequences ascend by run, and only within a run pieces change places.
    """
    limits = np.array([max_tokens, max_segments, max_loss or max_tokens], float)
    step = min(max_tokens, max_loss or max_tokens)
    bears = F.lit(None).cast("boolean") if loss is None else loss
    dealt = (in_runs if ordered else hashed)(docs, bears, bucket_docs)

    def packed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins = place(np.stack([own["length"], np.ones(len(own)), own["loss"]], axis=1).astype(float), limits)
        own = own.assign(sequence_id=(own["bucket"].to_numpy() << 32) | bins).sort_values("sequence_id", kind="stable")
        own["offset"] = own.groupby("sequence_id")["length"].cumsum() - own["length"]
        return own.drop(columns="bucket").rename(columns={"loss": "loss_tokens"})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"
    with small_batches(docs.sparkSession):  # which holds as long as the pieces are being made
        cut_pieces = written(pieces(dealt, tokenizer, end_id, step))
    return cut_pieces.groupBy("bucket").applyInPandas(packed, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
