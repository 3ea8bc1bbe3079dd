"""Deduplication of long substrings over a logarithmic family of indexes.

Every string of 50 bytes has one anchor: its 14-byte string with the least hash. Neighbouring strings of equal anchors
are shipped together, as one stretch of text, to the anchor's cell; equal strings have equal anchors, so they
meet. A run of one character, or of a short period, is one stretch, and of a document's equal stretches one text is
shipped. In a cell the stretches come in batches of ascending documents. A batch's suffixes (one a string
of 50 bytes) are sorted into an array of its own; the array is merge-scanned against the levels that earlier batches
left, whose documents are all smaller; then it becomes a level itself, and levels of equal size merge, so that a
suffix is merged as often as the logarithm of the number of batches. Only equality over the 50 bytes matters, so
suffixes are ordered by a 64-bit print of them, and bytes are compared on every hit.

``Index`` keeps the stretches of batches in a folder, as levels of a logarithmic family: what is added later is compared to
all levels, becomes a level, and levels of equal rank merge into one of the next.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blobs import PACKED, SUBS, by_cell, dealt, gathered, packed, rows_of, shuffled, unpacked
from tessera.llm.common import bounded, chunks, documents, give_back, mixed, parts, utf8, written

LENGTH, ANCHOR = 50, 14
WINDOW = LENGTH - ANCHOR + 1
BATCHES = 8
#: Bytes of text that are anchored at once; parts of a cell, gone through one after the other, so that only one is unpacked.
CHUNK, INNER = 2 << 20, 4
#: Stretches that a task remembers as repeated; spans that it holds before it packs them for their documents.
HOT, SPANS_HELD = 200_000, 500_000
#: Stands for a null identifier, after all others.
LAST = 2**63 - 1
ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def by_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd number and of its inverse."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((ODD, pow(ODD, -1, 2**64))):
            full = np.full(max(n, 1 << 20), base, np.uint64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as an integer; zeros follow the text."""
    v = np.zeros(len(text) + 8, np.uint64)
    v[: len(text)] = text
    for k in (1, 2, 4):
        v[:-k] |= v[k:] << np.uint64(8 * k)
    return v[: len(text)]


def anchor_hashes(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ANCHOR bytes from each position on."""
    eight = words_at(text)
    h = eight * np.uint64(0xD6E8FEB86659FD93)
    h[: 8 - ANCHOR] ^= eight[ANCHOR - 8 :] * np.uint64(0xA0761D6478BD642F)
    return mixed(h)


def sums_of(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes))[0], out=out[1:])
    return out


def prints(sums: np.ndarray, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A print of the ``n`` hashes from ``start`` on, the same wherever they stand."""
    return (sums[start + n] - sums[start]) * powers(len(sums))[1][start]


def anchors(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each position the least of the ``window`` hashes from there on (those at the end of the text have none of meaning)."""
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low[:0]
        span *= 2
    rest = window - span
    low = np.minimum(low[:-rest], low[rest:]) if rest and len(low) > rest else low
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for n positions each, one after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def runs(flags: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each run of true flags; a run ends before each true ``edge``."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (np.diff(at) > 1) | edge[at[1:]]])
    first = at[new]
    return first, np.append(at[np.flatnonzero(new)[1:] - 1], at[-1])


def segments(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(pieces of texts, each one's text, where it begins there) of CHUNK bytes or so together.

    A long text is cut into pieces that overlap by 49 bytes, so that each string of 50 bytes is in just one.
    """
    some, own, base, held = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 1), CHUNK):
            piece = text[at : at + CHUNK + LENGTH - 1]
            some.append(piece)
            own.append(k)
            base.append(at)
            held += len(piece)
            if held >= CHUNK:
                yield some, np.array(own), np.array(base)
                some, own, base, held = [], [], [], 0
    if some:
        yield some, np.array(own), np.array(base)


class Hot:
    """Marks of stretches that several documents have, each with the smallest document that a task saw it in."""

    def __init__(self):
        self.marks, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64)

    def least(self, marks: np.ndarray) -> np.ndarray:
        """The smallest document known to have each, or the largest number there is."""
        if not len(self.marks):
            return np.full(len(marks), LAST)
        k = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        return np.where(self.marks[k] == marks, self.ids[k], LAST)

    def add(self, marks: np.ndarray, ids: np.ndarray) -> None:
        if len(self.marks) + len(marks) > HOT:
            self.marks, self.ids = self.marks[:0], self.ids[:0]
        marks, ids = np.concatenate([self.marks, marks]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, marks))
        marks, ids = marks[order], ids[order]
        head = np.concatenate([[True], marks[1:] != marks[:-1]])[: len(marks)]
        self.marks, self.ids = marks[head], ids[head]


def stretches(texts: list[bytes], ids: np.ndarray, keys: np.ndarray, base: np.ndarray, n: int, hot: Hot) -> tuple[list[tuple[int, bytes]], tuple]:
    """Packed stretches by cell, and the spans (piece's number, start, end) found repeated at once.

    Of equal stretches in these texts only those of the smallest document are shipped, and none if the task has seen
    a smaller one: what repeats them in larger documents is known to be repeated. So of a passage that every document has
    a task ships few stretches. Equal stretches of one document are shipped as one text and its places.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    text = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    strings = np.maximum(lengths - LENGTH + 1, 0)
    if not strings.sum():
        return [], (empty, empty, empty)
    hashes = anchor_hashes(text)
    sums = sums_of(hashes)
    at = ranges(begins, strings)
    doc = np.repeat(np.arange(len(texts)), strings)
    anchor = hashes[anchors(hashes)[at]]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    first, own, anchor = at[new], doc[new], anchor[new]
    size = np.diff(np.append(new, len(at))) + LENGTH - 1
    mark = prints(sums, first, size - ANCHOR + 1) ^ mixed(size.astype(np.uint64))
    order = np.lexsort((ids[own], mark))
    head = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
    lead = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    least, most = ids[own][order][lead], ids[own][order][np.append(lead[1:], len(order)) - 1]
    seen = hot.least(mark[order][lead])
    least = np.minimum(least, seen)
    many = (most > least) | (seen < LAST)
    hot.add(mark[order][lead][many], least[many])
    again = np.zeros(len(own), bool)
    again[order] = ids[own][order] > least[group]
    where = first - begins[own] + base[own]
    found = own[again], where[again], (where + size)[again]
    keep = np.flatnonzero(~again)
    part = (mixed(anchor[keep]) % np.uint64(n * SUBS * INNER)).astype(np.int64)
    order = np.lexsort((where[keep], own[keep], mark[keep], part))
    keep, part = keep[order], part[order]
    head = np.concatenate([[True], (mark[keep][1:] != mark[keep][:-1]) | (own[keep][1:] != own[keep][:-1])])[: len(keep)]
    lead = np.flatnonzero(head)
    times = np.diff(np.append(lead, len(keep)))
    starts = np.append(lead, len(keep))
    cell = part[lead] // INNER
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
    out = []
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(cell)).tolist(), strict=True):
        mine = keep[lead[a:b]]
        inner = np.bincount(part[lead[a:b]] % INNER, minlength=INNER)
        docs, number = np.unique(own[mine], return_inverse=True)
        numbers = packed(np.diff(ids[docs], prepend=0), keys[docs], inner, narrow(number), narrow(size[mine]), narrow(times[a:b]), narrow(where[keep[starts[a] : starts[b]]]))
        body = zstandard.ZstdCompressor(level=2).compress(text[ranges(first[mine], size[mine])].tobytes())
        out.append((int(cell[a]), pickle.dumps((numbers, body), protocol=5)))
    return out, found


def opened(payload: bytes) -> Iterator[tuple[int, tuple]]:
    """(part of the cell, (ids, keys, number, size, times, where, text)) of what ``stretches`` packed."""
    numbers, body = pickle.loads(payload)
    ids, keys, inner, number, size, times, where = unpacked(numbers)
    ids, text = np.cumsum(ids), zstandard.ZstdDecompressor().decompress(body)
    records, places, wheres = np.append(0, np.cumsum(inner)), np.append(0, np.cumsum(size, dtype=np.int64)), np.append(0, np.cumsum(times, dtype=np.int64))
    for k in np.flatnonzero(inner):
        a, b = records[k], records[k + 1]
        yield int(k), (ids, keys, number[a:b], size[a:b], times[a:b], where[wheres[a] : wheres[b]], text[places[a] : places[b]])


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max())))


class Levels:
    """Sorted arrays of suffix prints with the place of each suffix; sizes grow geometrically."""

    def __init__(self, text: np.ndarray):
        self.eight, self.levels = words_at(text), []

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which suffixes agree over all their 50 bytes."""
        out = np.ones(len(a), bool)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            out &= self.eight[a + k] == self.eight[b + k]
        return out

    def scanned(self, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes some level has."""
        out = np.zeros(len(keys), bool)
        for own, at, _ in self.levels:
            k = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            hit = np.flatnonzero((own[k] == keys) & ~out)
            out[hit] = self.same(place[hit], at[k[hit]])
        return out

    def add(self, keys: np.ndarray, place: np.ndarray) -> None:
        if not len(keys):
            return
        level = keys, place, 1
        while self.levels and self.levels[-1][2] == level[2]:
            own, at, n = self.levels.pop()
            both = np.concatenate([own, level[0]])
            order = np.argsort(both, kind="stable")
            level = both[order], np.concatenate([at, level[1]])[order], n + level[2]
        self.levels.append(level)


def repeated(payloads: list[tuple]) -> Iterator[tuple]:
    """(ids, keys, starts, ends) of the spans that a smaller document has too, of stretches whose anchors share a part of a cell.

    A payload's last item says whether it was there before: then its documents come before all others, and have no spans.
    """
    ids = np.concatenate([p[0] for p in payloads])
    before = np.repeat([p[7] for p in payloads], [len(p[0]) for p in payloads])
    keys = np.concatenate([p[1] for p in payloads])
    base = np.cumsum([0, *(len(p[0]) for p in payloads)])
    own = np.concatenate([p[2].astype(np.int64) + b for p, b in zip(payloads, base, strict=False)])
    size, times, where = (np.concatenate([p[k].astype(np.int64) for p in payloads]) for k in (3, 4, 5))
    text = np.frombuffer(b"".join(p[6] for p in payloads), np.uint8)
    payloads.clear()
    first, places = np.cumsum(size) - size, np.cumsum(times) - times
    sums = sums_of(anchor_hashes(text))
    levels = Levels(text)
    new = ~before[own]
    doc = np.unique(np.stack([~before, ids]), axis=1, return_inverse=True)[1].reshape(-1)[own] if before.any() else ids[own]
    order = np.argsort(doc, kind="stable")
    # Batches of about equal size, none of which divides a document.
    edges = np.searchsorted(doc[order], doc[order][np.linspace(0, len(order) - 1, BATCHES + 1).astype(int)[1:-1]], "right")
    for batch in np.split(order, np.unique(edges)):
        if not len(batch):
            continue
        strings = size[batch] - LENGTH + 1
        place = ranges(first[batch], strings)
        record = np.repeat(np.arange(len(batch)), strings)
        mark = prints(sums, place, WINDOW)
        array = np.argsort(mark)
        mark = mark[array]
        heads = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        # The records of a batch ascend by document, so the first of equal suffixes by place is of the smallest.
        firsts = np.minimum.reduceat(array, heads)
        lead = np.repeat(firsts, np.diff(np.append(heads, len(array))))
        own_doc = doc[batch][record]
        hit = own_doc[array] > own_doc[lead]
        at_hit = np.flatnonzero(hit)
        hit[at_hit] = levels.same(place[array[at_hit]], place[lead[at_hit]])
        hit |= levels.scanned(mark, place[array])
        levels.add(mark[heads], place[firsts])
        flags = np.zeros(len(place), bool)
        flags[array] = hit
        a, b = runs(flags, np.concatenate([[True], record[1:] != record[:-1]]))
        rec = batch[record[a]]
        a, b, rec = a[new[rec]], b[new[rec]], rec[new[rec]]
        span = np.repeat(np.arange(len(rec)), times[rec])  # a span at each place of its stretch
        at, rec = where[ranges(places[rec], times[rec])], rec[span]
        yield ids[own[rec]], keys[own[rec]], at + place[a][span] - first[rec], at + place[b][span] - first[rec] + LENGTH


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs, in order; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return starts[new], ends[np.append(new[1:], len(ends)) - 1]


def packed_spans(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> pa.RecordBatch:
    part = mixed(ids.view(np.uint64)) % np.uint64(n)
    own = [(k * SUBS, packed(ids[at], keys[at], starts[at], ends[at])) for k, at in dealt(part, n)]
    return rows_of([k for k, _ in own], [p for _, p in own])


def united_spans(payloads: list[tuple]) -> Iterator[pa.RecordBatch]:
    """id, key, spans: the union of the packed spans of each document, as maximal runs."""
    ids, keys, starts, ends = (np.concatenate([p[k] for p in payloads]) for k in range(4))
    order = np.lexsort((keys, ids))
    ids, keys, starts, ends = ids[order], keys[order], starts[order], ends[order]
    heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])[: len(ids)])
    out = [np.stack(merged(s, e)).tobytes() for s, e in zip(np.split(starts, heads[1:]), np.split(ends, heads[1:]), strict=True)] if len(heads) else []
    yield pa.RecordBatch.from_arrays([pa.array(ids[heads], pa.int64()), pa.array(keys[heads], pa.int32()), pa.array(out, pa.binary())], names=["id", "key", "spans"])


def shipped(docs: DataFrame, n: int) -> DataFrame:
    """The stretches of ``docs`` for the cells of n partitions, and the spans found at once."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = Hot()
        for got, _ in chunks(batches, CHUNK):
            ids, keys = np.array(got["doc_id"], np.int64), np.array(got["key"], np.int32)
            for pieces, text, base in segments(got["text"]):
                out, (own, start, end) = stretches(pieces, ids[text], keys[text], base, n, hot)
                yield rows_of([k for k, _ in out], [b"s" + p for _, p in out])
                if len(own):
                    direct = packed_spans(ids[text[own]], keys[text[own]], start, end, n)
                    yield rows_of(direct.column(0).to_pylist(), [b"d" + p for p in direct.column(1).to_pylist()])

    text = utf8("text")
    return docs.select(by_id().alias("doc_id"), F.hash(text).alias("key"), text.alias("text")).mapInArrow(of_texts, PACKED)


def matched(rows: DataFrame, n: int) -> DataFrame:
    """id, key, spans of each new document that has repeated bytes: its maximal removed runs, packed. The key tells rows of one id apart.

    ``rows``: what ``shipped`` gives, and rows of an index, marked with an o for old.
    """

    def of_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for cell, payloads in by_cell(batches):
            done = [p[1:] for p in payloads if p[:1] == b"d"]
            yield rows_of([cell] * len(done), done)
            inner: dict[int, list[tuple]] = {}
            for payload in payloads:
                if payload[:1] != b"d":
                    for k, each in opened(payload[1:]):
                        inner.setdefault(k, []).append((*each, payload[:1] == b"o"))
            while inner:
                own = inner.popitem()[1]
                held += [] if all(p[7] for p in own) else [f for f in repeated(own) if len(f[0])]
                if sum(len(f[0]) for f in held) > SPANS_HELD:
                    yield packed_spans(*(np.concatenate([f[k] for f in held]) for k in range(4)), n)
                    held = []
        if held:
            yield packed_spans(*(np.concatenate([f[k] for f in held]) for k in range(4)), n)
        give_back()

    return gathered(shuffled(rows, n).mapInArrow(of_stretches, PACKED), n, united_spans, "id long, key int, spans binary")


class Index:
    """Levels of stretches below a folder that driver and executors share, for batches of documents that come one after the other.

    Documents of an earlier batch count as smaller than all of a later one. Batches of rank 0 merge to one of rank 1 and
    so on, so a stretch is written again as often as the logarithm of the number of batches. The number of partitions is
    that of the first batch. A batch whose add failed leaves no level and can be added again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def levels(self) -> list[tuple[int, int, int, str]]:
        """(rank, serial number, partitions, name) of each level, those of the highest rank first."""
        if not self.fs.exists(self.path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]
        return sorted(((*map(int, name.split("-")[1:]), name) for name in names if name.startswith("level-")), key=lambda x: (-x[0], x[1]))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(PACKED).parquet(f"{self.folder}/{name}")

    def add(self, docs: DataFrame) -> DataFrame:
        """The spans of ``docs`` as ``matched`` gives them, and the stretches as a level."""
        own = self.levels()
        n = own[0][2] if own else parts(self.spark)
        serial = max((x[1] for x in own), default=-1) + 1
        batch = f"batch-{serial}"
        shipped(docs, n).write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        rows = self.table(batch)
        for _, _, _, name in own:
            rows = rows.union(self.table(name).select("cell", F.concat(F.lit(b"o"), F.expr("substring(payload, 2)")).alias("payload")))
        found = written(matched(rows, n))
        is_text = F.expr("substring(payload, 1, 1)") == F.lit(b"s")
        self.put(self.table(batch).where(is_text), 0, serial, n)
        self.fs.delete(self.path(batch), True)
        self.merge()
        return found

    def put(self, rows: DataFrame, rank: int, serial: int, n: int) -> None:
        """Written aside and then renamed, so that a level is there as a whole or not at all."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/new-{rank}-{serial}")
        self.fs.rename(self.path(f"new-{rank}-{serial}"), self.path(f"level-{rank}-{serial}-{n}"))

    def merge(self) -> None:
        while True:
            own = self.levels()
            pair = next(((a, b) for a, b in zip(own, own[1:], strict=False) if a[0] == b[0]), None)
            if pair is None:
                return
            a, b = pair
            self.put(self.table(a[3]).union(self.table(b[3])), a[0] + 1, b[1], a[2])
            for level in pair:
                self.fs.delete(self.path(level[3]), True)


def without_repeats(docs: DataFrame, text_too: bool = False, index: Index | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs``, and ``kept_text`` (binary) if asked for.

    ``docs``: doc_id, text; other columns don't matter. Texts are UTF-8 bytes, a null text the empty one. Each byte
    goes that a string of 50 bytes covers which also starts in a document with a smaller doc_id; strings are
    judged on the input. A null doc_id comes after all others. Rows that repeat a doc_id don't repeat each
    other. An empty table gives no rows.

    With an ``index`` all documents of batches added to it before count as smaller, and these are added.
    """
    n = parts(docs.sparkSession)
    found = index.add(docs) if index else written(matched(shipped(docs, n), n))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, own in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                starts, ends = np.frombuffer(own or b"", np.int64).reshape(2, -1)
                kept = b"".join([text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)])
                rows.append((doc, len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            n = 6 if text_too else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols[:n], kinds[:n], strict=True)], names=names[:n])

    text = utf8("text")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), by_id().alias("id"), F.hash(text).alias("key"))
    both = keyed.join(bounded(found), ["id", "key"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * text_too)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
