"""Deduplication of long runs of words by relative Lempel-Ziv parsing.

A window is 20 successive words; its anchor is the run of 8 words in it with the least hash. Neighbouring windows of one
anchor are a stretch. Equal windows have equal anchors, so

1. anchors are counted, combined within a task first, and each document is told which of its stretches have an anchor that is
   elsewhere too: of a text of its own nothing more is moved than a hash for every seven words or so;
2. only these stretches are shipped, words and all, to the cell of their anchor. There the stretches in the order of
   their documents are cut into reference blocks, each indexed by windows, and every stretch is parsed greedily from
   left to right: a word that begins no window of any block up to its own is a literal, else the longest of the
   matches at the blocks' first such windows is a factor, and parsing goes on behind it. Factors are 20 words or longer. The windows that begin in a
   factor and end behind it are looked up on their own;
3. factors and such windows are the spans that go, united by document.

A match counts if it begins earlier: in a smaller document, or earlier in the same one. The anchors that are met most often
have no cell of their own: each of their windows is a stretch, dealt by its own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.blobs import PACKED, SUBS, by_cell, dealt, gathered, packed, rows_of, shuffled, unpacked
from tessera.llm.common import HASHES, documents, give_back, is_bounded, looked_up, mixed, parts, slices, split_words, utf8, written
from tessera.llm.suffix_dedup import Hot, anchors, by_id, narrow, packed_spans, prints, ranges, sums_of, united_spans

SIZE, ANCHOR = 20, 8
#: Bytes of text that are worked on at once, words of them; words of a reference block; parts of a cell.
CHUNK, PIECE, BLOCK, INNER = 4 << 20, 1 << 20, 1 << 18, 4
#: Anchors that a task combines before it ships their counts; spans that it holds before it packs them.
SEEN, SPANS_HELD = 200_000, 500_000
#: An anchor met in so many stretches is hot, and at most so many are: of the others none is met in more than their all, divided by that.
OFTEN, MOST_HOT = 4096, 1 << 17
MARKS = "id long, key int, marks binary, hot long, n long"


def runs_of_words(hashes: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR words from each position on."""
    h, span = hashes, 1
    while span < ANCHOR:
        h = mixed(h[:-span] * np.uint64(0x9E3779B97F4A7C15) + h[span:])
        span *= 2
    return h


def stretches(begins: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document's number, number there, first word, words, anchor's hash, whether windows in it can be equal) of each stretch.

    A long document is cut into pieces that overlap by 19 words, so that each window is in just one.
    """
    windows = np.maximum(np.diff(begins) - SIZE + 1, 0)
    out = []
    pieces = [(b + at, min(PIECE, n - at), k) for k in np.flatnonzero(windows > PIECE) for b, n in [(begins[k], windows[k])] for at in range(0, n, PIECE)]
    short = np.flatnonzero((windows > 0) & (windows <= PIECE))
    groups = [(begins[short], windows[short], short)] * bool(len(short)) + [tuple(np.array([x]) for x in p) for p in pieces]
    for start, n, doc in groups:
        at = ranges(start, n)
        base = int(at[0])
        runs = runs_of_words(hashes[base : at[-1] + SIZE])
        where = anchors(runs, SIZE - ANCHOR + 1)[at - base]
        anchor, own = runs[where], np.repeat(doc, n)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])]))
        count = np.diff(np.append(new, len(at)))
        inside = np.logical_or.reduceat(where != np.repeat(where[new], count), new)
        out.append((own[new], at[new], count + SIZE - 1, anchor[new], inside))
    if not out:
        return tuple(np.empty(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, bool))
    own, first, size, anchor, inside = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((first, own))
    own, first, size, anchor, inside = own[order], first[order], size[order], anchor[order], inside[order]
    lead = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    number = np.arange(len(own)) - np.repeat(lead, np.diff(np.append(lead, len(own))))
    return own, number, first, size, anchor, inside


class Seen:
    """Anchors that a task knows to be elsewhere too, each with the stretches that it met since they were last shipped."""

    def __init__(self):
        self.hashes, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[k] == hashes

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, back = np.unique(np.concatenate([self.hashes, hashes]), return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, counts])).astype(np.int64)

    def shipped(self, cells: int) -> pa.RecordBatch:
        own = [(k, b"m" + packed(self.hashes[at], self.counts[at])) for k, at in dealt(mixed(self.hashes) % np.uint64(cells), cells)]
        self.__init__()
        return rows_of([k for k, _ in own], [p for _, p in own])


def marked(ids: np.ndarray, keys: np.ndarray, numbers: np.ndarray, n: int, kind: bytes) -> pa.RecordBatch:
    """Stretches, by number, that have an anchor which is elsewhere too, packed for their documents' cells."""
    own = [(k * SUBS, kind + packed(ids[at], keys[at], numbers[at])) for k, at in dealt(mixed(ids.view(np.uint64)) % np.uint64(n), n)]
    return rows_of([k for k, _ in own], [p for _, p in own])


def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(piece of the input, ids, keys, where each text's words begin, each word's number, the words, each word's hash)."""
    for piece in slices(batches, 2, CHUNK):
        begins, word, words = split_words(piece.column(2))
        hashes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
        yield piece, piece.column(0).to_numpy(), piece.column(1).to_numpy(), begins, word, words, hashes[word]


def shared_anchors(rows: DataFrame, n: int) -> DataFrame:
    """Two kinds of rows: id, key and the numbers of a document's stretches whose anchor is elsewhere too; hot and n, an anchor met n times, OFTEN or more."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for _, ids, keys, begins, _, _, hashes in worded(batches):
            own, number, _, _, anchor, inside = stretches(begins, hashes)
            distinct, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
            many = (count > 1) | (np.bincount(back, inside, len(distinct)) > 0) | seen.has(distinct)
            seen.add(distinct[many], count[many])
            at = np.flatnonzero(many[back])
            if len(at):
                yield marked(ids[own[at]], keys[own[at]], number[at], n, b"d")
            at = np.flatnonzero(~many[back])
            docs, short = np.unique(own[at], return_inverse=True)
            out = []
            for cell, some in dealt(mixed(anchor[at]) % np.uint64(n * SUBS), n * SUBS):
                mine, told = np.unique(short[some], return_inverse=True)
                out.append((cell, b"s" + packed(ids[docs[mine]], keys[docs[mine]], narrow(told), narrow(number[at[some]]), anchor[at[some]])))
            yield rows_of([k for k, _ in out], [p for _, p in out])
            if len(seen.hashes) > SEEN:
                yield seen.shipped(n * SUBS)
        yield seen.shipped(n * SUBS)

    def of_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, payloads in by_cell(batches):
            done = [p[1:] for p in payloads if p[:1] == b"d"]
            yield rows_of([cell] * len(done), [b"d" + p for p in done])
            singles = [unpacked(p[1:]) for p in payloads if p[:1] == b"s"]
            many = [unpacked(p[1:]) for p in payloads if p[:1] == b"m"]
            hashes = np.concatenate([*(s[4] for s in singles), *(m[0] for m in many), np.empty(0, np.uint64)])
            alone = sum(len(s[4]) for s in singles)
            counts = np.concatenate([np.ones(alone, np.int64), *(m[1] for m in many)])
            distinct, back, records = np.unique(hashes, return_inverse=True, return_counts=True)
            total = np.bincount(back, counts, len(distinct)).astype(np.int64)
            again = ((records > 1) | (np.bincount(back[alone:], minlength=len(distinct)) > 0))[back[:alone]]
            if again.any():
                ids, keys, numbers = (np.concatenate(x) for x in ([s[0][s[2]] for s in singles], [s[1][s[2]] for s in singles], [s[3].astype(np.int64) for s in singles]))
                yield marked(ids[again], keys[again], numbers[again], n, b"d")
            hot = np.flatnonzero(total >= OFTEN)
            if len(hot):
                yield rows_of([cell], [b"h" + packed(distinct[hot], total[hot])])
        give_back()

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in by_cell(batches):
            own = [unpacked(p[1:]) for p in payloads if p[:1] == b"d"]
            hot = [unpacked(p[1:]) for p in payloads if p[:1] == b"h"]
            anchor, total = (np.concatenate([*(h[k] for h in hot), np.empty(0, kind)]) for k, kind in enumerate((np.uint64, np.int64)))
            ids, keys, numbers = (np.concatenate([*(o[k] for o in own), np.empty(0, kind)]) for k, kind in enumerate((np.int64, np.int32, np.int64)))
            order = np.lexsort((numbers, keys, ids))
            ids, keys, numbers = ids[order], keys[order], numbers[order]
            heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])])[: len(ids)])
            marks = [zstandard.compress(x.astype("<u4").tobytes(), 1) for x in np.split(numbers, heads[1:])] if len(heads) else []
            none = [None] * len(hot and anchor)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*ids[heads].tolist(), *none], pa.int64()), pa.array([*keys[heads].tolist(), *none], pa.int32()), pa.array([*marks, *none], pa.binary()), pa.array([None] * len(heads) + anchor.view(np.int64).tolist(), pa.int64()), pa.array([None] * len(heads) + total.tolist(), pa.int64())],
                names=["id", "key", "marks", "hot", "n"],
            )

    told = shuffled(rows.mapInArrow(of_texts, PACKED), n).mapInArrow(of_anchors, PACKED)
    return written(shuffled(told, n).mapInArrow(of_documents, MARKS))


def shipped(rows: DataFrame, hot: np.ndarray, n: int) -> DataFrame:
    """Packed stretches by cell, and the spans that are known to repeat at once. ``rows``: id, key, text, marks; ``hot``: hashes of anchors, sorted.

    Of equal stretches that a task has seen only those of the smallest document are shipped, at their first place in it;
    the others repeat it as a whole.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Hot()
        for piece, ids, keys, begins, word, words, hashes in worded(batches):
            own, number, first, size, anchor, _ = stretches(begins, hashes)
            lead = np.searchsorted(own, np.arange(len(ids)))
            chosen = np.zeros(len(own), bool)
            for doc, marks in enumerate(piece.column(3).to_pylist()):
                chosen[lead[doc] + np.frombuffer(zstandard.decompress(marks), "<u4")] = True
            own, first, size, anchor = own[chosen], first[chosen], size[chosen], anchor[chosen]
            sums = sums_of(hashes)
            if len(hot) and len(own):  # a stretch for each window of a hot anchor
                is_hot = hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor
                n_windows = (size - SIZE + 1)[is_hot]
                at = ranges(first[is_hot], n_windows)
                own, anchor = np.concatenate([own[~is_hot], np.repeat(own[is_hot], n_windows)]), np.concatenate([anchor[~is_hot], mixed(prints(sums, at, SIZE))])
                first, size = np.concatenate([first[~is_hot], at]), np.concatenate([size[~is_hot], np.full(len(at), SIZE)])
            if not len(own):
                continue
            where = first - begins[own]
            mark = prints(sums, first, size) ^ mixed(size.astype(np.uint64)) ^ anchor
            order = np.lexsort((where, keys[own], ids[own], mark))
            own, first, size, anchor, where, mark = own[order], first[order], size[order], anchor[order], where[order], mark[order]
            id_, key = ids[own], keys[own]
            head = np.concatenate([[True], mark[1:] != mark[:-1]])
            mine = head | np.concatenate([[True], (id_[1:] != id_[:-1]) | (key[1:] != key[:-1])])
            group, place = np.cumsum(head) - 1, np.flatnonzero(mine)[np.cumsum(mine) - 1]
            least = np.minimum(id_[head], met.least(mark[head]))
            again = (id_ > least[group]) | (where > where[place])
            met.add(mark[head], least)
            if again.any():
                spans = packed_spans(id_[again], key[again], where[again], (where + size)[again], n)
                yield rows_of(spans.column(0).to_pylist(), [b"d" + p for p in spans.column(1).to_pylist()])
            keep = np.flatnonzero(~again)
            part = (mixed(anchor[keep]) % np.uint64(n * SUBS * INNER)).astype(np.int64)
            out = []
            for cell, some in dealt(part // INNER, n * SUBS):
                some = some[np.argsort(part[some], kind="stable")]
                at = keep[some]
                inner = np.bincount(part[some] % INNER, minlength=INNER)
                docs, short = np.unique(own[at], return_inverse=True)
                text = b" ".join(map(words.__getitem__, word[ranges(first[at], size[at])].tolist()))
                out.append((cell, b"s" + packed(ids[docs], keys[docs], inner, narrow(short), narrow(size[at]), narrow(where[at]), text)))
            yield rows_of([k for k, _ in out], [p for _, p in out])

    return rows.mapInArrow(of, PACKED)


class Reference:
    """Some successive stretches, indexed by the windows in them: each one's first place."""

    def __init__(self, windows: np.ndarray, marks: np.ndarray):
        order = np.argsort(marks, kind="stable")
        head = np.concatenate([[True], marks[order][1:] != marks[order][:-1]])[: len(order)]
        self.marks, self.places = marks[order][head], windows[order][head]

    def first(self, marks: np.ndarray) -> np.ndarray:
        """The first place of each window, or -1."""
        k = np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)
        return np.where(self.marks[k] == marks, self.places[k], -1)


class Parser:
    """Stretches in the order of their documents, with reference blocks of them."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, size: np.ndarray, where: np.ndarray, word: np.ndarray):
        order = np.lexsort((where, keys, ids))
        first = (np.cumsum(size) - size)[order]
        self.ids, self.keys, self.size, self.where = ids[order], keys[order], size[order], where[order]
        self.word = word[ranges(first, self.size)]
        self.start = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(order)), self.size)
        self.end = self.start + self.size
        self.sums = sums_of(mixed(self.word.astype(np.uint64) + np.uint64(1)))
        windows = ranges(self.start, self.size - SIZE + 1)
        marks = prints(self.sums, windows, SIZE)
        edges = np.flatnonzero(np.diff(self.start[self.owner[windows]] // BLOCK)) + 1
        self.blocks = [Reference(*b) for b in zip(np.split(windows, edges), np.split(marks, edges), strict=True)]
        same = np.concatenate([[False], (self.ids[1:] == self.ids[:-1]) & (self.keys[1:] == self.keys[:-1])])
        self.document = np.cumsum(~same)
        # Only where rows of one id differ can a window's first place be in a document that is neither smaller nor the same.
        twins = np.zeros(len(order), bool)
        twins[1:] = (self.ids[1:] == self.ids[:-1]) & ~same[1:]
        twins = np.isin(self.ids, self.ids[twins])[self.owner[windows]]
        self.own = Reference(windows[twins], self.marked(windows[twins])) if twins.any() else None

    def marked(self, at: np.ndarray) -> np.ndarray:
        """A hash of the window and its document."""
        return prints(self.sums, at, SIZE) ^ mixed(self.document[self.owner[at]].astype(np.uint64))

    def earlier(self, source: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the source is a place, begins earlier than the window, and has the same words."""
        a, b = self.owner[source], self.owner[at]
        place, own = self.where[a] + source - self.start[a], self.where[b] + at - self.start[b]
        out = (source >= 0) & ((self.ids[a] < self.ids[b]) | ((self.document[a] == self.document[b]) & (place < own)))
        near = np.flatnonzero(out)
        for k in range(SIZE):
            near = near[self.word[source[near] + k] == self.word[at[near] + k]]
        out[:] = False
        out[near] = True
        return out

    def matched(self, source: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many words agree from both places on, within their stretches; SIZE or more do."""
        low, high = np.full(len(at), SIZE), np.minimum(self.end[self.owner[source]] - source, self.end[self.owner[at]] - at)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = prints(self.sums, source, mid) == prints(self.sums, at, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def factors(self, at: np.ndarray) -> np.ndarray:
        """The length of the longest match of each place at the blocks' first places of its window, or 0."""
        out = np.zeros(len(at), np.int64)
        marks = prints(self.sums, at, SIZE)
        sources = [b.first(marks) for b in self.blocks] + ([self.own.first(self.marked(at))] if self.own else [])
        for source in sources:
            hit = np.flatnonzero(self.earlier(source, at))
            out[hit] = np.maximum(out[hit], self.matched(source[hit], at[hit]))
        return out

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, keys, starts, ends) of what a match covers: all stretches are parsed side by side, a factor or literal at a time."""
        at, last = self.start.copy(), self.end - SIZE
        active = np.arange(len(at))
        places, lengths = [], []
        while len(active):
            length = self.factors(at[active])
            hit = length > 0
            places.append(at[active][hit])
            lengths.append(length[hit])
            at[active] += np.maximum(length, 1)
            active = active[at[active] <= last[active]]
        place, length = np.concatenate(places), np.concatenate(lengths)
        behind = place + length
        begin = np.maximum(place + 1, behind - SIZE + 1)
        crossing = ranges(begin, np.maximum(np.minimum(behind - 1, last[self.owner[place]]) - begin + 1, 0))
        crossing = crossing[self.factors(crossing) > 0]
        place, length = np.concatenate([place, crossing]), np.concatenate([length, np.full(len(crossing), SIZE)])
        own = self.owner[place]
        start = self.where[own] + place - self.start[own]
        return self.ids[own], self.keys[own], start, start + length


def parsed(rows: DataFrame, n: int) -> DataFrame:
    """id, key, spans of each document with repeated words; ``rows``: what ``shipped`` gives."""

    def of_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for cell, payloads in by_cell(batches):
            done = [p[1:] for p in payloads if p[:1] == b"d"]
            yield rows_of([cell] * len(done), done)
            inner: dict[int, list[tuple]] = {}
            for payload in payloads:
                if payload[:1] == b"s":
                    ids, keys, count, number, size, where, text = unpacked(payload[1:])
                    records, edges = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(size, dtype=np.int64))
                    begins, word, words = split_words(pa.array([text], pa.binary()))
                    for k in np.flatnonzero(count):
                        a, b = records[k], records[k + 1]
                        inner.setdefault(int(k), []).append((ids[number[a:b]], keys[number[a:b]], size[a:b].astype(np.int64), where[a:b].astype(np.int64), word[edges[a] : edges[b]], words))
            while inner:
                own = inner.popitem()[1]
                known: dict[bytes, int] = {}
                word = np.concatenate([np.array([known.setdefault(w, len(known)) for w in p[5]], np.int64)[p[4]] for p in own])
                held.append(Parser(*(np.concatenate([p[k] for p in own]) for k in range(4)), word).spans())
                if sum(len(h[0]) for h in held) > SPANS_HELD:
                    yield packed_spans(*(np.concatenate([h[k] for h in held]) for k in range(4)), n)
                    held = []
        if held:
            yield packed_spans(*(np.concatenate([h[k] for h in held]) for k in range(4)), n)
        give_back()

    return gathered(shuffled(rows, n).mapInArrow(of_stretches, PACKED), n, united_spans, "id long, key int, spans binary")


def without_copies(docs: DataFrame, text_too: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs``, and ``kept_text`` (binary) if asked for: the kept words joined by a space.

    ``docs``: doc_id, text; other columns don't matter. A word goes if a window of 20 words covers it that also begins
    earlier, in a document with a smaller doc_id or earlier in the same one; windows are judged on the input. A null
    or blank text has no words. A null doc_id comes after all others. Rows that repeat a doc_id don't repeat each other.
    An empty table gives no rows.
    """
    n = parts(docs.sparkSession)
    text = utf8("text")
    rows = docs.select(by_id().alias("id"), F.hash(text).alias("key"), text.alias("text"))
    told = shared_anchors(rows, n)
    often = told.where(F.col("hot").isNotNull()).orderBy(F.desc("n"), "hot").limit(MOST_HOT).select("hot").collect()
    hot = np.sort(np.array([r["hot"] for r in often], np.int64).view(np.uint64))
    marks = told.where(F.col("id").isNotNull()).select("id", "key", "marks")
    both = rows.join(F.broadcast(marks) if is_bounded(marks) else marks, ["id", "key"]).select("id", "key", "text", "marks")
    found = written(parsed(shipped(both, hot, n), n))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = text.split()
                starts, ends = np.frombuffer(spans or b"", np.int64).reshape(2, -1).tolist()
                kept = [w for a, b in zip([0, *ends], [*starts, len(words)], strict=True) for w in words[a:b]] if starts else words
                whole = b" ".join(kept)
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = dict(doc_id=pa.int64(), n_words=pa.int64(), n_removed=pa.int64(), kept_sha256=pa.string(), kept_text=pa.binary())
            names = list(kinds)[: 5 if text_too else 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(cols, names, strict=False)], names=names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), by_id().alias("id"), F.hash(text).alias("key"))
    return looked_up(keyed, found, ["id", "key"]).select("doc_id", "text", "spans").mapInArrow(of, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * text_too)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_copies(documents(spark, sf_dir))


_WINDOWS = r"""
words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS x FROM words, LATERAL (SELECT unnest(range(0, len(w) - 19)) AS s)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later)"""
#: Over tables whose doc_ids don't repeat.
ORACLE = f"""
WITH {_WINDOWS},
each AS (SELECT w.doc_id, w.i, w.word, g.i IS NULL AS kept FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM words) w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i),
sums AS (SELECT doc_id, count(*) - count(*) FILTER (kept) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (kept) AS text FROM each GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, CAST(coalesce(s.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.text, '')) AS kept_sha256
FROM words w LEFT JOIN sums s ON w.doc_id = s.doc_id"""
