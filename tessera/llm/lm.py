"""Scores texts with an n-gram model whose orders are mixed by deleted interpolation.

The model is over words and an end of text; V is the number of distinct ones in the training documents, N of all:

    P(w | v) = l2[b] * c(v, w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1),    b: the bucket of c(v)

The weights l of each bucket are learned by expectation-maximisation on the counts of held-out training documents,
against relative frequencies from the other training documents; then all of these are counted.

All words and pairs are counted, whatever the corpus's size. The counts are had in two ways that give the same numbers:
words that a table of bounded size holds are looked up where a text is read, and pairs of two of them meet in packed
rows; a pair with another word is a row of its own, and windows over that word and over the pair count both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.blobs import PACKED, SUBS, by_cell, dealt, gathered, packed, rows_of, shuffled, unpacked
from tessera.llm.common import documents, id_remainder, looked_up, mixed, parts, slices, split_words, stable, written

#: Bounds of the broadcast tables: words, and pairs frequent enough to be scored where the text is read.
VOCABULARY, FREQUENT_PAIRS = 1 << 18, 1 << 18
#: Remainder of crc32(doc_id) by 7 of the documents that aren't learned from, and of those that the weights are learned on.
FOLDS, HELD_OUT, WEIGHED = 7, 2, 3
CHUNK = 5 << 20
#: Bins of words' counts for each doubling.
STEPS = 8
#: Width of the bins, in log10, in which EM sees relative frequencies; one more bin is for zero.
BIN, ZERO = 0.05, -9999
DOC_BITS = 22
#: Sums by row that a task holds before it adds up those of one row.
SUMS = 2_000_000
#: Stand for the end of a text and for its start, where words are hashes.
END, START = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
#: Weights of a bucket without counts.
DEFAULT = np.array([0.1, 0.7, 0.2])
TINY = 1e-300
#: A pair with a word outside the table, in one document: the words' counts where the table has them.
OUTSIDE = "row long, fold int, v long, w long, a_v long, n_v long, a_w long, n_w long, n long"


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the whole part of the binary logarithm of its count."""
    return np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(other columns, where each text's words begin, each word's number, the distinct words' hashes) of pieces of the input."""
    for piece in slices(batches, -1, CHUNK):
        for at in range(0, piece.num_rows, (1 << DOC_BITS) - 1):
            own = piece.slice(at, (1 << DOC_BITS) - 1)
            begins, ids, words = split_words(pc.ascii_lower(own.column(own.num_columns - 1)))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            yield {n: own.column(k).to_numpy(zero_copy_only=False) for k, n in enumerate(own.schema.names[:-1])}, begins, ids, hashes


def counted(docs: DataFrame) -> DataFrame:
    """hash, a, b: how often each word is in the training documents, without and in those that the weights are learned on."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, begins, ids, hashes in texts_of(batches):
            fold = np.repeat(cols["fold"], np.diff(begins))
            a, b = (np.bincount(ids[m], minlength=len(hashes)) for m in ((fold != HELD_OUT) & (fold != WEIGHED), fold == WEIGHED))
            seen = np.flatnonzero(a + b)
            yield pa.RecordBatch.from_arrays([pa.array(x[seen], pa.int64()) for x in (hashes.view(np.int64), a, b)], names=["hash", "a", "b"])

    return docs.mapInArrow(of_texts, "hash long, a long, b long").groupBy("hash").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def least_bin(words: DataFrame, most: int) -> int:
    """The least bin of counts, of 2 or more, from which on there are at most ``most`` words. The driver gets a row a bin."""
    held, out = 0, 1 << 30
    for r in sorted(words.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        held += r["count"]
        if held > most or r["bin"] < STEPS:
            break
        out = r["bin"]
    return out


class Model:
    """Counts of the words in the table, by hash, and of the end and the start; the whole's sums; the weights."""

    def __init__(self, hashes: np.ndarray, a: np.ndarray, b: np.ndarray, sums: tuple[int, int], types: int, docs: tuple[int, int]):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.end, self.start, self.outside = range(len(hashes), len(hashes) + 3)
        self.classes = len(hashes) + 2
        self.a = np.concatenate([a[order], [docs[0]] * 2]).astype(float)
        self.all = self.a + np.concatenate([b[order], [docs[1]] * 2])
        self.n_a, self.n = float(sums[0] + docs[0]), float(sum(sums) + sum(docs))
        self.types = types + bool(sum(docs))
        self.base = np.log10((self.all + 1) / (self.n + self.types + 1))
        self.weights = np.tile(DEFAULT, (64, 1))

    def classed(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the table, or ``outside``."""
        if not len(self.hashes):
            return np.full(len(hashes), self.outside)
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[k] == hashes, k, self.outside)

    def tokens(self, begins: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document's number, place of the token, place of the token before, their numbers among the distinct words) of each token, ends of text included."""
        n = np.diff(begins)
        doc = np.repeat(np.arange(len(n)), n + 1)
        words = np.ones(len(doc), bool)
        words[begins[1:] + np.arange(len(n))] = False
        # The end and the start stand after the distinct words.
        places, word = np.append(self.classed(hashes), [self.end, self.start]), np.full(len(doc), len(hashes), np.int64)
        word[words] = ids
        before = np.empty(len(doc), np.int64)
        before[1:] = word[:-1]
        before[begins[:-1] + np.arange(len(n))] = len(hashes) + 1
        return doc, places[word], places[before], word, before

    def pair(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        return before.astype(np.uint64) * np.uint64(self.classes) + now.astype(np.uint64)

    def parts_of(self, pair: np.ndarray, count: np.ndarray, context: np.ndarray, unigram: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, relative frequency after the context, relative frequency) of pairs."""
        v, w = (pair // np.uint64(self.classes)).astype(np.int64), (pair % np.uint64(self.classes)).astype(np.int64)
        c = context[v]
        return bucket(c), count / np.maximum(c, 1), unigram[w] / max(n, 1)

    def log_prob(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        b, p2, p1 = self.parts_of(pair, count, self.all, self.all, self.n)
        own = self.weights[b]
        return np.log10(np.maximum(own[:, 0] * p2 + own[:, 1] * p1 + own[:, 2] / (self.types + 1), TINY))


def expectation_maximisation(n: np.ndarray, p: np.ndarray, rounds: int = 100, least: float = 1e-7) -> np.ndarray:
    """The weights of the columns of ``p`` under which ``n`` counts are likeliest."""
    weights = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = p * weights
        new = (n[:, None] * share / np.maximum(share.sum(axis=1, keepdims=True), TINY)).sum(axis=0) / n.sum()
        if np.abs(new - weights).max() < least:
            return new
        weights = new
    return weights


def binned(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(np.log10(np.maximum(p, TINY)) / BIN), ZERO).astype(np.int64)


def pair_counts(docs: DataFrame, model, most: int, n: int) -> DataFrame:
    """kind, x, y, z, n of pairs in the table: of kind 0 how many held-out tokens are in each bin for EM, of kind 1 the ``most`` most frequent pairs of each cell and their counts."""

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for cols, begins, ids, hashes in texts_of(batches):
            doc, now, before, *_ = m.tokens(begins, ids, hashes)
            fold = cols["fold"][doc]
            use = (fold != HELD_OUT) & (now != m.outside) & (before != m.outside)
            # The last bit says whether the weights are learned on it.
            seen, count = np.unique(m.pair(before[use], now[use]) << np.uint64(1) | (fold[use] == WEIGHED), return_counts=True)
            out = [(k, packed(np.diff(seen[at], prepend=np.uint64(0)), count[at].astype(np.uint32))) for k, at in dealt(mixed(seen >> np.uint64(1)) % np.uint64(n * SUBS), n * SUBS)]
            yield rows_of([k for k, _ in out], [p for _, p in out])

    def of_pairs(payloads: list[tuple]) -> Iterator[pa.RecordBatch]:
        m = model.value
        seen = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in payloads])
        count = np.concatenate([p[1] for p in payloads]).astype(np.int64)
        pair, back = np.unique(seen >> np.uint64(1), return_inverse=True)
        held = (seen & np.uint64(1)).astype(bool)
        a, b = (np.bincount(back[s], count[s], minlength=len(pair)) for s in (~held, held))
        many = np.flatnonzero(a + b >= 2)
        if len(many) > most:
            many = many[np.argpartition(-(a + b)[many], most - 1)[:most]]
        use = np.flatnonzero(b)
        where, p2, p1 = m.parts_of(pair[use], a[use], m.a, m.a, m.n_a)
        keys, at = np.unique(np.stack([where, binned(p2), binned(p1)]), axis=1, return_inverse=True)
        sums = np.bincount(at.reshape(-1), b[use], minlength=keys.shape[1]).astype(np.int64)
        kind = np.repeat([0, 1], [keys.shape[1], len(many)])
        zero = np.zeros(len(many), np.int64)
        cols = [kind, *(np.concatenate(c) for c in zip(keys, (pair[many].astype(np.int64), zero, zero), strict=True)), np.concatenate([sums, (a + b)[many].astype(np.int64)])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "x", "y", "z", "n"])

    return gathered(docs.mapInArrow(of_texts, PACKED), n, of_pairs, "kind long, x long, y long, z long, n long")


def outside_pairs(docs: DataFrame, model) -> DataFrame:
    """row, fold, n, the counts a (without the documents that the weights are learned on) and n of v, w and the pair, and w_out, for each pair of OUTSIDE.

    No word outside the table is frequent, so windows over it are short. A pair whose w is outside is counted at w, which is
    also where c(w) is; then pairs whose v is outside are counted at v, which sees every token after it.
    """

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        names = [c.split()[0] for c in OUTSIDE.split(", ")]
        for cols, begins, ids, hashes in texts_of(batches):
            doc, now, before, word, last = m.tokens(begins, ids, hashes)
            use = np.flatnonzero((now == m.outside) | (before == m.outside))
            # Of a document's equal pairs one row is left.
            pairs, own = np.unique(last[use] * (len(hashes) + 2) + word[use], return_inverse=True)
            _, first, count = np.unique(doc[use] * len(pairs) + own, return_index=True, return_counts=True)
            at = use[first]
            said = np.append(hashes, np.array([END, START], np.uint64)).view(np.int64)
            known = [(now[at] == m.outside, now[at]), (before[at] == m.outside, before[at])]
            (a_w, n_w), (a_v, n_v) = ([pa.array(c[np.where(out, 0, k)].astype(np.int64), pa.int64(), mask=out) for c in (m.a, m.all)] for out, k in known)
            own = [pa.array(cols["row"][doc[at]], pa.int64()), pa.array(cols["fold"][doc[at]], pa.int32()), pa.array(said[last[at]]), pa.array(said[word[at]]), a_v, n_v, a_w, n_w, pa.array(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(own, names=names)

    def sums(df: DataFrame, key: str, other: str) -> DataFrame:
        """``df`` with the counts of the word ``key`` and of the pair, over one partitioning by the word."""
        count = lambda over, *folds: F.sum(F.when(F.col("fold").isin(*folds), 0).otherwise(F.col("n"))).over(over)
        pair, word = Window.partitionBy(key, other), Window.partitionBy(key)
        own = df.repartition(key).withColumns({"a_vw": count(pair, HELD_OUT, WEIGHED), "n_vw": count(pair, HELD_OUT)})
        return own.withColumns({f"a_{key}": count(word, HELD_OUT, WEIGHED), f"n_{key}": count(word, HELD_OUT)})

    both = written(docs.mapInArrow(of_texts, OUTSIDE))
    at_w = sums(both.where("n_w IS NULL"), "w", "v").withColumn("w_out", F.lit(True))
    later = both.where("n_w IS NOT NULL").withColumns({"a_vw": F.lit(None).cast("long"), "n_vw": F.lit(None).cast("long"), "w_out": F.lit(False)})
    at_v = sums(at_w.where("n_v IS NULL").unionByName(later), "v", "w")
    return written(at_w.where("n_v IS NOT NULL").unionByName(at_v).drop("v", "w"))


def sql_bucket(count: Column) -> Column:
    """As ``bucket``: the number of the count's binary digits."""
    return F.when(count > 0, F.length(F.bin(count))).otherwise(0).cast("long")


def outside_bins(pairs: DataFrame, n_a: float) -> DataFrame:
    """x, y, z, n: how many held-out tokens are in each bin for EM."""
    bin_of = lambda p: F.when(p > 0, F.rint(F.log10(p) / BIN)).otherwise(ZERO).cast("long")
    return pairs.where(F.col("fold") == WEIGHED).groupBy(sql_bucket(F.col("a_v")).alias("x"), bin_of(F.col("a_vw") / F.greatest("a_v", F.lit(1))).alias("y"), bin_of(F.col("a_w") / F.lit(max(n_a, 1.0))).alias("z")).agg(F.sum("n").alias("n"))


def outside_scores(pairs: DataFrame, model: Model) -> DataFrame:
    """row and the sums of its pairs with words outside the table: score, base score, known tokens."""
    weights = F.array(*(F.array(*map(F.lit, own)) for own in model.weights.tolist()))
    own = F.element_at(weights, (sql_bucket(F.col("n_v")) + 1).cast("int"))
    p = own[0] * F.col("n_vw") / F.greatest("n_v", F.lit(1)) + own[1] * F.col("n_w") / F.lit(max(model.n, 1.0)) + own[2] / F.lit(model.types + 1.0)
    base = F.log10((F.col("n_w") + 1) / F.lit(model.n + model.types + 1))
    n, out = F.col("n"), F.col("w_out")
    return pairs.groupBy("row").agg(F.sum(n * F.log10(F.greatest(p, F.lit(TINY)))).alias("score"), F.sum(F.when(out, n * base).otherwise(0.0)).alias("base"), F.sum(F.when(out & (F.col("n_w") > 0), n).otherwise(0)).alias("known"))


def learned_weights(model: Model, bins: list) -> np.ndarray:
    """The weights by bucket; a bucket without counts takes those of the nearest lower one that has some."""
    rows = np.array([(r["x"], r["y"], r["z"], r["n"]) for r in bins], np.int64).reshape(-1, 4)
    value = lambda q: np.where(q == ZERO, 0.0, 10.0 ** (np.maximum(q, -6000) * BIN))
    out, last = np.tile(DEFAULT, (64, 1)), DEFAULT
    for b in range(64):
        own = rows[rows[:, 0] == b]
        if len(own):
            p = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), 1 / (model.types + 1))], axis=1)
            # A small part of the default keeps every weight above zero.
            last = 0.999 * expectation_maximisation(own[:, 3].astype(float), p) + 0.001 * DEFAULT
        out[b] = last
    return out


def scored(docs: DataFrame, model, n: int) -> DataFrame:
    """A row for each document: what of its score follows from the broadcast tables, and the sums over the pairs of two words in the table."""

    def to_rows(kind: bytes, row: np.ndarray, *cols: np.ndarray) -> tuple[list[int], list[bytes]]:
        # A row's sums are at one cell of a partition.
        out = [(k * SUBS, kind + packed(row[at], *(c[at] for c in cols))) for k, at in dealt(mixed(row.view(np.uint64)) % np.uint64(n), n)]
        return [k for k, _ in out], [p for _, p in out]

    def added(rows: list[np.ndarray], sums: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        row, at = np.unique(np.concatenate(rows), return_inverse=True)
        return [row], [np.bincount(at, np.concatenate(sums), minlength=len(row))]

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, frequent, counts = model.value
        for cols, begins, ids, hashes in texts_of(batches):
            row, docs_here = cols["row"], len(cols["row"])
            doc, now, before, *_ = m.tokens(begins, ids, hashes)
            learn = cols["fold"] != HELD_OUT
            in_table = now != m.outside
            known = np.bincount(doc[in_table], m.all[now[in_table]] > 0, minlength=docs_here).astype(np.int64)
            base = np.bincount(doc[in_table], m.base[now[in_table]], minlength=docs_here)
            both = in_table & (before != m.outside)
            pair, doc = m.pair(before[both], now[both]), doc[both]
            sums, often = np.zeros(docs_here), np.zeros(len(pair), bool)
            if len(frequent):
                k = np.minimum(np.searchsorted(frequent, pair), len(frequent) - 1)
                often = frequent[k] == pair
                sums = np.bincount(doc[often], m.log_prob(pair[often], counts[k[often]]), minlength=docs_here)
            yield rows_of(*to_rows(b"d", row, cols["doc_id"], cols["null_id"], ~learn, np.diff(begins) + 1, known, base, sums))
            pair, doc = pair[~often], doc[~often].astype(np.uint64)
            rest = (pair << np.uint64(DOC_BITS)) | doc
            out = [(k, b"p" + packed(row, learn, np.diff(np.sort(rest[at]), prepend=np.uint64(0)))) for k, at in dealt(mixed(pair) % np.uint64(n * SUBS), n * SUBS)]
            yield rows_of([k for k, _ in out], [x for _, x in out])

    def of_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value[0]
        rows, sums = [], []
        for cell, own in by_cell(batches):
            done = [p for p in own if p[:1] == b"d"]
            yield rows_of([cell] * len(done), done)
            payloads = [unpacked(p[1:]) for p in own if p[:1] == b"p"]
            if not payloads:
                continue
            base = np.cumsum([0, *(len(p[0]) for p in payloads)])
            row, learn = np.concatenate([p[0] for p in payloads]), np.concatenate([p[1] for p in payloads])
            codes = [np.cumsum(p[2], dtype=np.uint64) for p in payloads]
            key = np.concatenate([c >> np.uint64(DOC_BITS) for c in codes])
            doc = np.concatenate([(c & np.uint64((1 << DOC_BITS) - 1)).astype(np.int64) + b for c, b in zip(codes, base, strict=False)])
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            head = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(head) - 1
            total = np.bincount(doc, m.log_prob(key[head], np.bincount(group, learn[doc]))[group], minlength=len(row))
            some = np.unique(doc)
            rows.append(row[some])
            sums.append(total[some])
            if sum(map(len, rows)) > SUMS:
                rows, sums = added(rows, sums)
                if len(rows[0]) > SUMS // 2:
                    yield rows_of(*to_rows(b"s", rows[0], sums[0]))
                    rows, sums = [], []
        if rows:
            rows, sums = added(rows, sums)
            yield rows_of(*to_rows(b"s", rows[0], sums[0]))

    def of_rows(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        done = [unpacked(p[1:]) for p in payloads if p[:1] == b"d"]
        row, doc_id, null_id, held, n_tokens, known, base, score = (np.concatenate([p[k] for p in done]) for k in range(8))
        order = np.argsort(row)
        score = score.astype(float)
        for more, sums in (unpacked(p[1:]) for p in payloads if p[:1] == b"s"):
            np.add.at(score, order[np.searchsorted(row[order], more)], sums)
        cols = [pa.array(row, pa.int64()), pa.array(doc_id, pa.int64(), mask=null_id), pa.array(held), pa.array(n_tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score)]
        yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in by_cell(batches):
            yield from of_rows(payloads)

    sent = shuffled(shuffled(docs.mapInArrow(of_texts, PACKED), n).mapInArrow(of_tokens, PACKED), n)
    return sent.mapInArrow(of_sums, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, vocabulary: int = VOCABULARY, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs``.

    ``docs``: doc_id, text; other columns don't matter. Words are runs of non-blank bytes with A to Z lowered, and
    one end a text; a null or empty text is its end alone. Nothing is learned from documents whose
    crc32(doc_id as text) has remainder 2 by 7; a null doc_id counts as empty text there, and so is learned from. Rows
    that repeat are documents of their own. ``base_score`` has add-one smoothing; where nothing was learned it is 0.
    An empty table gives no rows. Words are told apart by 64-bit hashes. ``vocabulary`` and ``frequent_pairs``
    bound what is broadcast; they don't change the model.
    """
    spark = docs.sparkSession
    n = parts(spark)
    doc = F.col("doc_id").cast("long")
    own = stable(docs).select(F.monotonically_increasing_id().alias("row"), F.coalesce(doc, F.lit(0)).alias("doc_id"), doc.isNull().alias("null_id"), id_remainder("doc_id", FOLDS).alias("fold"), F.coalesce("text", F.lit("")).alias("text"))
    learn = own.where(F.col("fold") != HELD_OUT).select("fold", "text")
    ends = {r["fold"]: r["count"] for r in own.where(F.col("fold") != HELD_OUT).groupBy("fold").count().collect()}
    words = written(counted(learn).withColumn("bin", F.floor(F.log2(F.col("a") + F.col("b")) * STEPS)))
    a, b, types = words.agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count("*")).first()
    table = words.where(F.col("bin") >= least_bin(words, vocabulary)).toPandas()
    in_b = ends.pop(WEIGHED, 0)
    model = Model(table["hash"].to_numpy(np.int64).view(np.uint64), table["a"].to_numpy(), table["b"].to_numpy(), (a, b), types, (sum(ends.values()), in_b))
    counts = spark.sparkContext.broadcast(model)
    found = written(pair_counts(learn, counts, max(1, frequent_pairs // (n * SUBS)), n))
    outside = outside_pairs(own.select("row", "fold", "text"), counts)
    bins = found.where("kind = 0").select("x", "y", "z", "n").union(outside_bins(outside, model.n_a)).groupBy("x", "y", "z").agg(F.sum("n").alias("n")).collect()  # no more than bins
    model.weights = learned_weights(model, bins)
    counts.destroy()  # what was made with it is written
    pairs = found.where("kind = 1").select("x", "n").toPandas().sort_values("x")  # no more than ``frequent_pairs``, or one a cell
    tables = spark.sparkContext.broadcast((model, pairs["x"].to_numpy(np.int64).astype(np.uint64), pairs["n"].to_numpy(float)))
    more = written(outside_scores(outside, model)).select("row", F.col("score").alias("more"), F.col("base").alias("more_base"), F.col("known").alias("more_known"))
    both = looked_up(scored(own, tables, n), more, ["row"])
    total = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
    return both.select("doc_id", "held_out", "n_tokens", total("n_known", "more_known"), F.lit(int(model.n)).cast("long").alias("train_tokens"), total("base_score", "more_base"), total("score", "more"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
