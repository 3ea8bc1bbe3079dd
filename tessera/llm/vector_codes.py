"""Product codes of vectors by Lloyd's rounds with Hamerly's bounds.

A vector of integers is cut into PARTS; each part has a codebook of at most ENTRIES. A part keeps, from round to round, one
upper bound of its distance to its entry and one lower bound of its distance to any other. Where the upper bound,
loosened by how far the entry moved, stays strictly below the lower one, lowered by how far any other moved, the entry is
still the only nearest. Else the upper bound is made exact, and if that doesn't settle it all entries are gone through in
integers, of equally near ones the lowest index. Bounds are rounded outwards, so rounding never decides a code.

Vectors stay where they are: what Spark moves are sums by part, entry and position, and errors by label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, looked_up, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are compared at once.
ROWS = 4096
#: More than any squared distance; bounds of a part are 32-bit numbers, rounded outwards.
FAR = np.iinfo(np.int64).max
STATE = "vec_id long, label {label}, vector binary, code binary, upper binary, lower binary"
RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def scaled(vectors: DataFrame, most: int | None = None) -> DataFrame:
    """vec_id, label and the integers floor(256 * x) of each vector without null or non-finite components, at most ``most`` in size."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    out = vectors.where(F.col("embedding").isNotNull() & ~bad)
    own = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(most))), F.lit(float(-most))) if most else x)
    return out.select(F.col("vec_id").cast("long").alias("vec_id"), "label", (F.transform("embedding", own) if most else F.col("embedding")).alias("vector"))


def up(x: np.ndarray) -> np.ndarray:
    """32-bit numbers not below the given ones."""
    return np.nextafter((x * (1 + 2.0**-40)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    """32-bit numbers not above the given ones."""
    return np.nextafter((x * np.where(x > 0, 1 - 2.0**-40, 1 + 2.0**-40)).astype(np.float32), np.float32(-np.inf))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The squared distance of each row to the entry beside it."""
    return ((x - entries) ** 2).sum(-1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, squared distance, squared distance of the second nearest) of each row's nearest entry, the lowest index of equally near ones."""
    d = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        d += (x[:, k, None] - book[None, :, k]) ** 2
    rows = np.arange(len(x))
    own = d.argmin(1)
    least = d[rows, own]
    d[rows, own] = FAR
    return own, least, d.min(1)


def moves(before: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how far each entry moved, how far any other entry moved at most), as numbers not below the true ones."""
    own = np.sqrt(squared(before, now).astype(float)) * (1 + 2.0**-40)
    if len(own) < 2:
        return own, np.zeros(len(own))
    order = np.argsort(own)
    others = np.full(len(own), own[order[-1]])
    others[order[-1]] = own[order[-2]]
    return own, others


def coded(x: np.ndarray, book: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, moved: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper bound, lower bound, rows whose entries were all gone through) of one part of some vectors.

    ``state``: code, upper and lower bound by the codebook before; ``moved``: what ``moves`` gives from it to ``book``.
    """
    if state is None:
        code, low, scan = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32), np.arange(len(x))
        high = low.copy()
    else:
        code = state[0].astype(np.int64)
        high = up(state[1].astype(float) + moved[0][code])
        low = down(state[2].astype(float) - moved[1][code])
        loose = np.flatnonzero(high >= low)
        high[loose] = up(np.sqrt(squared(x[loose], book[code[loose]]).astype(float)))
        scan = loose[high[loose] >= low[loose]]
    if len(scan):
        own, least, second = nearest(x[scan], book)
        code[scan], high[scan], low[scan] = own, up(np.sqrt(least.astype(float))), down(np.sqrt(second.astype(float)))
    return code, high, low, len(scan)


def matrix(vectors: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as integers by row, part and position."""
    out = np.zeros((len(vectors), PARTS * width), np.int64)
    for k, v in enumerate(vectors):
        out[k] = np.frombuffer(v, f"<i{len(v) // (PARTS * width)}")
    return out.reshape(len(vectors), PARTS, width)


def first_state(kept: DataFrame, width: int, label: str) -> DataFrame:
    """The vectors packed, without codes; shorter ones end in zeros."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, at = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            rows = np.zeros((batch.num_rows, PARTS * width), np.int64)
            n = np.diff(at)
            rows[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(at[:-1], n)] = flat
            most = np.abs(rows).max(1) if len(rows) else []
            kinds = ["<i2" if m < 2**15 else "<i4" if m < 2**31 else "<i8" for m in most]
            packed = [row.astype(kind).tobytes() for row, kind in zip(rows, kinds, strict=True)]
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary()), none, none, none], names=["vec_id", "label", "vector", "code", "upper", "lower"])

    return kept.mapInArrow(of, STATE.format(label=label))


def assigned(state: DataFrame, books: np.ndarray, before: np.ndarray | None, label: str) -> DataFrame:
    """``state`` with each part's code and bounds by ``books`` (part, entry, position); ``before``: the codebooks that its codes are by."""
    width = books.shape[2]
    moved = [moves(before[p], books[p]) for p in range(PARTS)] if before is not None else None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = matrix(batch.column(2).to_pylist(), width)
                old = None
                if moved is not None:
                    old = [np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(-1, PARTS) for k, kind in ((3, np.uint8), (4, np.float32), (5, np.float32))]
                out = [coded(x[:, p], books[p], old and tuple(o[:, p] for o in old), moved and moved[p])[:3] for p in range(PARTS)]
                packed = [[row.tobytes() for row in np.stack([o[k] for o in out], axis=1).astype(kind)] for k, kind in enumerate((np.uint8, np.float32, np.float32))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(p, pa.binary()) for p in packed)], names=batch.schema.names)

    return state.mapInArrow(of, STATE.format(label=label))


def recentred(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each used entry replaced by the floor of the mean of its parts. The driver gets a row a part, entry and position."""
    width, entries = books.shape[2], books.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((PARTS * entries, width), np.int64), np.zeros(PARTS * entries, np.int64)
        for batch in batches:
            x = matrix(batch.column(0).to_pylist(), width).reshape(-1, width)
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, PARTS) + np.arange(PARTS) * entries
            np.add.at(sums, own.reshape(-1), x)
            count += np.bincount(own.reshape(-1), minlength=PARTS * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))), pa.array(sums[used].reshape(-1)), pa.array(np.repeat(count[used], width))], names=["entry", "position", "total", "n"])

    out = books.reshape(PARTS * entries, width).copy()
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    for r in state.select("vector", "code").mapInArrow(of, "entry long, position long, total long, n long").groupBy("entry", "position").agg(exact("total").alias("total"), exact("n").alias("n")).collect():
        out[r["entry"], r["position"]] = int(r["total"]) // int(r["n"])
    return out.reshape(books.shape)


def measured(state: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """vec_id, label, the code in hex and the squared distances summed over the parts."""
    width = books.shape[2]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                codes = batch.column(3).to_pylist()
                own = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, PARTS)
                entries = books[np.arange(PARTS)[None, :], own]
                error = squared(matrix(batch.column(2).to_pylist(), width), entries).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.hex() for c in codes], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.mapInArrow(of, f"vec_id long, label {label}, code string, error long")


def coded_vectors(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row of ``vectors`` (vec_id, embedding, label; other columns don't matter) whose embedding is whole.

    Rows without an embedding, or with a null or non-finite component, are dropped. The codebooks begin with the parts of
    the ``entries`` smallest vec_ids (at most 256), a null one last, of rows that repeat one by their vectors; fewer rows make smaller codebooks. Vectors shorter
    than the longest, or than a multiple of PARTS, count as ending in zeros. Components are held to what squared distances
    of 64 bits allow, some hundred million after scaling for usual lengths. label_error is the sum over equal labels, nulls
    together; null if it exceeds 64 bits. Rows that repeat have codes of their own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    label = vectors.schema["label"].dataType.simpleString()
    longest = scaled(vectors).agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], RESULT)
    width = max(1, -(-longest // PARTS))
    most = int(np.sqrt(2**61 / (PARTS * width)) / 2)
    kept = scaled(vectors, most)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    rows = np.zeros((len(first), PARTS * width), np.int64)
    for k, r in enumerate(first):
        rows[k, : len(r["vector"])] = r["vector"]
    books, before = rows.reshape(len(first), PARTS, width).transpose(1, 0, 2).copy(), None
    state = first_state(kept, width, label)
    for _ in range(rounds):
        state = written(assigned(state, books, before, label))
        before, books = books, recentred(state, books)
    last = written(measured(assigned(state, books, before, label), books, label))
    text = ",".join(map(str, books.reshape(-1).tolist()))
    bare, null, value = fresh(last, "bare", "null", "value")
    keyed = last.withColumns({null: F.col("label").isNull(), value: F.coalesce(F.col("label"), F.lit(0).cast(label))})
    sums = written(keyed.groupBy(null, value).agg(F.try_sum("error").alias("label_error")))
    return looked_up(keyed, sums, [null, value]).select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _round(k: int) -> str:
    """SQL of one assignment by the codebooks ``c{k}``: ``a{k}`` has a row a part with its entry and squared distance."""
    return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, label, p, v, min(d * 64 + e) % 64 AS e, min(d * 64 + e) // 64 AS d
  FROM (SELECT s.vec_id, s.label, s.p, s.v, c.e, CAST(list_sum(list_transform(range(1, len(s.v) + 1), lambda i: (s.v[i] - c.v[i]) * (s.v[i] - c.v[i]))) AS BIGINT) AS d FROM parts s JOIN c{k} c ON s.p = c.p)
  GROUP BY vec_id, label, p, v)"""


def _means(k: int) -> str:
    """SQL of the codebooks after round ``k``."""
    return f"""c{k + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT p, e, i, CAST(sum(v[i]) AS DOUBLE) AS s, count(*) AS n FROM a{k}, range(1, (SELECT max(len(v)) FROM parts) + 1) r(i) GROUP BY p, e, i) GROUP BY p, e) m
  ON c.p = m.p AND c.e = m.e)"""


#: Over tables whose vec_ids don't repeat and whose vectors are all of one length, a multiple of 16; sums over equal parts are exact in doubles there.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // 16 + 1 : (p + 1) * len(v) // 16] AS v FROM kept, range(0, 16) r(p)),
c0 AS MATERIALIZED (SELECT p, e - 1 AS e, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM parts) WHERE e <= 64),
{_round(0)}, {_means(0)}, {_round(1)}, {_means(1)}, {_round(2)},
codes AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM codes"""
