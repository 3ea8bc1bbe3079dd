"""Rows that carry many records at once: arrays packed for a cell, so that Spark moves a few large rows instead of many small ones.

A partition of the shuffle has SUBS cells. Spark sorts a partition's rows by cell, on disk where memory ends, and a worker
holds one cell at a time; more partitions make smaller cells, at worst down to a record a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "cell int, payload binary"
#: Cells of a partition.
SUBS = 8


def packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpacked(payload: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def rows_of(cells: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(payloads, pa.binary())], names=["cell", "payload"])


def dealt(cell: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(cell, positions of its records) of each cell that has records."""
    cell = cell.astype(np.min_scalar_type(n))
    order = np.argsort(cell, kind="stable")
    ends = np.cumsum(np.bincount(cell, minlength=n))
    start = 0
    for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        yield k, order[start : ends[k]]
        start = ends[k]


def shuffled(df: DataFrame, n: int) -> DataFrame:
    """The rows in ``n`` partitions of SUBS cells each, in the order of their cells."""
    return df.repartitionById(n, F.expr(f"cell div {SUBS}").cast("int")).sortWithinPartitions("cell")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Each cell of a sorted partition and its payloads."""
    cell, own = None, []
    for batch in batches:
        for now, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if now != cell:
                if own:
                    yield cell, own
                cell, own = now, []
            own.append(payload)
    if own:
        yield cell, own


def gathered(df: DataFrame, n: int, of: Callable[[list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``of`` over all payloads of each cell."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, payloads in by_cell(batches):
            yield from of([unpacked(p) for p in payloads])

    return shuffled(df, n).mapInArrow(each, schema)
