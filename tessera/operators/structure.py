"""Structural joins of nodes: all pairs of an ancestor and a descendant from two sets, by spans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a document whose nodes a stretch of a task goes through; pairs that a task holds before it gives them away.
RANGE, HELD = 1 << 16, 50_000


def contained(nodes: DataFrame, key: str, ancestors: Column, descendants: Column, show: str = "path", width: int = RANGE) -> DataFrame:
    """key, ancestor, descendant, and what ``show`` is of both: each node that meets ``descendants`` with each node around it that meets ``ancestors``.

    Documents are cut into ranges of bytes, so a large one is dealt to many tasks; an ancestor goes to each range that it
    reaches into. In a range nodes come by their starts, and a stack holds the ancestors that are open: every one of them
    contains the node at hand, so no pair is looked at that isn't given. A node isn't in itself. Nodes of documents that repeat a key are taken as one document's.
    """
    span = F.struct(F.col("start"), F.col("end"), F.col("node_id"), F.col(show).cast("string").alias("shown"))
    last = F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width)
    first = F.floor(F.col("start") / width)
    inside = nodes.where(descendants).select(F.col(key).alias("key"), first.alias("range"), F.lit(0).alias("role"), span.alias("n"))
    around = nodes.where(ancestors).select(F.col(key).alias("key"), F.explode(F.sequence(first, last)).alias("range"), F.lit(1).alias("role"), span.alias("n"))
    # Where a node is both, it is looked at as a descendant before it opens.
    rows = inside.union(around).select("key", "range", "role", "n.*").repartition("key", "range").sortWithinPartitions("key", "range", "start", "role")
    kind = dict(nodes.select(key).dtypes)[key]

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack, out = None, [], []
        names = [key, "ancestor", "descendant", "ancestor_shown", "descendant_shown"]
        for frame in frames:
            for own, part, role, start, end, node, shown in zip(*(frame[c].tolist() for c in ("key", "range", "role", "start", "end", "node_id", "shown")), strict=True):
                if now != (own, part):
                    now, stack = (own, part), []
                while stack and stack[-1][0] <= start:
                    stack.pop()
                if role:
                    stack.append((end, node, shown))
                else:
                    out.extend((own, a, node, said, shown) for _, a, said in stack)
            if len(out) > HELD:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(of, f"{key} {kind}, ancestor int, descendant int, ancestor_shown string, descendant_shown string")
