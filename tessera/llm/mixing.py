"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded, documents, fresh, numbered, small_table, written

#: Weights of the sources in order, repeating; the whole mix as a multiple of all sizes; most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: Rates of the sources along the training run, (time, rate) in order, repeating: the first kind fades out, the second
#: fades in, the third stays. Only their shape matters: each integrates to its source's target.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.5), (0.5, 0.9), (1.0, 1.7)), ((0.0, 1.0), (1.0, 1.0)))
#: Rows of a source whose running sum is made in one task.
BUCKET_ROWS = 8192
SOURCES = pa.schema([("own_source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()), ("buckets", pa.int64()), *((c, pa.list_(pa.float64())) for c in ("times", "rates", "sums"))])
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = SHARE, passes: int = PASSES) -> list[float]:
    """``share`` of all sizes dealt by weight; what exceeds ``passes`` times a source's size goes to the others by weight until nothing does."""
    out: list[float | None] = [None] * len(sizes)
    left, own = share * sum(sizes), list(range(len(sizes)))
    while own:
        unit = left / sum(weights[i] for i in own)
        over = [i for i in own if unit * weights[i] > passes * sizes[i]]
        if not over:
            for i in own:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(passes * sizes[i])
        left -= sum(passes * sizes[i] for i in over)
        own = [i for i in own if out[i] is None]
    return out


def integrated(knots: tuple[tuple[float, float], ...]) -> tuple[list[float], list[float], list[float]]:
    """(times, rates, integrals up to each time) of a piecewise linear rate, scaled to a whole of 1 over times 0 to 1."""
    times, rates = [float(t) for t, _ in knots], [float(r) for _, r in knots]
    if times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times or min(rates) < 0:
        raise ValueError("a schedule has times from 0 to 1 in order, and rates of 0 or more")
    parts = [(rates[k] + rates[k + 1]) / 2 * (times[k + 1] - times[k]) for k in range(len(times) - 1)]
    whole = sum(parts)
    return times, [r / whole for r in rates], [sum(parts[:k]) / whole for k in range(len(times))]


def inverted(part: Column) -> Column:
    """The time by which the share ``part`` of a source's demand is met, from the columns times, rates and sums."""
    k = F.least(F.greatest(F.size(F.filter("sums", lambda c: c <= part)), F.lit(1)), F.size("times") - 1)
    t0, t1, r0, r1 = F.element_at("times", k), F.element_at("times", k + 1), F.element_at("rates", k), F.element_at("rates", k + 1)
    rest = F.greatest(part - F.element_at("sums", k), F.lit(0.0))
    root = r0 + F.sqrt(F.greatest(r0 * r0 + 2 * (r1 - r0) / (t1 - t0) * rest, F.lit(0.0)))
    return F.least(F.when(root > 0, t0 + 2 * rest / root).otherwise(t0), t1)


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES, schedules: tuple = SCHEDULES, bucket_rows: int = BUCKET_ROWS, size: Callable[[Column], Column] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, print, size, source_size, target, taken, positions of each row of ``docs``, and its columns ``also``.

    ``docs``: doc_id, text, source; other columns don't matter. A document's size is its words (``size`` may give
    another measure of the text); a null text has none. Sources are ordered by code point, a null source last, and
    the sources are one row each on the driver, their number being the mixture's own. Within a source the
    documents stand in the order of a hash; the run takes them in that order, and again from the start where the
    target exceeds the source, each whole document whose middle is before the target. Then one document of the
    source comes in or goes out if that brings the source nearer its target. ``positions`` are the times, 0 to 1, of
    its uses. A row's place depends on its doc_id and text alone, so reruns agree; rows that repeat both stand one
    after the other, each with uses of its own. Running sums are made in buckets of a source's hash range, so a
    source of any size is spread out (rows that repeat doc_id and text share a bucket). An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    words = size(text) if size else F.regexp_count(text, F.lit(WORDS))
    place = F.xxhash64(F.col("doc_id").cast("long"), text)
    sized = written(docs.select(F.col("doc_id").cast("long"), "source", words.cast("long").alias("size"), place.alias("print"), F.monotonically_increasing_id().alias("nth"), F.struct(*also, F.lit(0)).alias("also")))
    found = sorted(sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["s"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, passes)
    table = [(r["source"], r["s"], t, max(1, -(-r["n"] // bucket_rows)), *integrated(schedules[i % len(schedules)])) for i, (r, t) in enumerate(zip(found, goal, strict=True))]
    sources = small_table(spark, table, SOURCES)
    if len(table) <= 10_000:
        sources = F.broadcast(sources)
    u = F.shiftrightunsigned("print", 11) / F.lit(2.0**53)
    rows = sized.join(sources, F.col("source").eqNullSafe(F.col("own_source"))).withColumn("bucket", F.floor(u * F.col("buckets"))).drop("own_source")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    offsets = written(sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("offset")))
    rows = rows.join(bounded(offsets), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    own = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("print", 1), "print", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("offset") + F.sum("size").over(own) - F.col("size")
    middle = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda e: F.col("start") + e * F.col("source_size") + F.col("size") / 2)
    uses = F.when(F.col("target") > 0, F.filter(middle, lambda m: m <= F.col("target"))).otherwise(F.array().cast("array<double>"))
    placed = written(rows.withColumn("start", start).withColumn("uses", uses).select("doc_id", "source", "print", "nth", "also", "size", "source_size", "target", "times", "rates", "sums", "start", "uses"))
    off = placed.groupBy("source").agg((F.sum(F.size("uses") * F.col("size")) - F.first("target")).alias("off"))
    here = placed.join(F.broadcast(off.withColumnRenamed("source", "s")) if len(table) <= 10_000 else off.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("size > 0")
    can = here.where(F.when(F.col("off") > 0, F.size("uses") > 0).otherwise(F.size("uses") < passes))
    rest = F.abs(F.abs("off") - F.col("size"))
    best = can.where(rest < F.abs("off")).groupBy("source").agg(F.min_by(F.struct("nth", (F.col("off") > 0).alias("out")), F.struct(rest, "print", "nth")).alias("turn"))
    turns = bounded(written(best.select(F.col("source").alias("s"), "turn")), 10_000)
    turned = placed.join(turns, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("mine", F.coalesce(F.col("turn.nth") == F.col("nth"), F.lit(False)))
    extra = F.array((F.col("start") + F.col("size") / 2) / F.col("source_size") * F.col("target"))
    last = F.when(~F.col("mine"), F.col("uses")).when(F.col("turn.out"), F.slice("uses", 1, F.size("uses") - 1)).otherwise(F.sort_array(F.concat("uses", extra)))
    done = turned.withColumn("uses", last)
    return done.select("doc_id", "source", "print", "size", "source_size", "target", (F.size("uses") * F.col("size")).alias("taken"), F.transform("uses", lambda m: inverted(m / F.col("target"))).alias("positions"), *(F.col("also")[c].alias(c) for c in also))


def training_order(docs: DataFrame, **mix) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns, sorted by position over a range partitioning.

    A null source is a source, the last; a text without words is never taken. Rows that repeat are taken each by itself.
    Equal positions are in the order of a hash. An empty table gives no rows.
    """
    path, row, file, own_row, at, mark, position = fresh(docs, "path", "row", "mix_file", "mix_row", "mix_at", "mix_print", "position")
    own = numbered(docs, path, row)
    takes = mixed_rows(own.withColumn(file, F.xxhash64(path)).withColumnRenamed(row, own_row), also=(file, own_row), **mix).where(F.size("positions") > 0).select(file, own_row, F.col("positions").alias(at), F.col("print").alias(mark))
    both = own.join(bounded(written(takes), 300_000), (F.xxhash64(path) == F.col(file)) & (F.col(row) == F.col(own_row)))
    return both.withColumn(position, F.explode(at)).orderBy(position, mark).select(*docs.columns)


def mixed(docs: DataFrame) -> DataFrame:
    return mixed_rows(docs).select("doc_id", "size", "source_size", "target", "taken", "positions")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))
