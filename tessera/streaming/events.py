"""Streams of entries: running counts with late data, and verdicts over a bounded sample that equal the batch ones."""

from __future__ import annotations

import json as js
import os
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import entries


def late_by(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream with its watermark; a table as it is."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window of event time; rows later than ``late`` behind the latest are left out. Works on streams and tables."""
    own = late_by(events, at, late)
    return own.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    own = late_by(events, at, late)
    return own.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def run_to_end(result: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """A stream over all that is there now, as a table in memory (for tests and small results)."""
    query = result.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return result.sparkSession.table(name)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; a table of one file is looked for in its folder."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if own.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(own).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", own.getName()).parquet(own.getParent().toString())


class Verdicts:
    """The event verdict of a stream of entries (order, JSON), read while it runs.

    Of the entries seen so far the first 200 objects, within the first 8 MiB, are kept below ``folder``, with the batch's
    number, the counts and the verdict, all in one folder that is there as a whole or not. When the sample is full, the verdict is final:
    the sample goes, and later entries are only counted. A batch that is run again changes nothing, and a driver that starts again
    goes on from what was kept.
    """

    FIELDS = "batch long, entries long, final boolean, hint boolean"

    def __init__(self, spark: SparkSession, folder: str, order: str, json: str):
        self.spark, self.folder, self.order, self.json = spark, folder.rstrip("/"), order, json
        self.batch, self.entries, self.final, self.hint = -1, 0, False, None
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        kept = self.kept()
        if kept:
            r = spark.read.schema(self.FIELDS).parquet(f"{self.folder}/batch-{kept[-1]}/progress").first()
            self.batch, self.entries, self.final, self.hint = r["batch"], r["entries"], r["final"], r["hint"]

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def kept(self) -> list[int]:
        """The batches that are kept, in order: the last one, and the one before if the driver ended between the two."""
        if not self.fs.exists(self.path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(""))]
        return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))

    def feed(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        if number <= self.batch:
            return
        fresh = batch.select(self.order, self.json)
        n, final, hint = self.entries + fresh.count(), self.final, self.hint
        new = f"{self.folder}/new-{number}"
        if not final:
            before = self.spark.read.schema(fresh.schema).parquet(f"{self.folder}/batch-{self.batch}/sample") if self.batch >= 0 else fresh.limit(0)
            entries.event_samples(before.unionByName(fresh), self.order, self.json).write.mode("overwrite").parquet(f"{new}/sample")
            kept = self.spark.read.schema(fresh.schema).parquet(f"{new}/sample")
            found = entries.event_verdict(kept, self.order, self.json).first()
            size = kept.agg(F.coalesce(F.sum(F.octet_length(self.json) + 1), F.lit(0))).first()[0]
            hint = found["is_event_stream"]
            final = found["n"] >= entries.SAMPLES or size >= entries.SAMPLE_BYTES
        self.spark.createDataFrame([(number, n, final, hint)], self.FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{new}/progress")
        if final:
            self.fs.delete(self.path(f"new-{number}/sample"), True)
        self.fs.rename(self.path(f"new-{number}"), self.path(f"batch-{number}"))
        for old in self.kept()[:-1]:
            self.fs.delete(self.path(f"batch-{old}"), True)
        self.batch, self.entries, self.final, self.hint = number, n, final, hint

    def progress(self, complete: bool = False) -> dict:
        """Entries so far, whether these are all, their number if so, and the verdict if it is final or the stream has ended."""
        return {"entries": self.entries, "complete": complete, "total": self.entries if complete else None, "hint": self.hint if self.final or complete else None}


def streamed_verdict(stream: DataFrame, order: str, json: str, folder: str) -> Verdicts:
    """Runs a stream over all that is there now through ``Verdicts``, below a folder that executors and driver share."""
    own = Verdicts(stream.sparkSession, folder, order, json)
    query = stream.writeStream.foreachBatch(own.feed).option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return own


class Number(str):
    """A number as it is written, with its kind."""


def signals(text: str) -> tuple[bool, bool, bool, set[tuple[str, str]]] | None:
    """(has a type, a time, a place in a sequence; its families with typed values) of an object's text; None for anything else."""
    try:
        pairs = js.loads(text, object_pairs_hook=lambda p: p, parse_int=lambda s: Number(f"i{s}"), parse_float=lambda s: Number(f"f{s}"), parse_constant=lambda s: 1 / 0)
    except (ValueError, ArithmeticError, RecursionError):
        return None
    if not isinstance(pairs, list) or not text.lstrip().startswith("{"):
        return None
    keys = {k for k, _ in pairs}
    family = lambda k: re.sub("_id$", "", re.sub("Id$", "_id", k).lower())
    groups = {(family(k), repr((type(v).__name__, v))) for k, v in pairs if k in entries.GROUP_KEYS}
    return bool(keys & set(entries.TYPE_KEYS)), bool(keys & set(entries.TIME_KEYS)), bool(keys & set(entries.SEQUENCE_KEYS)), groups


def is_event_stream(samples: list[str]) -> bool:
    """The verdict over objects' texts, 200 of them at most."""
    own = [s for s in map(signals, samples) if s is not None]
    n, count = len(own), lambda k: sum(s[k] for s in own)
    in_samples = Counter(g for s in own for g in s[3])
    grouped = sum(bool(s[3]) for s in own)
    repeated = sum(any(in_samples[g] > 1 for g in s[3]) for s in own)
    share = lambda a, of, percent: of > 0 and a * 100 >= of * percent
    again = share(repeated, grouped, 50)
    typed = share(count(0), n, 70) and (share(count(1), n, 40) or (share(grouped, n, 50) and again) or share(count(2), n, 40))
    return n >= 10 and (typed or (share(count(1), n, 70) and share(grouped, n, 70) and again))


class Sampler(StatefulProcessor):
    """Keyed state of a stream of entries: the sample as a list, counts and verdict as a value.

    Entries of a key count in the order in which they come, those of one batch by ``at``. Once 200 objects or 8 MiB are there the verdict is final, the
    list goes, and later entries are only counted.
    """

    COUNTS = "entries long, size long, samples int, final boolean, hint boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sample = handle.getListState("sample", "json string")
        self.counts = handle.getValueState("counts", self.COUNTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, size, samples, final, hint = self.counts.get() if self.counts.exists() else (0, 0, 0, False, None)
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        n += len(batch)
        if not final:
            fresh = []
            for text in batch["json"]:
                own = len((text or "").encode("utf-8", "surrogatepass")) + 1
                if samples >= entries.SAMPLES or size + own > entries.SAMPLE_BYTES:
                    final = True
                    break
                size += own
                if text is not None and signals(text) is not None:
                    fresh.append(text)
                    samples += 1
            final = final or samples >= entries.SAMPLES
            if fresh:
                self.sample.appendList([(text,) for text in fresh])
            hint = is_event_stream([r[0] for r in self.sample.get()]) if samples else False
            if final:
                self.sample.clear()
        self.counts.update((n, size, samples, final, hint))
        yield pd.DataFrame({"key": [key[0]], "entries": [n], "samples": [samples], "hint": [hint], "final": [final]})

    def close(self) -> None:
        pass


#: Where the keyed state is kept: on disk, with changes logged.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def keyed_verdicts(stream: DataFrame, by: str, order: str, json: str) -> DataFrame:
    """key, entries, samples, hint, final: after each batch a row for each key that had entries in it; the last row of a key counts. For output mode update."""
    kind = dict(stream.select(by).dtypes)[by]
    own = stream.select(F.col(by).alias("key"), F.col(order).alias("at"), F.col(json).alias("json"))
    return own.groupBy("key").transformWithStateInPandas(Sampler(), f"key {kind}, entries long, samples int, hint boolean, final boolean", "Update", "None")


def run_keyed_verdicts(stream: DataFrame, by: str, order: str, json: str, folder: str) -> DataFrame:
    """Runs a stream over all that is there now, with its state below ``folder``, and gives the keys' counts and verdicts as the state has them: key, entries, samples, hint, final.

    Called again, it goes on where it ended or was stopped.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = keyed_verdicts(stream, by, order, json).writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return state_of(spark, folder)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_of(spark: SparkSession, folder: str) -> DataFrame:
    """key, entries, samples, hint, final of each key, read back from the state variable."""
    kept = spark.read.format("statestore").option("stateVarName", "counts").load(f"{folder}/checkpoint")
    return kept.select(F.col("key.key").alias("key"), "value.entries", "value.samples", "value.hint", "value.final")


class Watch:
    """Progress of a stream's entries while it runs: a listener that adds up what each batch observed.

    ``observed`` marks the stream; ``rows`` has (batch, entries, matched) of each batch, and ``progress`` the sums so far.
    """

    def __init__(self, spark: SparkSession, name: str):
        from pyspark.sql.streaming import StreamingQueryListener

        self.spark, self.name, self.rows, self.ended = spark, name, {}, False
        watch = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event) -> None:  # noqa: N802
                pass

            def onQueryProgress(self, event) -> None:  # noqa: N802
                got = event.progress.observedMetrics.get(watch.name)
                if got is not None:
                    watch.rows[event.progress.batchId] = (got["entries"], got["matched"])

            def onQueryIdle(self, event) -> None:  # noqa: N802
                pass

            def onQueryTerminated(self, event) -> None:  # noqa: N802
                watch.ended = True

        self.listener = Listener()
        spark.streams.addListener(self.listener)

    def observed(self, stream: DataFrame, matches) -> DataFrame:
        return stream.observe(self.name, F.count(F.lit(1)).alias("entries"), F.count_if(matches).alias("matched"))

    def progress(self) -> dict:
        n = sum(a for a, _ in self.rows.values())
        return {"entries": n, "matched": sum(b for _, b in self.rows.values()), "complete": self.ended, "total": n if self.ended else None}

    def close(self) -> None:
        self.spark.streams.removeListener(self.listener)
