"""Verdicts of streams as keyed state and from kept samples, stopped and started again, against the batch ones."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import entries
from tessera.plans.derived import varied_json
from tessera.streaming import events


@pytest.fixture()
def feed(spark, tmp_path):
    """(table, folder of the stream, function that adds its k-th part as a file)."""
    table = varied_json(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).select("event_id", F.pmod("user_id", F.lit(3)).alias("user_id"), "json").cache()
    (tmp_path / "in").mkdir()

    def add(k, n=4):
        part = table.where((F.col("event_id") >= k * 1000 // n) & (F.col("event_id") < (k + 1) * 1000 // n))
        part.coalesce(1).write.parquet(str(tmp_path / f"part-{k}"))
        for f in (tmp_path / f"part-{k}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k}.parquet")

    add(0)
    return table, str(tmp_path / "in"), add


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_keyed_state_equals_batch_after_a_stop(spark, feed, tmp_path):
    table, folder, add = feed
    found = {r["key"]: r for r in events.run_keyed_verdicts(stream(spark, folder), "user_id", "event_id", "json", str(tmp_path / "state")).collect()}
    assert all(not r["final"] and r["entries"] < 200 for r in found.values())  # in mid-sample
    sample = spark.read.format("statestore").option("stateVarName", "sample").option("flattenCollectionTypes", "true").load(str(tmp_path / "state/checkpoint"))
    assert sample.count() == sum(r["samples"] for r in found.values())
    for k in (1, 2, 3):
        add(k)
    found = {r["key"]: r for r in events.run_keyed_verdicts(stream(spark, folder), "user_id", "event_id", "json", str(tmp_path / "state")).collect()}
    own = entries.event_verdict(entries.event_samples_by(table, "user_id", "event_id", "json"), "event_id", "json", ["user_id"])
    want = {r["user_id"]: r for r in own.collect()}
    assert {k: (r["samples"], r["hint"]) for k, r in found.items()} == {k: (r["n"], r["is_event_stream"]) for k, r in want.items()}
    assert sum(r["entries"] for r in found.values()) == table.count()
    assert all(r["final"] and r["samples"] == 200 for r in found.values())
    sample = spark.read.format("statestore").option("stateVarName", "sample").option("flattenCollectionTypes", "true").load(str(tmp_path / "state/checkpoint"))
    assert sample.count() == 0  # dropped at the verdict


def test_kept_progress_survives_a_restart(spark, feed, tmp_path):
    table, folder, add = feed
    first = events.streamed_verdict(stream(spark, folder), "event_id", "json", str(tmp_path / "kept"))
    assert first.entries == 250
    again = events.Verdicts(spark, str(tmp_path / "kept"), "event_id", "json")
    assert (again.batch, again.entries, again.final, again.hint) == (first.batch, first.entries, first.final, first.hint)
    add(1)
    second = events.streamed_verdict(stream(spark, folder), "event_id", "json", str(tmp_path / "kept"))
    want = entries.event_verdict(entries.event_samples(table.where("event_id < 500"), "event_id", "json"), "event_id", "json").first()
    assert second.entries == 500 and second.progress(True)["hint"] == want["is_event_stream"]


def test_a_restart_in_mid_sample(spark, tmp_path):
    """Two batches of eight events: the verdict needs ten."""
    rows = [(k, f'{{"type":"a","timestamp":{k}}}') for k in range(16)]
    df = spark.createDataFrame(rows, "id long, json string")
    one = events.Verdicts(spark, str(tmp_path / "v"), "id", "json")
    one.feed(df.where("id < 8"), 0)
    assert one.progress(True) == {"entries": 8, "complete": True, "total": 8, "hint": False}
    two = events.Verdicts(spark, str(tmp_path / "v"), "id", "json")
    two.feed(df.where("id < 8"), 0)  # run again: nothing changes
    two.feed(df.where("id >= 8"), 1)
    assert two.progress(True) == {"entries": 16, "complete": True, "total": 16, "hint": True}


def test_samples_of_long_streams(spark, monkeypatch):
    """The part that holds the sample is found without sorting the stream, and gives the same rows."""
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'no object', concat('{\"type\":', id, '}')) AS json").repartition(5)
    want = sorted(r["id"] for r in entries.event_samples(df, "id", "json").collect())
    assert want == [k for k in range(3000) if k % 3][:200]
    monkeypatch.setattr(entries, "SPAN_ROWS", 50)
    part = entries.first_part(df, "id", F.octet_length("json").cast("long") + 1, F.json_object_keys("json").isNotNull(), 50)
    assert part.count() < 600
    assert sorted(r["id"] for r in entries.event_samples(df, "id", "json").collect()) == want
    monkeypatch.setattr(entries, "SAMPLE_BYTES", 400)
    some = sorted(r["id"] for r in entries.event_samples(df, "id", "json").collect())
    size, out = 0, []
    for k in range(3000):
        text = "no object" if k % 3 == 0 else f'{{"type":{k}}}'
        size += len(text) + 1
        if size > 400:
            break
        out += [k] * (k % 3 != 0)
    assert some == out
    by = entries.event_samples_by(df.withColumn("s", F.lit(1)), "s", "id", "json", salts=3)
    assert sorted(r["id"] for r in by.collect()) == out


def test_progress_of_a_stream(spark, feed):
    table, folder, add = feed
    add(1)
    watch = events.Watch(spark, "entries_seen")
    try:
        query = watch.observed(stream(spark, folder), F.contains("json", F.lit('"type"'))).writeStream.format("noop").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
        import time

        for _ in range(50):
            if watch.ended and len(watch.rows) == 2:
                break
            time.sleep(0.1)
        assert watch.progress() == {"entries": 500, "matched": table.where("event_id < 500 AND event_id % 4 <> 0").count(), "complete": True, "total": 500}
        assert watch.rows[0][0] == 250
    finally:
        watch.close()
