"""Streams with state against the same question over a table at rest."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

EVENTS = "/root/testdata/sf0.001/events.parquet"


def fed(spark, tmp_path, batches, schema):
    """A stream whose micro-batches are the given lists of rows, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def drained(found, tmp_path, name):
    q = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start(f"{tmp_path}/{name}-out")
    q.awaitTermination()
    return [tuple(r) for r in found.sparkSession.read.schema(found.schema).parquet(f"{tmp_path}/{name}-out").collect()], q


def events_in_order(spark):
    import os

    if not os.path.exists(EVENTS):
        pytest.skip("no tables")
    rows = spark.read.parquet(EVENTS).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id").orderBy("ts", "event_id").collect()
    return [tuple(r) for r in rows]


def test_bursts_equal_islands(spark, tmp_path):
    from quarry.streaming.state import bursts, bursts_of

    rows, schema = events_in_order(spark), "event_id long, ts timestamp, user_id long"
    cut = [rows[i : i + 250] for i in range(0, len(rows), 250)]
    end = max(r[1] for r in rows) + timedelta(days=30)
    cut += [[(-1, end, -1)], [(-2, end + timedelta(days=1), -1)]]  # moves the watermark past everything
    gap = 6 * 3600 * 1000
    found, q = drained(bursts(fed(spark, tmp_path, cut, schema), "user_id", "ts", gap), tmp_path, "bursts")
    wanted = [tuple(r) for r in bursts_of(spark.createDataFrame(rows, schema), "user_id", "ts", gap).collect()]
    assert len(wanted) > 200 and sorted(x for x in found if x[0] != -1) == sorted(wanted)
    # What stays in state are the open bursts of the keys that have one, not the events.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 20


def test_debounce_fires_by_itself(spark, tmp_path):
    from quarry.streaming.state import debounced

    schema = "workspace string, ext string, path string"
    stream = fed(spark, tmp_path, [[("w", ".py", "a"), ("w", ".py", "b"), ("w", ".ts", "c")]], schema)
    q = debounced(stream, 700).writeStream.format("memory").queryName("debounced").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("debounced").count() < 2:
            time.sleep(0.3)
        assert sorted(map(tuple, spark.table("debounced").collect())) == [("w", ".py", 2), ("w", ".ts", 1)]
    finally:
        q.stop()


def test_linked_stream_equals_join(spark, tmp_path):
    from quarry.streaming.events import linked
    from quarry.streaming.state import linked_stream

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [("s", "d", 1, at(0), True), ("s", "d", 2, at(1), False), ("s", "e", 3, at(2), False), ("s", "d", 4, at(3), True), ("s", "d", 5, at(4), False), ("t", "d", 6, at(5), False), ("t", "d", 7, at(6), True), ("s", "d", 8, at(7), False), ("t", "d", 9, at(8), False)]
    schema = "session string, directory string, event_id long, ts timestamp, is_search boolean"
    # State with a time-to-live looks at the clock for ever: the stream is stopped once all greps are out.
    stream = linked_stream(fed(spark, tmp_path, [rows[:3], rows[3:6], rows[6:]], schema))
    q = stream.writeStream.format("memory").queryName("linked").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("linked").count() < 6:
            time.sleep(0.3)
        found = [tuple(r) for r in spark.table("linked").collect()]
    finally:
        q.stop()
    table = spark.createDataFrame(rows, schema)
    wanted = linked(table.where("is_search").drop("is_search"), table.where("NOT is_search").drop("is_search")).select("session", "directory", "event_id", "parent_event_id")
    assert sorted(found, key=str) == sorted(map(tuple, wanted.collect()), key=str)


def test_sessions_equal_batch(spark, tmp_path):
    from quarry.streaming.events import sessions

    rows, schema = events_in_order(spark), "event_id long, ts timestamp, user_id long"
    end = max(r[1] for r in rows) + timedelta(days=30)
    cut = [rows[:400], rows[400:], [(-1, end, -1)], [(-2, end, -1)]]
    found, _ = drained(sessions(fed(spark, tmp_path, cut, schema), "3 hours"), tmp_path, "sessions")
    wanted = [tuple(r) for r in sessions(spark.createDataFrame(rows, schema), "3 hours").collect()]
    assert sorted(x for x in found if x[0] != -1) == sorted(wanted)
