"""Encoders, cancelled builds, counters and progress."""

from __future__ import annotations

import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F


def Fails(limit: int, failure=RuntimeError):
    """An encoder that runs out of memory above a number of texts; of a class that workers needn't import."""

    class Encoder:
        width, most, error = 4, limit, staticmethod(failure)

        def documents(self, texts):
            if len(texts) > self.most:
                raise self.error("CUDA out of memory")
            return np.array([[len(x), 1, x.count("a"), 0] for x in texts], float)

        def queries(self, texts):
            return -self.documents(texts)

    return Encoder()


def test_encoders(spark):
    from quarry.operators.encoders import embed, encode_all

    rows = spark.createDataFrame([(i, "a" * (i % 7) + "b" * (i % 3)) for i in range(60)] + [(60, None)], "id long, text string")
    take = lambda *a, **k: {r.id: tuple(r.embedding) for r in embed(rows, "id", F.col("text"), *a, **k).collect()}
    whole = take(Fails(100), batch=64)
    assert take(Fails(9), batch=64, tries=4) == whole and take(Fails(2, MemoryError), batch=8) == whole
    assert take(Fails(100), kind="query", batch=5) == {k: tuple(-x for x in v) for k, v in whole.items()} and whole[60] == (0, 1, 0, 0)
    assert encode_all(Fails(3).documents, ["x"] * 20, 4, batch=16, tries=4)[1] == 2
    broken = lambda _: RuntimeError("broken")
    for encoder, batch in ((Fails(0), 4), (Fails(1, broken), 4)):
        with pytest.raises(RuntimeError):
            encode_all(encoder.documents, ["x"] * 4, 4, batch)
    with pytest.raises(ValueError):
        take(Fails(1), kind="generic")


def test_cancelled_build_goes_on(spark, tmp_path):
    from quarry.sources import snapshots
    from quarry.sources.build import Cancelled, build_in_steps, cancel

    root, asked = f"file://{tmp_path}/t", []
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")

    def step(n, waits=False):
        asked.append(n)
        rows = spark.range(n * 10, n * 10 + 10).withColumnRenamed("id", "k")
        return rows.select(slow("k").alias("k")).repartition(2) if waits and n == 2 else rows

    def stops():
        until = time.time() + 60
        while 2 not in asked and time.time() < until:
            time.sleep(0.05)
        time.sleep(0.3)
        cancel(spark, root, "mine")

    other = threading.Thread(target=stops)
    other.start()
    with pytest.raises(Cancelled):
        build_in_steps(root, lambda n: step(n, True), 5, "k", "s1", "mine", spark)
    other.join()
    done = snapshots.manifest(spark, root)["step"]
    assert done in (1, 2) and snapshots.read(spark, root).count() == 10 * (done + 1)  # readable, whole steps only
    asked.clear()
    seen = []
    assert build_in_steps(root, step, 5, "k", "s1", spark=spark, on_step=lambda n, of: seen.append((n, of))) == 4 - done and asked == list(range(done + 1, 5)) and seen[-1] == (5, 5)
    assert sorted(r.k for r in snapshots.read(spark, root).collect()) == list(range(50)) and build_in_steps(root, step, 5, "k", "s1", spark=spark) == 0
    assert build_in_steps(root, step, 2, "k", "s2", spark=spark) == 2 and snapshots.read(spark, root).count() == 20  # made from something else


def test_counters_need_no_job(spark, tmp_path):
    from quarry.streaming.progress import search_counters

    rows = spark.createDataFrame([(i, f"f{i % 4}") for i in range(40)], "id long, file string")
    scope, of_scope, _, _ = search_counters(rows, rows)
    _, _, results, of_results = search_counters(rows, scope.where("id < 7"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert len(results.collect()) == 7
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert of_scope.get == {"num_functions": 40, "num_files": 4} and of_results.get == {"result_count": 7, "result_files": 4}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == jobs and jobs - before <= 1


def test_progress_of_streams_and_steps(spark, tmp_path):
    from quarry.streaming.progress import ProgressLog

    log = ProgressLog(total=30)
    spark.streams.addListener(log)
    try:
        spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination()
        until = time.time() + 30
        while time.time() < until and not any(r[1] == "finished" for r in log.rows):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    rows = log.table(spark).collect()
    assert [r.phase for r in rows][0] == "started" and rows[-1].phase == "finished" and rows[-1].current == 30 and rows[-1].rest == 0
    log = ProgressLog()
    for at, current in ((0, 0), (2, 10), (4, 20)):
        log.told("embed", "Embedding", current, 50, now=100.0 + at)
    last = log.table(spark).collect()[-1]
    assert (last.rate, last.rest, last.seconds) == (5.0, 6.0, 4.0)
