"""Streams with state of their own: bursts that end by timers, and what a session remembers for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DEBOUNCE_MS = 1500


def use_rocks(spark: SparkSession) -> None:
    """The state store that timers and time-to-live need; stores take no disk before they hold something."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")


class _Debounce(StatefulProcessor):
    """Counts rows of a key until none came for a while."""

    def __init__(self, milliseconds: int):
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n = self.held.get()[0] if self.held.exists() else 0
        self.held.update((n + sum(len(x) for x in rows),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            yield pd.DataFrame({"workspace": [key[0]], "ext": [key[1]], "n": [self.held.get()[0]]})
            self.held.clear()

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, milliseconds: int = DEBOUNCE_MS) -> DataFrame:
    """(workspace, ext, n) once no change came for a while: one processing-time timer a key.

    changes: workspace, ext, path. A burst fires even if nothing follows it, which an event-time
    session in append mode would not.
    """
    use_rocks(changes.sparkSession)
    return changes.groupBy("workspace", "ext").transformWithStateInPandas(_Debounce(milliseconds), "workspace string, ext string, n long", "append", "processingTime")


class _Bursts(StatefulProcessor):
    """Open bursts of a key as (begin, end, n) in milliseconds; a burst goes out when the watermark is a gap past its end."""

    def __init__(self, gap: int, key: str):
        self.gap, self.key = gap, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "begins array<long>, ends array<long>, sizes array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for x in rows for t in x["at_ms"].tolist())
        spans = sorted([*(zip(*self.held.get(), strict=True) if self.held.exists() else ()), *((t, t, 1) for t in times)])
        merged: list[list[int]] = []
        for begin, end, n in spans:
            if merged and begin - merged[-1][1] < self.gap:
                merged[-1][1] = max(merged[-1][1], end)
                merged[-1][2] += n
            else:
                merged.append([begin, end, n])
        self._keep(merged)
        return iter(())

    def _keep(self, spans: list) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.held.update(tuple(list(x) for x in zip(*spans, strict=True)))
            self.handle.registerTimer(min(end for _, end, _ in spans) + self.gap)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans = [list(x) for x in zip(*self.held.get(), strict=True)] if self.held.exists() else []
        over = [x for x in spans if x[1] + self.gap <= timerValues.getCurrentWatermarkInMs()]
        self._keep([x for x in spans if x not in over])
        if over:
            yield pd.DataFrame({self.key: [key[0]] * len(over), "begin_ms": [x[0] for x in over], "end_ms": [x[1] for x in over], "n": [x[2] for x in over]})

    def close(self) -> None:
        pass


def bursts(events: DataFrame, key: str, ts: str, gap_ms: int, late: str = "0 seconds") -> DataFrame:
    """(key, begin_ms, end_ms, n): rows of a key less than a gap apart, once no earlier row can come; state holds open bursts only."""
    use_rocks(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    told = events.select(key, F.col(ts).alias("at_ts"), F.unix_millis(ts).alias("at_ms")).withWatermark("at_ts", late)
    return told.groupBy(key).transformWithStateInPandas(_Bursts(gap_ms, key), f"{key} {kind}, begin_ms long, end_ms long, n long", "append", "eventTime")


def bursts_of(events: DataFrame, key: str, ts: str, gap_ms: int) -> DataFrame:
    """The same rows from a table at rest: islands of times less than a gap apart."""
    from pyspark.sql import Window

    by_time = Window.partitionBy(key).orderBy("_ms")
    told = events.select(key, F.unix_millis(ts).alias("_ms")).withColumn("_new", F.coalesce(F.col("_ms") - F.lag("_ms").over(by_time) >= gap_ms, F.lit(True)))
    numbered = told.withColumn("_island", F.count_if("_new").over(by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "_island").agg(F.min("_ms").alias("begin_ms"), F.max("_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).drop("_island")


class _Remember(StatefulProcessor):
    """The last search of a session and directory, forgotten after a while; greps learn its id."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "event_id long, ms long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fed = pd.concat(list(rows), ignore_index=True).sort_values(["at_ms", "is_search", "event_id"], ascending=[True, False, True], kind="stable")
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for event, ms, is_search in zip(fed["event_id"].tolist(), fed["at_ms"].tolist(), fed["is_search"].tolist(), strict=True):
            if is_search and (last is None or ms >= last[1]):
                last = (event, ms)
            elif not is_search:
                out.append((key[0], key[1], event, last[0] if last and last[1] <= ms else None))
        if last:
            self.last.update(last)
        if out:
            frame = pd.DataFrame(out, columns=["session", "directory", "event_id", "parent_event_id"])
            yield frame.astype({"parent_event_id": "Int64"})

    def close(self) -> None:
        pass


def linked_stream(events: DataFrame, keep_ms: int = 30 * 60 * 1000) -> DataFrame:
    """(session, directory, event_id, parent_event_id) of each grep: the last search of its session and directory that was read before it.

    events: session, directory, event_id, ts, is_search. Unlike the join of two tables at rest, a search that
    arrives after a grep doesn't change what the grep was told; a session keeps one row of state, and that for ``keep_ms``.
    """
    use_rocks(events.sparkSession)
    told = events.select("session", "directory", "event_id", F.unix_millis("ts").alias("at_ms"), "is_search")
    result = "session string, directory string, event_id long, parent_event_id long"
    return told.groupBy("session", "directory").transformWithStateInPandas(_Remember(keep_ms), result, "append", "processingTime")
