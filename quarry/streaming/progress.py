"""Counters and progress without jobs of their own: metrics observed while a plan runs, and what streams report."""

from __future__ import annotations

import time
from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Rows of progress that are kept.
KEPT = 100


def counted(rows: DataFrame, name: str, **counters: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that has their counters once they were read: no second job."""
    seen = Observation(name)
    return rows.observe(seen, *[c.alias(x) for x, c in counters.items()]), seen


def search_counters(scope: DataFrame, results: DataFrame, file: str = "file") -> tuple[DataFrame, Observation, DataFrame, Observation]:
    """(scope, its counters, results, theirs): functions and files that a search looked at, and results that it has."""
    files = F.size(F.collect_set(file))
    a, of_scope = counted(scope, "scope", num_functions=F.count(F.lit(1)), num_files=F.approx_count_distinct(file))
    b, of_results = counted(results, "results", result_count=F.count(F.lit(1)), result_files=files)
    return a, of_scope, b, of_results


class ProgressLog(StreamingQueryListener):
    """The last reports of the session's streams, and of steps told by hand: (name, phase, current, total, seconds, rate, rest)."""

    def __init__(self, total: int | None = None):
        self.total, self.rows, self.begun, self.done = total, deque(maxlen=KEPT), {}, {}

    def told(self, name: str, phase: str, current: int, total: int | None, now: float | None = None) -> None:
        now = time.time() if now is None else now
        seconds = now - self.begun.setdefault(name, now)
        rate = current / seconds if seconds > 0 and current else None
        rest = None if not rate or total is None else max(0, total - current) / rate
        self.rows.append((name, phase, int(current), total, float(seconds), rate, rest))

    def onQueryStarted(self, event) -> None:
        self.told(str(event.id), "started", 0, self.total)

    def onQueryProgress(self, event) -> None:
        name = str(event.progress.id)
        self.done[name] = self.done.get(name, 0) + sum(s.numInputRows for s in event.progress.sources)
        self.told(name, "running", self.done[name], self.total)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.told(str(event.id), "failed" if event.exception else "finished", self.done.get(str(event.id), 0), self.total)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "name string, phase string, current long, total long, seconds double, rate double, rest double")
