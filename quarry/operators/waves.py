"""Early exit: parts of a table in order of its key are searched in growing waves until enough is found.

``lay_out`` sorts a table by range into numbered parts, each a partition of a Parquet table, so that the
parts one after the other are the table in order of its key. ``first_matches`` searches one part, then the next
two, four and so on, as ``take`` does for unordered rows, and stops with the wave that has enough: the
result is the head of the whole search. Only that many rows ever meet in the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lexical import grep

PART_ROWS = 10_000


class Found(NamedTuple):
    rows: DataFrame
    parts_read: int
    parts: int


def lay_out(rows: DataFrame, key: str, path: str, part_rows: int = PART_ROWS) -> int:
    """Write rows below path in parts of about ``part_rows``; the number of parts asked for."""
    parts = max(1, -(-rows.count() // part_rows))
    ordered = rows.repartitionByRange(parts, F.col(key)).sortWithinPartitions(key)
    ordered.withColumn("part", F.spark_partition_id()).write.option("compression", "zstd").partitionBy("part").parquet(path)
    return parts


def _parts(spark: SparkSession, path: str) -> list[int]:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(there)]
    return sorted(int(x.removeprefix("part=")) for x in names if x.startswith("part="))


def first_matches(spark: SparkSession, path: str, search: Callable[[DataFrame, int], DataFrame], most: int) -> Found:
    """The first ``most`` rows of search(part of the table, how many are wanted), which returns them in order of the key."""
    laid, parts = spark.read.parquet(path), _parts(spark, path)
    found, at, wave, schema = [], 0, 1, search(laid, most).schema
    while at < len(parts) and len(found) < most:
        own = parts[at : at + wave]
        found += search(laid.where(F.col("part").between(own[0], own[-1])).drop("part"), most - len(found)).collect()
        at, wave = at + len(own), 2 * wave
    return Found(spark.createDataFrame(found, schema), at, len(parts))


def grep_first(spark: SparkSession, path: str, key: str, text: str, pattern: str, regex: bool | None = None, ignore_case: bool = False, most: int = 100) -> Found:
    """As lexical.grep over the table laid out below path, reading only the parts that hold the first matches."""
    most = max(1, min(500, most))
    return first_matches(spark, path, lambda rows, n: grep(rows, key, F.col(text), pattern, regex, ignore_case, n), most)
