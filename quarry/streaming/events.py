"""Streams: event counts, sessions, incremental catalogs, linked events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import snapshots


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begin, event_type, n) per window; late rows count while the watermark allows."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("begin"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, begin, n): a session closes when the watermark passes its gap."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("begin"), "n")


def upsert_catalog(spark: SparkSession, path: str, compact_every: int = 50):
    """A foreachBatch sink that keeps (path, hash) as a versioned table: a batch writes what it changes.

    Rows of a batch are (path, hash, version); of a path the newest counts, and a null hash is a deletion.
    A batch that comes again after a restart is in already. The version before is compared with the paths of the
    batch alone, to leave out hashes that are as before.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        newest = batch.groupBy("path").agg(F.max_by("hash", "version").alias("hash"))
        before = snapshots.read(session, path)
        if before is not None:
            old = before.join(newest.select("path"), "path", "left_semi").select("path", F.col("hash").alias("_old"))
            newest = newest.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")
        snapshots.append(path, newest.where("hash IS NOT NULL"), "path", newest.where("hash IS NULL").select("path"), epoch=epoch)
        if (epoch + 1) % compact_every == 0:
            snapshots.compact(session, path)
            snapshots.vacuum(session, path, keep=2)

    return apply


def linked(searches: DataFrame, greps: DataFrame) -> DataFrame:
    """Each grep with the last search of its session and directory before it."""
    from quarry.operators.ranges import as_of

    a = greps.withColumn("_key", F.concat_ws("|", "session", "directory"))
    b = searches.withColumn("_key", F.concat_ws("|", "session", "directory")).select("_key", "ts", F.col("event_id").alias("parent_event_id"))
    return as_of(a, b, "_key", "ts", "ts", "parent_event_id").drop("_key")
