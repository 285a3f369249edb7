"""The persisted index: versions of symbols, vectors and a manifest, by workspace and extension."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import snapshots


def index_name(directory: str, ext: str) -> str:
    full = os.path.abspath(directory)
    return f"{os.path.basename(full)}_{hashlib.md5(full.encode()).hexdigest()[:16]}/{ext.lstrip('.')}"


def signature(**parameters) -> str:
    """Digest of the canonical JSON of named parameters."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save(root: str, workspace: str, ext: str, manifest: dict, **tables: DataFrame) -> int:
    """Write each table into a folder of its own and then the manifest of a new version, which names them.

    Until then the version before counts, and readers of it go on: nothing is overwritten.
    """
    spark, base = next(iter(tables.values())).sparkSession, f"{root}/{workspace}/{ext}"
    version = max(snapshots.versions(spark, base), default=0) + 1
    folders = {name: f"{version:012d}-{name}-{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.write.parquet(f"{base}/data/{folders[name]}")
    snapshots.commit(spark, base, version, {"manifest": manifest, "tables": folders, "folders": sorted(folders.values())})
    return version


def load(spark: SparkSession, root: str, workspace: str, ext: str, version: int | None = None, **expected) -> dict | None:
    """{"manifest": .., name: DataFrame}; None if there is no index or the manifest disagrees with what is expected."""
    base = f"{root}/{workspace}/{ext}"
    said = snapshots.manifest(spark, base, version)
    if said is None or any(said["manifest"].get(k) != v for k, v in expected.items()):
        return None
    return {"manifest": said["manifest"]} | {name: spark.read.parquet(f"{base}/data/{folder}") for name, folder in said["tables"].items()}


def clear_cache(spark: SparkSession, root: str, workspace: str, ext: str, disk: bool = False) -> None:
    """Forget what Spark holds in memory; with ``disk`` delete the index, all of its versions."""
    spark.catalog.clearCache()
    if disk:
        fs, there = snapshots._fs(spark, f"{root}/{workspace}/{ext}")
        fs.delete(there, True)


def append_jsonl(examples: DataFrame, path: str) -> None:
    examples.withColumn("schema_version", F.lit(1)).write.mode("append").json(path)


def tail_jsonl(spark: SparkSession, path: str, schema: str, order: str, limit: int = 50) -> DataFrame:
    """The last rows (1..200) in order; lines that don't parse are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.orderBy(F.col(order).desc()).limit(max(1, min(200, limit))).orderBy(order)
