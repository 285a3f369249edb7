"""Sessions and tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are planned for; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str, root: str | None = None) -> str:
    """A new folder below ``root``: by default spark.checkpoint.dir, which the driver and all executors share.

    Only in local mode, where that is unset, a temporary folder takes its place.
    """
    root = root or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quarry-shared")
    path = f"{root.rstrip('/')}/quarry/{name}-{uuid.uuid4().hex}"
    # What a lazy result still reads has to stay; it goes with the session.
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(there)
    store.deleteOnExit(there)
    return path
