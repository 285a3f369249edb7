"""What the operators of this subpackage share: the shared folder, written tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory, long texts included.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's spark.checkpoint.dir. Where that is unset (tests in local mode) a
    folder under the system's temporary folder takes its place.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "quarry-checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for one run of one operator below the shared folder."""
    return f"{checkpoint_root(spark)}/quarry/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage at a table that survives executors."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def make_folder(spark: SparkSession, path: str) -> None:
    """Make a folder below the shared folder before executors write files of their own into it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder, in whatever store that is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_spread(many: DataFrame, one: DataFrame, key: list[str], by: str, how: str = "inner") -> DataFrame:
    """many.join(one, key, how), where one has a row for each key and a key may hold a third of many.

    Rows of a key go to as many tasks as shuffles have, by what the column ``by`` hashes to. A row of
    one goes to each of the parts that its key has rows in, which a distinct finds that combines
    before it shuffles: at most a row for each part, however many rows the key has.
    """
    parts = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.withColumn("spread_part", F.pmod(F.xxhash64(by), F.lit(parts)))
    told = dealt.select(*key, "spread_part").distinct().join(one, key)
    return dealt.join(told, [*key, "spread_part"], how).drop("spread_part")


def _give_back() -> None:
    """Return what this worker freed to the system: an idle worker waits with it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, and a worker that is done gives its memory back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make(batches)
        finally:
            _give_back()

    return df.mapInArrow(run, schema)


def kept_struct(docs: DataFrame, keep: list[str]) -> Column:
    """The columns ``keep`` as one struct ``kept``: their names clash with nothing."""
    return F.struct(*[docs[c] for c in keep]).alias("kept")


def map_kept(held: DataFrame, keep: list[str], make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], results: str) -> DataFrame:
    """The columns ``keep`` beside results; make yields ``kept``, which held has, and the results.

    A kept column that bears the name of a result comes back with ``_kept`` after it.
    """
    own = StructType.fromDDL(results)
    out = map_batches(held, make, StructType([held.schema["kept"], *own.fields]))
    return out.select(*[F.col("kept")[c].alias(f"{c}_kept" if c in own.names else c) for c in keep], *own.names)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow integer column as (int64 values with 0 for null, mask of the non-null rows)."""
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), dtype=bool)
    return np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), valid


def maybe(values, valid: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values as an Arrow array, null where valid is false."""
    return pa.array(values, type=kind, mask=~np.asarray(valid, dtype=bool))
