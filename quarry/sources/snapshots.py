"""Versioned tables: deltas and tombstones, read as of a version.

A table is a folder of data folders and numbered manifests. Every write puts a new data folder down and
then one manifest, which names the data folders that make up its version: it is written beside its place
and moved there by one rename that fails if the number is taken. So a write that dies midway leaves the
version before it, and of two writers of one version one has to try again.

* ``append`` keeps the rows of a batch: whole rows for keys that are new or changed, tombstones for keys that
  are gone. Nothing else is written again. A batch may carry an epoch; an epoch that is in already is skipped.
* ``replace`` starts anew (a forced rebuild), ``clear`` with nothing.
* ``compact`` writes the rows of a version into one folder.
* ``vacuum`` deletes data folders that none of the last versions names, those of dead writes included.

``read`` takes the newest row of each key: one exchange by key, and none for a version of one folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of data folders beside the table's own.
VERSION, GONE = "_version", "_gone"


def _fs(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, there = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(x.removesuffix(".json")) for x in _names(spark, f"{root}/manifests") if x.endswith(".json") and x[0] != "."]


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The manifest of a version, by default the last; None if there is none."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        return None
    fs, there = _fs(spark, f"{root}/manifests/{max(known) if version is None else version:012d}.json")
    stream = fs.open(there)
    try:
        scanner = spark.sparkContext._jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
        return json.loads(scanner.next())
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, version: int, said: dict) -> None:
    """Put down the manifest of a version; FileExistsError if another writer was first."""
    jvm = spark.sparkContext._jvm
    fs, folder = _fs(spark, f"{root}/manifests")
    fs.mkdirs(folder)
    draft, place = (jvm.org.apache.hadoop.fs.Path(f"{root}/manifests/{x}") for x in (f".{uuid.uuid4().hex}", f"{version:012d}.json"))
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(said | {"version": version}, sort_keys=True).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, place, none)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(place):
            raise FileExistsError(f"version {version} of {root} is taken") from e
        raise


def _put(rows: DataFrame, root: str, version: int) -> str:
    name = f"{version:012d}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(f"{root}/data/{name}")
    return name


def append(root: str, rows: DataFrame, key: str, gone: DataFrame | None = None, epoch: int | None = None, **said) -> int:
    """Add a batch: rows by their key (distinct), keys that are gone; the number of the version that has it."""
    spark = rows.sparkSession
    last = manifest(spark, root) or {"version": 0, "folders": [], "schema": None}
    if epoch is not None and epoch <= last.get("epoch", -1):
        return last["version"]
    version = last["version"] + 1
    delta = rows.select("*", F.lit(version).cast("long").alias(VERSION), F.lit(False).alias(GONE))
    if gone is not None:
        own = [F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
        delta = delta.unionByName(gone.select(key).distinct().select(*own, F.lit(version).cast("long").alias(VERSION), F.lit(True).alias(GONE)))
    folder = _put(delta, root, version)
    told = {k: v for k, v in last.items() if k not in ("folders", "schema")} | said | ({} if epoch is None else {"epoch": epoch})
    commit(spark, root, version, told | {"folders": [*last["folders"], folder], "schema": delta.schema.json(), "key": key})
    return version


def replace(root: str, rows: DataFrame, key: str, **said) -> int:
    """A version that has these rows alone: a forced rebuild."""
    spark = rows.sparkSession
    version = ((manifest(spark, root) or {}).get("version") or 0) + 1
    whole = rows.select("*", F.lit(version).cast("long").alias(VERSION), F.lit(False).alias(GONE))
    folder = _put(whole, root, version)
    commit(spark, root, version, said | {"folders": [folder], "schema": whole.schema.json(), "key": key, "compact": True})
    return version


def clear(spark: SparkSession, root: str) -> int:
    """A version without rows; vacuum then deletes what the versions before it had."""
    last = manifest(spark, root)
    if last is None:
        return 0
    commit(spark, root, last["version"] + 1, {"folders": [], "schema": last["schema"], "key": last["key"]})
    return last["version"] + 1


def history(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """All rows and tombstones of a version's folders, with the number of the write that has them."""
    from pyspark.sql.types import StructType

    said = manifest(spark, root, version)
    if said is None:
        return None
    schema = StructType.fromJson(json.loads(said["schema"]))
    if not said["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/data/{x}" for x in said["folders"]])


def read(spark: SparkSession, root: str, version: int | None = None, with_version: bool = False) -> DataFrame | None:
    """The rows of a version, by default the last; None if there is none."""
    said, rows = manifest(spark, root, version), history(spark, root, version)
    if rows is None:
        return None
    if not (said.get("compact") and len(said["folders"]) == 1):
        newest = Window.partitionBy(said["key"]).orderBy(F.desc(VERSION))
        rows = rows.withColumn("_nth", F.row_number().over(newest)).where((F.col("_nth") == 1) & ~F.col(GONE)).drop("_nth")
    return rows.drop(GONE) if with_version else rows.drop(GONE, VERSION)


def compact(spark: SparkSession, root: str) -> int:
    """Write the last version's rows into one folder; they keep the number of the write that they come from."""
    last = manifest(spark, root)
    rows = read(spark, root, with_version=True)
    version = last["version"] + 1
    folder = _put(rows.withColumn(GONE, F.lit(False)), root, version)
    told = {k: v for k, v in last.items() if k not in ("folders", "compact")}
    commit(spark, root, version, told | {"folders": [folder], "compact": True})
    return version


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete data folders that none of the last ``keep`` versions names, and the manifests before those.

    No write may be under way: its folder has no manifest yet.
    """
    known = versions(spark, root)
    named = {x for v in known[-keep:] for x in manifest(spark, root, v)["folders"]}
    gone = [x for x in _names(spark, f"{root}/data") if x not in named]
    for path in [*(f"{root}/manifests/{v:012d}.json" for v in known[:-keep]), *(f"{root}/data/{x}" for x in gone)]:
        fs, there = _fs(spark, path)
        fs.delete(there, True)
    return gone
