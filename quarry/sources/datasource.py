"""Trees and event logs as sources that Spark plans: spark.read.format("quarry_tree"), spark.readStream.format("quarry_events").

``register(spark)`` makes both known. A tree has (path, suffix, ref, content): the driver lists names, partitions
of them are read by executors from the shared root. Filters on path and suffix cut the list before anything is
read, a filter on ref reads that commit instead of the work tree. An event log is a folder of .jsonl files whose names
ascend; its stream's offset is the last name, its partitions are files, and a restarted stream goes on behind it.
"""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from quarry.sources.git import git, safe_ref, visible_files, walk

TREE = "path string, suffix string, ref string, content binary"
FILES_A_PARTITION = 200


def suffix_of(path: str) -> str:
    return os.path.splitext(path)[1]


class Names(InputPartition):
    def __init__(self, names: Sequence[str], ref: str = ""):
        self.names, self.ref = list(names), ref


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.ref = os.path.abspath(options["path"]), options.get("ref", "")
        self.plain = options.get("git", "true").lower() == "false"
        self.each = int(options.get("filesapartition", options.get("filesAPartition", str(FILES_A_PARTITION))))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on names are taken over; the rest is Spark's."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column == "ref" and isinstance(f.value, str):
                self.ref = f.value
            elif isinstance(f, EqualTo | In) and column in ("path", "suffix"):
                self.tests.append((column, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif isinstance(f, StringEndsWith | StringStartsWith) and column == "path":
                self.tests.append((column, "ends" if isinstance(f, StringEndsWith) else "starts", f.value))
            else:
                yield f

    def _wanted(self, name: str) -> bool:
        of = {"path": name, "suffix": suffix_of(name)}
        return all(of[c] in v if how == "in" else of[c].endswith(v) if how == "ends" else of[c].startswith(v) for c, how, v in self.tests)

    def partitions(self) -> list[Names]:
        if self.ref:
            names = [x for x in git(self.root, "ls-tree", "-r", "-z", "--name-only", safe_ref(self.ref)).split("\0") if x]
        else:
            names = walk(self.root) if self.plain else visible_files(self.root)
        names = [x for x in names if self._wanted(x)]
        return [Names(names[i : i + self.each], self.ref) for i in range(0, len(names), self.each)] or [Names([])]

    def read(self, partition: Names) -> Iterator[tuple]:
        for name in partition.names:
            try:
                if partition.ref:
                    content = subprocess.run(["git", "-C", self.root, "show", f"{partition.ref}:{name}"], capture_output=True, check=True).stdout
                else:
                    with open(os.path.join(self.root, name), "rb") as f:
                        content = f.read()
            except (OSError, subprocess.CalledProcessError):
                content = None
            yield name, suffix_of(name), partition.ref, content


class TreeSource(DataSource):
    """Options: path, ref (a commit; by default the work tree), git (false: a plain walk), filesAPartition."""

    @classmethod
    def name(cls) -> str:
        return "quarry_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


class EventReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder, self.fields = options["path"], [(f.name, f.dataType.simpleString()) for f in schema]

    def _names(self) -> list[str]:
        return sorted(x for x in os.listdir(self.folder) if x.endswith(".jsonl") and x[0] not in "._") if os.path.isdir(self.folder) else []

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        return {"file": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Names]:
        return [Names([x]) for x in self._names() if start["file"] < x <= end["file"]]

    def read(self, partition: Names) -> Iterator[tuple]:
        for name in partition.names:
            with open(os.path.join(self.folder, name), encoding="utf-8") as f:
                for line in f:
                    try:
                        row = json.loads(line)
                    except ValueError:
                        continue
                    if isinstance(row, dict):
                        yield tuple(row.get(c) for c, _ in self.fields)

    def commit(self, end: dict) -> None:
        pass


class EventSource(DataSource):
    """Options: path. Give it the schema of the events; lines that are no objects are skipped."""

    @classmethod
    def name(cls) -> str:
        return "quarry_events"

    def schema(self) -> str:
        return "event_id long, created_at double, query string"

    def streamReader(self, schema: StructType) -> EventReader:
        return EventReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    spark.dataSource.register(EventSource)
