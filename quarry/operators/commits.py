"""Commit graphs: edges, references, lanes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parent_edges(commits: DataFrame) -> DataFrame:
    """(child, parent) edges whose parent is in the window."""
    edges = commits.select(F.col("hash").alias("child"), F.explode("parents").alias("parent"))
    return edges.join(commits.select(F.col("hash").alias("parent")), "parent", "left_semi").select("child", "parent")


def resolve(refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(ref, hash, subject): an exact name, or a prefix of four characters at least."""
    match = (F.col("ref") == F.col("hash")) | (F.col("ref") == F.col("short")) | ((F.length("ref") >= 4) & F.startswith("hash", F.col("ref")))
    # Four characters agree in every match, which makes it an equality join.
    left = refs.withColumn("_head", F.left("ref", F.lit(4)))
    return left.join(commits.withColumn("_head", F.left("hash", F.lit(4))), "_head").where(match).select("ref", "hash", "subject")


MOST_COMMITS = 1000


def assign_lanes(rows: list[tuple[str, list[str]]]) -> list[int]:
    """The lane of each (hash, parents), children before parents.

    A lane awaits one hash. A commit takes the first lane that awaits it, or the first free one,
    and frees the others that do. Its lane then awaits its first parent, whoever else does; a
    further parent that nobody awaits gets the first free lane.
    """
    awaits: dict[int, str] = {}
    free = lambda: next(k for k in range(len(awaits) + 1) if k not in awaits)
    out = []
    for name, parents in rows:
        mine = sorted(k for k, h in awaits.items() if h == name)
        lane = mine[0] if mine else free()
        for k in mine:
            del awaits[k]
        if parents:
            awaits[lane] = parents[0]
        for parent in parents[1:]:
            if parent not in awaits.values():
                awaits[free()] = parent
        out.append(lane)
    return out


def lanes(commits: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """(hash, lane) of the first ``most`` (1..1000) commits by ``position``: a graph view is that long, and lanes depend on all before."""

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        return pd.DataFrame({"hash": rows["hash"], "lane": assign_lanes([(h, list(p)) for h, p in zip(rows["hash"], rows["parents"], strict=True)])})

    window = commits.orderBy("position").limit(max(1, min(MOST_COMMITS, most)))
    return window.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(assign, "hash string, lane int")
