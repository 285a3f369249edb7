"""The folder tree of a set of paths, with what an ignore list checks in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that no tree shows, the depth and the number of nodes that it stops at.
HIDDEN = (".git", ".svn", ".hg")
DEPTH, MOST_DEPTH, MOST_NODES = 4, 8, 1500


def _plain(pattern: str) -> str:
    pattern = pattern.strip().replace("\\", "/").rstrip("/")
    return pattern.removeprefix("./")


def ignore_tree(paths: DataFrame, path: Column, patterns: list[str], depth: int = DEPTH, most: int = MOST_NODES) -> DataFrame:
    """(rel_path, name, depth, parent, checked, state) of the folders of relative file paths.

    Levels are opened one below the other until ``most`` nodes are shown, in order of their paths inside a
    level, so a node's parent is always there. checked: the folder is a pattern itself. state: ``all`` if it is
    or lies below one, or if that holds of every folder without further folders under it; ``some`` if it holds of
    any; else ``none``. The nodes are few, but they are a plan like any other: leaves vote for the folders above.
    """
    depth = max(1, min(MOST_DEPTH, depth))
    parts = paths.select(F.split(F.regexp_replace(path, "^(\\./)+", ""), "/").alias("s"))
    folders = parts.select(F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))).alias("s"))
    hidden = lambda s: F.exists(s, lambda x: x.isin(*HIDDEN, "", ".."))
    prefixes = folders.distinct().where(F.size("s") > 0).select("s", F.explode(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(depth)))).alias("depth"))
    dirs = prefixes.select(F.slice("s", 1, F.col("depth")).alias("s"), "depth").distinct().where(~hidden(F.col("s")))
    nodes = dirs.withColumn("rel_path", F.array_join("s", "/")).orderBy("depth", "rel_path").limit(most)
    wanted = [x for x in map(_plain, patterns) if x]
    above = F.transform(F.sequence(F.lit(1), F.col("depth")), lambda k: F.array_join(F.slice("s", 1, k), "/"))
    checked = F.col("rel_path").isin(*wanted) if wanted else F.lit(False)
    covered = F.exists(above, lambda p: p.isin(*wanted)) if wanted else F.lit(False)
    shown = nodes.select("rel_path", F.element_at("s", -1).alias("name"), "depth", F.when(F.col("depth") > 1, F.array_join(F.slice("s", 1, F.col("depth") - 1), "/")).otherwise(F.lit(".")).alias("parent"), checked.alias("checked"), covered.alias("_covered"), above.alias("_above"))
    leaves = shown.join(shown.select(F.col("parent").alias("rel_path")).distinct(), "rel_path", "left_anti")
    votes = leaves.select(F.explode("_above").alias("rel_path"), "_covered").groupBy("rel_path").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_covered").alias("_yes"))
    marked = shown.where("checked").select(F.explode("_above").alias("rel_path")).distinct().withColumn("_marked", F.lit(True))
    state = F.when(F.col("_covered") | (F.col("_yes") == F.col("_n")), "all").when((F.col("_yes") > 0) | F.col("_marked"), "some").otherwise("none")
    return shown.join(votes, "rel_path").join(marked, "rel_path", "left").select("rel_path", "name", "depth", "parent", "checked", state.alias("state"))
