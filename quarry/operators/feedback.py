"""Search events, how their results were used, and the training examples that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import location


def kept_last(rows: DataFrame, keys: list[str], order: str, n: int = 100) -> DataFrame:
    """The last n rows of each key: bounded history."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def kept_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with the same keys the first in order: combined in every task before they meet."""
    others = [c for c in rows.columns if c not in keys and c not in order]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_o"), F.min_by(F.struct(F.lit(0).alias("_none"), *others), F.struct(*order)).alias("_r"))
    return first.select(*keys, *[F.col("_o")[c].alias(c) for c in order], *[F.col("_r")[c].alias(c) for c in others]).select(*rows.columns)


def after_cursor(rows: DataFrame, key: str, since: int, limit: int) -> DataFrame:
    """The last ``limit`` (1..100) rows past the cursor, in order."""
    return rows.where(F.col(key) > since).orderBy(F.col(key).desc()).limit(max(1, min(100, limit))).orderBy(key)


def merged_latest(rows: DataFrame, key: str, version: str, n: int = 20) -> DataFrame:
    """The newest version of each key, the n largest keys."""
    columns = [c for c in rows.columns if c != key]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(version)).alias("_r"))
    return newest.orderBy(F.col(key).desc()).limit(n).select(key, "_r.*")


def usage_union(reports: DataFrame, key: str, values: str) -> DataFrame:
    """Per event all referenced values of its reports, sorted and distinct."""
    return reports.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias(values), F.count(F.lit(1)).alias("reports"))


def children(events: DataFrame, key: str, parent: str) -> DataFrame:
    """Parents with the sorted ids of their children."""
    return events.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(key)).agg(F.array_sort(F.collect_set(key)).alias("child_ids"))


def training_examples(results: DataFrame, used: DataFrame, event: str, key: str) -> DataFrame:
    """results (event, key, rank, ..) with label: 1 if used, else a weak negative; above_used marks skipped ones ranked above a used one.

    Events without any use give no example.
    """
    marks = used.select(event, key).distinct().withColumn("_used", F.lit(1))
    joined = results.join(marks, [event, key], "left")
    last = F.max(F.when(F.col("_used") == 1, F.col("rank"))).over(Window.partitionBy(event))
    both = joined.withColumn("_last", last).where(F.col("_last").isNotNull())
    label = F.coalesce("_used", F.lit(0))
    return both.withColumn("label", label).withColumn("above_used", (label == 0) & (F.col("rank") < F.col("_last"))).drop("_used", "_last")


def _bare(path: Column) -> Column:
    """Forward slashes, and no dots or slashes in front."""
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^[./]+", "")


def usage_examples(events: DataFrame, results: DataFrame, usage: DataFrame) -> DataFrame:
    """Training examples of every usage report: what was referenced, by rank or by location, and what wasn't.

    events: event_id, directory, query. results: event_id, rank, file, path, lineno, end_lineno, name, code. usage: usage_id, event_id,
    referenced_ranks array<long>, referenced_locations array<string> (path, path:line or path:line-end).
    A location names the first result by rank whose path, file or file below the directory it is, and whose
    lines hold its line; a result without lines holds any. A result is one example, by rank if it can; results that
    nothing references are weak negatives, and events without a query give none.
    """
    identity = F.concat_ws(":", F.coalesce("file", F.lit("")), F.coalesce(F.col("lineno").cast("string"), F.lit("")), F.coalesce(F.col("end_lineno").cast("string"), F.lit("")), F.coalesce("name", F.lit("")))
    told = F.transform(F.filter(F.array_distinct(F.transform("referenced_locations", lambda x: F.trim(x))), lambda x: x != ""), lambda x: F.struct(x.alias("location"), location(x).alias("at")))
    told = F.transform(told, lambda x: F.struct(x["location"].alias("location"), _bare(x["at"]["path"]).alias("path"), x["at"]["begin"].alias("line")))
    asked = usage.withColumn("_told", told).join(events.where(F.coalesce("query", F.lit("")) != "").select("event_id", "directory", "query"), "event_id")
    below = F.when(F.startswith("file", F.concat("directory", F.lit("/"))), F.expr("substring(file, length(directory) + 2)"))
    spellings = F.array(_bare(F.col("path")), F.regexp_replace("file", r"\\", "/"), below)
    holds = lambda x: x["line"].isNull() | F.col("lineno").isNull() | x["line"].between(F.col("lineno"), F.coalesce("end_lineno", "lineno"))
    each = asked.join(results, "event_id").withColumn("identity", identity).withColumn("_paths", spellings).withColumn("_known", F.col("usage_id").isNotNull())
    names = F.transform(F.filter("_told", lambda x: F.col("_known") & F.array_contains("_paths", x["path"]) & holds(x)), lambda x: x["location"])
    each = each.select(
        "usage_id", "event_id", "query", "rank", "file", "lineno", "end_lineno", "name", "code", "identity", names.alias("_names"), F.array_max("referenced_ranks").alias("_most"),
        (F.col("_known") & F.coalesce(F.array_contains("referenced_ranks", F.col("rank")), F.lit(False))).alias("_by_rank"),
    )
    # A result is a row for each location that names it, or one row; the first of them stands for the result itself.
    rows = each.select("*", F.posexplode_outer("_names").alias("_nth", "location")).withColumn("_itself", F.coalesce(F.col("_nth") == 0, F.lit(True))).drop("_names", "_nth")
    # Rows lie together by event as the join left them: windows only sort.
    spot = Window.partitionBy("event_id", "usage_id", "location")
    same = Window.partitionBy("event_id", "usage_id", "identity")
    named = F.col("location").isNotNull() & (F.struct("rank", "identity") == F.min(F.struct("rank", "identity")).over(spot))
    rows = rows.withColumn("_named", named)
    rows = rows.withColumns({"_ranked": F.max("_by_rank").over(same), "_first": F.min(F.when(F.col("_named"), F.struct("location", "rank"))).over(same)})
    # Of several references to one result, the rank comes first, then the first location.
    source = (
        F.when(F.col("_by_rank") & F.col("_itself"), "referenced_rank")
        .when(~F.col("_ranked") & F.col("_named") & (F.struct("location", "rank") == F.col("_first")), "referenced_location")
        .when((~F.col("_ranked") & F.col("_first").isNull() | F.col("usage_id").isNull()) & F.col("_itself"), "returned_not_referenced")
    )
    negative = F.col("label_source") == "returned_not_referenced"
    return rows.withColumn("label_source", source).where(F.col("label_source").isNotNull()).select(
        "usage_id", "event_id", "query", "rank", "file", "lineno", "end_lineno", "name", F.when(F.coalesce("code", F.lit("")) != "", F.sha2("code", 256)).alias("code_sha256"),
        F.when(negative, "weak_negative").otherwise("positive").alias("label"), "label_source", F.when(F.col("label_source") == "referenced_location", F.col("location")).alias("location"),
        F.when(negative, F.coalesce(F.col("rank") < F.col("_most"), F.lit(False))).alias("rank_above_referenced"),
    )
