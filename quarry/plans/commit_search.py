"""Search over commits: units are a commit's files, scores are a commit's best unit and its message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.fuse import min_max, top_ranked
from quarry.operators.lexical import bm25, keyword_match, matched_keywords
from quarry.operators.vector import distances, semantic_scores
from quarry.plans.requests import Search

KEY = "commit_key"


def search_commits(units: DataFrame, request: Search, query_vector: list[float] | None = None) -> DataFrame:
    """One row for each of the best commits, with the entries of all its files.

    units: commit_key, position (distinct, in order of the diff), path, lineno, additions, deletions, file_hunk_count,
    commit_message, search_text and, for semantic and hybrid modes, embedding. The unit that
    represents a commit is its best one, the last of equals, or in keyword mode the first that matches.
    """
    if request.mode == "keyword":
        matched = F.min_by(matched_keywords(F.col("search_text"), request.query), "position")
        hits = units.where(keyword_match(F.col("search_text"), request.query)).groupBy(KEY).agg(F.min("position").alias("representative"), matched.alias("matched_keywords"))
        first = hits.withColumn("_early", -F.col("representative"))
        none = F.lit(None).cast("double")
        best = top_ranked(first, "_early", KEY, request.top_k).select(KEY, "rank", "representative", "matched_keywords", none.alias("score"), F.lit(0.0).alias("semantic"), F.lit(0.0).alias("lexical"))
        scored = units.withColumn("semantic", F.lit(0.0))
    else:
        scored = units.withColumn("semantic", F.lit(0.0))
        if request.needs_vectors:
            measured = semantic_scores(distances(units, "position", "embedding", query_vector), "position")
            scored = units.join(measured.select("position", "semantic"), "position")
        commits = scored.groupBy(KEY).agg(
            F.max("semantic").alias("semantic"), F.max_by("position", F.struct("semantic", "position")).alias("representative"), F.min_by("commit_message", "position").alias("message")
        )
        both = commits.withColumn("lexical", F.lit(0.0))
        if request.mode != "semantic":
            said = min_max(bm25(commits, KEY, F.col("message"), request.query), "bm25", "lexical").select(KEY, "lexical")
            both = commits.join(said, KEY, "left")
            if request.mode == "bm25":  # commits that say nothing of the query count only if all do
                some = said.agg((F.count(F.lit(1)) > 0).alias("_some"))
                both = both.crossJoin(F.broadcast(some)).where("lexical IS NOT NULL OR NOT _some").drop("_some")
            both = both.withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
        weight = {"semantic": 1.0, "bm25": 0.0}.get(request.mode, request.commit_weight)
        both = both.withColumn("score", F.round(F.lit(weight) * F.col("semantic") + F.lit(1 - weight) * F.col("lexical"), 12))
        best = top_ranked(both, "score", KEY, request.top_k).withColumn("matched_keywords", F.lit(None).cast("array<string>"))
        best = best.select(KEY, "rank", "representative", "matched_keywords", "score", "semantic", "lexical")
    # At most 50 commits are ranked; their files are gathered for them alone.
    own = scored.join(F.broadcast(best.select(KEY, "representative")), KEY)
    shown = own.withColumn("_shown", F.max(F.when(F.col("position") == F.col("representative"), F.col("path"))).over(Window.partitionBy(KEY)))
    entry = F.struct(
        (-F.col("semantic")).alias("_order"), "position", "path", "lineno", "additions", "deletions", F.col("file_hunk_count").alias("hunk_count"),
        F.col("semantic").alias("score"), F.col("path").eqNullSafe(F.col("_shown")).alias("is_representative"),
    )
    files = shown.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("commit_file_count"), F.sum("file_hunk_count").alias("commit_hunk_count"),
        F.sort_array(F.collect_list(F.struct("position", "path"))).alias("_files"), F.sort_array(F.collect_list(entry)).alias("_hunks"),
    )
    hunks = F.transform("_hunks", lambda x: x.dropFields("_order", "position"))
    listed = files.select(KEY, "commit_file_count", "commit_hunk_count", F.col("_files.path").alias("commit_files"), hunks.alias("commit_hunks"))
    return best.join(listed, KEY)
