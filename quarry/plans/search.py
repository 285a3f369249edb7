"""The search pipeline over a symbol table: scope, branches, blend, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.globs import allowed
from quarry.functions.projections import bm25_text, keyword_text
from quarry.operators.fuse import blend, min_max, top_ranked
from quarry.operators.lexical import bm25, keyword_match
from quarry.operators.vector import distances, nearest, semantic_scores
from quarry.plans.requests import Search


def scoped(symbols: DataFrame, request: Search, files: DataFrame | None = None) -> DataFrame:
    """Globs and the file list, before any statistic: null files mean all, an empty table none."""
    out = symbols.where(allowed(F.col("file"), request.include_globs, request.exclude_globs))
    if request.include_files is not None:
        out = out.where(F.col("file").isin(*request.include_files) if request.include_files else F.lit(False))
    return out if files is None else out.join(files, "file", "left_semi")


def search(symbols: DataFrame, request: Search, query_vector: list[float] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Ranked symbols with score and its parts. symbols: symbol_id, embedding and SYMBOL columns."""
    scope = scoped(symbols, request, files)
    key = "symbol_id"
    if request.mode == "keyword":
        found = scope.where(keyword_match(keyword_text(scope), request.query)).orderBy("file", "lineno").limit(request.top_k)
        return found.select(symbols["*"], F.lit(None).cast("double").alias("score"))
    if request.mode == "semantic":
        best = semantic_scores(nearest(scope, key, "embedding", query_vector, request.top_k), key)
        ranked = top_ranked(best.withColumn("score", F.col("semantic")), "score", key, request.top_k)
    else:
        lexical = min_max(bm25(scope, key, bm25_text(scope), request.query), "bm25", "lexical")
        if request.mode == "bm25":
            every = scope.select(key).join(lexical, key, "left").select(key, F.coalesce("lexical", F.lit(0.0)).alias("score"))
        else:
            every = blend(semantic_scores(distances(scope, key, "embedding", query_vector), key), lexical, key, request.semantic_weight)
        ranked = top_ranked(every, "score", key, request.top_k)
    return scope.join(F.broadcast(ranked), key).orderBy("rank")  # at most 50 ranked rows
