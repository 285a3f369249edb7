"""Scores relative to a candidate set, blending, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEMANTIC_WEIGHT, COMMIT_WEIGHT = 0.75, 0.6
HIGH, MIDDLE = 0.7, 0.4


def min_max(scores: DataFrame, column: str, out: str, nearer_is_better: bool = False) -> DataFrame:
    """scores with ``out``: 0..1 between the set's extremes, 1 if they are equal.

    The extremes are a one-row aggregate that is broadcast, not a window over everything.
    """
    ends = scores.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    share = (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low"))
    share = 1 - share if nearer_is_better else share
    bounded = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return scores.crossJoin(F.broadcast(ends)).withColumn(out, bounded).drop("_low", "_high")


def blend(semantic: DataFrame, lexical: DataFrame, key: str, weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """(key, semantic, lexical, score) over the candidates of either; what is missing counts 0."""
    w = max(0.0, min(1.0, weight))
    both = semantic.select(key, "semantic").join(lexical.select(key, "lexical"), key, "full_outer")
    both = both.select(key, F.coalesce("semantic", F.lit(0.0)).alias("semantic"), F.coalesce("lexical", F.lit(0.0)).alias("lexical"))
    return both.withColumn("score", F.lit(w) * F.col("semantic") + F.lit(1 - w) * F.col("lexical"))


def top_ranked(scored: DataFrame, score: str, key: str, k: int) -> DataFrame:
    """The k best with rank 1.., by score and then key; only k rows meet for the rank."""
    best = scored.orderBy(F.col(score).desc(), F.col(key)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(key))).cast("long"))


def band(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MIDDLE, "mid").otherwise("low")
