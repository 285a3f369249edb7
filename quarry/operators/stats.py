"""Relevance per class or file, histograms, units of changes and their representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_stats(methods: DataFrame, results: DataFrame, cls: str, key: str) -> DataFrame:
    """Per class: methods, hits, summed reciprocal ranks, best rank, share found and the composite score.

    methods: (cls, key); results: (key, rank). A method counts with its best rank only.
    """
    best = results.groupBy(key).agg(F.min("rank").alias("rank"))
    grouped = methods.join(best, key, "left").groupBy(cls).agg(
        F.count(F.lit(1)).alias("method_count"), F.count("rank").alias("search_hits"), F.coalesce(F.sum(1 / F.col("rank")), F.lit(0.0)).alias("weighted_score"),
        F.min("rank").alias("best_rank"),
    )
    share = F.col("search_hits") / F.col("method_count")
    return grouped.withColumn("proportion", share).withColumn("composite_score", F.col("weighted_score") * (1 + share) / 2)


def results_first(symbols: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """symbols with rank: those that were found in order of rank, then the rest in their own order."""
    best = results.groupBy(key).agg(F.min("rank").alias("rank"))
    return symbols.join(best, key, "left").orderBy(F.col("rank").asc_nulls_last(), key)


def placed(symbols: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(key, place) of every symbol in the order of results_first, from 1 on; key is a number.

    Quantiles of the key deal the symbols into ranges, in order and the found ones first. A window
    numbers each range, and the sizes of the ranges before it are added: no window holds everything.
    """
    parts = int(symbols.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = F.array(*[F.lit(x) for x in sorted(set(symbols.approxQuantile(key, [k / parts for k in range(1, parts)], 0.001)))]).cast("array<double>")
    passed = F.coalesce(F.size(F.filter(bounds, lambda b: F.col(key).cast("double") >= b)), F.lit(0))
    best = results.groupBy(key).agg(F.min("rank").alias("rank"))
    below = F.when(F.col("rank").isNotNull(), 0).when(F.col(key).isNull(), 1).otherwise(passed + 1)
    ranged = symbols.join(best, key, "left").select(key, "rank", below.alias("_range"))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("rank").asc_nulls_last(), key))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_range").select(key, (F.col("_before") + F.col("_own")).cast("long").alias("place")).orderBy("place")


def most_common(values: DataFrame, column: str, order: list[str]) -> DataFrame:
    """(column, n) of the most common value; ties go by the given order, others after it by name."""
    place = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        place = F.when(F.col(column) == v, i).otherwise(place)
    return values.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), place, column).limit(1)


def file_units(hunks: DataFrame, keys: list[str], position: str, body: str, added: str, removed: str) -> DataFrame:
    """One row per unit: sums, count, and bodies in order of position."""
    piece = F.struct(F.col(position).alias("p"), F.col(body).alias("b"))
    grouped = hunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hunk_count"), F.sum(added).alias("additions"), F.sum(removed).alias("deletions"), F.sort_array(F.collect_list(piece)).alias("_p"), F.max(position).alias("end_line")
    )
    return grouped.withColumn("text", F.array_join(F.transform("_p", lambda x: x["b"]), "\n")).drop("_p")


def best_unit(units: DataFrame, group: str, score: str, position: str) -> DataFrame:
    """Per group its best score, and the last unit in position that has it."""
    return units.groupBy(group).agg(F.max(score).alias("best"), F.max_by(position, F.struct(score, position)).alias("representative"), F.count(F.lit(1)).alias("units"))
