"""Range, as-of and gaps-and-islands operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(spans: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """spans (key, begin, end, ..) that overlap a range (key, begin, end): a semi join on key with a residual test.

    Ends below their begins count as their begins.
    """
    r = ranges.select(F.col(key).alias("_key"), F.col("begin").alias("_b"), F.greatest("begin", "end").alias("_e"))
    touch = (F.col(key) == F.col("_key")) & (F.col("begin") <= F.col("_e")) & (F.col("_b") <= F.greatest(F.col("end"), F.col("begin")))
    return spans.join(r, touch, "left_semi")


def first_match(points: DataFrame, ranges: DataFrame, key: str, point: str, order: str) -> DataFrame:
    """Each point row (with an id column ``point_id``) with the first range by ``order`` that holds it.

    A point without a line matches every range of its key. The minimum is aggregated per point,
    so candidates never meet in a sort.
    """
    within = F.col(point).isNull() | F.col(point).between(F.col("begin"), F.col("end"))
    found = points.join(ranges, key).where(within)
    return found.groupBy("point_id").agg(F.min(order).alias(order))


def as_of(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str, value: str) -> DataFrame:
    """left with the ``value`` of the last right row of the same key at or before it, null if none.

    Both sides are united and sorted once by key and order: no pairs are made, whatever their number.
    """
    a = left.select(key, F.col(left_order).alias("_o"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(key, F.col(right_order).alias("_o"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn("_found", F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w))
    return joined.where("_side = 1").select("_row.*", F.col("_found").alias(value))


def islands(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, begin, end, n) of maximal runs of consecutive distinct lines.

    One sort by keys and line: lines that begin or end a run are told by their neighbours, and the edges of a run follow
    each other, so nothing is held in a hash table. A null line is a run of its own.
    """
    w = Window.partitionBy(*keys).orderBy(line)
    apart = lambda other, here: other.isNull() | (F.abs(here - other) > 1)  # noqa: E731  repeats of a line are not apart
    here, before, after = F.col(line), F.lag(line).over(w), F.lead(line).over(w)
    opens = F.when(here.isNull(), F.row_number().over(w) == 1).otherwise(apart(before, here))
    edges = lines.select(*keys, line).withColumns({"_opens": opens, "_ends": here.isNull() | apart(after, here)}).where("_opens OR _ends")
    runs = edges.withColumn("end", F.when(F.col("_ends"), here).otherwise(F.lead(line).over(w))).where("_opens")
    return runs.select(*keys, here.alias("begin"), "end", F.coalesce((F.col("end") - here + 1).cast("long"), F.lit(1).cast("long")).alias("n"))


def ranges_text(ranges: Column) -> Column:
    """a-b, c of an array of struct<begin, end>."""
    return F.array_join(F.transform(ranges, lambda r: F.when(r["begin"] == r["end"], r["begin"].cast("string")).otherwise(F.concat_ws("-", r["begin"], r["end"]))), ", ")


def running_lines(hunks: DataFrame, keys: list[str], position: str, sign: str) -> DataFrame:
    """hunk lines with old_line and new_line: counters that context, removals and additions advance."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    old = F.coalesce(F.sum(F.when(F.col(sign).isin(" ", "-"), 1).otherwise(0)).over(w), F.lit(0)) + 1
    new = F.coalesce(F.sum(F.when(F.col(sign).isin(" ", "+"), 1).otherwise(0)).over(w), F.lit(0)) + 1
    return hunks.withColumn("old_line", old).withColumn("new_line", new)
