"""Incremental catalog: what changed between two states of a tree, and which vectors stay valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def symbol_id(file: Column, name: Column, begin: Column, end: Column, code: Column) -> Column:
    """Identity of a symbol, its code included: an edit that keeps the span makes a new symbol."""
    return F.sha2(F.concat_ws("|", file, name, begin.cast("string"), end.cast("string"), content_hash(code)), 256)


def catalog_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) over both catalogs (path, hash): added, modified, deleted or unchanged."""
    a = old.select("path", F.col("hash").alias("_old"))
    b = new.select("path", F.col("hash").alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "deleted")
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .otherwise("modified")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def is_fresh(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: whether nothing differs, and how many paths do."""
    changed = catalog_diff(old, new).agg(F.count_if(F.col("status") != "unchanged").alias("changed"))
    return changed.select((F.col("changed") == 0).alias("fresh"), "changed")


def reuse(symbols: DataFrame, vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(symbols whose vector is kept, symbols to embed), by key."""
    return symbols.join(vectors.select(key).distinct(), key, "left_semi"), symbols.join(vectors.select(key), key, "left_anti")
