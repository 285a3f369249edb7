"""Calls and the modules they go to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def external_calls(calls: DataFrame, imports: DataFrame, key: str) -> DataFrame:
    """Of the calls (key, call), those that are an imported name of the same key (key, name) or begin with one and a dot.

    Every import that a dotted call can begin with is one of its own prefixes, so the test is an
    equality on key and prefix, whatever the number of imports.
    """
    parts = F.split("call", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))
    each = calls.select(key, "call").distinct().select(key, "call", F.explode(prefixes).alias("name"))
    return each.join(imports.select(key, "name").distinct(), [key, "name"]).select(key, "call").distinct()
