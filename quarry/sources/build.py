"""Builds that can be cancelled: steps with a tag, each committed, and a next run that takes up what is there."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quarry.sources import snapshots


class Cancelled(RuntimeError):
    """A build was interrupted; what its finished steps wrote stays readable."""


@contextmanager
def tagged(spark: SparkSession, tag: str):
    """Jobs started inside carry the tag, so that another thread can interrupt them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def cancel(spark: SparkSession, root: str, tag: str) -> list[str]:
    """Ask a build to stop before its next step, and interrupt the jobs of the one under way."""
    fs, there = snapshots._fs(spark, f"{root}/cancelled-{tag}")
    fs.create(there, True).close()
    return spark.interruptTag(tag)


def build_in_steps(root: str, step: Callable[[int], DataFrame], steps: int, key: str, signature: str, tag: str | None = None, spark: SparkSession | None = None, on_step: Callable[[int, int], None] | None = None) -> int:
    """Append step(0), step(1), .. to the versioned table at root; the number of steps that this run did.

    signature: what the build is made from. A table of the same signature goes on behind its last step, another one
    begins anew. Cancelled is raised once the build was asked to stop.
    """
    spark = spark or SparkSession.active()
    tag = tag or f"build-{uuid.uuid4().hex}"
    fs, wish = snapshots._fs(spark, f"{root}/cancelled-{tag}")
    last = snapshots.manifest(spark, root)
    begin = last.get("step", -1) + 1 if last and last.get("signature") == signature else 0
    for n in range(begin, steps):
        if fs.exists(wish):
            fs.delete(wish, False)
            raise Cancelled(f"stopped before step {n} of {steps}")
        try:
            with tagged(spark, tag):
                write = snapshots.replace if n == 0 else snapshots.append
                write(root, step(n), key, step=n, signature=signature)
        except Exception as e:
            if fs.exists(wish):
                fs.delete(wish, False)
                raise Cancelled(f"stopped in step {n} of {steps}") from e
            raise
        if on_step:
            on_step(n + 1, steps)
    return steps - begin
