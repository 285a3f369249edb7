"""Patches as hunk rows, changed ranges and changed symbols."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ranges import overlapping

HUNK = (
    "commit_hash string, commit_subject string, commit_message string, path string, diff_old_path string, diff_new_path string, lineno int, end_lineno int, "
    "changed_code string, diff_code string, search_text string, additions int, deletions int, added_ranges array<struct<begin:int,end:int>>, removed_ranges array<struct<begin:int,end:int>>, anchor int"
)
NAMES = [x.split()[0] for x in re.sub(r"<[^>]*>+", "", HUNK).split(", ")]
_HEADER = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$")


def header_path(text: str) -> str | None:
    """The path of a --- or +++ line: no device, nothing after a tab, quotes and the side's prefix off."""
    path = text.split("\t")[0].strip()
    if path.startswith('"') and path.endswith('"'):
        path = path[1:-1].encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace").decode("utf-8", "replace")
    return None if path == "/dev/null" else path[2:] if path[:2] in ("a/", "b/") else path


def file_header(old_path: str | None, new_path: str | None) -> str:
    """The three lines that git writes before a file's hunks; a missing side is the null device."""
    sides = [(f"a/{old_path or new_path or ''}", "a/" if old_path else None, old_path), (f"b/{new_path or old_path or ''}", "b/" if new_path else None, new_path)]
    shown = [prefix + path if prefix else "/dev/null" for _, prefix, path in sides]
    return f"diff --git {sides[0][0]} {sides[1][0]}\n--- {shown[0]}\n+++ {shown[1]}"


def line_ranges(numbers: list[int]) -> list[dict]:
    out: list[dict] = []
    for n in sorted(set(numbers)):
        if out and out[-1]["end"] == n - 1:
            out[-1]["end"] = n
        else:
            out.append({"begin": n, "end": n})
    return out


def parse_patch(patch: str) -> Iterator[dict]:
    """Hunks of a unified diff: changed_code has the lines that come and go, search_text the hunk below its file's header.

    Inside a hunk exactly the lines that its header counts are read, whatever they look like.
    """
    lines, k, old_path, new_path = patch.split("\n"), 0, None, None
    while k < len(lines):
        line = lines[k]
        k += 1
        if line.startswith("diff --git "):
            old_path = new_path = None
        elif line.startswith("--- "):
            old_path = header_path(line[4:])
        elif line.startswith("+++ "):
            new_path = header_path(line[4:])
        elif m := _HEADER.match(line):
            old, new = int(m[1]), int(m[3])
            left_old, left_new = int(m[2] or 1), int(m[4] or 1)
            anchor, body, added, removed, start = new, [], [], [], max(new, 1)
            while k < len(lines) and (left_old or left_new or lines[k].startswith("\\")):
                sign, text = lines[k][:1] or " ", lines[k]
                k += 1
                body.append(text)
                if sign == "\\":
                    continue
                if sign in " -":
                    left_old -= 1
                if sign in " +":
                    left_new -= 1
                if sign == "+":
                    added.append(new)
                if sign == "-":
                    anchor = anchor if removed else max(1, new - 1)  # the line before what goes
                    removed.append(old)
                old, new = old + (sign in " -"), new + (sign in " +")
            if added or removed:
                first = min(added, default=start)
                whole = "\n".join([line, *body]).rstrip()
                yield {
                    "path": new_path or old_path, "diff_old_path": old_path, "diff_new_path": new_path, "lineno": first, "end_lineno": max(first, new - 1),
                    "changed_code": "\n".join(x[1:] for x in body if x[:1] in ("+", "-")).rstrip(), "diff_code": whole, "search_text": f"{file_header(old_path, new_path)}\n{whole}", "additions": len(added), "deletions": len(removed),
                    "added_ranges": line_ranges(added), "removed_ranges": line_ranges(removed), "anchor": max(1, anchor),
                }


def hunks(patches: DataFrame) -> DataFrame:
    """HUNK rows of (commit_hash, commit_subject, commit_message, patch) rows."""

    def each(batches):
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                rows += [{"commit_hash": r.commit_hash, "commit_subject": r.commit_subject, "commit_message": r.commit_message, **h} for h in parse_patch(r.patch or "")]
            yield pd.DataFrame(rows, columns=NAMES)

    return patches.select("commit_hash", "commit_subject", "commit_message", "patch").mapInPandas(each, HUNK)


def changed_ranges(found: DataFrame) -> DataFrame:
    """(file, begin, end) in the new state; a hunk that only deletes stands at its anchor."""
    spot = F.array(F.struct(F.col("anchor").alias("begin"), F.col("anchor").alias("end")))
    each = found.select(F.col("path").alias("file"), F.explode(F.when(F.size("added_ranges") > 0, F.col("added_ranges")).otherwise(spot)).alias("r"))
    return each.select("file", "r.begin", "r.end").distinct()


def changed_symbols(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """Symbols (file, lineno, end_lineno, ..) that a net diff touches."""
    spans = symbols.withColumn("begin", F.col("lineno")).withColumn("end", F.col("end_lineno"))
    return overlapping(spans, changed_ranges(found), "file").drop("begin", "end")


def diff_units(found: DataFrame) -> DataFrame:
    """One row per commit and file (each file alone for the work tree), bodies and ranges in order."""
    key = F.coalesce(F.col("commit_hash"), F.col("commit_subject"), F.concat(F.lit("__file__"), F.col("path")))
    grouped = found.withColumn("commit_key", key).groupBy("commit_key", "path").agg(
        F.count(F.lit(1)).alias("file_hunk_count"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.max("end_lineno").alias("end_lineno"),
        F.min("lineno").alias("lineno"), F.max("commit_message").alias("commit_message"),
        F.sort_array(F.collect_list(F.struct("lineno", "end_lineno", "diff_code", "search_text", "added_ranges", "removed_ranges"))).alias("_b"),
    )
    joined = {c: F.array_join(F.col("_b")[c], "\n") for c in ("diff_code", "search_text")}
    ranges = {c: F.flatten(F.col("_b")[c]) for c in ("added_ranges", "removed_ranges")}
    return grouped.withColumns(joined | ranges).drop("_b")
