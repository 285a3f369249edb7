"""Patches without a parser: lines are rows, and what a parser would remember are running sums and last values.

* a line that looks like a hunk's header begins a segment; file lines are told by their place outside of hunks;
* inside a segment the header's counts, less the old and new lines so far, say which lines belong to the hunk, whatever
  these look like; a marker of a missing end of line directly behind counts as well;
* line numbers are the header's starts plus the same running sums; the paths in force are last values, which a
  new file's line sets back.

Windows are partitioned by patch or by segment, and a patch is one text, so no task gets more than a text's lines.
A hunk whose counts are not used up ends at the next header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import BLANKS

HEADER = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
#: What follows a backslash in a quoted path, and its byte.
ESCAPES = {"n": "0A", "t": "09", "r": "0D", "a": "07", "b": "08", "f": "0C", "v": "0B", '"': "22", "\\": "5C"}


def header_path(text: Column) -> Column:
    """The path of a --- or +++ line: null for no device, nothing after a tab, quotes and the side's prefix off."""
    path = F.regexp_replace(F.split_part(text, F.lit("\t"), F.lit(1)), f"^{BLANKS}+|{BLANKS}+$", "")
    parts = F.regexp_extract_all(F.regexp_replace(path, r'^"|"$', ""), F.lit(r"\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))
    escapes = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def byte(x: Column) -> Column:
        octal = F.lpad(F.conv(F.substring(x, 2, 3), 8, 16), 2, "0")
        return F.when(x.rlike(r"^\\[0-7]{3}$"), octal).when(x.startswith("\\"), F.coalesce(F.try_element_at(escapes, F.substring(x, 2, 1)), F.hex(F.encode(F.substring(x, 2, 1), "UTF-8")))).otherwise(F.hex(F.encode(x, "UTF-8")))

    plain = F.when(path.rlike('^".*"$'), F.decode(F.unhex(F.array_join(F.transform(parts, byte), "")), "UTF-8")).otherwise(path)
    return F.when(plain != "/dev/null", F.regexp_replace(plain, "^[ab]/", ""))


def scan_lines(patches: DataFrame, key: str, patch: Column) -> DataFrame:
    """(key, position, line, file, hunk, is_header, sign, old_line, new_line, old_start, new_start, old_path, new_path) of the lines of hunks and their headers."""
    each = patches.select(key, F.posexplode(F.split(F.coalesce(patch, F.lit("")), "\n", -1)).alias("position", "line"))
    number = lambda group, default: F.coalesce(F.nullif(F.regexp_extract("line", HEADER, group), F.lit("")).cast("int"), F.lit(default))
    so_far = Window.partitionBy(key).orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = each.withColumn("is_header", F.col("line").rlike(HEADER)).withColumn("hunk", F.count_if("is_header").over(so_far))
    sign = F.when(F.col("line") == "", " ").otherwise(F.substring("line", 1, 1))
    header = lambda c: F.when(F.col("is_header"), c)
    marked = marked.withColumns({"sign": sign, "_a": header(number(1, 1)), "_b": header(number(2, 1)), "_c": header(number(3, 1)), "_d": header(number(4, 1))})

    segment = Window.partitionBy(key, "hunk").orderBy("position")
    above = segment.rowsBetween(Window.unboundedPreceding, -1)
    whole = segment.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = lambda signs: F.coalesce(F.count_if(F.col("sign").isin(*signs) & ~F.col("is_header")).over(above), F.lit(0)).cast("int")
    told = marked.withColumns({x: F.max(x).over(whole) for x in ("_a", "_b", "_c", "_d")} | {"_old": counted((" ", "-")), "_new": counted((" ", "+"))})
    over = ~F.col("is_header") & ((F.col("hunk") == 0) | ((F.col("_old") >= F.col("_b")) & (F.col("_new") >= F.col("_d")) & (F.col("sign") != "\\")))
    told = told.withColumn("_over", over).withColumn("outside", F.coalesce(F.count_if("_over").over(segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) > 0)

    side = lambda mark: F.last(F.when(F.col("outside") & F.col("line").startswith(mark), F.struct(header_path(F.substring(F.col("line"), 5, 1 << 30)).alias("path"))).when(F.col("outside") & F.col("line").startswith("diff --git "), F.struct(F.lit(None).cast("string").alias("path"))), True).over(so_far)["path"]
    placed = told.withColumns({"old_path": side("--- "), "new_path": side("+++ "), "file": F.count_if(F.col("outside") & F.col("line").startswith("diff --git ")).over(so_far)})
    return placed.where(~F.col("outside")).select(
        key, "position", "line", "file", "hunk", "is_header", "sign", (F.col("_a") + F.col("_old")).alias("old_line"), (F.col("_c") + F.col("_new")).alias("new_line"),
        F.col("_a").alias("old_start"), F.col("_c").alias("new_start"), "old_path", "new_path",
    )


def _file_header(old: Column, new: Column) -> Column:
    shown = lambda mark, path: F.when(path.isNull(), F.lit("/dev/null")).otherwise(F.concat(F.lit(mark), path))
    return F.concat(F.lit("diff --git a/"), F.coalesce(old, new, F.lit("")), F.lit(" b/"), F.coalesce(new, old, F.lit("")), F.lit("\n--- "), shown("a/", old), F.lit("\n+++ "), shown("b/", new))


def scan_hunks(patches: DataFrame, key: str, patch: Column) -> DataFrame:
    """(key, hunk, path, lineno, end_lineno, changed_code, diff_code, search_text, additions, deletions, ranges, anchor) of hunks that change something."""
    lines = scan_lines(patches, key, patch)
    run = Window.partitionBy(key, "hunk", "sign").orderBy("position")
    at = F.when(F.col("sign") == "+", F.col("new_line")).when(F.col("sign") == "-", F.col("old_line"))
    body = ~F.col("is_header")
    edges = lines.withColumn("at", F.when(body, at)).withColumns({"begins": F.col("at") != F.coalesce(F.lag("at").over(run), F.lit(-2)) + 1, "ends": F.col("at") != F.coalesce(F.lead("at").over(run), F.lit(-2)) - 1})
    added, removed = body & (F.col("sign") == "+"), body & (F.col("sign") == "-")
    in_order = lambda keep, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("position", text.alias("x"))))), lambda s: s["x"]), "\n")

    def ranges(mine: Column) -> Column:
        of = lambda edge: F.sort_array(F.collect_list(F.when(mine & F.col(edge), F.col("at"))))
        return F.transform(F.arrays_zip(of("begins").alias("begin"), of("ends").alias("end")), lambda r: F.struct(r["begin"].alias("begin"), r["end"].alias("end")))

    grouped = edges.groupBy(key, "hunk").agg(
        F.first("old_path").alias("diff_old_path"), F.first("new_path").alias("diff_new_path"), F.count_if(added).cast("int").alias("additions"), F.count_if(removed).cast("int").alias("deletions"),
        F.min(F.when(added, F.col("new_line"))).alias("_first"), F.max("new_start").alias("_start"), F.count_if(body & F.col("sign").isin(" ", "+")).cast("int").alias("_size"),
        in_order(added | removed, F.expr("substring(line, 2)")).alias("_changed"), in_order(F.lit(True), F.col("line")).alias("_whole"),
        ranges(added).alias("added_ranges"), ranges(removed).alias("removed_ranges"), F.min(F.when(removed, F.col("new_line") - 1)).alias("_anchor"),
    ).where("additions > 0 OR deletions > 0")
    stripped = lambda c: F.regexp_replace(c, f"{BLANKS}+$", "")
    lineno = F.coalesce("_first", F.greatest(F.col("_start"), F.lit(1)))
    return grouped.select(
        key, "hunk", F.coalesce("diff_new_path", "diff_old_path").alias("path"), "diff_old_path", "diff_new_path", lineno.alias("lineno"),
        F.greatest(lineno, F.col("_start") + F.col("_size") - 1).alias("end_lineno"), stripped("_changed").alias("changed_code"), stripped("_whole").alias("diff_code"),
        F.concat(_file_header(F.col("diff_old_path"), F.col("diff_new_path")), F.lit("\n"), stripped("_whole")).alias("search_text"),
        "additions", "deletions", "added_ranges", "removed_ranges", F.greatest(F.lit(1), F.coalesce("_anchor", "_start")).alias("anchor"),
    )
