"""Queries over patches between two states of documents: the patches are made in the plan, the SQL knows the states."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.patch_scan import scan_hunks, scan_lines
from quarry.queries import query
from quarry.session import table

#: In the second state every sixth line from the second on is gone, and every sixth from the fifth on ends in a mark.
GONE, MARKED, OF, HUNK_LINES = 2, 5, 6, 10


def document_patches(spark, sf_dir):
    """(doc_id, patch): a text for each document with an id, ten lines of the first state to a hunk."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    lines = F.split(F.regexp_replace("text", "\r", " "), "\n", -1)
    shown = F.transform(lines, lambda x, i: F.when(i % OF == GONE - 1, F.concat(F.lit("-"), x)).when(i % OF == MARKED - 1, F.concat(F.lit("-"), x, F.lit("\n+"), x, F.lit("!"))).otherwise(F.concat(F.lit(" "), x)))
    gone_before = lambda i: F.floor((i + OF - GONE) / OF)  # noqa: E731  lines of those before the i-th, counted from 0
    n = F.size(lines)

    def hunk(g):
        begin, end = g * HUNK_LINES, F.least((g + 1) * HUNK_LINES, n)
        head = F.concat(F.lit("@@ -"), (begin + 1).cast("string"), F.lit(","), (end - begin).cast("string"), F.lit(" +"), (begin - gone_before(begin) + 1).cast("string"), F.lit(","), (end - gone_before(end) - begin + gone_before(begin)).cast("string"), F.lit(" @@\n"))
        return F.concat(head, F.array_join(F.slice(shown, begin + 1, end - begin), "\n"))

    hunks = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / HUNK_LINES).cast("int")), hunk), "\n")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), hunks).alias("patch"))


_LINES = """WITH d AS (SELECT doc_id, max(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
a AS (SELECT doc_id, string_split(replace(text, chr(13), ' '), chr(10)) AS a FROM d),
l AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM a),
n AS (SELECT *, (i - 1) // 10 + 1 AS hunk, i - (i + 3) // 6 AS new FROM l)"""


@query(f"""{_LINES}, k AS (SELECT doc_id, hunk, 'doc_' || doc_id AS path, count(*) FILTER (WHERE i % 6 = 5) AS additions, count(*) FILTER (WHERE i % 6 IN (2, 5)) AS deletions,
min(new) FILTER (WHERE i % 6 = 5) AS first, min(new) AS start, count(*) FILTER (WHERE i % 6 <> 2) AS size,
string_agg(CASE WHEN i % 6 = 2 THEN x ELSE x || chr(10) || x || '!' END, chr(10) ORDER BY i) FILTER (WHERE i % 6 IN (2, 5)) AS changed, min(new - 1) FILTER (WHERE i % 6 IN (2, 5)) AS anchor FROM n GROUP BY doc_id, hunk)
SELECT doc_id, hunk, path, CAST(additions AS INT) AS additions, CAST(deletions AS INT) AS deletions, CAST(coalesce(first, start) AS INT) AS lineno,
CAST(greatest(coalesce(first, start), start + size - 1) AS INT) AS end_lineno, sha256(regexp_replace(changed, '\\s+$', '')) AS changed_sha256, CAST(greatest(1, coalesce(anchor, start)) AS INT) AS anchor
FROM k WHERE additions + deletions > 0""")
def patch_hunks(spark, sf_dir):
    found = scan_hunks(document_patches(spark, sf_dir), "doc_id", F.col("patch"))
    return found.select("doc_id", "hunk", "path", "additions", "deletions", "lineno", "end_lineno", F.sha2("changed_code", 256).alias("changed_sha256"), "anchor")


@query(f"""{_LINES} SELECT doc_id, hunk, sign, CAST(line AS INT) AS line, count(*) AS n FROM (
SELECT doc_id, hunk, '-' AS sign, i AS line FROM n WHERE i % 6 IN (2, 5) UNION ALL SELECT doc_id, hunk, '+', new FROM n WHERE i % 6 = 5) GROUP BY ALL""")
def patch_lines(spark, sf_dir):
    """The lines that come and go, by their numbers in the state that has them."""
    lines = scan_lines(document_patches(spark, sf_dir), "doc_id", F.col("patch")).where("sign IN ('-', '+') AND NOT is_header")
    return lines.select("doc_id", "hunk", "sign", F.when(F.col("sign") == "+", F.col("new_line")).otherwise(F.col("old_line")).alias("line")).groupBy("doc_id", "hunk", "sign", "line").count().withColumnRenamed("count", "n")
