"""The patch scan against the parser: patches of a scratch repository and odd texts."""

from __future__ import annotations

import random
import subprocess

import pytest
from pyspark.sql import functions as F

COLUMNS = ("path", "diff_old_path", "diff_new_path", "lineno", "end_lineno", "changed_code", "diff_code", "search_text", "additions", "deletions", "added_ranges", "removed_ranges", "anchor")


def compared(spark, patches):
    from quarry.operators.diffs import parse_patch
    from quarry.operators.patch_scan import scan_hunks

    rows = scan_hunks(spark.createDataFrame(list(enumerate(patches)), "id long, patch string"), "id", F.col("patch")).orderBy("id", "hunk").collect()
    plain = lambda x: [(r["begin"], r["end"]) for r in x] if isinstance(x, list) else x
    found = [(r["id"], *(plain(r[c]) for c in COLUMNS)) for r in rows]
    wanted = [(i, *(plain(h[c]) for c in COLUMNS)) for i, p in enumerate(patches) for h in parse_patch(p or "")]
    for a, b in zip(found, wanted, strict=True):
        assert a == b


def test_scan_equals_parser_on_git(spark, tmp_path):
    r = random.Random(6)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    git("init", "-q")
    names = ["a.txt", "dir name/b.txt", "ü é.txt", 'quo"te.txt', "gone.txt"]
    (tmp_path / "dir name").mkdir()
    words = ["x", "-- a", "++ b", "@ c", "", " ", "\\ d", "diff --git a/z b/z", "é\t", "long line " * 5]
    patches = []
    for step in range(8):
        for name in names:
            p = tmp_path / name
            old = p.read_text().split("\n") if p.exists() else []
            new = [x for x in old if r.random() > 0.1]
            for _ in range(r.randrange(12)):
                new.insert(r.randrange(len(new) + 1), r.choice(words))
            p.write_text("\n".join(new) + ("\n" if r.random() < 0.5 else ""))
        if step == 5:
            (tmp_path / "gone.txt").unlink()
        git("add", "-A")
        patches += [git("diff", "--cached", f"-U{n}", *((("HEAD",)) if step else ())) for n in (0, 1, 3)]
        git("commit", "-qm", "m", "--allow-empty")
    compared(spark, patches)


@pytest.mark.parametrize(
    "patch",
    [
        None, "", "no patch", "@@ -1 +1 @@\n-a\n+b", "--- a/x\n+++ b/x\n@@ -0,0 +1,2 @@ fn\n+a\n+b\n\\ No newline at end of file\n",
        "--- a/x\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- a\n-b\n--- a/y\n+++ b/y\n@@ -3 +3 @@\n-c\n+d\njunk\n\\ junk", "--- x\t2020\n+++ x\t2021\n@@ -5,3 +5,3 @@\n a\n\n-b\n+c",
        "@@ -1,2 +1,2 @@\n a\n b\n@@ -9 +9 @@\n-x\n+x ", "--- \"a/\\303\\274\\tq\\\"\"\n+++ \"b/\\303\\274\\tq\\\"\"\n@@ -1 +1 @@\n-a\n+b", "x" * 100_000 + "\n@@ -1 +1 @@\n-" + "y" * 100_000 + "\n+z",
    ],
)
def test_scan_equals_parser_on_odd_texts(spark, patch):
    compared(spark, [patch, "--- a/q\n+++ b/q\n@@ -1 +1 @@\n-a\n+b\n"])


def test_scan_has_no_python(spark):
    from quarry.operators.patch_scan import scan_hunks

    plan = scan_hunks(spark.createDataFrame([(1, "")], "id long, patch string"), "id", F.col("patch"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan
