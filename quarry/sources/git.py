"""Trees, changes and commits of a git work tree as DataFrames.

git runs on the driver; contents and patches become rows, and everything after that is plans.
"""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.globs import ignore_rules

#: Directories that are never scanned.
SKIPPED = frozenset(".git .mypy_cache .quarry_index .pytest_cache .venv .vscode-test __pycache__ build dist node_modules out".split())
#: Ignore files of a tree's root; the second is the engine's own.
IGNORE_FILES = (".gitignore", ".quarryignore")
RECORD, UNIT = "\x1e", "\x1f"
FILES = "path string, content binary"
COMMITS = "hash string, short string, parents array<string>, author string, date string, refs string, subject string"


def git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def safe_ref(ref: str) -> str:
    """A reference that can't be taken for an option or split into several."""
    if not ref or ref.startswith("-") or re.search(r"[\s\0]", ref):
        raise ValueError(f"not a git reference: {ref!r}")
    return ref


def is_ignored(path: str, rules: list[tuple[bool, str]]) -> bool:
    out = False
    for ignored, regex in rules:
        if re.search(regex, path):
            out = ignored
    return out


def read_rules(root: str, names: tuple[str, ...] = IGNORE_FILES) -> list[tuple[bool, str]]:
    """The rules of the ignore files in root, one file after the other: the last that matches decides."""
    rules = []
    for path in (os.path.join(root, n) for n in names):
        if os.path.exists(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                rules += ignore_rules(f.read())
    return rules


#: What a new ignore file holds where git has none.
FALLBACK_PATTERNS = ("node_modules/", "out/", "dist/", "build/", ".venv/", "__pycache__/", ".quarry_index/")


def clean_patterns(patterns: list[str]) -> list[str]:
    """Patterns relative to the root: trimmed, forward slashes, no leading ./ or /, each once, sorted; comments go."""
    said = (p.strip().replace("\\", "/") for p in patterns)
    return sorted({c for p in said if not p.startswith("#") and (c := p.removeprefix("./").lstrip("/"))})


def default_patterns(root: str) -> list[str]:
    """What an ignore file begins with: git's own patterns, or the usual folders."""
    path = os.path.join(root, IGNORE_FILES[0])
    if os.path.exists(path):
        with open(path, encoding="utf-8", errors="replace") as f:
            if own := clean_patterns(f.read().splitlines()):
                return own
    return list(FALLBACK_PATTERNS)


def write_patterns(root: str, patterns: list[str]) -> list[str]:
    """Replace the engine's ignore file in one step; the patterns that it has now."""
    kept, path = clean_patterns(patterns), os.path.join(root, IGNORE_FILES[1])
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.write("\n".join(["# Paths that searches leave out, relative to this folder.", *kept, ""]))
    os.replace(f"{path}.new", path)
    return kept


def walk(root: str, suffix: str | None = None, ignore_files: tuple[str, ...] = IGNORE_FILES) -> list[str]:
    """Relative paths below root; ignored and skipped directories are not entered."""
    rules = read_rules(root, ignore_files)
    found = []
    for folder, folders, files in os.walk(root):
        rel = lambda n, f=folder: os.path.relpath(os.path.join(f, n), root).replace(os.sep, "/")
        folders[:] = sorted(d for d in folders if d not in SKIPPED and not is_ignored(rel(d) + "/x", rules))
        found += [rel(f) for f in sorted(files) if (not suffix or f.endswith(suffix)) and not is_ignored(rel(f), rules)]
    return found


def visible_files(root: str, suffix: str | None = None) -> list[str]:
    """Tracked and untracked files that git doesn't ignore; a plain walk outside git."""
    try:
        names = git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0")
    except (subprocess.CalledProcessError, FileNotFoundError):
        return walk(root, suffix)
    return sorted({n for n in names if n and (not suffix or n.endswith(suffix)) and os.path.isfile(os.path.join(root, n))})


def changed_files(root: str, suffix: str | None = None) -> list[str]:
    """Added, copied, modified or renamed since HEAD, and untracked ones."""
    names = git(root, "diff", "--name-only", "-z", "--diff-filter=ACMR", "HEAD").split("\0") + git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0")
    return sorted({n for n in names if n and (not suffix or n.endswith(suffix)) and os.path.isfile(os.path.join(root, n))})


def read_files(spark: SparkSession, root: str, paths: list[str], partitions: int | None = None) -> DataFrame:
    """(path, content) read on executors from a shared root; unreadable files have null content.

    Spark's own binary source hides names that begin with _ or ., so files are opened here.
    """

    def each(batches):
        import pandas as pd

        for batch in batches:
            content = []
            for path in batch["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        content.append(f.read())
                except OSError:
                    content.append(None)
            yield pd.DataFrame({"path": batch["path"], "content": content})

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(partitions or max(1, min(len(paths) // 16, 1000))).mapInPandas(each, FILES)


def diff_text(root: str, base: str | None = None, head: str | None = None) -> str:
    """base...head, base...HEAD, or HEAD against the work tree with untracked files as additions."""
    if head and not base:
        raise ValueError("a head needs a base")
    if base:
        return git(root, "diff", "--no-color", f"{safe_ref(base)}...{safe_ref(head or 'HEAD')}")
    return git(root, "diff", "--no-color", "HEAD") + "".join(_as_added(root, p) for p in git(root, "ls-files", "-z", "--others", "--exclude-standard").split("\0") if p)


def _as_added(root: str, path: str) -> str:
    with open(os.path.join(root, path), "rb") as f:
        data = f.read()
    if b"\0" in data[:4096] or not data:
        return ""
    lines = data.decode("utf-8", "replace").split("\n")
    end = [] if lines[-1] else lines.pop() or []
    mark = "" if not end and data.endswith(b"\n") else "\\ No newline at end of file\n"
    body = "".join(f"+{x}\n" for x in lines)
    return f"diff --git a/{path} b/{path}\nnew file mode 100644\n--- /dev/null\n+++ b/{path}\n@@ -0,0 +1,{len(lines)} @@\n{body}{mark}"


PATCHES = "commit_hash string, commit_subject string, commit_message string, patch string"


def patches(spark: SparkSession, root: str, base: str, head: str = "HEAD", partitions: int | None = None) -> DataFrame:
    """(commit_hash, commit_subject, commit_message, patch) of the commits of base..head, merges without a patch.

    The driver lists hashes only; executors that share the root read each commit's patch.
    """
    hashes = git(root, "rev-list", f"{safe_ref(base)}..{safe_ref(head)}").split()

    def each(batches):
        import pandas as pd

        for batch in batches:
            shown = [git(root, "show", "--no-color", f"--format=%s{UNIT}%B{UNIT}", h).split(UNIT, 2) for h in batch["commit_hash"]]
            yield pd.DataFrame([(h, s, m.strip(), p.lstrip("\n")) for h, (s, m, p) in zip(batch["commit_hash"], shown, strict=True)], columns=["commit_hash", "commit_subject", "commit_message", "patch"])

    listed = spark.createDataFrame([(h,) for h in hashes], "commit_hash string")
    return listed.repartition(partitions or max(1, min(len(hashes) // 16, 1000))).mapInPandas(each, PATCHES)


def commits(spark: SparkSession, root: str, limit: int = 200) -> DataFrame:
    """The commit graph, newest first, without stashes."""
    fields = UNIT.join(("%H", "%h", "%P", "%an", "%aI", "%D", "%s"))
    log = git(root, "log", "--exclude=refs/stash", "--all", "--date-order", f"--max-count={max(1, min(1000, limit))}", f"--format={fields}{RECORD}")
    rows = [x.strip("\n").split(UNIT) for x in log.split(RECORD) if x.strip()]
    return spark.createDataFrame([(h, s, p.split(), a, d, r, t) for h, s, p, a, d, r, t in rows], COMMITS)


def content_at(root: str, ref: str, path: str) -> str:
    return git(root, "show", f"{safe_ref(ref)}:{path}")
