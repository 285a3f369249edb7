"""Globs and ignore files, compiled on the driver to one regular expression each."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directory names that mark source trees.
SOURCE_SEGMENTS = ("src", "app", "lib", "packages", "components", "server", "client", "backend", "frontend")


def normalise(patterns: list[str] | None) -> list[str]:
    """Trimmed, forward slashes, no leading ./ and no blanks."""
    out = []
    for p in patterns or []:
        p = p.strip().replace("\\", "/")
        p = p[2:] if p.startswith("./") else p
        if p:
            out.append(p)
    return out


def _body(pattern: str, one: str = ".") -> str:
    """A shell glob as a regular expression; * and ? stand for what ``one`` matches: all, or all but slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out += one + "*"
        elif c == "?":
            out += one
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else "\\" + inside if inside[0] == "^" else inside) + "]"
            i = end
        else:
            out += re.sub(r"([^\w/ -])", r"\\\1", c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """What a relative path must match: dir/ and dir/** take all below; a glob without slash may match the last segment."""
    if pattern.endswith("/**") or pattern.endswith("/"):
        return "^" + _literal(pattern.removesuffix("**").rstrip("/")) + "(?:/.*)?$"
    body = _body(pattern)
    return f"^(?:.*/)?{body}$" if "/" not in pattern else f"^{body}$"


def _literal(text: str) -> str:
    return re.sub(r"([^\w/ -])", r"\\\1", text)


def any_regex(patterns: list[str]) -> str:
    return "|".join(f"(?:{glob_regex(p)})" for p in patterns)


def allowed(path: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """include AND NOT exclude; no include passes all; an empty path fails."""
    take, drop = normalise(include), normalise(exclude)
    out = F.coalesce(path, F.lit("")) != ""
    if take:
        out = out & path.rlike("(?s)" + any_regex(take))
    if drop:
        out = out & ~path.rlike("(?s)" + any_regex(drop))
    return out


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(ignored, regex) of each line of an ignore file, in order: the last that matches decides."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line.strip() or line.startswith("#"):
            continue
        ignored = not line.startswith("!")
        line = line if ignored else line[1:]
        line = line[1:] if line.startswith("\\") else line
        only_dir, line = line.endswith("/"), line.rstrip("/")
        anchored, line = "/" in line, line.lstrip("/")
        parts = [".*" if s == "**" else _body(s, "[^/]") for s in line.split("/")]
        body = "/".join(parts).replace(".*/", "(?:.*/)?")
        rules.append((ignored, ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if only_dir else "(?:/.*)?$")))
    return rules


def is_ignored(path: Column, text: str) -> Column:
    """Whether the last matching rule of the ignore file ignores the path."""
    out = F.lit(False)
    for ignored, regex in ignore_rules(text):
        out = F.when(path.rlike(regex), F.lit(ignored)).otherwise(out)
    return out


def diff_allowed(path: Column, suffix: str, ignore: str = "", include: list[str] | None = None, exclude: list[str] | None = None, files: list[str] | None = None) -> Column:
    """Whether a patch's path is searched: its suffix, the list of files (none: all, an empty one: nothing), ignore rules, globs."""
    listed = F.lit(True) if files is None else path.isin(*files) if files else F.lit(False)
    return F.coalesce(F.endswith(path, F.lit(suffix)) & listed & ~is_ignored(path, ignore) & allowed(path, include, exclude), F.lit(False))


def in_source_tree(path: Column, segments: tuple[str, ...] = SOURCE_SEGMENTS) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.lower(s).isin(*segments))
