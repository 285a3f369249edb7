"""Column functions over text, paths, references and digests."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An identifier or a run of digits.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+"
BLANKS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
LINE_END = r"\r\n|\n|\r"
#: What follows a query in its variants.
QUERY_SUFFIXES = ("", " function method implementation", " handler service repository", " route endpoint request response", " state cache session auth")
LINE_CHARS = 500


def tokens(text: Column) -> Column:
    """Lower-cased code tokens in order, repeats included. A token is ASCII, so A-Z are lowered before it is found."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; an end of line at the end of the text opens no further line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def clipped(text: Column, n: int, mark: str = "…") -> Column:
    """At most n characters, the last of them a mark where text was cut.

    Text of one line gets single blanks; text with line ends keeps its inside and loses only the
    blanks around it. What a cut leaves loses the blanks at its end.
    """
    around = rf"^{BLANKS}+|{BLANKS}+$"
    single = F.trim(F.regexp_replace(text, f"{BLANKS}+", " "))
    clean = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, around, "")).otherwise(single)
    cut = F.regexp_replace(F.substring(clean, 1, max(0, n - 1)), f"{BLANKS}+$", "")
    return F.when(F.length(clean) > n, F.concat(cut, F.lit(mark))).otherwise(clean)


def query_variants(query: Column, most: int = 5) -> Column:
    """The query with single blanks, and with each suffix; none for a blank query."""
    clean = F.trim(F.regexp_replace(query, r"\s+", " "))
    made = F.slice(F.array_distinct(F.array(*[F.concat(clean, F.lit(s)) for s in QUERY_SUFFIXES])), 1, most)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(made)


def short_ref(ref: Column) -> Column:
    """Seven characters of a full hexadecimal object name; other references as they are."""
    return F.when(ref.rlike("^[0-9a-fA-F]{12,40}$"), F.left(ref, F.lit(7))).otherwise(ref)


def compare_label(base: Column, head: Column) -> Column:
    """base...head in short form; HEAD for a missing head, the work tree without a base."""
    left, right = short_ref(F.coalesce(base, F.lit(""))), short_ref(F.coalesce(head, F.lit("")))
    return F.when(left == "", F.lit("HEAD...working tree")).otherwise(F.concat(left, F.lit("..."), F.when(right == "", F.lit("HEAD")).otherwise(right)))


def location(text: Column) -> Column:
    """struct<path, begin, end> of path, path:line or path:line-end; missing numbers are null."""
    pattern = r"^(.*?)(?::([0-9]+)(?:-([0-9]+))?)?$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int")
    begin = part(2)
    return F.struct(F.regexp_extract(text, pattern, 1).alias("path"), begin.alias("begin"), F.coalesce(part(3), begin).alias("end"))


def commit_url(remote: Column, commit: Column) -> Column:
    """Web address of a commit from a remote in scp, ssh, git or http(s) form; null for others."""
    bare = F.regexp_replace(F.trim(remote), r"(?:\.git)?/*$", "")
    scp = r"^[^@/:]+@([^:/]+):(.+)$"
    url = r"^(?:ssh|git|https?)://(?:[^@/]+@)?([^/:]+)(?::[0-9]+)?/(.+)$"
    is_url, is_scp = bare.rlike(url), bare.rlike(scp)
    host = F.when(is_url, F.regexp_extract(bare, url, 1)).when(is_scp, F.regexp_extract(bare, scp, 1))
    path = F.when(is_url, F.regexp_extract(bare, url, 2)).when(is_scp, F.regexp_extract(bare, scp, 2))
    middle = F.when(F.lower(host).contains("gitlab"), "/-/commit/").otherwise("/commit/")
    return F.concat(F.lit("https://"), host, F.lit("/"), path, middle, commit)


def duration(seconds: Column) -> Column:
    """1h 02m, 3m 04s or 5s."""
    s = F.round(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(s >= 3600, F.format_string("%dh %02dm", hours, minutes))
        .when(s >= 60, F.format_string("%dm %02ds", minutes, s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def percent(current: Column, total: Column) -> Column:
    """A whole percentage from 0 to 100; 0 of nothing."""
    share = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(100 * current / total + 0.5)))).otherwise(0.0)
    return F.concat(share.cast("int").cast("string"), F.lit("%"))


#: What translators put around what they are asked for.
AROUND, PREFIX = "[\"'`]+", r"(?i)^translated(?: english| text)?:\s*"


def clean_translation(said: Column, asked: Column) -> Column:
    """A translator's answer without quotes and label; what was asked where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(said), f"^{AROUND}|{AROUND}$", ""), PREFIX, "")
    return F.coalesce(F.when(F.trim(bare) != "", F.trim(bare)), asked)


def clean_doc_comment(text: Column) -> Column:
    """The text of a /** */ comment without its frame and leading stars."""
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*/\*\*+", ""), r"\*+/\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?m)^[ \t]*\*[ \t]?", ""), r"^\s+|\s+$", ""))


def has_japanese(text: Column) -> Column:
    return text.rlike("[぀-ヿ㐀-䶿一-龯]")


def last_segment(dotted: Column) -> Column:
    return F.element_at(F.split(dotted, r"\."), -1)


def normalised_patterns(patterns: Column) -> Column:
    """Ignore patterns with forward slashes, trimmed, without blanks and repeats, sorted."""
    clean = F.transform(patterns, lambda p: F.trim(F.regexp_replace(p, r"\\", "/")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda p: p != "")))
