"""What searches, learners and readers see of a row of symbols, hunks or matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import BLANKS, clipped

#: What an agent is shown at most.
SHOWN_RESULTS, SHOWN_MATCHES, SHOWN_LINES, SHOWN_CHARS, SHOWN_MATCH, SHOWN_CALLS = 12, 40, 8, 900, 300, 6
#: The names under which callers give the parts of a result, the first one that says something counts.
ALIASES = {
    "code": ("raw_code", "code", "text"), "file": ("file", "file_path", "path"), "lineno": ("lineno", "line_number", "line"),
    "end_lineno": ("end_lineno", "end_line"), "name": ("function_name", "name"),
}
PAYLOAD = ("rank", "class_name", "symbol_kind", "score", "similarity", "semantic_similarity", "bm25_score", "hybrid_score", "distance")


def _has(rows: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in rows.columns]


def _said(value: Column) -> Column:
    """Empty text counts as not said."""
    return F.when(value.cast("string") != "", value)


def static_json(rows: DataFrame) -> Column:
    """The static record as JSON text, null fields left out; braces where there is none."""
    return F.coalesce(F.to_json("python_static"), F.lit("{}")) if "python_static" in rows.columns else F.lit(None).cast("string")


def _text(rows: DataFrame, parts: list[Column]) -> Column:
    own = F.concat_ws("\n", *[_said(p) for p in parts])
    if "search_text" in rows.columns:
        return F.when(F.col("symbol_kind").eqNullSafe("diff_hunk") & F.col("search_text").isNotNull(), F.col("search_text")).otherwise(own)
    return own


def _names(rows: DataFrame) -> list[Column]:
    other = [F.when(~F.col("function_name").eqNullSafe(F.col("name")), F.col("function_name"))] if "function_name" in rows.columns else []
    return [F.col("name"), *other, *_has(rows, "class_name")]


def bm25_text(rows: DataFrame) -> Column:
    """What BM25 reads: names, class, kind, path and its last part, code, static record; a hunk its own text."""
    code = F.coalesce(*[_said(c) for c in _has(rows, "raw_code", "code")])
    return _text(rows, [*_names(rows), *_has(rows, "symbol_kind"), F.col("file"), F.element_at(F.split("file", "/"), -1), code, static_json(rows)])


def keyword_text(rows: DataFrame) -> Column:
    """What keywords are looked for in: names, class, doc comment, code, static record; a hunk its own text."""
    code = F.coalesce(*[_said(c) for c in _has(rows, "raw_code", "code")])
    return _text(rows, [*_names(rows), *_has(rows, "docstring"), code, static_json(rows)])


def payload(rows: DataFrame) -> DataFrame:
    """A training example's part about a result: the fields of PAYLOAD, aliases as one, code and its digest."""
    first = lambda names: F.coalesce(*[_said(c) for c in _has(rows, *names)], F.lit(None))
    code = F.coalesce(first(ALIASES["code"]).cast("string"), F.lit(""))
    own = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in PAYLOAD]
    return rows.select(*own, *[first(ALIASES[c]).alias(c) for c in ("file", "lineno", "end_lineno", "name")], F.when(code != "", F.sha2(code, 256)).alias("code_sha256"), code.alias("code"))


def is_shown(kind: str, symbol_kind: Column, class_name: Column) -> Column:
    """Whether a result passes the kind filter: all, functions, methods, function_level or codeblocks."""
    symbol_kind, in_class = F.coalesce(symbol_kind, F.lit("")), F.coalesce(class_name, F.lit("")) != ""
    block = symbol_kind == "code_block"
    own = {"functions": ~in_class & ~block, "methods": in_class | (symbol_kind == "method"), "function_level": ~block, "codeblocks": block}.get(kind, F.lit(True))
    return F.when(symbol_kind == "diff_hunk", F.lit(kind in ("all", "function_level"))).otherwise(own)


def kind_label(symbol_kind: Column, class_name: Column) -> Column:
    """UnifiedDiff, CodeBlock, Method or Function."""
    return F.when(symbol_kind == "diff_hunk", "UnifiedDiff").when(symbol_kind == "code_block", "CodeBlock").when(F.coalesce(class_name, F.lit("")) != "", "Method").otherwise("Function")


def as_diff_result(hunks: DataFrame) -> DataFrame:
    """Hunks as results of the diff target: the patch is their code, and their name says so."""
    code = F.coalesce(_said(F.col("diff_code")), _said(F.col("changed_code")), F.lit(""))
    name = F.regexp_replace(F.coalesce("function_name", F.lit("")), "^(.*?)Diff hunk:", "$1Unified diff:")
    return hunks.withColumns({"code": code, "raw_code": code, "function_name": name, "name": name, "search_target": F.lit("diff_hunks")})


def _relative(file: Column, directory: str) -> Column:
    root = directory.rstrip("/") + "/"
    return F.when(F.startswith(file, F.lit(root)), F.substring(file, F.lit(len(root) + 1), F.length(file))).otherwise(file)


def reading(results: DataFrame, directory: str = "", most: int = SHOWN_RESULTS) -> DataFrame:
    """(rank, text): how an agent reads the first results. results: rank, score, and the columns of symbols."""
    number = lambda c: F.format_string("%.3f", F.col(c).cast("double"))
    has = lambda c: c in results.columns
    name = F.coalesce(*[_said(c) for c in _has(results, "function_name", "name")], F.lit("unknown"))
    name = F.when(F.coalesce("class_name", F.lit("")) != "", F.concat("class_name", F.lit("."), name)).otherwise(name)
    place = F.concat(_relative(F.coalesce("file", F.lit("")), directory), F.lit(":"), F.coalesce("lineno", F.lit(1)).cast("string"), F.coalesce(F.concat(F.lit("-"), F.col("end_lineno").cast("string")), F.lit("")))
    head = F.concat(F.col("rank").cast("string"), F.lit(". "), kind_label(F.col("symbol_kind"), F.col("class_name")), F.lit(" `"), name, F.lit("` at `"), place, F.lit("`"))
    scores = [F.concat(F.lit("   rank_score="), F.coalesce(number("score"), F.lit("n/a")))]
    scores += [F.concat(F.lit("semantic="), number("semantic"))] if has("semantic") else []
    scores += [F.when(F.col("bm25") > 0, F.concat(F.lit("bm25="), number("bm25")))] if has("bm25") else []
    lines = F.transform(F.slice(F.split(F.regexp_replace(F.coalesce("raw_code", F.lit("")), f"^{BLANKS}+|{BLANKS}+$", ""), "\n"), 1, SHOWN_LINES), lambda x: F.regexp_replace(x, f"{BLANKS}+$", ""))
    snippet = F.array_join(lines, "\n")
    parts = [head, F.concat_ws(", ", *scores)]
    static = results.schema["python_static"].dataType.names if has("python_static") else ()
    if "routes" in static:
        route = F.get("python_static.routes", F.lit(0))
        parts.append(F.when(F.size("python_static.routes") > 0, F.rtrim(F.concat(F.lit("   route="), F.coalesce(route["method"], F.lit("")), F.lit(" "), F.coalesce(route["path"], F.lit(""))))))
    if "calls" in static:
        parts.append(F.when(F.size("python_static.calls") > 0, F.concat(F.lit("   calls="), F.array_join(F.slice("python_static.calls", 1, SHOWN_CALLS), ", "))))
    parts.append(F.when(snippet != "", F.concat(F.lit("   snippet:\n```text\n"), clipped(snippet, SHOWN_CHARS), F.lit("\n```"))))
    return results.where(F.col("rank") <= most).select("rank", F.concat_ws("\n", *parts).alias("text"))


def reading_matches(matches: DataFrame, key: str, most: int = SHOWN_MATCHES) -> DataFrame:
    """(position, text): how an agent reads the first matches of a line search. matches: key, line_no, line."""
    from pyspark.sql import Window

    first = matches.orderBy(key, "line_no").limit(most)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(key, "line_no")))  # at most ``most`` rows
    place = F.concat(F.lit("`"), F.col(key).cast("string"), F.lit(":"), F.col("line_no").cast("string"), F.lit("`"))
    return numbered.select("position", F.concat(F.col("position").cast("string"), F.lit(". "), place, F.lit("\n   "), clipped(F.coalesce("line", F.lit("")), SHOWN_MATCH)).alias("text"))
