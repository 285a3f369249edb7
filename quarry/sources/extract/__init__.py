"""Symbols of source files: a registry by suffix, and the DataFrame form.

A file that can't be read or parsed gives no symbols, never a failed job. More languages plug in
through ``EXTRACTORS``: suffix -> function from bytes to symbol dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.extract.braces import java_symbols, script_symbols
from quarry.sources.extract.python_ast import python_symbols

STATIC = (
    "struct<docstring:string,params:array<string>,returns:string,decorators:array<string>,calls:array<string>,assigned_names:array<string>,imports:array<string>,"
    "is_async:boolean,routes:array<struct<framework:string,method:string,path:string>>,framework_tags:array<string>,block_type:string,block_types:array<string>,statement_count:int,"
    "local_calls:array<string>,external_import_calls:array<string>,fallback:string>"
)
SYMBOL = f"file string, name string, function_name string, code string, raw_code string, lineno int, end_lineno int, class_name string, symbol_kind string, docstring string, python_static {STATIC}"
STATIC_FIELDS = [x.split(":")[0] for x in "docstring params returns decorators calls assigned_names imports is_async routes framework_tags block_type block_types statement_count local_calls external_import_calls fallback".split()]

EXTRACTORS = {".py": python_symbols, ".java": java_symbols, ".ts": script_symbols, ".tsx": script_symbols, ".js": script_symbols, ".jsx": script_symbols}


def symbols_of(path: str, content: bytes) -> list[dict]:
    extract = next((f for suffix, f in EXTRACTORS.items() if path.endswith(suffix)), None)
    if extract is None or content is None:
        return []
    try:
        found = extract(bytes(content))
    except Exception:  # one odd file never fails a build
        return []
    out = []
    for s in found:
        static = s.get("python_static") or {}
        out.append(
            {
                "file": path, "name": s["name"], "function_name": s.get("function_name", s["name"]), "code": s["code"], "raw_code": s.get("raw_code", s["code"]),
                "lineno": s["lineno"], "end_lineno": s["end_lineno"], "class_name": s.get("class_name"),
                "symbol_kind": s.get("symbol_kind") or ("method" if s.get("class_name") else "function"), "docstring": s.get("docstring"),
                "python_static": {k: static.get(k) for k in STATIC_FIELDS},
            }
        )
    return out


def extract_symbols(files: DataFrame) -> DataFrame:
    """Symbols (SYMBOL) of files (path, content binary), with symbol_id."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [s for path, content in zip(batch["path"], batch["content"], strict=True) for s in symbols_of(path, content)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SYMBOL.split(", ")])

    found = files.select("path", "content").mapInPandas(each, SYMBOL)
    from quarry.operators.catalog import symbol_id

    return found.withColumn("symbol_id", symbol_id(F.col("file"), F.col("name"), F.col("lineno"), F.col("end_lineno"), F.col("raw_code")))


def call_graph(symbols: DataFrame) -> DataFrame:
    """(file, caller, callee) edges inside a file: the last segment of a call names a function of the file."""
    last = lambda call: F.element_at(F.split(call, r"\."), -1)
    caller = F.struct(F.col("name").alias("caller"))
    # Names and calls are rows of one table: files are read once, and meet by file and word.
    words = F.transform(F.coalesce("python_static.calls", F.array()), lambda c: F.struct(last(c).alias("word"), caller.alias("by")))
    named = F.when(F.col("symbol_kind").isin("function", "method"), F.array(F.struct(F.col("name").alias("word"), F.lit(None).cast("struct<caller:string>").alias("by"))))
    each = symbols.select("file", F.explode(F.concat(words, F.coalesce(named, F.array()))).alias("x")).where("file IS NOT NULL AND x.word IS NOT NULL")
    met = each.groupBy("file", F.col("x.word").alias("callee")).agg(F.count_if(F.col("x.by").isNull()).alias("names"), F.collect_set("x.by").alias("by"))
    return met.where("names > 0").select("file", F.explode("by.caller").alias("caller"), "callee")


def import_edges(symbols: DataFrame) -> DataFrame:
    """(file, caller, module, call): calls into what the file imports, and the imported module that each goes to."""
    calls = symbols.select("file", F.col("name").alias("caller"), F.explode("python_static.external_import_calls").alias("call")).distinct()
    return calls.select("file", "caller", F.split_part("call", F.lit("."), F.lit(1)).alias("module"), "call")
