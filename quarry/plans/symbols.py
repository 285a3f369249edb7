"""Extraction and diff queries: every document stands for a source file, written from a template of its language."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.diffs import changed_symbols as touched
from quarry.operators.diffs import hunks
from quarry.operators.ranges import ranges_text
from quarry.queries import query
from quarry.session import table
from quarry.sources.extract import call_graph, extract_symbols, import_edges

#: In templates and in what they hold, @I is the document's id, @M its rest by seven, @N its length.
PYTHON = '''import json
from os import path as p


class Store@M:
    @staticmethod
    def load(key: str, *rest):
        """Entry @I."""
        return json.loads(key)


def find_@I(a, b=None):
    found = find_@I(a)
    return Store@M.load(found)


LIMIT = @N
print(find_@I(LIMIT))
'''
BROKEN = "def fine_@I(x):\n    return x\n\n\nif broken(:\n"
JAVA = "package a;\nclass Box@M {\n    int size@I(int a) { if (a > 0) { return a; } return 0; }\n    class In { void deep() { } }\n}\n"
SCRIPT = "/** Adds @I. */\nfunction add@I(a: number) { return `${a}{`; }\nclass Svc@M {\n    async run(q: string): Promise<void> { return add@I(1); }\n    #hid() { return 1; }\n}\n"
PATCH = """diff --git a/src/@I.py b/src/@I.py
--- a/src/@I.py
+++ b/src/@I.py
@@ -12,3 +12,3 @@ class Store@M:
 def find_@I(a, b=None):
-    found = find_@I(b)
+    found = find_@I(a)
     return Store@M.load(found)
"""
#: What diff_hunks_parse also reads: a hunk that only removes a line, which looks like a file's header.
REMOVAL = """@@ -17,3 +17,2 @@ def find_@I(a, b=None):
 LIMIT = @N
--- limit
 print(find_@I(LIMIT))
"""
#: By the rest of a document's id by five: the file's suffix and its template.
KINDS = ((".py", PYTHON), (".py", PYTHON), (".py", BROKEN), (".java", JAVA), (".ts", SCRIPT))


def _every_document(spark, sf_dir):
    """(doc_id, n), in as many parts as shuffles have: a row is few bytes here and a file to be parsed later, so parts must not be joined by size."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", "n_chars")
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").groupBy("doc_id").agg(F.max("n_chars").alias("n"))


def _documents(spark, sf_dir, *rests: int):
    return _every_document(spark, sf_dir).where((F.col("doc_id") >= 0) & (F.col("doc_id") % 5).isin(*rests))


def _filled(template: str):
    out = F.lit(template)
    for mark, value in (("@I", F.col("doc_id")), ("@M", F.col("doc_id") % 7), ("@N", F.coalesce("n", F.lit(0)))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def _files(spark, sf_dir, *rests: int):
    rest = F.col("doc_id") % 5
    text, suffix = F.lit(None).cast("string"), F.lit("")
    for i in rests:
        text, suffix = F.when(rest == i, _filled(KINDS[i][1])).otherwise(text), F.when(rest == i, KINDS[i][0]).otherwise(suffix)
    return _documents(spark, sf_dir, *rests).select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.encode(text, "UTF-8").alias("content"))


def _shown(symbols):
    lists = [F.array_join(f"python_static.{c}", "; ").alias(c) for c in ("params", "calls", "framework_tags")]
    return symbols.select("file", "name", "symbol_kind", "class_name", "lineno", "end_lineno", "docstring", *lists, "python_static.fallback", F.sha2("raw_code", 256).alias("code_hash"))


# What the templates hold, read by eye: names, lines and texts. The code is cut from the lines by the SQL itself.
_COLUMNS = ("name", "symbol_kind", "class_name", "lineno", "end_lineno", "docstring", "params", "calls", "framework_tags", "fallback", "first")
_FIND = "('find_@I', 'function', NULL, 12, 14, NULL, 'a; b', 'Store@M.load; find_@I', '', NULL, 1)"
_IN_PYTHON = f"""('load', 'method', 'Store@M', 7, 9, 'Entry @I.', 'key: str; rest', 'json.loads', '', NULL, 5), {_FIND},
('CodeBlock:17-18:calls=find_@I,print', 'code_block', NULL, 17, 18, NULL, NULL, 'find_@I; print', NULL, NULL, 1)"""
_IN_BROKEN = "('fine_@I', 'function', NULL, 1, 2, NULL, NULL, NULL, NULL, 'tree_sitter', 1)"
_IN_JAVA = "('size@I', 'method', 'Box@M', 3, 3, NULL, NULL, NULL, NULL, NULL, 5), ('deep', 'method', 'In', 4, 4, NULL, NULL, NULL, NULL, NULL, 16)"
_IN_SCRIPT = """('add@I', 'function', NULL, 2, 2, 'Adds @I.', NULL, NULL, NULL, NULL, 1), ('run', 'method', 'Svc@M', 4, 4, NULL, NULL, NULL, NULL, NULL, 5), ('#hid', 'method', 'Svc@M', 5, 5, NULL, NULL, NULL, NULL, NULL, 5)"""


def _put(text: str) -> str:
    return f"replace(replace(replace({text}, '@I', CAST(doc_id AS VARCHAR)), '@M', CAST(doc_id % 7 AS VARCHAR)), '@N', CAST(n AS VARCHAR))"


def _text(source: str) -> str:
    return "'" + source.replace("'", "''") + "'"


def _cut(rests: str, suffix: str, source: str, values: str) -> str:
    """The symbols of all files of a template; ``first`` is the character that a symbol's code begins at in its first line, ``deep`` ends before the line does."""
    columns = ", ".join(c if c in ("lineno", "end_lineno") else f"{_put(c)} AS {c}" for c in _COLUMNS[:-1])
    lines = f"list_slice(string_split({_put(_text(source))}, chr(10)), lineno, end_lineno)"
    code = f"substr(array_to_string({lines}, chr(10)), CASE WHEN symbol_kind = 'method' AND lineno < end_lineno THEN 1 ELSE first END)"
    code = f"CASE WHEN name = 'deep' THEN substr({code}, 1, 15) ELSE {code} END"
    return f"""SELECT 'src/' || doc_id || '{suffix}' AS file, {columns}, sha256({code}) AS code_hash FROM (SELECT doc_id, coalesce(max(n_chars), 0) AS n FROM documents WHERE doc_id >= 0 GROUP BY doc_id), (VALUES {values}) t({', '.join(_COLUMNS)}) WHERE doc_id % 5 IN ({rests})"""


@query(f"{_cut('0, 1', '.py', PYTHON, _IN_PYTHON)} UNION ALL {_cut('2', '.py', BROKEN, _IN_BROKEN)}")
def extract_python_symbols(spark, sf_dir):
    return _shown(extract_symbols(_files(spark, sf_dir, 0, 1, 2)))


@query(f"{_cut('3', '.java', JAVA, _IN_JAVA)} UNION ALL {_cut('4', '.ts', SCRIPT, _IN_SCRIPT)}")
def extract_brace_symbols(spark, sf_dir):
    return _shown(extract_symbols(_files(spark, sf_dir, 3, 4)))


_PY = "SELECT DISTINCT doc_id, 'src/' || doc_id || '.py' AS file FROM documents WHERE doc_id >= 0 AND doc_id % 5 IN (0, 1)"


@query(f"""SELECT file, {_put("caller").replace("CAST(n AS VARCHAR)", "''")} AS caller, {_put("callee").replace("CAST(n AS VARCHAR)", "''")} AS callee
FROM ({_PY}), (VALUES ('find_@I', 'find_@I'), ('find_@I', 'load'), ('CodeBlock:17-18:calls=find_@I,print', 'find_@I')) t(caller, callee)""")
def call_graph_edges(spark, sf_dir):
    return call_graph(extract_symbols(_files(spark, sf_dir, 0, 1)))


@query(f"SELECT file, 'load' AS caller, 'json' AS module, 'json.loads' AS call FROM ({_PY})")
def import_dependencies(spark, sf_dir):
    return import_edges(extract_symbols(_files(spark, sf_dir, 0, 1)))


def _patches(docs, template: str):
    none = [F.lit(None).cast("string").alias(c) for c in ("commit_hash", "commit_subject", "commit_message")]
    return docs.select(*none, _filled(template).alias("patch"))


_HEADER, _FIRST = PATCH[: PATCH.index("@@ -12")], PATCH[PATCH.index("@@ -12") :].rstrip()
_EVERY = "SELECT doc_id, coalesce(max(n_chars), 0) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id"


@query(f"""SELECT 'src/' || doc_id || '.py' AS path, lineno, end_lineno, {_put("changed")} AS changed_code, sha256({_put(f"{_text(_HEADER)} || body")}) AS search_hash, additions, 1 AS deletions, added, removed, anchor FROM ({_EVERY}), (VALUES
(13, 14, '    found = find_@I(b)' || chr(10) || '    found = find_@I(a)', {_text(_FIRST)}, 1, '13', '13', 12), (17, 18, '-- limit', {_text(REMOVAL.rstrip())}, 0, '', '18', 17)) t(lineno, end_lineno, changed, body, additions, added, removed, anchor)""")
def diff_hunks_parse(spark, sf_dir):
    ranges = [ranges_text(F.col(f"{c}_ranges")).alias(c) for c in ("added", "removed")]
    patches = _patches(_every_document(spark, sf_dir), PATCH + REMOVAL)
    return hunks(patches).select("path", "lineno", "end_lineno", "changed_code", F.sha2("search_text", 256).alias("search_hash"), "additions", "deletions", *ranges, "anchor")


@query(_cut("0, 1", ".py", PYTHON, _FIND))
def changed_symbols(spark, sf_dir):
    return _shown(touched(extract_symbols(_files(spark, sf_dir, 0, 1)), hunks(_patches(_documents(spark, sf_dir, 0, 1), PATCH))))
