"""Queries over what searches, learners and readers see: documents stand for symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import projections as P
from quarry.operators.fuse import top_ranked
from quarry.operators.lexical import bm25, grep, keyword_match
from quarry.plans.retrieval import bm25_sql, query_text
from quarry.queries import query
from quarry.session import table
from quarry.streaming.progress import counted

#: A document as a symbol, by hand: English ones are functions, German ones methods, French ones blocks, others hunks.
_SYMBOLS = """s AS (SELECT doc_id, 'doc_' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'doc_' || doc_id ELSE 'fn' || doc_id END AS function_name, CASE WHEN lang = 'de' THEN source END AS class_name,
CASE lang WHEN 'en' THEN 'function' WHEN 'de' THEN 'method' WHEN 'fr' THEN 'code_block' ELSE 'diff_hunk' END AS kind, '/w/' || source || '/' || doc_id || '.py' AS file, coalesce(text, '') AS code,
CASE WHEN lang NOT IN ('en', 'de', 'fr') AND doc_id % 2 = 0 THEN 'hunk ' || doc_id END AS search_text, '{"calls":["' || source || '","' || lang || '"]}' AS static, n_chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)"""
_JOINED = "array_to_string(list_filter([name, CASE WHEN function_name <> name THEN function_name END, {middle}, nullif(code, ''), static], lambda x: x IS NOT NULL), chr(10))"
_OWN = "CASE WHEN kind = 'diff_hunk' AND search_text IS NOT NULL THEN search_text ELSE {own} END"


def symbols(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    kind = F.when(F.col("lang") == "en", "function").when(F.col("lang") == "de", "method").when(F.col("lang") == "fr", "code_block").otherwise("diff_hunk")
    name, key = F.concat(F.lit("doc_"), F.col("doc_id").cast("string")), F.col("doc_id").cast("string")
    return docs.select(
        "doc_id", name.alias("name"), F.when(F.col("doc_id") % 3 == 0, name).otherwise(F.concat(F.lit("fn"), key)).alias("function_name"), F.when(F.col("lang") == "de", F.col("source")).alias("class_name"),
        kind.alias("symbol_kind"), F.concat(F.lit("/w/"), F.col("source"), F.lit("/"), key, F.lit(".py")).alias("file"), F.col("text").alias("raw_code"), F.lit(None).cast("string").alias("docstring"),
        F.when((kind == "diff_hunk") & (F.col("doc_id") % 2 == 0), F.concat(F.lit("hunk "), key)).alias("search_text"), F.struct(F.array("source", "lang").alias("calls"), F.lit(None).cast("string").alias("returns")).alias("python_static"),
        F.col("n_chars").cast("int").alias("lineno"),
    )


@query(f"""WITH {_SYMBOLS} SELECT doc_id, sha256({_OWN.format(own=_JOINED.format(middle="class_name, kind, file, doc_id || '.py'"))}) AS bm25_text, sha256({_OWN.format(own=_JOINED.format(middle='class_name'))}) AS keyword_text FROM s""")
def symbol_texts(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    return rows.select("doc_id", F.sha2(P.bm25_text(rows), 256).alias("bm25_text"), F.sha2(P.keyword_text(rows), 256).alias("keyword_text"))


@query(f"""WITH {_SYMBOLS}, k AS (SELECT unnest(['all', 'functions', 'methods', 'function_level', 'codeblocks']) AS filter)
SELECT filter, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM s, k WHERE CASE WHEN kind = 'diff_hunk' THEN filter IN ('all', 'function_level') WHEN filter = 'functions' THEN kind = 'function' WHEN filter = 'methods' THEN kind = 'method'
WHEN filter = 'function_level' THEN kind <> 'code_block' WHEN filter = 'codeblocks' THEN kind = 'code_block' ELSE true END GROUP BY filter""")
def kind_filters(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    kinds = ("all", "functions", "methods", "function_level", "codeblocks")
    passed = F.filter(F.array(*[F.when(P.is_shown(k, F.col("symbol_kind"), F.col("class_name")), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
    return rows.select("doc_id", F.explode(passed).alias("filter")).groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""WITH {_SYMBOLS} SELECT doc_id, CASE kind WHEN 'diff_hunk' THEN 'UnifiedDiff' WHEN 'code_block' THEN 'CodeBlock' WHEN 'method' THEN 'Method' ELSE 'Function' END AS label,
CASE WHEN kind = 'diff_hunk' THEN 'Unified diff: ' || name ELSE function_name END AS shown FROM s""")
def kind_labels(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    hunk = F.col("symbol_kind") == "diff_hunk"
    named = rows.withColumns({"function_name": F.when(hunk, F.concat(F.lit("Diff hunk: "), F.col("name"))).otherwise(F.col("function_name")), "diff_code": F.col("raw_code"), "changed_code": F.lit("")})
    return P.as_diff_result(named).select("doc_id", P.kind_label(F.col("symbol_kind"), F.col("class_name")).alias("label"), F.col("name").alias("shown"))


@query(f"""WITH {_SYMBOLS} SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN file ELSE 'p/' || doc_id END AS file, CAST(CASE doc_id % 2 WHEN 0 THEN n_chars ELSE 7 END AS INT) AS lineno,
coalesce(nullif(function_name, ''), name) AS name, CASE WHEN code <> '' THEN sha256(code) END AS code_sha256, length(code) AS n FROM s""")
def training_payloads(spark, sf_dir):
    even = F.col("doc_id") % 2 == 0
    rows = symbols(spark, sf_dir).select(
        F.col("doc_id").alias("rank"), F.when(even, F.col("file")).otherwise("").alias("file"), F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), F.when(even, F.col("lineno")).alias("line_number"), F.lit(7).alias("line"),
        "name", "function_name", F.col("raw_code").alias("text"), "symbol_kind",
    )
    return P.payload(rows).select(F.col("rank").alias("doc_id"), "file", "lineno", "name", "code_sha256", F.length("code").cast("long").alias("n"))


_READ = """CAST(rank AS VARCHAR) || '. ' || CASE kind WHEN 'diff_hunk' THEN 'UnifiedDiff' WHEN 'code_block' THEN 'CodeBlock' WHEN 'method' THEN 'Method' ELSE 'Function' END || ' `' || coalesce(class_name || '.', '') || function_name || '` at `' || substr(file, 4) || ':' || n_chars || '`'
|| chr(10) || '   rank_score=' || printf('%.3f', s) || chr(10) || '   calls=' || replace(replace(replace(static, '{"calls":["', ''), '"]}', ''), '","', ', ')"""


@query(f"""WITH {bm25_sql('SELECT * FROM documents')}, {_SYMBOLS}, r AS (SELECT doc_id, round(s, 6) AS s, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM b JOIN s USING (doc_id) QUALIFY rank <= 12)
SELECT rank, {_READ} AS head FROM r JOIN s USING (doc_id)""")
def agent_reading(spark, sf_dir):
    """The heads of what an agent reads of the first results; tests compare the snippets."""
    rows = symbols(spark, sf_dir)
    found = bm25(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), query_text(spark, sf_dir)).join(rows.select("doc_id"), "doc_id", "left_semi")
    best = top_ranked(found.withColumn("score", F.round("bm25", 6)).drop("bm25"), "score", "doc_id", P.SHOWN_RESULTS)
    shown = P.reading(rows.withColumn("end_lineno", F.lit(None).cast("int")).join(F.broadcast(best), "doc_id"), "/w")  # 12 rows
    return shown.select("rank", F.split_part("text", F.lit("\n   snippet:"), F.lit(1)).alias("head"))


@query("""WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS a FROM documents WHERE contains(text, ' of the ') AND position(chr(0) IN substr(text, 1, 4096)) = 0),
e AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM l), m AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS position FROM e WHERE contains(line, ' of the ') QUALIFY position <= 40)
SELECT CAST(position AS INT) AS position, position || '. `' || doc_id || ':' || line_no || '`' AS head FROM m""")
def agent_grep(spark, sf_dir):
    matches = grep(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), " of the ")
    return P.reading_matches(matches, "doc_id").select("position", F.split_part("text", F.lit("\n"), F.lit(1)).alias("head"))


@query(f"""WITH {_SYMBOLS} SELECT count(*) AS num_functions, count(DISTINCT file) FILTER (WHERE contains(lower(code), 'the') AND contains(lower(code), 'tion')) AS result_files,
count(*) FILTER (WHERE contains(lower(code), 'the') AND contains(lower(code), 'tion')) AS result_count FROM s""")
def search_counters(spark, sf_dir):
    """Counters of a keyword search, observed while its results are written: the search runs once."""
    scope, of_scope = counted(symbols(spark, sf_dir), "scope", num_functions=F.count(F.lit(1)))
    found = scope.where(keyword_match(F.coalesce("raw_code", F.lit("")), "the tion"))
    results, of_results = counted(found.select("doc_id", "file"), "results", result_count=F.count(F.lit(1)), result_files=F.size(F.collect_set("file")).cast("long"))
    results.write.format("noop").mode("overwrite").save()
    row = of_scope.get | of_results.get
    return spark.createDataFrame([(row["num_functions"], row["result_files"], row["result_count"])], "num_functions long, result_files long, result_count long")
