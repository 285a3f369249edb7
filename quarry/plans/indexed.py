"""Queries through what is kept on disk: postings, snapshots, vector cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import cells, postings, tree, waves
from quarry.operators.catalog import content_hash
from quarry.operators.fuse import top_ranked
from quarry.plans.analysis import PATH_SQL, paths
from quarry.plans.retrieval import MEASURED, TOKENS, TOP, bm25_sql, query_text, query_vector
from quarry.queries import query
from quarry.session import shared_folder, table
from quarry.sources import snapshots


def _index(spark, sf_dir) -> str:
    path = shared_folder(spark, "postings")
    postings.build_postings(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), path)
    return path


def _ranked(found):
    return top_ranked(found.select(F.col("key").alias("doc_id"), F.round("bm25", 6).alias("bm25")), "bm25", "doc_id", TOP)


@query(f"WITH {bm25_sql('SELECT * FROM documents')} SELECT doc_id, round(s, 6) AS bm25, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 10")
def bm25_postings(spark, sf_dir):
    return _ranked(postings.search_postings(spark, _index(spark, sf_dir), query_text(spark, sf_dir), TOP))


@query(f"""WITH {bm25_sql("SELECT * FROM documents WHERE lang = 'en'")} SELECT doc_id, round(s, 6) AS bm25, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 10""")
def bm25_postings_scoped(spark, sf_dir):
    scope = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return _ranked(postings.search_postings(spark, _index(spark, sf_dir), query_text(spark, sf_dir), TOP, scope))


@query(f"""WITH d AS (SELECT doc_id, {TOKENS} AS k FROM documents), a AS (SELECT avg(len(k)) AS a FROM d),
t AS (SELECT doc_id, t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(k) AS t, len(k) AS dl FROM d) GROUP BY doc_id, t)
SELECT t AS token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf, round(max(tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / a))), 6) AS most FROM t, a GROUP BY t""")
def postings_lexicon(spark, sf_dir):
    return postings.lexicon(spark, _index(spark, sf_dir)).select("token", "df", "tf", F.round("most", 6).alias("most"))


def _states(spark, sf_dir) -> str:
    """Two states of documents: all of them, then those labelled toxic rewritten and those of low quality gone."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    root = shared_folder(spark, "states")
    hashed = docs.groupBy("doc_id").agg(F.max(content_hash(F.col("text"))).alias("hash"))
    snapshots.append(root, hashed, "doc_id", epoch=0)
    marked = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).join(hashed, "doc_id")
    rewritten = marked.where("toxic = 1 AND quality > 0").select("doc_id", F.sha2(F.concat("hash", F.lit("!")), 256).alias("hash"))
    snapshots.append(root, rewritten, "doc_id", marked.where("quality = 0").select("doc_id"), epoch=1)
    return root


_STATES = """WITH h AS (SELECT doc_id, max(sha256(coalesce(text, ''))) AS hash FROM documents GROUP BY doc_id),
m AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM h) GROUP BY doc_id),
w AS (SELECT 1 AS version, doc_id, hash, false AS gone FROM h
      UNION ALL SELECT 2, m.doc_id, sha256(h.hash || '!'), false FROM m JOIN h USING (doc_id) WHERE toxic = 1 AND quality > 0
      UNION ALL SELECT 2, doc_id, NULL, true FROM m WHERE quality = 0)"""


@query(f"{_STATES} SELECT doc_id, hash, version FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS nth FROM w) WHERE nth = 1 AND NOT gone")
def snapshot_newest(spark, sf_dir):
    found = snapshots.read(spark, _states(spark, sf_dir), with_version=True)
    return found.select("doc_id", "hash", F.col(snapshots.VERSION).cast("int").alias("version"))


@query(f"{_STATES} SELECT version, gone, count(*) AS n FROM w GROUP BY version, gone")
def snapshot_deltas(spark, sf_dir):
    """Rows that each write put down: a batch writes only what changed."""
    rows = snapshots.history(spark, _states(spark, sf_dir))
    return rows.groupBy(F.col(snapshots.VERSION).cast("int").alias("version"), F.col(snapshots.GONE).alias("gone")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_STATES} SELECT doc_id, hash FROM w WHERE version = 1")
def snapshot_as_of(spark, sf_dir):
    """The first version, read after a second one and its compaction."""
    root = _states(spark, sf_dir)
    snapshots.compact(spark, root)
    return snapshots.read(spark, root, 1)


def _cells(spark, sf_dir) -> str:
    path = shared_folder(spark, "cells")
    cells.build_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", path)
    return path


@query(f"WITH {MEASURED} SELECT vec_id, round(d, 6) AS distance FROM m ORDER BY d, vec_id LIMIT 10")
def cells_exact_topk(spark, sf_dir):
    found = cells.nearest_in_cells(spark, _cells(spark, sf_dir), query_vector(spark, sf_dir), TOP, exact=True)
    return found.select(F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query()
def cells_knn(spark, sf_dir):
    """Approximate: the 10 nearest of every vector whose id is divisible by 50, among all."""
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = cells.nearest_of_many(spark, _cells(spark, sf_dir), queries, TOP)
    return found.select("query", F.col("key").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


_GREP = """WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS a FROM documents WHERE contains(text, ' of the ') AND position(chr(0) IN substr(text, 1, 4096)) = 0),
e AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM l)
SELECT doc_id, line_no, substr(line, 1, 500) AS line FROM e WHERE contains(line, ' of the ') ORDER BY doc_id, line_no LIMIT 100"""


@query(_GREP)
def grep_early_exit(spark, sf_dir):
    path = f"{shared_folder(spark, 'parts')}/table"  # the folder itself is there already
    waves.lay_out(table(spark, sf_dir, "documents"), "doc_id", path, part_rows=500)
    return waves.grep_first(spark, path, "doc_id", "text", " of the ").rows


#: A folder for each language, first digit and first two digits of a page's number; the list checks some of them.
CHECKED = ["./de/", "en/1", "en/2/25/", "fr/3/3", "absent"]
_FOLDERS = f"""WITH p AS (SELECT string_split(path, '/') AS s FROM ({PATH_SQL}) WHERE path <> ''),
f AS (SELECT s[1] AS a, left(s[2], 1) AS b, left(s[2], 2) AS c FROM p WHERE len(s) > 1 AND s[1] <> '' AND s[2] <> ''),
d AS (SELECT DISTINCT * FROM (SELECT 1 AS depth, a AS rel_path, a AS name, '.' AS parent FROM f UNION ALL SELECT 2, a || '/' || b, b, a FROM f UNION ALL SELECT 3, a || '/' || b || '/' || c, c, a || '/' || b FROM f)),
n AS (SELECT * FROM d ORDER BY depth, rel_path LIMIT 150),
k AS (SELECT *, rel_path IN ('de', 'en/1', 'en/2/25', 'fr/3/3') AS checked, rel_path = 'de' OR starts_with(rel_path, 'de/') OR rel_path = 'en/1' OR starts_with(rel_path, 'en/1/') OR rel_path = 'en/2/25' OR rel_path = 'fr/3/3' AS covered FROM n),
v AS (SELECT x.rel_path, count(*) AS n, count(*) FILTER (WHERE y.covered) AS yes FROM k x JOIN k y ON y.rel_path = x.rel_path OR starts_with(y.rel_path, x.rel_path || '/')
      WHERE y.rel_path NOT IN (SELECT parent FROM k) GROUP BY 1)"""


@query(f"""{_FOLDERS} SELECT rel_path, name, depth, parent, checked, CASE WHEN covered OR yes = n THEN 'all'
WHEN yes > 0 OR EXISTS (SELECT 1 FROM k z WHERE z.checked AND starts_with(z.rel_path, k.rel_path || '/')) THEN 'some' ELSE 'none' END AS state FROM k JOIN v USING (rel_path)""")
def ignore_tree(spark, sf_dir):
    pages = paths(spark, sf_dir).where("size(split(path, '/')) > 1 AND split(path, '/')[0] <> '' AND split(path, '/')[1] <> ''").select(F.split("path", "/").alias("s"))
    number = F.col("s")[1]
    files = pages.select(F.concat_ws("/", F.col("s")[0], F.left(number, F.lit(1)), F.left(number, F.lit(2)), number).alias("path"))
    return tree.ignore_tree(files, F.col("path"), CHECKED, most=150)
