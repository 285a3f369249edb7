"""Retrieval queries over the documents and embeddings tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.encoders import HashEncoder, embed
from quarry.operators.fuse import SEMANTIC_WEIGHT, band, blend, min_max, top_ranked
from quarry.operators.lexical import bm25, document_frequency, grep, keyword_match, matched_keywords
from quarry.operators.vector import distances, lsh_nearest, nearest, nearest_by_matrix, semantic_scores
from quarry.queries import query
from quarry.session import table

TOP = 10
KEYWORDS = "the tion er"
LITERAL, PATTERN = " of the ", r"(password|token|secret)\s*[:=]"

TOKENS = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*|[0-9]+'), lambda t: lower(t))"
#: The query text is the first benchmark item's, whole.
TERMS = f"q AS (SELECT t, CAST(count(*) AS DOUBLE) AS w FROM (SELECT unnest({TOKENS}) AS t FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)) GROUP BY t)"


def bm25_sql(docs: str) -> str:
    """CTEs q and b(doc_id, s): BM25 over the documents that ``docs`` selects."""
    return f"""{TERMS},
d AS (SELECT doc_id, {TOKENS} AS k FROM ({docs})),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(k)) AS a FROM d),
tf AS (SELECT doc_id, t, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(k) AS t, len(k) AS dl FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
df AS (SELECT t, CAST(count(*) AS DOUBLE) AS df FROM tf GROUP BY t),
b AS (SELECT doc_id, sum(w * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / a))) AS s
      FROM tf JOIN df USING (t) JOIN q USING (t), n GROUP BY doc_id)"""


DISTANCE = "list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
MEASURED = f"v AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1), m AS (SELECT vec_id, label, {DISTANCE} AS d FROM embeddings e, v)"


def query_text(spark, sf_dir) -> str:
    return table(spark, sf_dir, "benchmark").orderBy("item_id").select("text").first()["text"]


def query_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def lexical(spark, sf_dir, docs=None):
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return bm25(docs, "doc_id", F.col("text"), query_text(spark, sf_dir))


def measured(spark, sf_dir):
    return distances(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir))


@query(f"WITH {bm25_sql('SELECT * FROM documents')} SELECT doc_id, round(s, 6) AS bm25, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 10")
def bm25_topk(spark, sf_dir):
    return top_ranked(lexical(spark, sf_dir).withColumn("bm25", F.round("bm25", 6)), "bm25", "doc_id", TOP)


@query(f"""WITH {bm25_sql("SELECT * FROM documents WHERE lang = 'en'")} SELECT doc_id, round(s, 6) AS bm25, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 10""")
def bm25_scoped(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return top_ranked(lexical(spark, sf_dir, docs).withColumn("bm25", F.round("bm25", 6)), "bm25", "doc_id", TOP)


@query(f"WITH {bm25_sql('SELECT * FROM documents')} SELECT doc_id, round(CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END, 6) AS lexical FROM b")
def bm25_minmax_all(spark, sf_dir):
    return min_max(lexical(spark, sf_dir), "bm25", "lexical").select("doc_id", F.round("lexical", 6).alias("lexical"))


@query(f"SELECT t AS token, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY t")
def token_document_frequency(spark, sf_dir):
    return document_frequency(table(spark, sf_dir, "documents"), F.col("text"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'er')")
def keyword_and_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(keyword_match(F.col("text"), KEYWORDS)).select("doc_id")


@query("SELECT doc_id, array_to_string(list_filter(['the', 'tion', 'er', 'zu'], lambda w: contains(lower(text), w)), ' ') AS matched FROM documents")
def multi_keyword_and(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(matched_keywords(F.col("text"), "the tion er zu"), " ").alias("matched"))


GREP_SQL = """WITH l AS (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS a FROM documents WHERE {test_text} AND position(chr(0) IN substr(text, 1, 4096)) = 0),
e AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM l)
SELECT doc_id, line_no, substr(line, 1, 500) AS line FROM e WHERE {test_line} ORDER BY doc_id, line_no LIMIT 100"""


@query(GREP_SQL.format(test_text="contains(text, ' of the ')", test_line="contains(line, ' of the ')"))
def grep_literal(spark, sf_dir):
    return grep(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), LITERAL)


_CI = r"regexp_matches({}, '(?i)(password|token|secret)\s*[:=]')"


@query(GREP_SQL.format(test_text=_CI.format("text"), test_line=_CI.format("line")))
def grep_regex_ci(spark, sf_dir):
    return grep(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), PATTERN, ignore_case=True)


@query(f"WITH {MEASURED} SELECT vec_id, round(d, 6) AS distance FROM m ORDER BY d, vec_id LIMIT 10")
def knn_exact_topk(spark, sf_dir):
    found = nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir), TOP)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"WITH {MEASURED} SELECT vec_id, round(d, 6) AS distance FROM m ORDER BY d, vec_id LIMIT 10")
def knn_matrix_topk(spark, sf_dir):
    found = nearest_by_matrix(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir), TOP)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


_SCORED = "round(CASE WHEN max(d) OVER () = min(d) OVER () THEN 1 ELSE greatest(0, least(1, 1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()))) END, 6)"


@query(f"WITH {MEASURED}, t AS (SELECT * FROM m ORDER BY d, vec_id LIMIT 10) SELECT vec_id, round(d, 6) AS distance, {_SCORED} AS semantic, row_number() OVER (ORDER BY d, vec_id) AS rank FROM t")
def semantic_topk_scored(spark, sf_dir):
    best = nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir), TOP)
    ranked = top_ranked(semantic_scores(best).withColumn("_near", -F.col("distance")), "_near", "vec_id", TOP)
    return ranked.select("vec_id", F.round("distance", 6).alias("distance"), F.round("semantic", 6).alias("semantic"), "rank")


@query(f"WITH {MEASURED} SELECT vec_id, {_SCORED} AS semantic FROM m")
def semantic_all_scored(spark, sf_dir):
    return semantic_scores(measured(spark, sf_dir)).select("vec_id", F.round("semantic", 6).alias("semantic"))


@query(f"WITH {MEASURED}, s AS (SELECT {_SCORED} AS s FROM m) SELECT CASE WHEN s >= 7e-1 THEN 'high' WHEN s >= 4e-1 THEN 'mid' ELSE 'low' END AS band, count(*) AS n, max(s) AS best FROM s GROUP BY 1")
def score_bands(spark, sf_dir):
    scored = semantic_scores(measured(spark, sf_dir)).select(F.round("semantic", 6).alias("s"))
    return scored.groupBy(band(F.col("s")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("best"))


def _hybrid(spark, sf_dir, text: str | None, k: int = TOP, weight: float = SEMANTIC_WEIGHT):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    near = distances(vectors.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), "vec_id", "embedding", query_vector(spark, sf_dir))
    semantic = semantic_scores(near).select(F.col("vec_id").alias("doc_id"), "semantic")
    scope = docs.join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    found = bm25(scope, "doc_id", F.col("text"), query_text(spark, sf_dir) if text is None else text)
    both = blend(semantic, min_max(found, "bm25", "lexical"), "doc_id", weight)
    both = both.select("doc_id", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "score")])
    return top_ranked(both, "score", "doc_id", k)


_SCOPE = "SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)"
HYBRID_SQL = f"""WITH {MEASURED}, c AS (SELECT * FROM m WHERE vec_id IN (SELECT doc_id FROM documents)),
x AS (SELECT vec_id AS doc_id, CASE WHEN max(d) OVER () = min(d) OVER () THEN 1 ELSE greatest(0, least(1, 1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()))) END AS s FROM c),
{bm25_sql(_SCOPE)},
y AS (SELECT doc_id, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS l FROM b),
z AS (SELECT doc_id, coalesce(s, 0) AS s, coalesce(l, 0) AS l FROM x FULL JOIN y USING (doc_id)),
r AS (SELECT doc_id, round(s, 6) AS semantic, round(CAST(l AS DOUBLE), 6) AS lexical, round(75e-2 * s + 25e-2 * l, 6) AS score FROM z)
SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10"""


@query(HYBRID_SQL)
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir, None)


@query(f"""WITH {MEASURED}, c AS (SELECT * FROM m WHERE vec_id IN (SELECT doc_id FROM documents)),
x AS (SELECT vec_id AS doc_id, round(greatest(0, least(1, 1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()))), 6) AS semantic, 1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS s FROM c),
r AS (SELECT doc_id, semantic, CAST(0 AS DOUBLE) AS lexical, round(75e-2 * s, 6) AS score FROM x)
SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10""")
def hybrid_no_lexical_hits(spark, sf_dir):
    return _hybrid(spark, sf_dir, "日本語のみ")


#: CRC-32 of ASCII text t, by hand: bits from a byte, bytes from the text.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(substr(t, CAST(i AS INT), 1)) AS BIGINT))),
lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda r, j: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)), CAST(4294967295 AS BIGINT))"""


@query(f"""WITH d AS (SELECT doc_id, unnest({TOKENS}) AS t FROM documents), h AS (SELECT t, {_CRC} AS h FROM (SELECT DISTINCT t FROM d)),
s AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS x FROM d JOIN h USING (t) GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM s GROUP BY 1),
e AS (SELECT k.doc_id, k.i, CAST(CAST(CASE WHEN n.n > 0 THEN coalesce(s.x, 0) / n.n ELSE 0 END AS FLOAT) AS DOUBLE) AS x FROM (SELECT doc_id, unnest(range(64)) AS i FROM documents) k LEFT JOIN s ON s.doc_id = k.doc_id AND s.i = k.i LEFT JOIN n ON n.doc_id = k.doc_id)
SELECT e.doc_id, round(sum((e.x - q.x) * (e.x - q.x)), 6) AS distance FROM e JOIN e q ON q.i = e.i AND q.doc_id = (SELECT min(doc_id) FROM documents) GROUP BY e.doc_id ORDER BY sum((e.x - q.x) * (e.x - q.x)), e.doc_id LIMIT 10""")
def hash_embed_knn(spark, sf_dir):
    """Every document through the encoder plug-in, and the nearest of the first one."""
    docs = embed(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), HashEncoder(), batch=256)
    first = docs.orderBy("doc_id").select("embedding").first()[0]
    return nearest(docs, "doc_id", "embedding", list(first), TOP).select("doc_id", F.round("distance", 6).alias("distance"))


@query()
def lsh_knn(spark, sf_dir):
    found = lsh_nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", query_vector(spark, sf_dir), TOP)
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


