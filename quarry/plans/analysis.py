"""Scope, catalog, range, statistics, feedback and text queries over all tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import globs, projections
from quarry.functions import text as X
from quarry.operators import catalog, commits, feedback, ranges, stats
from quarry.operators.calls import external_calls
from quarry.operators.fuse import min_max, top_ranked
from quarry.operators.lexical import bm25
from quarry.operators.vector import distances, semantic_scores
from quarry.plans.commit_search import search_commits
from quarry.plans.requests import Search
from quarry.plans.retrieval import MEASURED, bm25_sql, lexical, measured, query_text, query_vector
from quarry.queries import query
from quarry.session import table
from quarry.streaming.events import sessions, tumbling

EXCLUDE = ["*.php", "*/1*"]
IGNORE = "# pages\nen/\n*7\n!*77\np?ge[0-4]*\nfr/1*\n"
PATH_SQL = "SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages"


def paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"))


INCLUDE_PATHS = ["en/*", "de/*", "fr/**"]
#: Written by hand: what the globs mean, not what the code makes of them.
PATHS_SQL = """path <> '' AND (starts_with(path, 'en/') OR starts_with(path, 'de/') OR path = 'fr' OR starts_with(path, 'fr/')) AND NOT (suffix(path, '.php') OR contains(path, '/1'))"""


@query(f"SELECT page_id, path FROM ({PATH_SQL}) WHERE {PATHS_SQL}")
def glob_filter(spark, sf_dir):
    return paths(spark, sf_dir).where(globs.allowed(F.col("path"), INCLUDE_PATHS, EXCLUDE))


#: Written by hand from IGNORE, last rule first: a path is a rule's if it or a folder above it is.
IGNORE_SQL = """CASE WHEN regexp_matches(path, '^fr/1[^/]*(/|$)') THEN true WHEN regexp_matches(path, '(^|/)p.ge[0-4][^/]*(/|$)') AND NOT regexp_matches(path, '(^|/)p/ge') THEN true
WHEN regexp_matches(path, '(^|/)[^/]*77(/|$)') THEN false WHEN regexp_matches(path, '(^|/)[^/]*7(/|$)') THEN true WHEN regexp_matches(path, '(^|/)en/') THEN true ELSE false END"""


@query(f"SELECT page_id, path FROM ({PATH_SQL}) WHERE NOT ({IGNORE_SQL})")
def ignore_filter(spark, sf_dir):
    return paths(spark, sf_dir).where(~globs.is_ignored(F.col("path"), IGNORE))


SEGMENTS = ("de", "fr", "src")


@query(f"SELECT page_id, path FROM ({PATH_SQL}) WHERE len(list_filter(string_split(path, '/'), lambda s: lower(s) IN {SEGMENTS})) > 0")
def source_segment_scope(spark, sf_dir):
    return paths(spark, sf_dir).where(globs.in_source_tree(F.col("path"), SEGMENTS))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def file_scope_semi(spark, sf_dir):
    scope = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(scope, "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE regexp_matches(source, '^src1.*$') INTERSECT SELECT doc_id FROM labels")
def scope_intersect_glob(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(globs.allowed(F.col("source"), ["src1*"], None)).select("doc_id")
    return docs.intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE false")
def empty_scope_is_none(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(table(spark, sf_dir, "labels").where("quality < 0").select("doc_id"), "doc_id", "left_semi")


@query(f"SELECT page_id, path FROM ({PATH_SQL}) WHERE ({PATHS_SQL}) AND NOT ({IGNORE_SQL}) AND suffix(path, '3') AND page_id IN (SELECT doc_id FROM labels)")
def path_predicate_combined(spark, sf_dir):
    scope = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    test = globs.diff_allowed(F.col("path"), "3", IGNORE, INCLUDE_PATHS, EXCLUDE)
    return paths(spark, sf_dir).where(test).join(scope, "page_id", "left_semi")


# Two states of a tree: documents by path, and the same after toxic ones went, low-quality ones
# were edited and benchmark items came.
OLD_SQL = "SELECT source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS hash FROM documents"
NEW_SQL = """SELECT d.source || '/' || d.doc_id AS path, sha256(coalesce(d.text, '') || CASE WHEN l.quality = 0 THEN chr(10) ELSE '' END) AS hash
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0 UNION ALL SELECT 'benchmark/' || item_id, sha256(text) FROM benchmark"""


def _states(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    old = docs.select(path, catalog.content_hash(F.col("text")).alias("hash"))
    edited = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("quality") == 0, "\n").otherwise(""))
    new = docs.join(labels, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0).select(path, F.sha2(edited, 256).alias("hash"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), catalog.content_hash(F.col("text")).alias("hash"))
    return old, new.unionByName(items)


DIFF_SQL = f"""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status
FROM ({OLD_SQL}) o FULL JOIN ({NEW_SQL}) n ON o.path = n.path"""


@query(DIFF_SQL)
def catalog_diff(spark, sf_dir):
    return catalog.catalog_diff(*_states(spark, sf_dir))


@query(f"SELECT count(*) = 0 AS fresh, count(*) AS changed FROM ({DIFF_SQL}) WHERE status <> 'unchanged'")
def freshness_check(spark, sf_dir):
    return catalog.is_fresh(*_states(spark, sf_dir))


@query("SELECT 'keep' AS action, count(*) AS n FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'embed', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def embedding_reuse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    kept, new = catalog.reuse(docs, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    both = kept.select(F.lit("keep").alias("action")).unionByName(new.select(F.lit("embed").alias("action")))
    return both.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def changed_union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT lang AS ext, count(*) AS n FROM documents GROUP BY lang")
def distinct_extensions(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT array_to_string(s[1:k], '/') AS rel_path, k AS depth, count(*) AS n FROM (SELECT string_split(path, '/') AS s, unnest(range(1, least(len(string_split(path, '/')), 4) + 1)) AS k FROM ({PATH_SQL}))
GROUP BY 1, 2 ORDER BY rel_path LIMIT 1500""")
def path_prefix_tree(spark, sf_dir):
    parts = paths(spark, sf_dir).select(F.split("path", "/").alias("s"))
    each = parts.select("s", F.explode(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(4)))).alias("k"))
    tree = each.groupBy(F.array_join(F.slice("s", 1, F.col("k")), "/").alias("rel_path"), F.col("k").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n"))
    return tree.orderBy("rel_path").limit(1500)


@query("""SELECT DISTINCT o_orderkey AS key FROM orders o JOIN (SELECT l_orderkey, min(l_linenumber) AS b, max(l_linenumber) AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) r
ON r.l_orderkey = o_orderkey WHERE 2 <= r.e AND r.b <= 3""")
def changed_interval_overlap(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit(2).alias("begin"), F.lit(3).alias("end"))
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_linenumber").alias("begin"), F.max("l_linenumber").alias("end"))
    return ranges.overlapping(spans, changed, "key").select("key").distinct()


@query("""SELECT p.event_id, v.event_id AS view_id FROM events p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v
ON p.user_id = v.user_id AND p.ts >= v.ts WHERE p.event_type = 'purchase'""")
def asof_nearest_preceding(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return ranges.as_of(bought, views, "user_id", "ts", "ts", "view_id").select("event_id", "view_id")


@query("""SELECT c.conv_id * 1000 + c.turn AS point_id, min(r.turn) AS turn FROM conversations c JOIN conversations r ON c.conv_id = r.conv_id AND c.turn BETWEEN r.turn AND r.turn + 2 AND r.role = 'user' GROUP BY 1""")
def range_first_match(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    points = turns.select("conv_id", F.col("turn").alias("line"), (F.col("conv_id") * 1000 + F.col("turn")).alias("point_id"))
    spans = turns.where("role = 'user'").select("conv_id", "turn", F.col("turn").alias("begin"), (F.col("turn") + 2).alias("end"))
    return ranges.first_match(points, spans, "conv_id", "line", "turn")


HREFS = """SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]+)"', 1)) AS call FROM pages"""


@query(f"""WITH c AS (SELECT DISTINCT page_id, replace(call, '/', '.') AS call FROM ({HREFS})), i AS (SELECT DISTINCT page_id, CASE WHEN length(call) % 2 = 0 THEN split_part(call, '.', 1) ELSE call || '.x' END AS name FROM c)
SELECT DISTINCT c.page_id, c.call FROM c JOIN i ON i.page_id = c.page_id AND (c.call = i.name OR starts_with(c.call, i.name || '.'))""")
def prefix_edge_join(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("href"))
    links = links.select("page_id", F.replace("href", F.lit("/"), F.lit(".")).alias("call"))
    first = F.when(F.length("call") % 2 == 0, F.element_at(F.split("call", r"\."), 1)).otherwise(F.concat("call", F.lit(".x")))
    return external_calls(links, links.select("page_id", first.alias("name")), "page_id")


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem), g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS r FROM l)
SELECT l_orderkey, l_returnflag, min(l_linenumber) AS begin, max(l_linenumber) AS "end", count(*) AS n FROM g GROUP BY l_orderkey, l_returnflag, r""")
def line_range_islands(spark, sf_dir):
    return ranges.islands(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], "l_linenumber")


_SIGN = "CASE event_type WHEN 'purchase' THEN '+' WHEN 'click' THEN '-' ELSE ' ' END"


@query(f"""WITH s AS (SELECT event_id, user_id, {_SIGN} AS sign FROM events)
SELECT event_id, sign, 1 + coalesce(sum(CASE WHEN sign IN (' ', '-') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS old_line, 1 + coalesce(sum(CASE WHEN sign IN (' ', '+') THEN 1 ELSE 0 END) OVER w, 0)::BIGINT AS new_line
FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_line_counters(spark, sf_dir):
    signed = table(spark, sf_dir, "events").select("event_id", "user_id", F.expr(_SIGN).alias("sign"))
    return ranges.running_lines(signed, ["user_id"], "event_id", "sign").select("event_id", "sign", F.col("old_line").cast("long").alias("old_line"), F.col("new_line").cast("long").alias("new_line"))


@query("""SELECT l_orderkey, l_suppkey, count(*) AS hunk_count, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS additions, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS deletions,
max(l_linenumber) AS end_line, string_agg(l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text FROM lineitem GROUP BY 1, 2""")
def file_units(spark, sf_dir):
    hunks = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("body"),
        (F.col("l_returnflag") == "N").cast("int").alias("a"), (F.col("l_returnflag") == "R").cast("int").alias("d"),
    )
    return stats.file_units(hunks, ["l_orderkey", "l_suppkey"], "l_linenumber", "body", "a", "d")


@query("""SELECT l_orderkey, count(*) AS hunks, count(DISTINCT l_suppkey) AS files, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS additions, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS deletions FROM lineitem GROUP BY 1 HAVING count_if(l_returnflag <> 'A') > 0""")
def drop_unchanged_units(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("hunks"), F.countDistinct("l_suppkey").alias("files"),
        F.count_if(F.col("l_returnflag") == "N").alias("additions"), F.count_if(F.col("l_returnflag") == "R").alias("deletions"),
    )
    return units.where("additions > 0 OR deletions > 0")


@query(f"""WITH {MEASURED}, s AS (SELECT vec_id, label, round(0 - d, 6) AS score FROM m)
SELECT label, max(score) AS best, max(CASE WHEN score = b THEN vec_id END) AS representative, count(*) AS units FROM (SELECT *, max(score) OVER (PARTITION BY label) AS b FROM s) GROUP BY label""")
def commit_max_representative(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    scored = distances(vectors, "vec_id", "embedding", query_vector(spark, sf_dir)).join(vectors.select("vec_id", "label"), "vec_id")
    return stats.best_unit(scored.select("label", "vec_id", F.round(F.lit(0.0) - F.col("distance"), 6).alias("score")), "label", "score", "vec_id")


@query(f"""WITH {MEASURED}, x AS (SELECT vec_id, label, greatest(0, least(1, 1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()))) AS s FROM m),
{bm25_sql("SELECT * FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")},
y AS (SELECT label, max(s) AS l FROM (SELECT doc_id, (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) AS s FROM b) JOIN embeddings ON vec_id = doc_id GROUP BY label),
z AS (SELECT label, max(s) AS s FROM x GROUP BY label)
SELECT label, round(6e-1 * s + 4e-1 * coalesce(l, 0), 6) AS score, row_number() OVER (ORDER BY round(6e-1 * s + 4e-1 * coalesce(l, 0), 6) DESC, label) AS rank FROM z LEFT JOIN y USING (label) QUALIFY rank <= 5""")
def commit_hybrid(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    groups = vectors.select("vec_id", "label")
    near = semantic_scores(measured(spark, sf_dir)).join(groups, "vec_id").groupBy("label").agg(F.max("semantic").alias("s"))
    scope = docs.join(groups.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    said = min_max(bm25(scope, "doc_id", F.col("text"), query_text(spark, sf_dir)), "bm25", "l")
    said = said.join(groups, F.col("doc_id") == F.col("vec_id")).groupBy("label").agg(F.max("l").alias("l"))
    both = near.join(said, "label", "left").select("label", F.round(0.6 * F.col("s") + 0.4 * F.coalesce("l", F.lit(0.0)), 6).alias("score"))
    return top_ranked(both, "score", "label", 5)


_UNITS = f"""WITH {MEASURED}, u AS (SELECT doc_id AS p, CAST(label AS VARCHAR) AS k, source || '/' || doc_id AS path, 1 + n_chars % 3 AS h, text, d FROM documents JOIN m ON vec_id = doc_id),
x AS (SELECT *, greatest(0, least(1, 1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()))) AS s FROM u), said AS (SELECT k AS doc_id, arg_min(text, p) AS text FROM u GROUP BY k),
{bm25_sql("SELECT * FROM said")}, y AS (SELECT doc_id AS k, CASE WHEN max(s) OVER () = min(s) OVER () THEN 1 ELSE (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) END AS l FROM b)"""
_FILES = "count(*) AS commit_file_count, CAST(sum(h) AS BIGINT) AS commit_hunk_count, string_agg(path, ',' ORDER BY p) AS files, string_agg(path || CASE WHEN best = p THEN '!' ELSE '' END, ',' ORDER BY o DESC, p) AS hunks"


def _commit_units(spark, sf_dir):
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    n = F.col("n_chars")
    return docs.join(vectors, F.col("doc_id") == F.col("vec_id")).select(
        F.col("label").cast("string").alias("commit_key"), F.col("doc_id").alias("position"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), (n % 50).alias("lineno"),
        (n % 7).alias("additions"), (n % 5).alias("deletions"), (n % 3 + 1).alias("file_hunk_count"), F.col("text").alias("commit_message"), F.col("text").alias("search_text"), "embedding",
    )


def _told(found):
    marked = F.transform("commit_hunks", lambda x: F.concat(x["path"], F.when(x["is_representative"], F.lit("!")).otherwise("")))
    scores = [F.round(c, 6).alias(c) for c in ("score", "semantic", "lexical")]
    return found.select("commit_key", "rank", "representative", *scores, "commit_file_count", "commit_hunk_count", F.sha2(F.array_join("commit_files", ","), 256).alias("files"), F.sha2(F.array_join(marked, ","), 256).alias("hunks"))


def _commit_sql(score: str, where: str, semantic: str = "s") -> str:
    return f"""{_UNITS}, g AS (SELECT k, max({semantic}) AS s, arg_max(p, ({semantic}, p)) AS best FROM x GROUP BY k), r AS (SELECT k, best, s, coalesce(l, 0) AS l, {score} AS score FROM g LEFT JOIN y USING (k) WHERE {where}),
t AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, k) AS rank FROM r QUALIFY rank <= 4), f AS (SELECT k, {_FILES} FROM (SELECT x.k, x.path, x.p, x.h, {semantic.replace('s', 'x.s') if semantic == 's' else semantic} AS o, best FROM x JOIN t USING (k)) GROUP BY k)
SELECT k AS commit_key, rank, best AS representative, round(score, 6) AS score, round(s, 6) AS semantic, round(CAST(l AS DOUBLE), 6) AS lexical, commit_file_count, commit_hunk_count, sha256(files) AS files, sha256(hunks) AS hunks FROM t JOIN f USING (k)"""


@query(_commit_sql("6e-1 * s + 4e-1 * coalesce(l, 0)", "true"))
def commit_search_hybrid(spark, sf_dir):
    return _told(search_commits(_commit_units(spark, sf_dir), Search(query_text(spark, sf_dir), target="commits", top_k=4), query_vector(spark, sf_dir)))


@query(_commit_sql("CAST(coalesce(l, 0) AS DOUBLE)", "l IS NOT NULL OR (SELECT count(*) FROM y) = 0", "0e0"))
def commit_search_bm25(spark, sf_dir):
    return _told(search_commits(_commit_units(spark, sf_dir), Search(query_text(spark, sf_dir), mode="bm25", target="commits", top_k=4)))


@query("""WITH u AS (SELECT doc_id AS p, CAST(label AS VARCHAR) AS k, contains(lower(text), 'password') AND contains(lower(text), 'th') AS hit FROM documents JOIN embeddings ON vec_id = doc_id)
SELECT k AS commit_key, min(p) FILTER (WHERE hit) AS representative, row_number() OVER (ORDER BY min(p) FILTER (WHERE hit)) AS rank, 'password th' AS matched, count(*) AS commit_file_count FROM u GROUP BY k HAVING count_if(hit) > 0 QUALIFY rank <= 4""")
def commit_search_keyword(spark, sf_dir):
    found = search_commits(_commit_units(spark, sf_dir), Search("Password th", mode="keyword", target="commits", top_k=4))
    return found.select("commit_key", "representative", "rank", F.array_join("matched_keywords", " ").alias("matched"), "commit_file_count")


RESULTS = f"""WITH {bm25_sql('SELECT * FROM documents')}, r AS (SELECT doc_id, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM b QUALIFY rank <= 50)"""


def _results(spark, sf_dir, k: int = 50):
    return top_ranked(lexical(spark, sf_dir).withColumn("bm25", F.round("bm25", 6)), "bm25", "doc_id", k).select("doc_id", "rank")


STATS_SQL = f"""{RESULTS} SELECT source, count(*) AS method_count, count(rank) AS search_hits, round(coalesce(sum(1 / rank), 0), 6) AS weighted_score, min(rank) AS best_rank,
round(count(rank) / count(*), 6) AS proportion, round(coalesce(sum(1 / rank), 0) * (1 + count(rank) / count(*)) / 2, 6) AS composite_score FROM documents LEFT JOIN r USING (doc_id) GROUP BY source"""


@query(STATS_SQL)
def class_stats(spark, sf_dir):
    found = stats.class_stats(table(spark, sf_dir, "documents").select("source", "doc_id"), _results(spark, sf_dir), "source", "doc_id")
    return found.select("source", "method_count", "search_hits", F.round("weighted_score", 6).alias("weighted_score"), "best_rank", F.round("proportion", 6).alias("proportion"), F.round("composite_score", 6).alias("composite_score"))


@query(f"SELECT * FROM ({STATS_SQL}) WHERE search_hits > 0")
def stats_kind_filter(spark, sf_dir):
    return class_stats(spark, sf_dir).where("search_hits > 0")


@query(f"{RESULTS}, o AS (SELECT doc_id, row_number() OVER (ORDER BY rank ASC NULLS LAST, doc_id) AS place FROM documents LEFT JOIN r USING (doc_id)) SELECT * FROM o")
def standalone_order(spark, sf_dir):
    return stats.placed(table(spark, sf_dir, "documents").select("doc_id"), _results(spark, sf_dir), "doc_id")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, lang LIMIT 1")
def extension_histogram_pick(spark, sf_dir):
    return stats.most_common(table(spark, sf_dir, "documents"), "lang", ["fr", "de"])


@query("SELECT * FROM (SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id DESC LIMIT 20) ORDER BY event_id")
def event_cursor_tail(spark, sf_dir):
    return feedback.after_cursor(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 100, 20)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def ring_buffer(spark, sf_dir):
    return feedback.kept_last(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 5)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id ORDER BY user_id DESC LIMIT 20")
def event_merge_latest(spark, sf_dir):
    return feedback.merged_latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types, count(*) AS reports FROM events GROUP BY user_id")
def usage_union(spark, sf_dir):
    reports = table(spark, sf_dir, "events").select("user_id", F.array("event_type").alias("types"))
    return feedback.usage_union(reports, "user_id", "types").withColumn("types", F.array_join("types", ","))


_ID = "conv_id * 1000 + turn"


@query(f"SELECT p.conv_id * 1000 + p.turn AS id, array_to_string(list_sort(list({'c.conv_id * 1000 + c.turn'})), ',') AS child_ids FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1 GROUP BY 1")
def parent_child_link(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ID).alias("id"), F.lag("turn").over(w).alias("before"))
    parent = F.when(F.col("before") == F.col("turn") - 1, F.col("id") - 1)
    return feedback.children(turns.withColumn("parent", parent), "id", "parent").withColumn("child_ids", F.array_join(F.col("child_ids").cast("array<string>"), ","))


@query("SELECT c.conv_id, c.turn AS child, p.turn AS parent FROM conversations c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1")
def parent_edges(spark, sf_dir):
    turn = lambda n: F.concat_ws(":", "conv_id", n)
    rows = table(spark, sf_dir, "conversations").select(turn("turn").alias("hash"), F.array(turn(F.col("turn") - 1)).alias("parents"))
    part = lambda c, i: F.split_part(c, F.lit(":"), F.lit(i)).cast("long")
    return commits.parent_edges(rows).select(part("child", 1).alias("conv_id"), part("child", 2).alias("child"), part("parent", 2).alias("parent"))


@query(f"""{RESULTS}, u AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), j AS (SELECT r.doc_id, rank, u.doc_id IS NOT NULL AS used FROM r LEFT JOIN u USING (doc_id))
SELECT doc_id, rank, CAST(used AS INTEGER) AS label, NOT used AND rank < (SELECT max(rank) FROM j WHERE used) AS above_used FROM j WHERE (SELECT max(rank) FROM j WHERE used) IS NOT NULL""")
def training_labels(spark, sf_dir):
    results = _results(spark, sf_dir).withColumn("event", F.lit(1))
    used = table(spark, sf_dir, "labels").where("quality = 1").select(F.lit(1).alias("event"), "doc_id")
    return feedback.training_examples(results, used, "event", "doc_id").select("doc_id", "rank", "label", "above_used")


#: An event for each order; the rank and the three locations that its report names come from its keys.
_REPORTS = """WITH e AS (SELECT o_orderkey AS id, 1 + o_orderkey % 3 AS want, o_custkey AS c, './src/' || (o_orderkey % 5) || '.py:' || (o_custkey % 100) AS one, 'src/' || (o_custkey % 5) || '.py' AS two, 'src/' || ((o_orderkey + 1) % 5) || '.py:10-12' AS three FROM orders),
r AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS rank, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
x AS (SELECT id, rank, '/w/src/' || (p % 5) || '.py' AS file, p % 100 AS a, p % 100 + 10 AS b, 'f' || (p % 7) AS name, sha256('c' || p) AS code, '/w/src/' || (p % 5) || '.py:' || (p % 100) || ':' || (p % 100 + 10) || ':f' || (p % 7) AS i, p % 5 AS d, want, c, one, two, three FROM r JOIN e USING (id)),
k AS (SELECT id, i FROM x WHERE rank = want),
l AS (SELECT id, location, arg_min(i, rank) AS i, min(rank) AS rank FROM (SELECT x.*, one AS location FROM x WHERE d = id % 5 AND c % 100 BETWEEN a AND b UNION ALL SELECT x.*, two FROM x WHERE d = c % 5
UNION ALL SELECT x.*, three FROM x WHERE d = (id + 1) % 5 AND 10 BETWEEN a AND b) GROUP BY id, location),
n AS (SELECT id, i, min(location) AS location, arg_min(rank, location) AS rank FROM l WHERE (id, i) NOT IN (SELECT id, i FROM k) GROUP BY id, i)"""


@query(f"""{_REPORTS} SELECT id AS event_id, rank, file, a AS lineno, name, code AS code_sha256, 'positive' AS label, 'referenced_rank' AS label_source, NULL AS location, NULL AS rank_above_referenced FROM x WHERE rank = want
UNION ALL SELECT id, rank, file, a, name, code, 'positive', 'referenced_location', n.location, NULL FROM n JOIN x USING (id, i, rank)
UNION ALL SELECT id, rank, file, a, name, code, 'weak_negative', 'returned_not_referenced', NULL, rank < want FROM x WHERE (id, i) NOT IN (SELECT id, i FROM k UNION ALL SELECT id, i FROM l)""")
def usage_training_examples(spark, sf_dir):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    one = F.concat(F.lit("./src/"), text(key % 5), F.lit(".py:"), text(customer % 100))
    told = F.array(one, F.concat(F.lit("src/"), text(customer % 5), F.lit(".py")), F.concat(F.lit("src/"), text((key + 1) % 5), F.lit(".py:10-12")), F.lit(" "), F.lit("gone.py:1"))
    orders = table(spark, sf_dir, "orders")
    events = orders.select(key.alias("event_id"), F.lit("/w").alias("directory"), F.lit("q").alias("query"))
    p = F.col("p")
    shown = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("long").alias("rank")).agg(F.min("l_partkey").alias("p"))
    name = F.concat((p % 5).cast("string"), F.lit(".py"))
    results = shown.select(
        "event_id", "rank", F.concat(F.lit("/w/src/"), name).alias("file"), F.concat(F.lit("src/"), name).alias("path"), (p % 100).alias("lineno"), (p % 100 + 10).alias("end_lineno"),
        F.concat(F.lit("f"), (p % 7).cast("string")).alias("name"), F.concat(F.lit("c"), p.cast("string")).alias("code"),
    )
    usage = orders.select(key.alias("event_id"), key.alias("usage_id"), F.array((1 + key % 3).cast("long")).alias("referenced_ranks"), told.alias("referenced_locations"))
    found = feedback.usage_examples(events, results, usage)
    return found.select("event_id", "rank", "file", "lineno", "name", "code_sha256", "label", "label_source", "location", "rank_above_referenced")


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark, sf_dir):
    return feedback.kept_first(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts")


@query(f"{RESULTS} SELECT doc_id FROM r WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def except_referenced(spark, sf_dir):
    used = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return _results(spark, sf_dir).select("doc_id").join(used, "doc_id", "left_anti")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, sha256(source || '|' || lang || '|1|' || n_chars || '|' || sha256(coalesce(text, ''))) AS symbol, md5(source) AS folder FROM documents")
def digest_signatures(spark, sf_dir):
    symbol = catalog.symbol_id(F.col("source"), F.col("lang"), F.lit(1), F.col("n_chars"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", catalog.content_hash(F.col("text")).alias("hash"), symbol.alias("symbol"), F.md5("source").alias("folder"))


_B = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]"


@query(f"""SELECT 'd' || doc_id AS id, CASE WHEN length(f) > 60 THEN regexp_replace(substr(f, 1, 59), '{_B}+$', '') || '…' ELSE f END AS short
FROM (SELECT doc_id, CASE WHEN contains(text, chr(10)) THEN regexp_replace(text, '^{_B}+|{_B}+$', '', 'g') ELSE trim(regexp_replace(text, '{_B}+', ' ', 'g')) END AS f FROM documents)
UNION ALL SELECT 'b' || item_id, array_to_string([q, q || ' function method implementation', q || ' handler service repository', q || ' route endpoint request response', q || ' state cache session auth'], '|') FROM (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark)""")
def truncate_and_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), X.clipped(F.col("text"), 60).alias("short"))
    variants = F.array_join(X.query_variants(F.col("text")), "|")
    return docs.unionByName(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), variants.alias("short")))


@query(HREFS.replace("AS call", "AS route"))
def route_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("route"))


_KIND = "CASE WHEN lang = 'en' THEN 'function' WHEN lang = 'de' THEN 'method' ELSE 'code_block' END"


@query(f"SELECT doc_id, {_KIND} AS kind FROM documents WHERE {_KIND} IN ('function', 'method')")
def symbol_kind_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_KIND).alias("kind"))
    return rows.where(projections.is_shown("function_level", F.col("kind"), F.lit(None).cast("string")))


@query(f"{RESULTS} SELECT doc_id, row_number() OVER (ORDER BY {_KIND} = 'code_block', rank) AS place FROM r JOIN documents USING (doc_id)")
def similar_selection_order(spark, sf_dir):
    kinds = table(spark, sf_dir, "documents").select("doc_id", (F.expr(_KIND) == "code_block").alias("block"))
    found = _results(spark, sf_dir).join(kinds, "doc_id")
    return found.select("doc_id", F.row_number().over(Window.orderBy("block", "rank")).cast("long").alias("place"))


@query(f"SELECT doc_id, source, n_chars, {_KIND} AS kind FROM documents ORDER BY source, n_chars, {_KIND} = 'code_block', doc_id")
def symbol_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.expr(_KIND).alias("kind"))
    return rows.orderBy("source", "n_chars", F.col("kind") == "code_block", "doc_id")


@query(f"SELECT doc_id, 'diff_' || {_KIND} AS result_kind, CASE {_KIND} WHEN 'function' THEN 'Function' WHEN 'method' THEN 'Method' ELSE 'Code block' END AS label FROM documents")
def relabel_and_kind_label(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_KIND).alias("kind"))
    label = F.when(F.col("kind") == "function", "Function").when(F.col("kind") == "method", "Method").otherwise("Code block")
    return rows.select("doc_id", F.concat(F.lit("diff_"), F.col("kind")).alias("result_kind"), label.alias("label"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS begin, count(*) AS n FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""SELECT doc_id, regexp_matches(t, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9faf}]') AS found
FROM (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN 'かな' WHEN 1 THEN '漢' WHEN 2 THEN 'ー' WHEN 3 THEN '한글é' ELSE '' END AS t FROM documents)""")
def script_detector(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, ("かな", "漢", "ー", "한글é", ""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", X.has_japanese(F.concat("text", tail)).alias("found"))


@query("SELECT doc_id, sha256(concat_ws(chr(10), source, lang, text, '{\"n_chars\":' || n_chars || '}')) AS hash FROM documents")
def search_text_projection(spark, sf_dir):
    text = F.concat_ws("\n", "source", "lang", "text", F.to_json(F.struct("n_chars")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("hash"))


@query("SELECT doc_id, sha256(text || chr(10) || 'language: ' || lang || CASE WHEN n_chars > 2000 THEN chr(10) || 'long: ' || n_chars ELSE '' END) AS hash, round(ln(1 + n_chars), 6) AS weight FROM documents")
def embedding_text_projection(spark, sf_dir):
    long_ = F.when(F.col("n_chars") > 2000, F.concat(F.lit("long: "), F.col("n_chars").cast("string")))
    text = F.concat_ws("\n", "text", F.concat(F.lit("language: "), F.col("lang")), long_)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("hash"), F.round(F.ln(1 + F.col("n_chars")), 6).alias("weight"))


@query("""WITH g AS (SELECT l_orderkey, l_suppkey, list_sort(list(l_linenumber) FILTER (WHERE l_returnflag = 'N')) AS a, min(l_linenumber) AS anchor FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_suppkey, CASE WHEN a IS NULL OR len(a) = 0 THEN anchor || '-' || anchor ELSE array_to_string(list_transform(a, lambda x: x || '-' || x), ',') END AS ranges FROM g""")
def deletion_anchor_ranges(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "N", F.col("l_linenumber")))).alias("a"), F.min("l_linenumber").alias("anchor"))
    lines = F.when(F.size("a") > 0, F.col("a")).otherwise(F.array("anchor"))
    return grouped.select("l_orderkey", "l_suppkey", F.array_join(F.transform(lines, lambda x: F.concat_ws("-", x, x)), ",").alias("ranges"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS lines FROM lineitem GROUP BY 1")
def distinct_sorted_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("lines"))


@query("SELECT user_id, string_agg(event_type, '+' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct_types(spark, sf_dir):
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("f", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(ordered, "+").alias("types"))


@query("""SELECT user_id, event_id, i AS current, n AS total, round(CASE WHEN elapsed > 0 THEN (n - i) / (i / elapsed) END, 6) AS eta FROM (SELECT user_id, event_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n,
epoch(ts) - epoch(min(ts) OVER (PARTITION BY user_id)) AS elapsed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def progress_rate_eta(spark, sf_dir):
    users = Window.partitionBy("user_id")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.row_number().over(users.orderBy("ts", "event_id")).cast("long").alias("current"), F.count(F.lit(1)).over(users).alias("total"), (seconds - F.min(seconds).over(users)).alias("elapsed")
    )
    eta = F.when(F.col("elapsed") > 0, (F.col("total") - F.col("current")) / (F.col("current") / F.col("elapsed")))
    return rows.select("user_id", "event_id", "current", "total", F.round(eta, 6).alias("eta"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'x/' || page_id WHEN 3 THEN 'c:\\y:z' ELSE 'x/' || page_id END AS path,
CAST(CASE page_id % 4 WHEN 2 THEN NULL WHEN 3 THEN 7 ELSE page_id END AS INTEGER) AS begin, CAST(CASE page_id % 4 WHEN 0 THEN page_id + 3 WHEN 1 THEN page_id WHEN 3 THEN 7 END AS INTEGER) AS "end" FROM pages""")
def location_parse(spark, sf_dir):
    n = F.col("page_id").cast("string")
    shapes = F.array(F.concat(F.lit("x/"), n, F.lit(":"), n, F.lit("-"), (F.col("page_id") + 3).cast("string")), F.concat(F.lit("x/"), n, F.lit(":"), n), F.concat(F.lit("x/"), n), F.lit("c:\\y:z:7"))
    text = F.element_at(shapes, (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", X.location(text).alias("l")).select("page_id", "l.path", "l.begin", "l.end")


@query("""SELECT page_id, 'https://' || regexp_extract(url, '^https?://([^/]+)/', 1) || '/' || regexp_replace(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '(\\.git)?/*$', '') || '/commit/' || left(md5(url), 7) AS link FROM pages""")
def url_rewrite(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.commit_url(F.col("url"), F.left(F.md5("url"), F.lit(7))).alias("link"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE s || 's' END AS took
FROM (SELECT event_id, event_id % 8000 AS s FROM events)""")
def duration_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.duration(F.col("event_id") % 8000).alias("took"))


@query(f"SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(string_split(path, '/'), lambda p: p <> ''))), ',') AS patterns FROM ({PATH_SQL})")
def pattern_normalise(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", F.array_join(X.normalised_patterns(F.split("path", "/")), ",").alias("patterns"))


@query("""SELECT user_id, event_id, CAST(floor(100.0 * i / n + 5e-1) AS INT) || '%' AS done FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def progress_percent(spark, sf_dir):
    users = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(users.orderBy("ts", "event_id")).alias("i"), F.count(F.lit(1)).over(users).alias("n"))
    return rows.select("user_id", "event_id", X.percent(F.col("i"), F.col("n")).alias("done"))


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN trim(text) WHEN 1 THEN trim(text) WHEN 2 THEN 'asked ' || item_id ELSE 'x ' || trim(text) END AS query FROM benchmark""")
def translation_cleanup(spark, sf_dir):
    """Answers of a translator, made up around the items: quoted, labelled, empty, with a word before."""
    shapes = F.array(F.concat(F.lit('"'), F.trim("text"), F.lit("`'")), F.concat(F.lit(" 'Translated English: "), F.trim("text")), F.lit(' "translated text: " '), F.concat(F.lit("x "), F.col("text")))
    said = F.element_at(shapes, (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select("item_id", X.clean_translation(said, F.concat(F.lit("asked "), F.col("item_id").cast("string"))).alias("query"))
