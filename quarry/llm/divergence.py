"""Source divergence audit: how far the words of each source lie from those of others and of their language.

Terms are runs of ASCII letters (A-Z lower-cased) and of all code points beyond ASCII. A language keeps
the terms of at least ``min_docs`` of its documents. Each (lang, source) group, and each language as a
whole, gives a kept term with count c the scaled probability p = 1 + floor(10**9 * (c + 1) / (N + V)),
where N is the sum of its counts and V the number of the language's kept terms. A term's divergence of p
from q is floor((p - q)**2 / q). Part ``pair`` sums it over all kept terms for each other source of the
language, part ``term`` lists the terms that a group has more of than its language. Integers throughout:
p comes from a long division by thousands, squares stay below 2**63.

The method is a dictionary of integers. Kept terms are sorted by range and numbered in UTF-8 order,
and a chunk has the same number of them everywhere. In a chunk terms become ids by
``searchsorted`` in its sorted array of terms, and one ``bincount`` over (group, id) makes the dense
vectors of all groups of the language. Sums over terms are sums of chunks, and ties are broken by ids.

Texts are read once; a task counts in dictionaries of at most ``ENTRIES`` terms and sends what it has when
they are full. A chunk has at most ``cells`` cells (terms times the most sources of a language), so
its task is as large whatever the tables are. A language without kept terms has one chunk without terms.
A source that holds a third of all rows sends sums like any other, as many as its tasks have terms.

Defined results: null text, lang and source are empty strings; repeated rows are documents of their own;
a group without terms is a group; a language of one source has no pairs; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, prepare, workspace, written

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Terms that a task counts before it sends them; cells of a chunk; bytes of a text that are cut into words at once.
ENTRIES, CELLS, SLICE = 400_000, 1 << 18, 1 << 20

#: ASCII letters in lower case and bytes beyond ASCII stay, all others part words.
_LETTERS = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))

_COUNTED = "lang string, source string, term string, n long, docs long"
_FOUND = "lang string, source string, part string, item string, id long, value long"


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of whole ones at a time."""
    data = data.translate(_LETTERS)
    begin = 0
    while begin < len(data):
        end = begin + SLICE
        if end < len(data):
            end = data.find(b" ", end)
            end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


def _sent(lang: str, source: str, n: Counter, docs: Counter) -> pa.RecordBatch:
    """What was counted of a group, and a row without a term, which says that there is the group."""
    size = len(n) + 1
    terms = pa.array([*n, None], pa.binary()).cast(pa.string())
    columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms, pa.array([*n.values(), 0], pa.int64()), pa.array([*(docs[x] for x in n), 0], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _COUNTED.split(", ")])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"], strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _words(text.as_buffer().to_pybytes() if text.is_valid else b""):
                n.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(n) for n, _ in groups.values()) > ENTRIES:
            for (lang, source), counted in groups.items():
                yield _sent(lang, source, *counted)
            groups = {}
    for (lang, source), counted in groups.items():
        yield _sent(lang, source, *counted)


def scaled(counts: np.ndarray, total, kept) -> np.ndarray:
    """1 + floor(SCALE * (counts + 1) / (total + kept)), exact while total + kept stays below 2**53."""
    below = np.asarray(total, np.int64) + np.asarray(kept, np.int64)
    out, rest = np.divmod(counts.astype(np.int64) + 1, below)
    for _ in range(3):  # SCALE is 1000 cubed
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def _audit(top: int):
    def run(table: pa.Table) -> pa.Table:
        """A chunk's part of every sum, and each group's best terms of the chunk."""
        known = np.array([x is None for x in table["term"].to_pylist()]) if len(table) else np.zeros(0, bool)
        groups = table.filter(pa.array(known)).sort_by("source")
        entries = table.filter(pa.array(~known))
        lang = table["lang"][0].as_py()
        sources = groups["source"].to_pylist()
        total, kept, whole = (groups[c].to_numpy().astype(np.int64) for c in ("total", "kept", "whole"))

        coded = entries["term"].combine_chunks().cast(pa.binary()).dictionary_encode()
        words = np.empty(len(coded.dictionary), object)
        words[:] = coded.dictionary.to_pylist()
        terms = np.sort(words)
        begin = int(entries["id"].to_numpy().min()) if len(entries) else 0
        ids = np.searchsorted(terms, words)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        place = {s: i for i, s in enumerate(sources)}
        group = np.fromiter((place[s] for s in entries["source"].to_pylist()), np.int64, len(entries))
        n_groups, n_terms = len(sources), len(terms)
        counts = np.bincount(group * n_terms + ids, weights=entries["n"].to_numpy(), minlength=n_groups * n_terms).astype(np.int64).reshape(n_groups, n_terms)

        p = scaled(counts, total[:, None], kept[:, None]) if n_terms else counts
        rows: list[tuple] = []
        for other in range(n_groups):
            value = ((p - p[other]) ** 2 // p[other]).sum(axis=1) if n_terms else np.zeros(n_groups, np.int64)
            rows += [(sources[i], "pair", sources[other], 0, int(value[i])) for i in range(n_groups) if i != other]
        q = scaled(counts.sum(axis=0), whole[0], kept[0]) if n_terms else None
        for i in range(n_groups) if n_terms else ():
            more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = (p[i, more] - q[more]) ** 2 // q[more]
            best = np.lexsort([more, -value])[:top]
            rows += [(sources[i], "term", terms[more[x]].decode(), begin + int(more[x]), int(value[x])) for x in best]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([lang] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def numbered(terms: DataFrame, parts: int, work: str) -> DataFrame:
    """terms with ``id``: their place among those of their language in UTF-8 order, from 0.

    Terms are sorted by range; a term's id is its place in its part and how many of its language the parts before have.
    """
    ordered = terms.repartitionByRange(max(1, parts), "lang", "term").sortWithinPartitions("lang", "term")
    placed = written(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("nth")), f"{work}/sorted")
    of_part = placed.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"), F.min("nth").alias("first"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = of_part.select("lang", "part", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("begin"))
    return placed.join(begins, ["lang", "part"]).select(*terms.columns, (F.col("begin") + F.col("nth")).alias("id"))


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: each group's divergence from others, and its terms that diverge most."""
    spark = docs.sparkSession
    prepare(spark)
    work = workspace(spark, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = map_batches(docs.select(text("lang").alias("lang"), text("source").alias("source"), F.col("text").cast("string").alias("text")), _count, _COUNTED)
    triples = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), f"{work}/triples")
    groups = triples.where("term IS NULL").select("lang", "source")
    terms = triples.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    terms = written(terms.select("lang", "term", "n"), f"{work}/terms")

    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunk_terms = max(1, cells // widest)
    kept = written(numbered(terms, -(-terms.count() // chunk_terms), work).withColumn("chunk", F.expr(f"id DIV {chunk_terms}")), f"{work}/kept")

    entries = written(triples.where("term IS NOT NULL").join(kept.select("lang", "term", "chunk", "id"), ["lang", "term"]).select("lang", "chunk", "source", "term", "id", "n"), f"{work}/entries")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("whole"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    told = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("kept"), zero("whole"))
    parts = kept.select("lang", "chunk").distinct()
    told = told.join(parts, "lang", "left").select("lang", F.coalesce("chunk", F.lit(-1)).alias("chunk"), "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("n"), "total", "kept", "whole")
    no = F.lit(None).cast("long")
    both = told.unionByName(entries.withColumns({"total": no, "kept": no, "whole": no}))
    found = written(both.groupBy("lang", "chunk").applyInArrow(_audit(top), _FOUND), f"{work}/found")

    of_group = Window.partitionBy("lang", "source")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "item")))
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "id"))).where(F.col("rank") <= top)
    return pairs.unionByName(best.drop("id")).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
n AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.c, 1 + (CAST(1000000000 AS HUGEINT) * (x.c + 1)) // (n.n + v.v) AS p
      FROM x JOIN n ON n.lang = x.lang AND n.source = x.source JOIN v ON v.lang = x.lang),
l AS (SELECT lang, term, sum(c) AS c FROM x GROUP BY lang, term),
m AS (SELECT lang, sum(c) AS n FROM l GROUP BY lang),
q AS (SELECT l.lang, l.term, 1 + (CAST(1000000000 AS HUGEINT) * (l.c + 1)) // (m.n + v.v) AS q FROM l JOIN m ON m.lang = l.lang JOIN v ON v.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // q.q
      FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.c > 0 AND p.p > q.q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 200
"""
