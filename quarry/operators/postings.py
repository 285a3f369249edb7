"""An inverted index on disk: BM25 without reading the texts.

``build_postings`` writes two tables. ``postings`` has a row for each token of each document (key,
tf, dl), partitioned by a bucket of the token's hash and sorted by token and key, so that a search reads
the partitions of its words, skips row groups by their statistics on token, and finds ids that Parquet has
delta-coded; partition -1 has a row without a token for every document, which holds the lengths. A bucket is
dealt by document to several files, so the postings of a word that every document has are written and
read by many tasks. ``lexicon`` has a row for each token: its document frequency and the most that it adds
to any document's score for each unit of weight.

``search_postings`` takes the words' rows from the lexicon (as many as the query has words) and scores in two
steps. The words that can add most give k documents and with them a least score. Words that together
cannot reach it only add to documents which the others have found; their postings are joined to those.
Scores and order are those of ``bm25`` over the same documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators.lexical import B, K1, query_terms

DOCS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS, SHARD_DOCS = 50, 16, 256, 100_000
META = "n long, average double, buckets int"
#: The partition of the rows that stand for documents.
DOCUMENTS = -1


def _bucket(token: Column, buckets: int) -> Column:
    return F.when(token.isNull(), DOCUMENTS).otherwise(F.pmod(F.xxhash64(token), F.lit(buckets))).cast("int")


def _gain(average: Column) -> Column:
    """What a document's tf adds to its score, without the word's idf and weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / average))


def _counted(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, dl, token, tf) of every document and token, and a row without a token for the document: counted inside each document, so nothing is dealt for it."""
    found = docs.select(F.col(key).alias("key"), tokens(text).alias("_t")).select("key", F.size("_t").alias("dl"), F.sort_array("_t").alias("_t"))
    # In order, a token's last place less that of the token before is its count.
    placed = F.transform("_t", lambda t, i: F.struct(t.alias("token"), (i + 1).alias("place")))
    ends = found.select("key", "dl", F.filter(placed, lambda x: F.coalesce(F.get("_t", x["place"]) != x["token"], F.lit(True))).alias("_e"))
    tf = F.transform("_e", lambda x, i: F.struct(x["token"].alias("token"), (x["place"] - F.coalesce(F.get("_e", i - 1)["place"], F.lit(0))).cast("int").alias("tf")))
    itself = F.struct(F.lit(None).cast("string").alias("token"), F.lit(1).alias("tf"))
    return ends.select("key", "dl", F.explode(F.array_append(tf, itself)).alias("x")).select("key", "dl", "x.token", "x.tf")


def build_postings(docs: DataFrame, key: str, text: Column, path: str, buckets: int | None = None, shard_docs: int = SHARD_DOCS) -> None:
    """Write the index of docs, whose keys are distinct, below path."""
    spark, n = docs.sparkSession, docs.count()
    buckets = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, n // DOCS_A_BUCKET))
    counts = _counted(docs, key, text)
    shards = max(1, -(-n // shard_docs))
    dealt = counts.withColumn("bucket", _bucket(F.col("token"), buckets)).repartition("bucket", F.pmod(F.hash("key"), F.lit(shards))).sortWithinPartitions("bucket", "token", "key")
    dealt.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    postings = _postings(spark, path, dealt.schema["key"].dataType.simpleString())
    average = postings.where(F.col("bucket") == DOCUMENTS).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("average"))
    average.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/meta")
    average = spark.read.schema(META).parquet(f"{path}/meta").select("average")
    rows = postings.where(F.col("bucket") != DOCUMENTS).crossJoin(F.broadcast(average))  # one row
    lexicon = rows.groupBy("bucket", "token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.max(_gain(F.col("average"))).alias("most"))
    lexicon.repartition("bucket").sortWithinPartitions("bucket", "token").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/lexicon")


def _postings(spark: SparkSession, path: str, key_type: str) -> DataFrame:
    return spark.read.schema(f"key {key_type}, dl int, token string, tf int, bucket int").parquet(f"{path}/postings")


def _meta(spark: SparkSession, path: str):
    return spark.read.schema(META).parquet(f"{path}/meta").first()


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, token, df, tf, most) of every token."""
    return spark.read.schema("token string, df long, tf long, most double, bucket int").parquet(f"{path}/lexicon")


def postings_of(spark: SparkSession, path: str, words: list[str], key_type: str = "long") -> DataFrame:
    """(bucket, token, key, tf, dl) of the words: only their partitions are read."""
    own = _buckets_of(spark, words, _meta(spark, path)["buckets"])
    return _postings(spark, path, key_type).where(F.col("bucket").isin(*own) & F.col("token").isin(*words))


def _buckets_of(spark: SparkSession, words: list[str], buckets: int) -> list[int]:
    """The words' buckets, by the hash that the index was dealt with."""
    row = spark.range(1).select(F.array(*[_bucket(F.lit(w), buckets) for w in words]).alias("b")).first()
    return sorted(set(row["b"]))


def search_postings(
    spark: SparkSession, path: str, query: str, k: int, scope: DataFrame | None = None, key_type: str = "long", bounded: bool = True
) -> DataFrame:
    """(key, bm25) of the k best documents (by score, then key).

    scope: keys of the documents that count; statistics are theirs then, as everywhere in this library,
    and every posting in scope is scored. bounded=False scores every posting without a scope, too.
    """
    terms = query_terms(query)
    meta, documents = _meta(spark, path), _postings(spark, path, key_type).where(F.col("bucket") == DOCUMENTS).select("key", "dl")
    none = documents.select("key", F.lit(0.0).alias("bm25")).where(F.lit(False))
    if not terms:
        return none
    words = list(terms)
    own = postings_of(spark, path, words, key_type)
    if scope is not None:
        keys = scope.select(F.col(scope.columns[0]).alias("key"))
        documents, own = documents.join(keys, "key", "left_semi"), own.join(keys, "key", "left_semi")
    n, average = (meta["n"], meta["average"]) if scope is None else documents.agg(F.count(F.lit(1)), F.avg("dl")).first()
    if not n:
        return none
    if scope is None:
        rows = lexicon(spark, path).where(F.col("bucket").isin(*_buckets_of(spark, words, meta["buckets"])) & F.col("token").isin(*words))
        known = {r["token"]: (r["df"], r["most"]) for r in rows.collect()}
    else:
        known = {r["token"]: (r["df"], 0.0) for r in own.groupBy("token").agg(F.count(F.lit(1)).alias("df")).collect()}
    if not known:
        return none
    idf = {w: terms[w] * _idf(n, df) for w, (df, _) in known.items()}
    gain = F.element_at(F.create_map(*[F.lit(x) for w, v in idf.items() for x in (w, v)]), F.col("token")) * _gain(F.lit(float(average)))
    scored = own.where(F.col("token").isin(*idf)).select("key", "token", gain.alias("s"))
    total = lambda rows: rows.groupBy("key").agg(F.sum("s").alias("bm25"))
    best = lambda rows: rows.orderBy(F.desc("bm25"), "key").limit(k)
    if scope is not None or not bounded:
        return best(total(scored).where("bm25 > 0"))
    essential, rest, least = _essential(scored, {w: idf[w] * most for w, (_, most) in known.items()}, {w: df for w, (df, _) in known.items()}, k)
    first = total(scored.where(F.col("token").isin(*essential)))
    if not rest:
        return best(first.where("bm25 > 0"))
    reach = sum(idf[w] * known[w][1] for w in rest)
    candidates = first.where(F.col("bm25") + reach * (1 + 1e-9) >= least)
    added = scored.where(F.col("token").isin(*rest)).join(candidates.select("key"), "key", "left_semi")
    return best(total(candidates.select("key", F.col("bm25").alias("s")).unionByName(added.select("key", "s"))).where("bm25 > 0"))


def _idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _essential(scored: DataFrame, bounds: dict[str, float], df: dict[str, int], k: int) -> tuple[list[str], list[str], float]:
    """(words that a document among the best must have one of, the rest, the least score of the k best).

    The k best sums over the words with the highest bounds that have k documents together are what k documents reach at least.
    """
    order = sorted(bounds, key=lambda w: (-bounds[w], w))
    leading, seen = [], 0
    for w in order:
        leading.append(w)
        seen += df[w]
        if seen >= 4 * k:
            break
    some = scored.where(F.col("token").isin(*leading)).groupBy("key").agg(F.sum("s").alias("s")).orderBy(F.desc("s")).limit(k).select("s").collect()
    least = min(r["s"] for r in some) * (1 - 1e-9) if len(some) == k else 0.0
    rest, reach = [], 0.0
    for w in reversed(order):
        if reach + bounds[w] >= least:
            break
        reach += bounds[w]
        rest.append(w)
    return [w for w in order if w not in rest], rest, least
