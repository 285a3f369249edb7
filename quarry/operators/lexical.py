"""Lexical retrieval: BM25 over scoped documents, literal keywords, line search."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import LINE_CHARS, TOKEN, lines, tokens

K1, B = 1.5, 0.75


def query_terms(query: str) -> dict[str, int]:
    """Query tokens as a bag: a repeated token counts repeatedly."""
    return dict(Counter(t.lower() for t in re.findall(TOKEN, query or "")))


def term_counts(docs: DataFrame, key: str, text: Column, words: list[str]) -> DataFrame:
    """(key, _dl, _term, _tf): how often each document has each word; a row without a term stands for the document."""
    found = docs.select(key, tokens(text).alias("_t")).select(key, F.size("_t").alias("_dl"), F.filter("_t", lambda t: t.isin(*words)).alias("_t"))
    each = found.select(key, "_dl", F.explode(F.array_append("_t", F.lit(None).cast("string"))).alias("_term"))
    return each.groupBy(key, "_dl", "_term").agg(F.count(F.lit(1)).alias("_tf"))


def bm25(docs: DataFrame, key: str, text: Column, query: str) -> DataFrame:
    """(key, bm25) of the documents with a positive score; all statistics are those of docs, whose keys are distinct."""
    terms = query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0.0).alias("bm25")).where(F.lit(False))
    return bm25_of_counts(term_counts(docs, key, text, list(terms)), key, terms)


def bm25_of_counts(counts: DataFrame, key: str, terms: dict[str, int]) -> DataFrame:
    """(key, bm25) from rows of term_counts.

    Statistics and scores both read the exchange of the counts, which is planned once and reused:
    texts are tokenised once. The statistics are one row, broadcast at any size: a number for each
    word of the query.
    """
    whole = F.col("_term").isNull()
    by_term = counts.groupBy("_term").agg(F.count_if(F.col("_tf") > 0).alias("_df"), F.sum("_tf").alias("_n"), F.sum(F.col("_dl") * F.col("_tf")).alias("_length"))
    stats = by_term.agg(
        F.max(F.when(whole, F.col("_n"))).cast("double").alias("_n"), F.max(F.when(whole, F.col("_length") / F.col("_n"))).alias("_avg"),
        F.map_from_entries(F.collect_list(F.when(~whole, F.struct("_term", F.col("_df").cast("double").alias("_df"))))).alias("_df"),
    )
    weight = F.create_map(*[F.lit(x) for word, n in terms.items() for x in (word, float(n))])
    idf = F.transform_values("_df", lambda term, df: F.try_element_at(weight, term) * F.ln(1 + (F.col("_n") - df + 0.5) / (df + 0.5)))
    norm = F.lit(1 - B) + F.lit(B) * F.col("_dl") / F.col("_avg")
    score = F.try_element_at("_idf", F.coalesce("_term", F.lit(""))) * F.col("_tf") * (K1 + 1) / (F.col("_tf") + F.lit(K1) * norm)
    scored = counts.crossJoin(F.broadcast(stats.select("_avg", idf.alias("_idf")))).select(key, score.alias("_s"))
    return scored.groupBy(key).agg(F.sum("_s").alias("bm25")).where("bm25 > 0")


def document_frequency(docs: DataFrame, text: Column) -> DataFrame:
    """(token, df, tf) over docs."""
    sorted_ = docs.select(F.sort_array(tokens(text)).alias("_t"))
    # In order, the first of a document's equal tokens counts for the document.
    tagged = F.transform("_t", lambda t, i: F.struct(t.alias("token"), F.coalesce(F.get("_t", i - 1) != t, F.lit(True)).alias("once")))
    each = sorted_.select(F.explode(tagged).alias("x"))
    return each.groupBy(F.col("x.token").alias("token")).agg(F.count_if("x.once").alias("df"), F.count(F.lit(1)).alias("tf"))


def keyword_match(text: Column, query: str) -> Column:
    """Every blank-separated keyword is a substring, in lower case; no keyword matches nothing."""
    words = (query or "").split()
    out = F.lit(bool(words))
    for word in words:
        out = out & F.lower(text).contains(word.lower())
    return out


def matched_keywords(text: Column, query: str) -> Column:
    words = list(dict.fromkeys((query or "").lower().split()))
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)) if words else F.array().cast("array<string>")


def grep(docs: DataFrame, key: str, text: Column, pattern: str, regex: bool | None = None, ignore_case: bool = False, most: int | None = 100) -> DataFrame:
    """(key, line_no, line) of matching lines in order of key and line; at most ``most`` of them.

    regex defaults to whether the pattern holds a bar. Texts without a match anywhere are
    dropped before they are split into lines; texts with a zero byte near the start are binary.
    """
    regex = "|" in pattern if regex is None else regex
    expr = ("(?i)" if ignore_case else "") + (pattern if regex else re.sub(r"([^\w\s])", r"\\\1", pattern))
    test = (lambda c: c.rlike(expr)) if regex or ignore_case else (lambda c: c.contains(pattern))
    plain = docs.select(key, text.alias("_text")).where(test(F.col("_text")) & ~F.substring("_text", 1, 4096).contains("\0"))
    each = plain.select(key, F.posexplode(lines(F.col("_text"))).alias("_no", "_line")).where(test(F.col("_line")))
    out = each.select(key, (F.col("_no") + 1).cast("long").alias("line_no"), F.substring("_line", 1, LINE_CHARS).alias("line"))
    return out if most is None else out.orderBy(key, "line_no").limit(max(1, min(500, most)))
