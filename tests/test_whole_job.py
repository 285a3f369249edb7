"""Queries that once did less than the whole job: every row, every word, against plain Python."""

from __future__ import annotations

import pytest


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder of 150 documents, and a benchmark item whose last word is past its 120th character."""
    folder = tmp_path_factory.mktemp("many")
    docs = [(k, "latest" if k == 140 else "early" if k % 50 == 3 else "other", ("en", "de", "fr")[k % 3], f"s{k % 4}", k % 7) for k in range(150)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "early " + "- " * 80 + "latest"), (2, "other")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_orders_hold_every_row(spark, many):
    from quarry.registry import QUERIES

    rows = spark.read.parquet(f"{many}/documents.parquet").collect()
    expected = sorted(rows, key=lambda r: (r.source, r.n_chars, r.lang not in ("en", "de"), r.doc_id))
    assert [r.doc_id for r in QUERIES["symbol_order"](spark, many).collect()] == [r.doc_id for r in expected]
    found = QUERIES["standalone_order"](spark, many).collect()
    first = [r.doc_id for r in QUERIES["bm25_topk"](spark, many).collect()]
    assert [r.place for r in found] == list(range(1, 151))
    assert [r.doc_id for r in found] == first + [k for k in range(150) if k not in first]


def test_places_of_nulls_and_repeats(spark):
    from quarry.operators.stats import placed

    ids = [None, 5, 5, 3, -2, 9, None, 7]
    symbols = spark.createDataFrame([(k,) for k in ids], "id long")
    results = spark.createDataFrame([(9, 1), (5, 2)], "id long, rank int")
    assert [tuple(r) for r in placed(symbols, results, "id").collect()] == [(9, 1), (5, 2), (5, 3), (None, 4), (None, 5), (-2, 6), (3, 7), (7, 8)]


def test_query_text_is_whole(spark, many):
    from quarry.plans.retrieval import query_text
    from quarry.registry import QUERIES

    assert query_text(spark, many).endswith("latest") and len(query_text(spark, many)) > 120
    assert {r.doc_id for r in QUERIES["bm25_minmax_all"](spark, many).collect()} == {3, 53, 103, 140}
    assert QUERIES["bm25_topk"](spark, many).first().doc_id == 140


def test_lsh_recall_and_fallback(spark):
    import numpy as np

    from quarry.operators.vector import lsh_nearest, nearest

    rng = np.random.default_rng(15)
    m = rng.normal(size=(300, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for scale, least in ((1.0, 0.9), (1e4, 1.0)):  # at the second scale hardly any vector shares a bucket
        vectors = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m * scale)], "vec_id long, embedding array<float>").cache()
        shares = []
        for k in range(0, 300, 100):
            query = [float(x) for x in m[k] * scale]
            found, exact = ([r.vec_id for r in f(vectors, "vec_id", "embedding", query, 10).collect()] for f in (lsh_nearest, nearest))
            assert len(found) == 10
            shares.append(len(set(found) & set(exact)) / 10)
        assert np.mean(shares) >= least


def test_every_document_has_a_patch_of_two_hunks(spark, tmp_path):
    from quarry.registry import QUERIES

    spark.createDataFrame([(i, i + 5) for i in (-3, 0, 1, 2, 3, 4)] + [(None, 1)], "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["diff_hunks_parse"](spark, str(tmp_path)).collect()
    assert sorted((r.path, r.lineno, r.additions, r.removed) for r in found) == sorted((f"src/{i}.py", *x) for i in (-3, 0, 1, 2, 3, 4) for x in ((13, 1, "13"), (17, 0, "18")))
    assert {r.changed_code for r in found if not r.additions} == {"-- limit"}
