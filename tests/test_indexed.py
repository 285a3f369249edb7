"""What is kept on disk: postings, versioned tables, vector cells."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

# ---- postings ----


def corpus(spark, n=400):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = ["common " * r.randrange(1, 4) + " ".join(r.choices(words, weights, k=r.randrange(40))) for _ in range(n)]
    return spark.createDataFrame([*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "common " * 50_000)], "id long, text string")


@pytest.mark.parametrize("text", ["common w3 w3 w40 w59", "common", "w1 w2 w50 absent", "absent", "", "日本", "w55 w56 w57 w58 w59 w0"])
def test_postings_equal_bm25(spark, tmp_path, text):
    from quarry.operators.lexical import bm25
    from quarry.operators.postings import build_postings, search_postings

    docs, path = corpus(spark), f"file://{tmp_path}/p"
    build_postings(docs, "id", F.col("text"), path, buckets=16, shard_docs=100)
    for scope in (None, docs.where("id % 3 = 1").select("id")):
        own = docs if scope is None else docs.join(scope, "id", "left_semi")
        wanted = bm25(own, "id", F.col("text"), text).orderBy(F.round("bm25", 9).desc(), "id").limit(10).collect()
        found = search_postings(spark, path, text, 10, scope).orderBy(F.round("bm25", 9).desc(), "key").collect()
        assert [x.key for x in found] == [x.id for x in wanted] and [x.bm25 for x in found] == pytest.approx([x.bm25 for x in wanted])


def test_postings_read_only_their_buckets(spark, tmp_path):
    from quarry.operators.postings import build_postings, postings_of

    path = f"file://{tmp_path}/p"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    build_postings(corpus(spark), "id", F.col("text"), path, buckets=16, shard_docs=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = postings_of(spark, path, ["w7", "w50"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(token" in plan
    assert {x.token for x in rows.select("token").distinct().collect()} == {"w7", "w50"}
    # A word that every document has lies in several files.
    buckets = postings_of(spark, path, ["common"])
    assert buckets.select(F.input_file_name()).distinct().count() > 1


# ---- versioned tables ----


def rows_of(spark, *rows):
    return spark.createDataFrame(rows, "k string, v long")


def test_versions(spark, tmp_path):
    from quarry.sources import snapshots as S

    root = f"file://{tmp_path}/t"
    assert S.read(spark, root) is None and S.clear(spark, root) == 0
    assert S.append(root, rows_of(spark, ("a", 1), ("b", 2), ("c", 3)), "k", epoch=0) == 1
    assert S.append(root, rows_of(spark, ("b", 20), ("d", 4)), "k", rows_of(spark, ("c", None), ("zz", None)), epoch=1) == 2
    assert S.append(root, rows_of(spark, ("x", 9)), "k", epoch=1) == 2  # the same batch again
    now = lambda v=None: {tuple(x) for x in S.read(spark, root, v).collect()}
    assert now() == {("a", 1), ("b", 20), ("d", 4)} and now(1) == {("a", 1), ("b", 2), ("c", 3)} and S.read(spark, root, 7) is None
    assert S.history(spark, root).where(F.col(S.VERSION) == 2).count() == 4  # what changed, not the table
    assert S.compact(spark, root) == 3 and now() == {("a", 1), ("b", 20), ("d", 4)}
    assert "Window" not in S.read(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in S.read(spark, root, with_version=True).select("k", S.VERSION).collect()} == {("a", 1), ("b", 2), ("d", 2)}
    assert S.replace(root, rows_of(spark, ("n", 1)), "k") == 4 and now() == {("n", 1)} and now(2) == {("a", 1), ("b", 20), ("d", 4)}
    assert S.clear(spark, root) == 5 and now() == set()
    assert len(S.vacuum(spark, root, keep=2)) == 3 and S.versions(spark, root) == [4, 5] and now(4) == {("n", 1)}


def test_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from quarry.sources import index
    from quarry.sources import snapshots as S

    root = f"file://{tmp_path}/t"
    S.append(root, rows_of(spark, ("a", 1)), "k")
    index.save(root, "w", "py", {"model": "m"}, symbols=rows_of(spark, ("a", 1)), vectors=rows_of(spark, ("a", 2)))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S, "commit", dies)
        for write in (lambda: S.append(root, rows_of(spark, ("a", 2)), "k"), lambda: S.compact(spark, root), lambda: index.save(root, "w", "py", {"model": "n"}, symbols=rows_of(spark, ("b", 1)))):
            with pytest.raises(KeyboardInterrupt):
                write()
    assert [tuple(x) for x in S.read(spark, root).collect()] == [("a", 1)] and len(os.listdir(tmp_path / "t/data")) == 3
    found = index.load(spark, root, "w", "py")
    assert found["manifest"] == {"model": "m"} and found["vectors"].count() == 1 and found["symbols"].first().k == "a"
    assert len(S.vacuum(spark, root)) == 2 and S.read(spark, root).count() == 1
    with pytest.raises(FileExistsError):  # two writers of one version
        S.commit(spark, root, 1, {})
    index.save(root, "w", "py", {"model": "n"}, symbols=rows_of(spark, ("b", 1)))
    assert set(index.load(spark, root, "w", "py")) == {"manifest", "symbols"} and index.load(spark, root, "w", "py", 1)["symbols"].first().k == "a"
    index.clear_cache(spark, root, "w", "py", disk=True)
    assert index.load(spark, root, "w", "py") is None


# ---- vector cells ----


def vectors_of(spark, n=1500, width=16):
    import numpy as np

    r = np.random.default_rng(3)
    middles = r.normal(size=(12, width))
    rows = middles[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, width))
    rows[: n // 3] = rows[0]  # copies of one vector
    return spark.createDataFrame([*((i, [float(x) for x in v]) for i, v in enumerate(rows)), (n, None)], "vec_id long, embedding array<float>")


def test_cells_hold_the_nearest(spark, tmp_path):
    from quarry.operators.cells import build_cells, nearest_in_cells, nearest_of_many
    from quarry.operators.vector import nearest

    vectors, path = vectors_of(spark), f"file://{tmp_path}/c"
    build_cells(vectors, "vec_id", "embedding", path, shard=200)
    known = {r.vec_id: list(r.embedding) for r in vectors.where("vec_id % 50 = 0 AND embedding IS NOT NULL").collect()}
    found: dict[int, set] = {}
    for r in nearest_of_many(spark, path, spark.createDataFrame(list(known.items()), "query long, vector array<float>"), 10).collect():
        found.setdefault(r["query"], set()).add(r.key)
    hits = 0
    for key, q in known.items():
        wanted = [r.vec_id for r in nearest(vectors.where("embedding IS NOT NULL"), "vec_id", "embedding", q, 10).collect()]
        hits += len(found[key] & set(wanted))
        if key % 300 == 0:
            assert [r.key for r in nearest_in_cells(spark, path, q, 10, probes=1, exact=True).collect()] == wanted
    assert hits >= 0.9 * 10 * len(known)
    assert nearest_in_cells(spark, path, known[0], 2000, probes=1).count() == 1500  # too few in a cell: all that may be near
    plan = nearest_in_cells(spark, path, known[0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "In(cell" in plan or "cell#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_cells_of_the_table(spark, tmp_path):
    """Recall of 10 at least 0.9 over the ids divisible by 50, with a twentieth of the vectors measured: these are spread evenly, so cells alone would not do."""
    source = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(source):
        pytest.skip("no tables")
    import numpy as np

    from quarry.operators.cells import build_cells, nearest_of_many

    vectors, path = spark.read.parquet(source), f"file://{tmp_path}/c"
    build_cells(vectors, "vec_id", "embedding", path)
    rows = vectors.orderBy("vec_id").collect()
    ids, all_ = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found: dict[int, set] = {}
    for r in nearest_of_many(spark, path, queries, 10).collect():
        found.setdefault(r["query"], set()).add(r.key)
    exact = {i: set(ids[np.lexsort([ids, ((all_ - all_[np.flatnonzero(ids == i)[0]]) ** 2).sum(axis=1)])[:10]]) for i in found}
    assert sum(len(found[i] & exact[i]) for i in found) >= 0.9 * 10 * len(found)
    size = lambda name: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "c" / name) for f in fs if f.endswith(".parquet"))
    assert size("codes") < 0.2 * size("vectors")  # what is scanned instead of the vectors


# ---- early exit, folder tree ----


def test_early_exit_reads_few_parts(spark, tmp_path):
    from quarry.operators.lexical import grep
    from quarry.operators.waves import grep_first, lay_out

    docs = spark.range(2000).select("id", F.when(F.col("id") % 10 == 3, F.concat(F.lit("x\nhit "), F.col("id").cast("string"))).when(F.col("id") == 1990, "rare").otherwise("no").alias("text")).repartition(7)
    lay_out(docs, "id", f"file://{tmp_path}/p", part_rows=50)
    common = grep_first(spark, f"file://{tmp_path}/p", "id", "text", "hit", most=20)
    assert [tuple(r) for r in common.rows.collect()] == [tuple(r) for r in grep(docs, "id", F.col("text"), "hit", most=20).collect()]
    read = spark.read.parquet(f"file://{tmp_path}/p").where(F.col("part") < common.parts_read).count()
    assert common.parts == 40 and 5 * read <= 2000
    rare, none = (grep_first(spark, f"file://{tmp_path}/p", "id", "text", x) for x in ("rare", "absent"))
    assert [r.id for r in rare.rows.collect()] == [1990] and rare.parts_read == 40 and none.rows.count() == 0


def test_early_exit_query_equals_the_search(spark):
    """The registered query lays its table out in a folder that is there already."""
    from quarry.registry import QUERIES

    source = "/root/testdata/sf0.001"
    if not os.path.exists(source):
        pytest.skip("no tables")
    found, wanted = (QUERIES[q](spark, source).collect() for q in ("grep_early_exit", "grep_literal"))
    assert [tuple(r) for r in found] == [tuple(r) for r in wanted] and found


@pytest.mark.parametrize("most", [1500, 30])
def test_ignore_tree_by_brute_force(spark, most):
    from quarry.operators.tree import ignore_tree

    r = random.Random(9)
    files = ["/".join([*(r.choice(["a", "b", "ü", ".git", "c d"]) for _ in range(r.randrange(6))), "f.py"]) for _ in range(200)] + ["./a/z/f.py", "top.py"]
    patterns = ["a/", "./b/a", "ü/b/a", "b\\b\\c d", "absent", ""]
    plain = ["a", "b/a", "ü/b/a", "b/b/c d"]
    dirs = {tuple(p[:k]) for f in files for p in [f.removeprefix("./").split("/")[:-1]] for k in range(1, min(4, len(p)) + 1) if ".git" not in p[:k]}
    dirs = sorted(dirs, key=lambda d: (len(d), "/".join(d).encode()))[:most]
    cover = lambda d: any("/".join(d[:k]) in plain for k in range(1, len(d) + 1))

    def state(d):
        below = [x for x in dirs if x[: len(d)] == d]
        leaves = [x for x in below if not any(y[:-1] == x for y in dirs)]
        if cover(d) or all(map(cover, leaves)):
            return "all"
        return "some" if any(map(cover, below)) else "none"

    found = ignore_tree(spark.createDataFrame([(f,) for f in [*files, None]], "p string"), F.col("p"), patterns, most=most).collect()
    assert {(x.rel_path, x.name, x.depth, x.parent, x.checked, x.state) for x in found} == {("/".join(d), d[-1], len(d), "/".join(d[:-1]) or ".", "/".join(d) in plain, state(d)) for d in dirs} and len(found) == len(dirs)
