"""Steps that read their input once, and what they must still find."""

from __future__ import annotations

import random


def plan_of(found) -> str:
    return found._jdf.queryExecution().executedPlan().toString()


def test_islands_hold_no_table_in_memory(spark):
    from quarry.operators.ranges import islands

    r = random.Random(5)
    rows = [(r.choice("ab"), r.choice([None, *range(12)])) for _ in range(60)] + [("c", None), ("c", None), ("d", 7), ("d", 7), (None, 3), (None, 4), ("e", -1), ("e", 0), ("e", 2)]
    found = islands(spark.createDataFrame(rows, "k string, line int"), ["k"], "line")
    wanted = set()
    for k in {k for k, _ in rows}:
        lines = {x for y, x in rows if y == k}
        wanted |= {(k, None, None, 1)} if None in lines else set()
        for begin in (x for x in lines if x is not None and x - 1 not in lines):
            end = next(y for y in range(begin, 99) if y + 1 not in lines)
            wanted.add((k, begin, end, end - begin + 1))
    assert {tuple(x) for x in found.select("k", "begin", "end", "n").collect()} == wanted and found.count() == len(wanted)
    assert "Aggregate" not in plan_of(found)


def test_usage_examples_by_brute_force(spark):
    from quarry.operators.feedback import usage_examples

    r = random.Random(8)
    results = [(e, rank, f"/w/{p}.py", f"{p}.py", line, line + 5, r.choice("fg"), "x") for e in range(6) for rank in range(1, 8) for p, line in [(r.choice("ab"), r.choice([1, 4]))]]
    places = ["a.py", "a.py:5", "./b.py:2-9", "b.py", "a.py:99", "gone.py", " "]
    usage = [(10 + u, u % 7, r.sample(range(1, 9), r.randrange(3)), r.choices(places, k=r.randrange(5))) for u in range(30)]
    events = spark.createDataFrame([(e, "/w", "q") for e in range(7)], "event_id long, directory string, query string")
    shown = spark.createDataFrame(results, "event_id long, rank long, file string, path string, lineno long, end_lineno long, name string, code string")
    found = usage_examples(events, shown, spark.createDataFrame(usage, "usage_id long, event_id long, referenced_ranks array<long>, referenced_locations array<string>"))
    wanted = []
    for usage_id, event, ranks, said in usage:
        own = [x for x in results if x[0] == event]
        identity = lambda x: (x[2], x[4], x[5], x[6])
        ranked, first = {identity(x) for x in own if x[1] in ranks}, {}
        for place in sorted({s.strip() for s in said} - {""}):
            path, _, line = place.removeprefix("./").partition(":")
            at = int(line.split("-")[0]) if line else None
            hits = [x for x in own if x[3] == path and (at is None or x[4] <= at <= x[5])]
            if hits:
                first.setdefault(identity(hits[0]), (place, hits[0][1]))
        for x in own:
            k, rank = identity(x), x[1]
            if rank in ranks:
                wanted.append((usage_id, rank, "referenced_rank", None, None))
            elif k not in ranked and k in first and first[k][1] == rank:
                wanted.append((usage_id, rank, "referenced_location", first[k][0], None))
            elif k not in ranked and k not in first:
                wanted.append((usage_id, rank, "returned_not_referenced", None, bool(ranks) and rank < max(ranks)))
    assert plan_of(found).count("Join") == 2  # reports with events, and these with results
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(found.select("usage_id", "rank", "label_source", "location", "rank_above_referenced").collect()) == order(wanted)


def test_call_graph_reads_files_once(spark):
    from quarry.sources.extract import call_graph, extract_symbols

    text = "def a():\n    b()\n    x.a()\n    b()\n\n\nclass C:\n    def b(self):\n        len(a())\n\n\na()\n"
    files = spark.createDataFrame([("p.py", bytearray(text.encode())), ("q.py", bytearray(b"def z():\n    a()\n")), ("r.py", None)], "path string, content binary")
    edges = call_graph(extract_symbols(files))
    assert edges.columns == ["file", "caller", "callee"] and plan_of(edges).count("MapInPandas") == 1
    assert sorted(tuple(x) for x in edges.collect()) == [("p.py", "CodeBlock:12-12:calls=a", "a"), ("p.py", "a", "a"), ("p.py", "a", "b"), ("p.py", "b", "a")]


def test_postings_are_dealt_once_into_few_files(spark, tmp_path):
    from quarry.operators import postings as P

    texts = ["b a b", "", None, "A a a_1 12 12 c", "x"]
    docs = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    counts = P._counted(docs, "id", docs["text"])
    assert "Exchange" not in plan_of(counts)
    wanted = {(0, 3, "a", 1), (0, 3, "b", 2), (3, 6, "a", 2), (3, 6, "a_1", 1), (3, 6, "12", 2), (3, 6, "c", 1), (4, 1, "x", 1)} | {(i, n, None, 1) for i, n in enumerate((3, 0, 0, 6, 1))}
    found = [tuple(x) for x in counts.collect()]
    assert set(found) == wanted and len(found) == len(wanted)
    assert P.MOST_BUCKETS <= 256  # files are buckets times shards, and a bucket's files are sorted by token


def test_distances_to_cells_are_held_in_steps(monkeypatch):
    import numpy as np

    from quarry.operators import cells as C

    r, sizes, measure = np.random.default_rng(1), [], C._distances
    rows, centers = r.normal(size=(10_000, 8)), r.normal(size=(784, 8))  # a batch, and the cells of 600,000 vectors
    monkeypatch.setattr(C, "_distances", lambda a, b: sizes.append(len(a) * len(b)) or measure(a, b))
    own, away = C._nearest(rows, centers)
    whole = measure(rows, centers)
    assert max(sizes) <= C.HELD and (own == whole.argmin(axis=1)).all() and np.allclose(away, whole.min(axis=1))
    assert [len(x) for x in C._nearest(rows[:0], centers)] == [0, 0]
