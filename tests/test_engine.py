"""The retrieval engine: goldens by hand, scratch repositories, streams against batches."""

from __future__ import annotations

import subprocess

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_bm25_by_hand(spark):
    import math

    from quarry.operators.lexical import bm25

    docs = frame(spark, [(1, "foo bar"), (2, "foo foo"), (3, ""), (4, "baz"), (5, None)], "id long, text string")
    found = dict(bm25(docs, "id", F.col("text"), "foo FOO bar").collect())
    avg = 5 / 5
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert found == pytest.approx({1: 2 * part(1, 2, 2) + part(1, 2, 1), 2: 2 * part(2, 2, 2)})
    assert bm25(docs, "id", F.col("text"), "日本").count() == 0


def test_scores_and_bands(spark):
    from quarry.operators.fuse import blend, min_max, top_ranked

    same = frame(spark, [(1, 2.0), (2, 2.0)], "id long, s double")
    assert {r.x for r in min_max(same, "s", "x").collect()} == {1.0}
    a = frame(spark, [(1, 1.0), (2, 0.5)], "id long, semantic double")
    b = frame(spark, [(2, 1.0), (3, 1.0)], "id long, lexical double")
    ranked = top_ranked(blend(a, b, "id", 0.5), "score", "id", 3).collect()
    assert [(r["id"], r["rank"], r["score"]) for r in ranked] == [(2, 1, 0.75), (1, 2, 0.5), (3, 3, 0.5)]


def test_globs(spark):
    from quarry.functions.globs import allowed, is_ignored

    paths = frame(spark, [(p,) for p in ("a.py", "src/a.py", ".github/x.yml", "tests/deep/t.py", "tests", "")], "p string")
    take = lambda inc, exc=None: [r.p for r in paths.where(allowed(F.col("p"), inc, exc)).collect()]
    assert take(["*.py"]) == ["a.py", "src/a.py", "tests/deep/t.py"]
    assert take(["src/**"]) == ["src/a.py"] and take(["./tests/"]) == ["tests/deep/t.py", "tests"] and take([".github/*"]) == [".github/x.yml"]
    assert take(None, ["*.py"]) == [".github/x.yml", "tests"]
    ignored = [r.p for r in paths.where(is_ignored(F.col("p"), "*.py\n!src/*.py\n# x\n/tests/\n")).collect()]
    assert ignored == ["a.py", "tests/deep/t.py"]


def test_text_functions(spark):
    from quarry.functions import text as X

    row = frame(spark, [("a/b.py:3-9", "git@host.org:me/r.git", "0123456789abcdef", "one\r\n two", "/** A\n * b */")], "l string, u string, h string, t string, d string")
    r = row.select(
        X.location(F.col("l")).alias("l"), X.commit_url(F.col("u"), F.lit("abc")).alias("u"), X.short_ref(F.col("h")).alias("h"), X.clipped(F.col("t"), 6).alias("t"),
        X.clean_doc_comment(F.col("d")).alias("d"), X.duration(F.lit(3725)).alias("s"), X.query_variants(F.lit(" a  b ")).alias("v"), X.lines(F.lit("a\nb\r\n")).alias("n"),
    ).first()
    assert tuple(r.l) == ("a/b.py", 3, 9) and r.u == "https://host.org/me/r/commit/abc" and r.h == "0123456" and r.t == "one…" and r.d == "A\nb"
    assert r.s == "1h 02m" and len(r.v) == 5 and r.v[0] == "a b" and r.n == ["a", "b"]


PY = b'''import pathlib as pl

@decorator
def load(path: str, *a, k=1, **kw) -> dict:
    """Load."""
    data = pl.Path(path).read_text()
    def inner(): pass
    return {"d": data}

class A:
    class B:
        def no(self): pass
    @app.get("/u/{i}")
    async def m(self): return load("x")

@pytest.fixture()
def fix(): pass

config = 1
# note
if True:
    print(load("u"))
assert 1
x = 2
'''


def test_python_symbols(spark):
    from quarry.sources.extract import call_graph, extract_symbols, symbols_of

    found = {s["name"]: s for s in symbols_of("a.py", PY)}
    assert list(found) == ["load", "m", "fix", "CodeBlock:19-22:calls=load,print", "CodeBlock:24-24"]
    load, m = found["load"]["python_static"], found["m"]
    assert load["params"] == ["path: str", "k", "a", "kw"] and load["returns"] == "dict" and load["assigned_names"] == ["data"] and load["external_import_calls"] == ["pathlib.Path"]
    assert (m["class_name"], m["symbol_kind"], m["python_static"]["routes"][0]["path"], m["python_static"]["local_calls"]) == ("A", "method", "/u/{i}", ["load"])
    assert found["fix"]["python_static"]["framework_tags"] == ["pytest"] and found["load"]["docstring"] == "Load." and "Calls: pl.Path" in found["load"]["code"]
    broken = symbols_of("b.py", b"def ok():\n    def inner():\n        return 1\n    return True\n\nif broken:\n")
    assert [(s["name"], s["lineno"], s["end_lineno"]) for s in broken] == [("ok", 1, 4), ("inner", 2, 3)] and broken[0]["python_static"]["fallback"] == "tree_sitter"
    files = frame(spark, [("a.py", bytearray(PY)), ("x.bin", bytearray(b"\0")), ("n.py", None)], "path string, content binary")
    symbols = extract_symbols(files).cache()
    assert symbols.count() == 5 and {(r.caller, r.callee) for r in call_graph(symbols).collect()} >= {("m", "load")}


def test_brace_symbols():
    from quarry.sources.extract import symbols_of

    java = b'''public class Foo {
  // void fake() {
  String s = "void x() { }";
  public Foo() { }
  public int bar(int a) throws X { if (a > 1) { return f(a); } return 2; }
  abstract void none();
  @Override
  public List<String> names() { return null; }
  class In { void deep() { } }
}
interface I { void q(); }
'''
    assert [(s["name"], s["class_name"], s["lineno"]) for s in symbols_of("A.java", java)] == [("bar", "Foo", 5), ("names", "Foo", 7), ("deep", "In", 9)]
    script = '''// über
/** Adds.
 * two */
export function add(a: number, b: number): number { return `${a}{`.length + b; }
const arrow = () => { return 1; };
const fv = function named() { return 2; };
/** Far. */
const z = 1;
function plain() { return 1; }
export class Svc {
  private x = 1;
  /** Runs. */
  async run(q: string): Promise<{a: number}> { if (q) { return foo(q); } }
  #hid() { return 1 }
  plain(): void { return this.run(''); }
  typed(): {x: number} | Map<string, {y: {z: 1}}> { return 1; }
  maker(): () => void { return f; }
  none(): void;
}
function guard(a: string): a is {k: 1}[] { return true; }
'''
    found = [(s["name"], s["class_name"], s["docstring"]) for s in symbols_of("a.ts", script.encode())]
    assert found == [("add", None, "Adds.\ntwo"), ("plain", None, None), ("run", "Svc", "Runs."), ("#hid", "Svc", None), ("plain", "Svc", None), ("typed", "Svc", None), ("maker", "Svc", None), ("guard", None, None)]
    assert {s["name"]: s["end_lineno"] - s["lineno"] for s in symbols_of("a.ts", script.encode())} == dict.fromkeys([f[0] for f in found], 0)


@pytest.fixture
def scratch(tmp_path):
    def run(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return 2\n\n\ndef h():\n    return 3\n")
    (tmp_path / "q.sql").write_text("-- note\nselect 1\nselect 2\n")
    (tmp_path / ".gitignore").write_text("*.log\n")
    run("add", "-A")
    run("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return 22\n\n\ndef h():\n    return 3\n")
    (tmp_path / "q.sql").write_text("select 1\nselect 2\n")
    run("commit", "-qam", "second")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return 22\n\n\ndef h():\n")
    (tmp_path / "_new.py").write_text("x = 1")
    (tmp_path / "n.log").write_text("ignored")
    return str(tmp_path)


def test_git_sources_and_diffs(spark, scratch):
    from quarry.operators import commits as C
    from quarry.operators.diffs import changed_symbols, diff_units, hunks
    from quarry.sources import git as G
    from quarry.sources.extract import extract_symbols

    assert G.visible_files(scratch, ".py") == ["_new.py", "a.py"] == G.walk(scratch, ".py") and G.changed_files(scratch) == ["_new.py", "a.py"]
    files = G.read_files(spark, scratch, ["a.py", "_new.py", "gone.py"])
    assert {r.path: r.content is None for r in files.collect()} == {"a.py": False, "_new.py": False, "gone.py": True}
    log = G.patches(spark, scratch, "HEAD~1")
    found = hunks(log).collect()
    assert sorted((r.path, r.lineno, r.additions, r.deletions) for r in found) == [("a.py", 6, 1, 1), ("q.sql", 1, 0, 1)]
    assert diff_units(hunks(log)).count() == 2
    net = frame(spark, [(None, None, None, G.diff_text(scratch))], "commit_hash string, commit_subject string, commit_message string, patch string")
    touched = {r.name for r in changed_symbols(extract_symbols(files), hunks(net)).collect()}
    assert "h" in touched and "f" not in touched and any(n.startswith("CodeBlock") for n in touched)
    graph = G.commits(spark, scratch)
    assert C.parent_edges(graph).count() == 1 and {r.lane for r in C.lanes(graph.withColumn("position", F.monotonically_increasing_id())).collect()} == {0}
    short = graph.select(F.left("hash", F.lit(5)).alias("ref"))
    assert C.resolve(short, graph).count() == 2 and G.content_at(scratch, "HEAD~1", "q.sql").startswith("-- note")
    for bad in ("--all", "a b", ""):
        with pytest.raises(ValueError):
            G.safe_ref(bad)


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "-- x", "++ y", "@@ -1 +1 @@", ""]), max_size=8), st.lists(st.sampled_from(["a", "-- x", "++ y", "@@ -1 +1 @@", "b"]), max_size=8))
def test_patch_lines_are_counted(old, new):
    import difflib

    from quarry.operators.diffs import parse_patch

    lines = list(difflib.unified_diff(old, new, "a/f", "b/f", lineterm=""))
    found = list(parse_patch("\n".join(lines)))
    plain = difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
    assert sum(h["additions"] for h in found) == sum(j2 - j1 for t, _, _, j1, j2 in plain if t != "equal")
    assert sum(h["deletions"] for h in found) == sum(i2 - i1 for t, i1, i2, _, _ in plain if t != "equal")
    for h in found:
        body = h["diff_code"].split("\n")[1:]
        numbers = [n for r in h["added_ranges"] for n in range(r["begin"], r["end"] + 1)]
        assert [new[n - 1] for n in numbers] == [x[1:] for x in body if x[:1] == "+"][: len(numbers)] or any(not x for x in new)
        assert h["changed_code"] == "\n".join(x[1:] for x in body if x[:1] in ("+", "-")).rstrip()
        assert h["search_text"] == "diff --git a/f b/f\n--- a/f\n+++ b/f\n" + h["diff_code"]


def test_commit_lanes_of_branching_histories(spark):
    from quarry.operators.commits import assign_lanes, lanes

    assert assign_lanes([("A", ["C"]), ("B", ["C"]), ("D", ["E"]), ("C", ["E"]), ("E", [])]) == [0, 1, 2, 0, 0]
    # A merge opens a lane for its second parent; the lane that meets it again is freed and taken anew.
    assert assign_lanes([("M", ["a", "b"]), ("a", ["r"]), ("b", ["r"]), ("r", []), ("x", ["y"]), ("z", []), ("y", [])]) == [0, 0, 1, 0, 0, 1, 0]
    assert assign_lanes([("O", ["p", "q", "s"]), ("q", ["p"]), ("s", ["p"]), ("p", [])]) == [0, 1, 2, 0] and assign_lanes([]) == []
    rows = [(n, p, k) for k, (n, p) in enumerate([("A", ["C"]), ("B", ["C"]), ("C", [])])]
    found = lanes(frame(spark, rows, "hash string, parents array<string>, position long"), most=2).collect()
    assert {(r.hash, r.lane) for r in found} == {("A", 0), ("B", 1)}


def test_hunks_by_hand(spark):
    from quarry.operators.diffs import parse_patch

    gone = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -5,4 +5,3 @@ def f\n a\n-b = 1\n c\n d\n"
    (h,) = parse_patch(gone)
    assert (h["changed_code"], h["lineno"], h["end_lineno"], h["anchor"], h["added_ranges"]) == ("b = 1", 5, 7, 5, [])
    assert h["search_text"] == gone.strip()
    new = "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+x\n+y\n"
    (h,) = parse_patch(new)
    assert h["search_text"].startswith("diff --git a/n.py b/n.py\n--- /dev/null\n+++ b/n.py\n@@") and (h["lineno"], h["end_lineno"]) == (1, 2)


def test_clipped_and_labels(spark):
    from quarry.functions import text as X

    rows = ["  a \t b  ", "one line that is long", "two\n lines  ", "\n a b \n", "abcd ef", "x\u2003y\u00a0z", "", None]
    expected = ["a b", "one lin…", "two\n li…", "a b", "abcd ef", "x y z", "", None]
    frame_ = frame(spark, list(enumerate(rows)), "i int, t string")
    assert [r.t for r in frame_.select("i", X.clipped(F.col("t"), 8).alias("t")).orderBy("i").collect()] == expected
    assert frame_.where("i = 4").select(X.clipped(F.col("t"), 6).alias("t")).first().t == "abcd…"  # blanks before the mark go
    refs = frame(spark, [("a" * 40, "main"), ("main", None), (None, "x"), ("", "")], "b string, h string")
    assert [r.c for r in refs.select(X.compare_label(F.col("b"), F.col("h")).alias("c")).collect()] == ["aaaaaaa...main", "main...HEAD", "HEAD...working tree", "HEAD...working tree"]


def test_ignore_rules(spark, tmp_path):
    from quarry.functions.globs import is_ignored
    from quarry.sources.git import walk

    paths = ["a/b", "axb", "a?b", "x/axb/c", "d/e.log", "d/x/e.log", "d/[k]", "build/o", "src/build/o", "doc/a/b/t.txt", "doc/t.txt"]
    rows = frame(spark, [(p,) for p in paths], "p string")
    take = lambda text: {r.p for r in rows.where(is_ignored(F.col("p"), text)).collect()}
    assert take("a?b") == {"axb", "a?b", "x/axb/c"} and take("d/*.log") == {"d/e.log"} and take("/build") == {"build/o"}
    assert take("doc/**/t.txt") == {"doc/a/b/t.txt", "doc/t.txt"} and take("[a-c]?[!x]") == {"axb", "a?b", "x/axb/c"}
    for name, text in ((".gitignore", "*.log\n!keep.log\n"), (".quarryignore", "keep.log\ntmp/\n"), ("a.log", ""), ("keep.log", ""), ("b.py", "")):
        (tmp_path / name).write_text(text)
    assert walk(str(tmp_path)) == [".gitignore", ".quarryignore", "b.py"]


@pytest.mark.parametrize("name", ["bm25_topk", "hybrid_topk", "training_labels", "class_stats"])
def test_texts_are_tokenised_once(spark, name):
    """One expression that finds tokens, whatever is built on the scores: later uses read its exchange."""
    from quarry.registry import QUERIES

    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("regexp_extract_all") == 1


def test_catalog_and_index(spark, tmp_path):
    from quarry.operators.catalog import catalog_diff, is_fresh
    from quarry.sources import index

    old = frame(spark, [("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    new = frame(spark, [("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in catalog_diff(old, new).collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "added"}
    assert is_fresh(old, old).first().fresh and not is_fresh(old, new).first().fresh
    root = f"file://{tmp_path}"
    assert index.load(spark, root, "w", "py") is None
    index.save(root, "w", "py", {"model": "m"}, symbols=old)
    assert index.load(spark, root, "w", "py", model="m")["symbols"].count() == 3 and index.load(spark, root, "w", "py", model="other") is None
    index.append_jsonl(old, f"{root}/x")
    (tmp_path / "x" / "part-bad.json").write_text("{not json\n")
    assert [r.path for r in index.tail_jsonl(spark, f"{root}/x", "path string, hash string", "path", 2).collect()] == ["b", "c"]


def test_requests_and_search(spark):
    from quarry.operators.encoders import HashEncoder, embed
    from quarry.plans.requests import Search, extension
    from quarry.functions.projections import reading
    from quarry.plans.search import search
    from quarry.sources.extract import extract_symbols

    r = Search("q", mode="odd", top_k=99, semantic_weight=3, target="diff")
    assert (r.mode, r.top_k, r.semantic_weight, r.target, Search("q").commit_weight) == ("hybrid", 50, 1.0, "diff_hunks", 0.6)
    assert extension(None, {".ts": 2, ".java": 2}) == ".java"
    with pytest.raises(ValueError):
        extension("exe", {})
    symbols = extract_symbols(frame(spark, [("src/a.py", bytearray(PY))], "path string, content binary")).cache()
    symbols = symbols.join(embed(symbols, "symbol_id", F.col("code"), HashEncoder()), "symbol_id").cache()
    vector = symbols.where("name = 'load'").first()["embedding"]
    for mode in ("semantic", "hybrid", "bm25", "keyword"):
        found = search(symbols, Search("load path", mode=mode), vector).collect()
        assert found and (mode == "keyword" or found[0]["name"] == "load"), mode
    assert search(symbols, Search("load", include_files=()), vector).count() == 0
    assert reading(search(symbols, Search("load path"), vector)).first()["text"].startswith("1. Function `load` at `src/a.py:4-8`\n   rank_score=1.000")


def test_ranges(spark):
    from quarry.operators.ranges import as_of, ranges_text
    from quarry.streaming.events import linked

    left = frame(spark, [("k", 5, 1), ("k", 1, 2), ("z", 9, 3)], "key string, t long, id long")
    right = frame(spark, [("k", 2, 20), ("k", 5, 50), ("k", 9, 90)], "key string, t long, v long")
    assert {r["id"]: r.v for r in as_of(left, right, "key", "t", "t", "v").collect()} == {1: 50, 2: None, 3: None}
    row = frame(spark, [(1,)], "x int").select(ranges_text(F.array(F.struct(F.lit(1).alias("begin"), F.lit(3).alias("end")), F.struct(F.lit(7).alias("begin"), F.lit(7).alias("end")))).alias("t"))
    assert row.first().t == "1-3, 7"
    s = frame(spark, [("s", "d", 1, 10), ("s", "d", 5, 11)], "session string, directory string, ts long, event_id long")
    g = frame(spark, [("s", "d", 4, 1)], "session string, directory string, ts long, n long")
    assert linked(s, g).first().parent_event_id == 10


def test_feedback(spark):
    from quarry.operators.feedback import training_examples

    results = frame(spark, [(1, f"d{r}", r) for r in range(1, 6)] + [(2, "d1", 1)], "event long, doc string, rank long")
    used = frame(spark, [(1, "d3"), (1, "d3"), (1, "nowhere")], "event long, doc string")
    found = {r.doc: (r.label, r.above_used) for r in training_examples(results, used, "event", "doc").collect()}
    assert found == {"d1": (0, True), "d2": (0, True), "d3": (1, False), "d4": (0, False), "d5": (0, False)}


def test_usage_examples(spark):
    from quarry.operators.feedback import usage_examples

    events = frame(spark, [(1, "/w", "q"), (2, "/w", "")], "event_id long, directory string, query string")
    shown = [(1, "/w/a.py", "a.py", 10, 20, "f"), (2, "/w/b.py", "b.py", 1, 5, "g"), (3, "/w/a.py", "./a.py", 15, 30, "h"), (4, "c.py", None, None, None, "k"), (5, "/w/b.py", "b.py", 6, 9, "m")]
    results = frame(spark, [(e, *r[:1], *r[1:], "x") for e in (1, 2) for r in shown], "event_id long, rank long, file string, path string, lineno long, end_lineno long, name string, code string")
    usage = frame(spark, [(7, 1, [2], ["a.py:16-18", " /w/b.py:2 ", "c.py:99", "gone.py"]), (8, 1, [], []), (9, 2, [1], [])], "usage_id long, event_id long, referenced_ranks array<long>, referenced_locations array<string>")
    found = {(r.usage_id, r["rank"]): (r.label_source, r.location, r.rank_above_referenced) for r in usage_examples(events, results, usage).collect()}
    none = ("returned_not_referenced", None)
    assert found == {
        (7, 1): ("referenced_location", "a.py:16-18", None), (7, 2): ("referenced_rank", None, None), (7, 3): (*none, False), (7, 4): ("referenced_location", "c.py:99", None), (7, 5): (*none, False),
        **{(8, k): (*none, False) for k in range(1, 6)},
    }


def test_commit_search_modes(spark):
    from quarry.plans.commit_search import search_commits
    from quarry.plans.requests import Search

    rows = [("A", 0, "x.py", "fix parser", "alpha beta", [1.0, 0.0], 2), ("A", 1, "y.py", "fix parser", "beta", [0.0, 1.0], 1), ("B", 2, "x.py", "add tests", "alpha", [0.6, 0.8], 1), ("C", 3, "z.py", None, "beta alpha", [0.0, 1.0], 1), ("C", 4, "w.py", None, "", [0.0, 1.0], 3)]
    units = frame(spark, rows, "commit_key string, position long, path string, commit_message string, search_text string, embedding array<float>, file_hunk_count int")
    units = units.withColumns({c: F.lit(1) for c in ("lineno", "additions", "deletions")})
    run = lambda mode, text="parser", v=(0.0, 1.0), k=5: {r.commit_key: r for r in search_commits(units, Search(text, mode=mode, target="commits", top_k=k), list(v)).collect()}
    semantic = run("semantic")
    assert (semantic["C"].representative, semantic["A"].representative, semantic["A"].score) == (4, 1, 1.0)  # the last of equals
    assert [(h.path, h.is_representative, h.hunk_count) for h in semantic["A"].commit_hunks] == [("y.py", True, 1), ("x.py", False, 2)]
    assert semantic["A"].commit_files == ["x.py", "y.py"] and semantic["C"].commit_hunk_count == 4
    assert set(run("bm25")) == {"A"} and set(run("bm25", "nothing")) == {"A", "B", "C"} and run("bm25")["A"].representative == 1
    hybrid = run("hybrid")
    assert hybrid["A"].score == 1.0 and hybrid["C"].score == 0.6 and [hybrid[k]["rank"] for k in "ACB"] == [1, 2, 3]
    keyword = run("keyword", "ALPHA beta")
    assert {k: (r["rank"], r.representative, r.score, r.matched_keywords) for k, r in keyword.items()} == {"A": (1, 0, None, ["alpha", "beta"]), "C": (2, 3, None, ["alpha", "beta"])}


def test_streams_equal_batches(spark, tmp_path):
    from quarry.sources import snapshots
    from quarry.streaming import events as E

    source = "/root/testdata/sf0.001/events.parquet"
    import os
    import shutil

    if not os.path.exists(source):
        pytest.skip("no tables")
    (tmp_path / "in").mkdir()
    shutil.copy(source, tmp_path / "in" / "events.parquet")
    schema = spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")).schema
    raw = spark.readStream.schema(spark.read.parquet(source).schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    assert raw.schema.fieldNames() == schema.fieldNames()
    q = E.tumbling(raw).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    q.processAllAvailable()
    q.stop()
    batch = E.tumbling(spark.read.parquet(source).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("tumbling").collect())) == sorted(map(tuple, batch.collect()))
    (tmp_path / "c").mkdir()
    sink = E.upsert_catalog(spark, f"file://{tmp_path}/state")
    sink(frame(spark, [("a", "1", 1), ("b", "1", 1), ("a", "2", 2)], "path string, hash string, version long"), 0)
    sink(frame(spark, [("b", None, 3), ("c", "1", 3)], "path string, hash string, version long"), 1)
    sink(frame(spark, [("c", "1", 3), ("a", "2", 4)], "path string, hash string, version long"), 1)  # again after a restart
    sink(frame(spark, [("c", "1", 5), ("a", "3", 5)], "path string, hash string, version long"), 2)
    state = f"file://{tmp_path}/state"
    assert {tuple(r) for r in snapshots.read(spark, state).collect()} == {("a", "3"), ("c", "1")} and {tuple(r) for r in snapshots.read(spark, state, 2).collect()} == {("a", "2"), ("c", "1")}
    # An epoch writes what it changes: c came again as it was.
    assert sorted(tuple(r) for r in snapshots.history(spark, state).where("_version > 1").select("path", "hash", "_version", "_gone").collect()) == [("a", "3", 3, False), ("b", None, 2, True), ("c", "1", 2, False)]
    sink = E.upsert_catalog(spark, state, compact_every=4)
    sink(frame(spark, [("d", "1", 6)], "path string, hash string, version long"), 3)
    assert len(snapshots.manifest(spark, state)["folders"]) == 1 and snapshots.read(spark, state).count() == 3 and len(snapshots.versions(spark, state)) == 2


def test_contract():
    import __spark_entry__ as e

    known = e.queries()
    assert set(e.oracle_sql()) <= set(known) and "hybrid_topk" in known and len(known) > 70


def test_symbols_of_literal_sources(spark):
    import literal_sources as L

    from quarry.operators.diffs import changed_symbols, hunks
    from quarry.sources.extract import call_graph, extract_symbols, import_edges

    known = {"app.py": L.PYTHON, "broken.py": L.BROKEN, "Box.java": L.JAVA, "svc.ts": L.SCRIPT}
    files = frame(spark, [(n, bytearray(t.encode())) for n, t in known.items()], "path string, content binary")
    found = extract_symbols(files).cache()
    names = lambda *suffixes: {r.name for r in found.collect() if r.file.endswith(suffixes)}
    assert names(".py") == {"read_user", "trim", "save", "fine", "CodeBlock:23-25:calls=print,trim"} and names(".java", ".ts") == {"size", "deep", "add", "run", "#hid"}
    app = found.where("file = 'app.py'")
    assert {(r.caller, r.callee) for r in call_graph(app).collect()} >= {("read_user", "trim"), ("save", "trim")}
    assert {(r.caller, r.module, r.call) for r in import_edges(app).collect()} >= {("read_user", "json", "json.loads")}
    net = hunks(frame(spark, [(None, None, None, L.PATCH)], "commit_hash string, commit_subject string, commit_message string, patch string"))
    assert [(r.lineno, r.additions, r.deletions) for r in net.collect()] == [(14, 1, 1), (21, 0, 1)]
    assert {r.name for r in changed_symbols(app, net).collect()} == {"trim"}
