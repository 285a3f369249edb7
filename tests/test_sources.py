"""Trees and event logs as planned sources."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import functions as F


def test_tree_source(spark, tmp_path):
    from quarry.sources import git as G
    from quarry.sources.datasource import TreeReader, register

    register(spark)
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for name, text in {"a.py": "1", "d/b.py": "2", "d/_hidden.py": "3", "c.ts": "4", "out.log": "5", ".gitignore": "*.log\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("changed")
    (tmp_path / "new.py").write_text("6")
    tree = spark.read.format("quarry_tree").option("filesAPartition", 2).load(str(tmp_path))
    names = G.visible_files(str(tmp_path))
    same = lambda rows: sorted((r.path, bytes(r.content)) for r in rows.select("path", "content").collect())
    assert same(tree) == same(G.read_files(spark, str(tmp_path), names)) and len(names) == 6 and tree.rdd.getNumPartitions() == 3
    python = tree.where((F.col("suffix") == ".py") & F.col("path").startswith("d/"))
    assert [x for x, _ in same(python)] == ["d/_hidden.py", "d/b.py"] and python.rdd.getNumPartitions() == 1  # cut before it is dealt
    assert dict(same(tree.where(F.col("ref") == "HEAD")))["a.py"] == b"1" and "new.py" not in dict(same(tree.where("ref = 'HEAD'")))
    assert tree.where("length(content) = 7").count() == 1  # Spark's own
    reader = TreeReader({"path": str(tmp_path), "git": "false"})
    assert sum(len(p.names) for p in reader.partitions()) == 6


def test_event_stream_goes_on(spark, tmp_path):
    from quarry.sources.datasource import register

    register(spark)
    log = tmp_path / "log"
    log.mkdir()

    def put(name, *rows):
        (log / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")

    def run():
        stream = spark.readStream.format("quarry_events").schema("event_id long, query string").load(str(log))
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
        return sorted((r.event_id, r.query) for r in spark.read.schema("event_id long, query string").parquet(f"{tmp_path}/out").collect())

    put("000.jsonl", {"event_id": 1, "query": "a"}, "broken {", {"event_id": 2, "query": "b", "more": 1}, "[3]")
    assert run() == [(1, "a"), (2, "b")]
    put("001.jsonl", {"event_id": 3})
    put("002.jsonl", {"event_id": 4, "query": "d"})
    assert run() == [(1, "a"), (2, "b"), (3, None), (4, "d")]  # nothing again, nothing lost
    assert run() == [(1, "a"), (2, "b"), (3, None), (4, "d")]


def test_ignore_file_is_written(tmp_path):
    from quarry.sources import git as G

    assert G.default_patterns(str(tmp_path)) == list(G.FALLBACK_PATTERNS)
    (tmp_path / ".gitignore").write_text("# none\n\n*.log\n ./tmp/ \n")
    assert G.default_patterns(str(tmp_path)) == ["*.log", "tmp/"]
    assert G.write_patterns(str(tmp_path), ["b\\c/", " ./a ", "/a", "", "# x"]) == ["a", "b/c/"]
    for name in ("a/x.py", "b/c/y.py", "b/z.py", "e.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert [x for x in G.walk(str(tmp_path), ".py")] == ["b/z.py"] and not (tmp_path / ".quarryignore.new").exists()
