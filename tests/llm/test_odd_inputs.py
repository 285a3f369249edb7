"""Every operator on nulls, repeated rows, empty tables, very long texts and columns whose names clash."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string"
#: Names that operators use for results and inside.
CLASHES = (
    "kept", "row", "bucket", "digest", "score", "predicted", "n_words", "n_hit", "items", "n_tokens", "ids", "block", "sizes", "spans", "hash", "owner", "repository", "label", "rep",
    "key", "keep_id", "group_size", "member", "salt", "entry", "toxic", "event", "turns", "formatted", "component_id", "n_shingles", "bands", "u", "v", "at",
)


def grammar():
    from quarry.llm.toxicity import Grammar

    return Grammar({"=scum": 2.0, "vile*": 1.5}, (-3.0, 1.0, 1.0, 0.1, 0.5))


def items(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "secret sauce"), (None, None), (3, "")], "item_id long, text string")


def pieces(docs):
    from quarry.llm.pieces import default_model, encode_pieces

    return encode_pieces(docs, default_model())


def toxicity(docs):
    from quarry.llm.toxicity import score_toxicity

    return score_toxicity(docs, grammar())


def decontaminate(docs):
    from quarry.llm import decontam

    return decontam.decontaminate(docs, items(docs.sparkSession))


def token_counts(docs):
    from quarry.llm.pieces import default_model
    from quarry.llm.token_counts import count_tokens

    return count_tokens(docs, default_model())


def near(docs):
    from quarry.llm.minhash import near_duplicates

    return near_duplicates(docs, width=2)


def repeats(docs):
    from quarry.llm.suffix_dedup import remove_repeats

    return remove_repeats(docs, 40, 5, block_bytes=3000, bucket_keys=500)


def exact(docs):
    from quarry.llm.exact_dedup import exact_dedup

    return exact_dedup(docs, bucket_size=4, hot_rows=2)


def secrets(docs):
    from quarry.llm.secrets import scan_secrets

    return scan_secrets(docs).withColumn("spans", F.to_json("spans"))


OPERATORS = [pieces, toxicity, decontaminate, token_counts, near, repeats, exact, secrets]


def rows():
    rng = random.Random(21)
    words = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    long_ = words(4000) + " you vile thing, scum! password=hunter22 " + words(4000)
    body = words(60)
    out = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, body, "b"), (5, body, None), (5, body, None), (6, body.upper(), "c"), (7, long_, "a"), (None, body, "a"), (None, None, None)]
    out += [(8, "token: abcdef123 AKIA" + "A1B2" * 4 + " 0123456789abcdef01234567", "b"), (9, "one two three four five six seven eight nine ten", "d"), (10, "日本 🎉 é scum", "d"), (11, "x" * 30_000, "a")]
    return out


def told(df):
    return Counter(map(repr, (r.asDict() for r in df.collect())))


@pytest.mark.parametrize("operator", OPERATORS, ids=lambda f: f.__name__)
def test_odd_rows(spark, operator):
    docs = spark.createDataFrame(rows(), SCHEMA)
    plain = told(operator(docs))
    assert sum(plain.values()) == len(rows())
    clashing = docs.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    assert told(operator(clashing)) == plain
    assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    assert operator(spark.createDataFrame([(None, None, None)], SCHEMA)).count() == 1


@pytest.mark.parametrize("operator", [pieces, toxicity, decontaminate, token_counts, secrets], ids=lambda f: f.__name__)
def test_repeated_rows_repeat_their_result(spark, operator):
    docs = spark.createDataFrame(rows(), SCHEMA).where("doc_id = 7")
    once, thrice = (told(operator(d)) for d in (docs, docs.union(docs).union(docs)))
    assert list(once.values()) == [1] and sum(thrice.values()) == 3
    if operator is not secrets:  # an owner counts once, however often it repeats
        assert list(thrice) == list(once)


@pytest.mark.parametrize("operator", ["pieces", "toxicity", "decontaminate", "secrets"])
def test_kept_columns_may_bear_results_names(spark, operator):
    from quarry.llm import decontam, pieces, secrets, toxicity

    docs = spark.createDataFrame([(1, "scum password=hunter22 secret sauce", "s")], SCHEMA).select("*", *[F.lit("mine").alias(c) for c in ("score", "n_tokens", "n_words", "spans", "row", "repository", "owner")])
    run, results = {
        "pieces": (lambda keep: pieces.encode_pieces(docs, pieces.default_model(), keep=keep), ["n_tokens"]),
        "toxicity": (lambda keep: toxicity.score_toxicity(docs, grammar(), keep=keep), ["score"]),
        "decontaminate": (lambda keep: decontam.decontaminate(docs, items(spark), keep=keep), ["n_words"]),
        "secrets": (lambda keep: secrets.scan_secrets(docs, keep=keep), ["spans"]),
    }[operator]
    keep = ["doc_id", "score", "n_tokens", "n_words", "spans", "row", "repository", "owner", "text"]
    found = run(keep)
    assert found.columns[: len(keep)] == [f"{c}_kept" if c in results else c for c in keep]
    row = found.first()
    assert all(row[f"{c}_kept" if c in results else c] == "mine" for c in keep[1:-1]) and row[results[0]] != "mine"


def test_warc_of_odd_pages(spark, tmp_path):
    from quarry.llm import warc

    pages = spark.createDataFrame([(1, "u", "é" * 70_000), (2, None, None), (2, None, None), (None, "u", "é" * 70_000), (3, "u", "é" * 70_000)], "id long, uri string, payload string")
    clashing = pages.select("*", *[F.lit("clash").alias(c) for c in ("sha", "n", "first", "digest", "record_id", "data", "chunk_no", "stored", "payload_bytes", "record_type")])
    for k, table in enumerate((pages, clashing)):
        folder = f"file://{tmp_path}/{k}"
        chunks = warc.read_warc(warc.write_warc(warc.plan_records(table), folder, chunk_bytes=1000), folder, chunk_bytes=1000)
        last = chunks.where("is_last")
        assert sorted((str(r.record_id), r.record_type, r.refers_to, r.payload_bytes) for r in last.collect()) == [
            ("1", "response", None, 140_000), ("2", "response", None, 0), ("2", "response", None, 0), ("3", "revisit", "1", 140_000), ("None", "revisit", "1", 140_000),
        ]
        assert chunks.where("record_id = '1'").agg(F.sum(F.length("data")), F.max(F.length("data"))).first()[:] == (140_000, 1000)
    cut = warc.chunk_table(warc.plan_records(pages), 1000)
    assert cut.agg(F.max(F.length("data"))).first()[0] == 1000 and cut.where("record_type = 'revisit' AND length(data) > 0").count() == 0


def test_both_branches_of_exact_dedup(spark):
    """Members and nonmembers of the first half both occur, and the result is that of one batch."""
    from quarry.llm.exact_dedup import exact_dedup

    rng = random.Random(22)
    docs = [(k, f"T{rng.randrange(40)}"[: rng.randrange(2, 4)]) for k in range(300)] + [(1000 + k, "hot") for k in range(200)]
    found = exact_dedup(spark.createDataFrame(docs, "doc_id long, text string"), bucket_size=8, hot_rows=16).collect()
    groups = defaultdict(list)
    for i, t in docs:
        groups[t.lower()].append(i)
    text = dict(docs)
    assert {r.is_repeat for r in found} == {True, False} and len(found) == len(docs)
    for r in found:
        own = groups[text[r.doc_id].lower()]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def test_secrets_of_a_text_with_many_matches(spark):
    """More matches than a run holds: positions by brute force."""
    from quarry.llm import secrets

    rng = random.Random(23)
    text = "".join(rng.choice(["token=" + "a" * rng.randrange(3, 9) + " ", "é ", "AKIA" + "Z" * rng.randrange(10, 20) + ";", "f" * rng.randrange(20, 30) + "\n"]) for _ in range(5000))
    (row,) = secrets.scan_secrets(spark.createDataFrame([(1, text, "s")], SCHEMA)).collect()
    expected = []
    for rank, kind in enumerate(secrets.BASE):
        pattern, group, least = secrets.PATTERNS[kind]
        expected += [(m.start(), rank, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    assert [(s.begin, s["rank"], s.end) for s in row.spans if s["rank"] < len(secrets.BASE)] == sorted(expected)


def test_ownership_by_brute_force(spark):
    from quarry.llm import secrets

    rng = random.Random(24)
    values = [f"Value{k}x{k}" for k in range(12)]
    docs = [(k, " ".join(f"secret={rng.choice(values[: 1 + k % 12])}" for _ in range(3)), rng.choice([None, "a", "b", "c", "d"])) for k in range(60)]
    owners = defaultdict(set)
    for _, text, source in docs:
        for value in re.findall(r"secret=(\w+)", text):
            owners[value].add(source)
    found = secrets.scan_secrets(spark.createDataFrame(docs, SCHEMA)).collect()
    text = {i: t for i, t, _ in docs}
    for r in found:
        base = [s for s in r.spans if s.kind == "assign"]
        assert len(base) == 3
        for s in base:
            value = text[r.doc_id][s.begin : s.end].split("=")[1]
            assert s.owners == len(owners[value]) and (s.verdict == "example") == (len(owners[value]) > secrets.MAX_OWNERS)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_key_is_joined_in_many_tasks(spark, how):
    """The join on one key gives what a plain join gives, and its rows meet in more than one task."""
    from quarry.llm.common import join_spread

    many = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 90)).alias("key"))
    one = spark.createDataFrame([("hot", 1), ("k3", 2), ("k6", 3), ("none", 4)], "key string, value int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_spread(many, one, ["key"], "id", how)
        found = joined.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r.id, r.key, r.value or 0) for r in found) == sorted((r.id, r.key, r.value or 0) for r in many.join(one, "key", how).collect())
    assert len({r.task for r in found if r.key == "hot"}) > 1


def test_copies_of_one_text_against_several_blocks(spark):
    """Documents with one text, told apart by doc_id, all learn the hits of all blocks."""
    from quarry.llm.decontam import decontaminate

    text = " ".join(f"p{k}" for k in range(30))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.create_map(F.lit("a"), F.col("id")).alias("extra"))
    items = spark.createDataFrame([(k, " ".join(f"p{j}" for j in range(k, k + 10))) for k in range(0, 20, 2)], "item_id long, text string")
    found = decontaminate(docs, items, keep=["doc_id", "extra"], block_bytes=200).collect()
    assert sorted(r.doc_id for r in found) == list(range(200))
    assert {(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found} == {(30, 28, 10, True)}
