"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item's windows (``window`` consecutive words; a shorter item is one window) are the records
of the small side. Containment of a window asks for every one of its words, so a prefix of one
word is enough: words are ordered by how many documents hold them, and each window is indexed
under its rarest word (the anchor), with the anchor's offset. A document word that is an anchor
proposes the windows indexed there; the offset must leave the window inside the document
(positional and length bounds); the proposed stretch of words is then compared whole.

The index of windows is broadcast in blocks of at most ``block_bytes`` of window text. A
benchmark beyond one block is joined block by block, so what is broadcast never grows with it, and
hits of all blocks are united by the digest of the text, for which documents are dealt once, copies
of one text to as many tasks as shuffles have. With one block, as any benchmark of usual size is, hits need no uniting and documents stay where they are.

Defined results: null text has no words; an item without words has no window; equal items each
count; items whose item_id is null are found as all others, count in n_items as one item together
and are left out of the digest; rows of an empty table give nothing; a null doc_id keeps its row;
extra columns are ignored. Windows and counts use the whole of every text.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import join_spread, kept_struct, map_batches, map_kept, prepare, workspace, written

WINDOW = 10
BLOCK_BYTES = 64 << 20

#: Bytes outside words become spaces; A-Z become a-z. UTF-8 bytes from 0x80 on belong to words.
_TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Each distinct window of an item, and how often no more than once."""
    for batch in batches:
        ids, texts = [], []
        for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            words = words_of(text)
            if words:
                found = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}
                ids += [item] * len(found)
                texts += [x.decode() for x in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "window"])


def _count(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    known = vocabulary.value
    for batch in batches:
        for text in batch["text"].to_pylist():
            counts.update(known.intersection(words_of(text)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([x.decode() for x in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
    )


class Anchors:
    """Windows by their rarest word: word -> {(offset, length)}, and window words -> items."""

    def __init__(self, windows: list[tuple[str, list[str]]], frequency: dict[bytes, int]):
        self.shapes: dict[bytes, set] = defaultdict(set)
        self.items: dict[tuple, list[str | None]] = {}
        for text, items in windows:
            words = tuple(text.encode().split(b" "))
            anchor = min(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i], i))
            self.shapes[words[anchor]].add((anchor, len(words)))
            self.items[words] = items
        self.shapes = {k: sorted(v) for k, v in self.shapes.items()}

    def hits(self, words: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(begin, length, items) of each occurrence of a window."""
        found, shapes, items, n = [], self.shapes, self.items, len(words)
        for at in [i for i, w in enumerate(words) if w in shapes]:
            for offset, length in shapes[words[at]]:
                begin = at - offset
                if begin >= 0 and begin + length <= n and (owners := items.get(tuple(words[begin : begin + length]))) is not None:
                    found.append((begin, length, owners))
        return found


def _covered(found, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for begin, length, _ in found:
        edge[begin] += 1
        edge[begin + length] -= 1
    return np.cumsum(edge[:n]) > 0


def _runs(mask: np.ndarray) -> bytes:
    """Maximal runs of a mask as little-endian (begin, end) pairs."""
    at = np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0]))
    return at.astype("<i8").tobytes()


_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _summary(n_words: list[int], n_hit: list[int], items: list[list[str]]) -> list[pa.Array]:
    digests = [hashlib.sha256(",".join(sorted(y for y in x if y is not None)).encode()).hexdigest() for x in items]
    return [
        pa.array(n_words, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in items], pa.int64()),
        pa.array(digests, pa.string()),
        pa.array([x > 0 for x in n_hit], pa.bool_()),
    ]


def _scan(batches: Iterator[pa.RecordBatch], anchors, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """All documents against the only block."""
    index: Anchors = anchors.value
    for batch in batches:
        n_words, n_hit, items = [], [], []
        for text in batch["text"].to_pylist():
            words = words_of(text)
            found = index.hits(words)
            n_words.append(len(words))
            n_hit.append(int(_covered(found, len(words)).sum()) if found else 0)
            items.append({x for _, _, owners in found for x in owners})
        yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *_summary(n_words, n_hit, items)], names=[*keep, *_names()])


def _names() -> list[str]:
    return [x.split()[0] for x in _RESULT.split(", ")]


def _scan_block(batches: Iterator[pa.RecordBatch], anchors) -> Iterator[pa.RecordBatch]:
    """Texts that one of several blocks hits: digest, covered runs of words, items."""
    index: Anchors = anchors.value
    for batch in batches:
        digests, runs, items = [], [], []
        for text in batch["text"].to_pylist():
            words = words_of(text)
            if found := index.hits(words):
                digests.append(hashlib.sha256(text.encode()).hexdigest())
                runs.append(_runs(_covered(found, len(words))))
                items.append(list({x for _, _, owners in found for x in owners}))
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.string()), pa.array(runs, pa.binary()), pa.array(items, pa.list_(pa.string()))], names=["digest", "runs", "items"]
        )


def _unite(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_hit, items = [], [], []
        for text, parts, names in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), batch["items"].to_pylist(), strict=True):
            mask = np.zeros(len(words_of(text)), bool)
            for part in parts or []:
                for begin, end in struct.iter_unpack("<2q", part):
                    mask[begin:end] = True
            n_words.append(len(mask))
            n_hit.append(int(mask.sum()))
            items.append({x for part in names or [] for x in part})
        yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *_summary(n_words, n_hit, items)], names=[*keep, *_names()])


def _blocks(windows: DataFrame, block_bytes: int) -> int:
    size = windows.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0
    return max(1, -(-size // block_bytes))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of each document, with n_words, n_hit, n_items, items_sha256, contaminated.

    docs needs ``text``, and the columns of ``keep`` (doc_id alone by default); benchmark needs
    ``item_id`` and ``text``. A kept column that bears the name of a result comes back with ``_kept``
    after it.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    sc, keep = spark.sparkContext, keep or ["doc_id"]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    each = map_batches(items, lambda b: _windows(b, window), "item_id string, window string")
    # collect_set drops nulls: an item without an id is put back as one null.
    nameless = F.when(F.max(F.col("item_id").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))
    grouped = each.groupBy("window").agg(F.concat(F.sort_array(F.collect_set("item_id")), nameless).alias("items"))
    windows = written(grouped, f"{workspace(spark, 'decontaminate')}/windows")
    blocks = _blocks(windows, block_bytes)
    dealt = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    indexes = []
    for k in range(blocks):
        rows = [(r["window"], r["items"]) for r in dealt.where(F.col("block") == k).toLocalIterator()]
        vocabulary = sc.broadcast(frozenset(w for text, _ in rows for w in text.encode().split(b" ")))
        counted = map_batches(docs.select("text"), lambda b, v=vocabulary: _count(b, v), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        frequency = {r["word"].encode(): r["n"] for r in counted.toLocalIterator()}
        indexes.append(sc.broadcast(Anchors(rows, frequency)))
    if blocks == 1:
        return map_kept(docs.select(kept_struct(docs, keep), "text"), keep, lambda b: _scan(b, indexes[0], ["kept"]), _RESULT)
    found = None
    for index in indexes:
        hits = map_batches(docs.select("text"), lambda b, a=index: _scan_block(b, a), "digest string, runs binary, items array<string>")
        hits = hits.dropDuplicates(["digest"])
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("digest").agg(F.collect_list("runs").alias("runs"), F.collect_list("items").alias("items"))
    # Copies are told apart by what is kept of them; maps and variants have no hash.
    told = [docs[f.name] for f in docs.schema.fields if f.name in keep and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    both = docs.select(kept_struct(docs, keep), "text", F.sha2("text", 256).alias("digest"), F.xxhash64(*told or [F.lit(0)]).alias("copy"))
    both = join_spread(both, found, ["digest"], "copy", "left")
    return map_kept(both.select("kept", "text", "runs", "items"), keep, lambda b: _unite(b, ["kept"]), _RESULT)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP4_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(w) >= n),
h AS (SELECT p.r, p.i, p.n, w.item_id FROM p JOIN w ON w.n = p.n AND w.g = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id COLLATE "C") AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
