"""Exact deduplication through minimal perfect hashes over historical distinct digests.

The history is reduced to one entry per distinct digest: the winner's locator (its largest
doc_id) and the size of the group. Entries are dealt into buckets by digest, and each bucket
gets a minimal perfect hash whose slots hold the full digest, the locator and the size. A
lookup hashes a digest to its only possible slot and compares all 32 bytes there: members are
repeats of history, and nonmembers are grouped among themselves.

Without a history from elsewhere, half of the rows (by a hash of doc_id) come first and are the
history of the other half. Arrivals that are members may hold a larger doc_id than the slot's
winner, so what they add (largest doc_id and number by digest) becomes an index of its own, in
which all members are looked up; nonmembers are looked up in the index of their own groups. The
result is the same as for one batch.

Memory is bounded by a bucket (``bucket_size`` digests). Lookups stream past the index of
their bucket, and buckets with more than ``hot_rows`` rows are split over salted copies of
their index, so one text that fills a third of the table spreads over many tasks. Texts are
hashed once and never shuffled.

Defined results: null text is the empty text; a null doc_id never wins unless the whole group
has none, and then keep_id is null; rows that repeat the winner's doc_id are all kept, since
they are the same document; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, longs, map_batches, maybe, prepare, workspace, written

BUCKET_SIZE = 4096
HOT_ROWS = 4 * BUCKET_SIZE
#: Bits for each key in a level of the hash; 40 levels leave nothing behind in practice.
GAMMA, LEVELS = 2, 40

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    x = h ^ np.uint64((level + 1) * int(_MIX) % (1 << 64))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests: bit arrays by level, slots by rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [int(x.sum()) for x in levels]
        self.starts = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def build(cls, digests: np.ndarray) -> "PerfectHash":
        """digests: uint8 of shape (n, 32), all different."""
        left, levels = _keys(digests), []
        for level in range(LEVELS):
            if not len(left):
                break
            at = _mix(left, level) % np.uint64(GAMMA * len(left))
            count = np.bincount(at.astype(np.int64), minlength=GAMMA * len(left))
            levels.append((count == 1).astype(np.uint8))
            left = left[count[at.astype(np.int64)] > 1]
        if len(left):
            raise ValueError("two digests agree in their first 16 bytes")
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The only slot that may hold each digest; -1 if there is none."""
        keys, out = _keys(digests), np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (_mix(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[open_[hit]] = self.starts[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> "PerfectHash":
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=int.from_bytes(x[:8], "little")) for x in parts])


def _keys(digests: np.ndarray) -> np.ndarray:
    halves = np.ascontiguousarray(digests[:, :16]).view(np.uint64).reshape(-1, 2)
    return halves[:, 0] ^ (halves[:, 1] * _MIX)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


_INDEX = "bucket long, levels array<binary>, digests binary, winners binary, sizes binary"
_NO_WINNER = np.int64(-(2**63))


def _build(table: pa.Table) -> pa.Table:
    digests = _digests(table["digest"].combine_chunks())
    hashed = PerfectHash.build(digests)
    order = np.argsort(hashed.slots(digests))
    winners, known = longs(table["keep_id"].combine_chunks())
    winners = np.where(known, winners, _NO_WINNER)
    sizes, _ = longs(table["group_size"].combine_chunks())
    return pa.table(
        {
            "bucket": pa.array([table["bucket"][0].as_py()], pa.int64()),
            "levels": pa.array([hashed.packed()], pa.list_(pa.binary())),
            "digests": pa.array([digests[order].tobytes()], pa.binary()),
            "winners": pa.array([winners[order].tobytes()], pa.binary()),
            "sizes": pa.array([sizes[order].tobytes()], pa.binary()),
                    }
    )


def digests_of(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, digest, bucket) of each row's text, lower-cased in A-Z only."""
    hexed = F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), hexed.alias("hexed")).select(
        "doc_id",
        F.unhex("hexed").alias("digest"),
        F.pmod(F.conv(F.substring("hexed", 33, 15), 16, 10).cast("long"), F.lit(buckets)).alias("bucket"),
    )


def groups_of(digests: DataFrame) -> DataFrame:
    """(bucket, digest, keep_id, group_size) of each distinct digest."""
    return digests.groupBy("bucket", "digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def build_index(groups: DataFrame) -> DataFrame:
    """One row per bucket: the perfect hash over its distinct digests, and the slots."""
    return groups.groupBy("bucket").applyInArrow(_build, _INDEX)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = index = None
    for batch in batches:
        buckets, _ = longs(batch["bucket"])
        kinds, _ = longs(batch["kind"])
        edges = np.flatnonzero(np.r_[True, (np.diff(buckets) != 0) | (np.diff(kinds) != 0)])
        for begin, end in zip(edges, np.r_[edges[1:], len(buckets)], strict=True):
            if kinds[begin] == 0:
                at = buckets[begin]
                row = {k: batch[k][begin].as_py() for k in ("levels", "digests", "winners", "sizes")}
                index = (
                    PerfectHash.unpacked(row["levels"]),
                    np.frombuffer(row["digests"], np.uint8).reshape(-1, 32),
                    np.frombuffer(row["winners"], np.int64),
                    np.frombuffer(row["sizes"], np.int64),
                )
                continue
            part = batch.slice(begin, end - begin)
            digests = _digests(part["digest"])
            if at == buckets[begin]:
                slots = index[0].slots(digests)
                member = slots >= 0
                member[member] = (index[1][slots[member]] == digests[member]).all(axis=1)
                winners, sizes = index[2][np.where(member, slots, 0)], index[3][np.where(member, slots, 0)]
            else:
                member = np.zeros(len(digests), bool)
                winners = sizes = np.zeros(len(digests), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in _ASKED), maybe(winners, member & (winners != _NO_WINNER), pa.int64()), maybe(sizes, member, pa.int64()), pa.array(member, pa.bool_())],
                names=[*_ASKED, "keep_id", "group_size", "member"],
            )


#: What a row asks with, and keeps: known_id and known_size are what an index before this one held.
_ASKED = ("doc_id", "digest", "bucket", "known_id", "known_size")
_FOUND = "doc_id long, digest binary, bucket long, known_id long, known_size long, keep_id long, group_size long, member boolean"


def salted(digests: DataFrame, hot: DataFrame) -> DataFrame:
    """digests with ``salt``: rows of a bucket are dealt in turn, whatever ids they have.

    Rows are numbered as they are read from a written table, before any join, so a task that runs again numbers them alike.
    """
    rows = digests.withColumn("row", F.monotonically_increasing_id())
    return rows.join(hot, "bucket", "left").withColumn("salt", F.pmod("row", F.coalesce("salts", F.lit(1))).cast("int"))


def look_up(digests: DataFrame, index: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """_ASKED, keep_id, group_size and member of each row: what the index holds of its digest.

    The rows of a bucket are dealt over as many salted copies of its index as their number calls for.
    """
    asking = digests.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    salts = asking.select("bucket", F.ceil(F.col("n") / F.lit(float(hot_rows))).cast("int").alias("salts"))
    hot = salts.where("salts > 1")
    copies = index.join(hot, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    asked = salted(digests, hot)
    no = lambda kind: F.lit(None).cast(kind)
    slots = ("levels", "digests", "winners", "sizes")
    both = copies.select(
        "salt", F.lit(0).alias("kind"), no("long").alias("doc_id"), no("binary").alias("digest"), "bucket", no("long").alias("known_id"), no("long").alias("known_size"), *slots
    ).unionByName(asked.select("salt", F.lit(1).alias("kind"), *_ASKED, no("array<binary>").alias("levels"), *[no("binary").alias(c) for c in slots[1:]]))
    ordered = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    return map_batches(ordered, _look_up, _FOUND)


def came_first(doc_id):
    """Half of the rows, by doc_id, and those without one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 2 == 0, F.lit(True))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, bucket_size: int = BUCKET_SIZE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and is_repeat of each row of docs.

    history: documents that came before: their repeats in docs go, and nonmembers are grouped among
    themselves. By default docs is one batch, and the largest doc_id of each group stays;
    is_repeat then marks the rows whose digest the first half of the rows has.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    work = workspace(spark, "exact")
    n = docs.count() + (0 if history is None else history.count())
    buckets = max(1, -(-n // bucket_size))
    new = lambda rows: rows.withColumns({"known_id": F.lit(None).cast("long"), "known_size": F.lit(0).cast("long")})
    own = new(written(digests_of(docs, buckets), f"{work}/digests"))
    past = own.where(came_first(F.col("doc_id"))) if history is None else digests_of(history, buckets)
    found = written(look_up(own, build_index(groups_of(past)), hot_rows), f"{work}/found")
    members = found.where("member")
    strangers = found.where("NOT member").select("doc_id", "digest", "bucket", "known_id", "known_size")
    fresh = look_up(strangers, build_index(groups_of(strangers)), hot_rows)
    if history is None:
        later = members.where(~came_first(F.col("doc_id"))).select("doc_id", "digest", "bucket")
        asked = members.select("doc_id", "digest", "bucket", F.col("keep_id").alias("known_id"), F.col("group_size").alias("known_size"))
        members = look_up(asked, build_index(groups_of(later)), hot_rows)
    keep, size = F.greatest("known_id", "keep_id"), F.col("known_size") + F.coalesce("group_size", F.lit(0))
    out = [
        rows.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), "digest", F.lit(repeat).alias("is_repeat"))
        for rows, repeat in ((members, True), (fresh, False))
    ]
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.lit(history is None) | ~F.col("is_repeat"))
    return out[0].unionByName(out[1]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "is_repeat")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).drop("is_repeat")


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
