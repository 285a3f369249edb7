"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. One pass hashes each document's distinct shingles, takes ``BANDS * ROWS`` minima, folds them
   into band keys and keeps the low two bits of every minimum, packed into longs. Documents
   with equal sets collapse into a class named by its smallest doc_id before anything is paired.
2. Each class meets the smallest class of every band bucket it is in (a star, not all pairs).
   Estimated similarity, corrected for two-bit collisions, comes from bit counts; pairs far
   below the threshold go, the rest is confirmed on full sets. Linked classes form components.
3. Only what stars can't settle is left: buckets that hold several components. A bucket's
   classes are packed into chunks of whole sets, and chunks with a class outside the bucket's
   largest component are compared with the bucket's chunks: sizes and the estimate rule most
   pairs out, one matrix product counts the rest exactly. A task keeps a forest over the
   components it has seen and writes a link only if it joins two trees, so rows grow with the
   number of components left, not with pairs. Every pair of a bucket thus ends in one
   component, or was ruled out, estimated or counted apart.

With 32 bands of 4 rows, a pair at similarity 0.8 shares no bucket with a chance below 1e-7.
The estimate's cut is six standard deviations below what a pair at 0.8 gives. Work and memory:
band keys are spread by hash, buckets are never gathered into one value, no pair inside a
component is made again, and texts move only for documents that are in a candidate pair. A hub's
text goes once to each of the tasks that its pairs are dealt over. Chunks of buckets that need
more than one are files in the shared folder; rows only name them.

Defined results: null and blank texts have no set, are linked with nothing and are kept; a null
doc_id is a document that is linked with nothing; rows that share a doc_id are one node, which
reaches whatever any of its rows reaches; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import make_folder, map_batches, prepare, remove, workspace, written
from quarry.llm.components import components

BANDS, ROWS = 32, 4
SHINGLE = 5
THRESHOLD = 80  # hundredths
WORDS_KNOWN = 250_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SEEDS = np.random.default_rng(20240601).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
_XORS, _MULS = _SEEDS[0], _SEEDS[1] | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KNOWN:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def shingles(text: str | None, known: _Words, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; with fewer words than a shingle, one of them all."""
    words = text.encode().lower().split() if text else []  # bytes: lowers A-Z only, splits at \x20 and \x09-\x0D only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mix(out * _M1 + h[k : k + n])
    return np.unique(out)


_SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    known = _Words()
    fields = np.arange(32, dtype=np.uint64) * np.uint64(2)
    for batch in batches:
        texts, ids = batch["text"], batch["doc_id"]
        sets = [shingles(t, known, width) for t in texts.to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        full = np.flatnonzero(sizes)
        digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        bands: list = [None] * len(sets)
        bits: list = [None] * len(sets)
        if len(full):
            flat = np.concatenate([sets[k] for k in full])
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            minima = np.empty((len(full), BANDS * ROWS), np.uint64)
            for k in range(BANDS * ROWS):
                minima[:, k] = np.minimum.reduceat((flat ^ _XORS[k]) * _MULS[k], starts)
            keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(full), 1))
            for r in range(ROWS):
                keys = _mix(keys * _M2 + minima[:, r::ROWS])
            low = (_mix(minima) & np.uint64(3)).reshape(len(full), -1, 32)
            packed = np.bitwise_or.reduce(low << fields, axis=2)
            for at, k in enumerate(full):
                bands[k], bits[k] = keys[at].view(np.int64), packed[at].view(np.int64)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(bands, kind), pa.array(bits, kind)],
            names=["doc_id", "n_shingles", "digest", "bands", "bits"],
        )


def _least_agreeing(threshold: int) -> int:
    """Agreeing two-bit minima below which a pair at the threshold lies by six deviations."""
    n, p = BANDS * ROWS, threshold / 100 + (1 - threshold / 100) / 4
    return int(n * p - 6 * (n * p * (1 - p)) ** 0.5)


def _likely(a: str, b: str, threshold: int) -> Column:
    """Sizes and two-bit minima don't rule the threshold out."""
    apart = F.lit(0)
    for k in range(BANDS * ROWS // 32):
        x = F.get(F.col(f"{a}_bits"), F.lit(k)).bitwiseXOR(F.get(F.col(f"{b}_bits"), F.lit(k)))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * threshold) & (apart <= BANDS * ROWS - _least_agreeing(threshold))


class _Forest:
    """Trees over nodes seen so far: a link is worth a row only if it joins two of them."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _confirm(batches: Iterator[pa.RecordBatch], width: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Each hub's own texts come first, then the texts to be held against them; what links is a forest."""
    known, forest = _Words(), _Forest()
    at, hubs = None, []
    for batch in batches:
        out = []
        columns = [batch[k].to_pylist() for k in ("v", "salt", "u", "text")]
        for v, salt, u, text in zip(*columns, strict=True):
            own = None
            if (v, salt) != at:
                at, hubs = (v, salt), []
            if u is None:
                hubs.append(shingles(text, known, width))
            elif forest.root(u) != forest.root(v):
                own = shingles(text, known, width)
                for hub in hubs:
                    common = len(np.intersect1d(own, hub, assume_unique=True))
                    if common and 100 * common >= threshold * (len(own) + len(hub) - common):
                        forest.join(u, v)
                        out.append((u, v))
                        break
        yield _links(out)


HUB_PAIRS = 512


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, threshold: int, path: str) -> DataFrame:
    """Of the pairs (u, v), links that connect what the pairs at or above the threshold on full sets do.

    A hub's text goes once to each task that its pairs are dealt over, not to each pair, and a
    task takes HUB_PAIRS or so of them.
    """
    hubs = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(HUB_PAIRS))).cast("int").alias("salts"))
    own = hubs.join(texts, hubs["v"] == texts["doc_id"]).select("v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("u"), "text")
    held = pairs.join(hubs, "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int"))
    held = held.join(texts.select(F.col("doc_id").alias("u"), "text"), "u").select("v", "salt", "u", "text")
    rows = own.unionByName(held).repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first())
    return written(map_batches(rows, lambda b: _confirm(b, width, threshold), "u long, v long"), path)


_SETS = "rep long, digest binary, hashes binary"


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        found = [shingles(t, known, width) for t in batch["text"].to_pylist()]
        digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
        columns = [batch["doc_id"], pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "digest", "hashes"])


CHUNK_SETS, CHUNK_HASHES = 256, 1 << 18


class _Chunk:
    """Some of a bucket's classes: labels, sizes, sketches and whole sets."""

    def __init__(self, labels, hashes, bits, bands):
        self.labels, self.bits, self.bands = labels, bits, bands
        self.sizes = np.array([len(x) for x in hashes], np.int64)
        self.hashes = np.concatenate(hashes)
        self.owner = np.repeat(np.arange(len(hashes)), self.sizes)

    @classmethod
    def of(cls, rows: list[tuple]) -> "_Chunk":
        """rows: (label, outside, hashes, bits, bands)."""
        labels = np.array([r[0] for r in rows], np.int64)
        return cls(labels, [np.frombuffer(r[2], np.uint64) for r in rows], np.array([r[3] for r in rows], np.int64).view(np.uint64), np.array([r[4] for r in rows], np.int64))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, labels=self.labels, sizes=self.sizes, hashes=self.hashes, bits=self.bits, bands=self.bands)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> "_Chunk":
        x = np.load(io.BytesIO(data))
        return cls(x["labels"], np.split(x["hashes"], np.cumsum(x["sizes"])[:-1]), x["bits"], x["bands"])

    def dense(self, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
        """rows x words, 1 where the row's set has the word."""
        mine = np.isin(self.owner, rows)
        h, owner = self.hashes[mine], np.searchsorted(rows, self.owner[mine])
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        ok = words[at] == h
        out = np.zeros((len(rows), len(words)), np.float32)
        out[owner[ok], at[ok]] = 1
        return out


def _common(a: _Chunk, b: _Chunk, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Intersection sizes of the rows of a with the columns of b."""
    words = np.intersect1d(a.hashes, b.hashes)
    out = np.zeros((len(rows), len(cols)), np.int64)
    for k in range(0, len(words), 8192):
        part = words[k : k + 8192]
        out += (a.dense(rows, part) @ b.dense(cols, part).T).astype(np.int64)
    return out


def _compare(a: _Chunk, b: _Chunk, key: int, threshold: int, forest: _Forest) -> list[tuple[int, int]]:
    """Links between labels that the chunks' classes give on whole sets and that the forest lacks.

    Each pair of classes counts in its first common bucket only. Sizes and two-bit minima rule
    most pairs out; pairs whose labels are in one tree already are left alone.
    """
    field = np.uint64(0x5555555555555555)
    band = int(np.flatnonzero(a.bands[0] == key)[0])
    roots = [np.array([forest.root(x) for x in side.labels.tolist()], np.int64) for side in (a, b)]
    open_ = roots[0][:, None] != roots[1][None, :]
    small, large = np.minimum(a.sizes[:, None], b.sizes[None, :]), np.maximum(a.sizes[:, None], b.sizes[None, :])
    open_ &= small * 100 >= large * threshold
    for i in range(band):
        open_ &= a.bands[:, None, i] != b.bands[None, :, i]
    apart = np.zeros(open_.shape, np.int64)
    for i in range(a.bits.shape[1]):
        x = a.bits[:, None, i] ^ b.bits[None, :, i]
        apart += np.bitwise_count((x | (x >> np.uint64(1))) & field)
    open_ &= apart <= BANDS * ROWS - _least_agreeing(threshold)
    if not open_.any():
        return []
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    common = _common(a, b, rows, cols)
    total = a.sizes[rows][:, None] + b.sizes[cols][None, :]
    at = np.nonzero(open_[np.ix_(rows, cols)] & (100 * common >= threshold * (total - common)))
    linked = np.unique(np.stack([a.labels[rows[at[0]]], b.labels[cols[at[1]]]], axis=1), axis=0)
    return [(max(u, v), min(u, v)) for u, v in linked.tolist() if forest.join(u, v)]


_SETTLED = "u long, v long, key long, file string, begin long, size long, outside long"


def _settle(batches: Iterator[pa.RecordBatch], threshold: int, folder: str, chunk_sets: int) -> Iterator[pa.RecordBatch]:
    """A bucket that fits in a chunk is compared at once; of others, chunks go to a file and a row names each.

    Files are named anew by each attempt; only those that the written table of rows names count.
    """
    names = [x.split()[0] for x in _SETTLED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    files, root = fs.FileSystem.from_uri(folder)
    forest, name, out, begin = _Forest(), uuid.uuid4().hex, None, 0
    at, first, held, weight, rows = None, True, [], 0, []

    def put():
        nonlocal out, begin, first, held, weight
        data = _Chunk.of(held).dump()
        out = out or files.open_output_stream(f"{root}/{name}")
        out.write(data)
        rows.append((None, None, at[0], name, begin, len(data), sum(r[1] for r in held)))
        begin, first, held, weight = begin + len(data), False, [], 0

    def end():
        nonlocal first, held, weight
        if held and first and at[2] == 1:
            chunk = _Chunk.of(held)
            rows.extend((*x, None, None, None, None, None) for x in _compare(chunk, chunk, at[0], threshold, forest))
        elif held:
            put()
        first, held, weight = True, [], 0

    def batch_of():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("key", "salt", "salts", "label", "outside", "hashes", "bits", "bands")]
        for key, salt, salts, *row in zip(*columns, strict=True):
            if at != (key, salt, salts):
                end()
                at = (key, salt, salts)
            elif len(held) >= chunk_sets or weight >= CHUNK_HASHES:
                put()
            held.append(tuple(row))
            weight += len(row[2]) // 8
        yield batch_of()
        rows.clear()
    end()
    if out:
        out.close()
    yield batch_of()


def _across(batches: Iterator[pa.RecordBatch], threshold: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Links between the chunks of large buckets; rows name two chunks."""
    files, root = fs.FileSystem.from_uri(folder)
    forest, last, left = _Forest(), None, None

    def load(file: str, begin: int, size: int) -> _Chunk:
        with files.open_input_file(f"{root}/{file}") as source:
            return _Chunk.load(source.read_at(size, begin))

    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if (place := (row["a_file"], row["a_begin"], row["a_size"])) != last:
                last, left = place, load(*place)
            right = (row["b_file"], row["b_begin"], row["b_size"])
            found += _compare(left, left if right == last else load(*right), row["key"], threshold, forest)
        yield _links(found)


def _mixed(named: DataFrame) -> DataFrame:
    """Members (key, rep, label, ..) of the buckets that hold several labels, with the most common one."""
    counted = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("labels"))
    return named.join(main.where("labels > 1").drop("labels"), "key")


def _reused(signed: DataFrame, classes: DataFrame, work: str) -> tuple[DataFrame, DataFrame | None]:
    """The doc_ids whose rows differ in their sets, and links (u, v) between the classes of each; None if there are none."""
    mark = F.when(F.col("digest").isNotNull(), F.xxhash64("digest"))
    seen = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.bool_or(F.col("digest").isNull()).alias("blank"))
    reused = written(seen.where("low < high OR blank AND low IS NOT NULL").select("doc_id"), f"{work}/reused")
    if reused.isEmpty():
        return reused, None
    held = signed.where("digest IS NOT NULL").join(reused, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
    least = held.groupBy("doc_id").agg(F.min("rep").alias("v"))
    return reused, written(held.join(least, "doc_id").select(F.col("rep").alias("u"), "v").where("u <> v").distinct(), f"{work}/same")


def _unsettled(mixed: DataFrame, texts: DataFrame, classes: DataFrame, width: int, threshold: int, chunk_sets: int, work: str) -> DataFrame:
    """Links (u, v) between labels that stars didn't find: the buckets that hold several, compared on whole sets."""
    folder = f"{work}/sets"
    make_folder(mixed.sparkSession, folder)
    own = texts.join(mixed.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = map_batches(own, lambda b: _sets(b, width), _SETS).join(classes.select("digest", "bits", "bands"), "digest")
    # A doc_id with several texts has sets of other classes too: a bucket takes those that have its key.
    rows = mixed.join(sets, "rep").where(F.array_contains("bands", F.col("key"))).withColumn("outside", (F.col("label") != F.col("main")).cast("int"))
    # A bucket's share of a task is bounded: large buckets are dealt over several.
    rows = rows.withColumn("salts", F.ceil(F.col("size") / (2.0 * chunk_sets))).withColumn("salt", F.pmod(F.xxhash64("rep"), "salts"))
    rows = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("outside"), "label")
    rows = rows.select("key", "salt", "salts", "label", "outside", "hashes", "bits", "bands")
    settled = written(map_batches(rows, lambda b: _settle(b, threshold, folder, chunk_sets), _SETTLED), f"{work}/settled")
    chunks = settled.where("file IS NOT NULL")
    a, b = (chunks.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("file", "begin", "size", "outside")]) for side in "ab")
    # Rows name chunks only; their sets are read where two chunks meet.
    pairs = a.join(b, "key").where("(a_file < b_file OR a_file = b_file AND a_begin <= b_begin) AND a_outside + b_outside > 0")
    pairs = pairs.repartition("a_file", "a_begin").sortWithinPartitions("a_file", "a_begin")
    across = map_batches(pairs, lambda x: _across(x, threshold, folder), "u long, v long")
    return settled.where("u IS NOT NULL").select("u", "v").unionByName(across)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, chunk_sets: int = CHUNK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs (doc_id, text)."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    work = workspace(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(map_batches(docs, lambda b: _sign(b, width), _SIGNATURE), f"{work}/signatures")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
    )
    classes = written(classes, f"{work}/classes")
    # Rows that share a doc_id are one node: the classes that hold rows of one doc_id are linked from the start.
    reused, same = _reused(signed, classes, work)
    sketch = classes.select("rep", "n", "bits")
    spread = classes.select("rep", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").drop("most")
    members = written(spread.join(shared, "key"), f"{work}/members")
    # Texts move once: those of the classes that share a bucket with another.
    texts = written(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), f"{work}/texts")

    def sides(pairs: DataFrame) -> DataFrame:
        for side in ("u", "v"):
            pairs = pairs.join(sketch.select(F.col("rep").alias(side), F.col("n").alias(f"{side}_n"), F.col("bits").alias(f"{side}_bits")), side)
        return pairs.where(_likely("u", "v", threshold)).select("u", "v").distinct()

    stars = members.where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct()
    links = _confirmed(written(sides(stars), f"{work}/stars"), texts, width, threshold, f"{work}/first")
    if same is not None:
        links = links.unionByName(same)
    labels = written(components(links, f"{work}/first-components"), f"{work}/first-labels")

    named = members.join(labels, members["rep"] == labels["node"], "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = written(_mixed(named), f"{work}/mixed")
    if not mixed.isEmpty():
        more = written(_unsettled(mixed, texts, classes, width, threshold, chunk_sets, work), f"{work}/second")
        joined = components(more, f"{work}/second-components")
        # More links join labels: a node takes what its label, or the node itself if it had none, reaches.
        moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        alone = joined.join(labels.select("node"), "node", "left_anti")
        labels = written(moved.unionByName(alone), f"{work}/second-labels")
    for name in ("texts", "members", "stars", "mixed", "sets", "settled", "first-components", "second-components"):
        remove(spark, f"{work}/{name}")
    named = classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    if same is not None:  # a row without a set goes where the others of its doc_id go
        known = out.join(reused, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("label").alias("known"))
        out = out.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "known"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


OP7_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
e AS (SELECT r, doc_id, len(s) AS n, unnest(s) AS g FROM s),
f AS (SELECT g, count(*) AS c FROM e GROUP BY g),
o AS (SELECT r, doc_id, n, g, row_number() OVER (PARTITION BY r ORDER BY c, g) AS k FROM e JOIN f USING (g)),
p AS (SELECT DISTINCT a.r AS a, b.r AS b FROM o a JOIN o b ON a.g = b.g AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      WHERE a.k <= a.n - ceil(a.n * 0.8) + 1 AND b.k <= b.n - ceil(b.n * 0.8) + 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN s x ON x.r = p.a JOIN s y ON y.r = p.b
      WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
t AS (WITH RECURSIVE t(a, b) AS (SELECT a, b FROM (SELECT a, b FROM l UNION SELECT b, a FROM l) UNION SELECT t.a, l.b FROM t JOIN (SELECT a, b FROM l UNION SELECT b, a FROM l) l ON l.a = t.b) SELECT * FROM t),
m AS (SELECT a, min(b) AS b FROM t GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, least(doc_id, coalesce(b, doc_id)) = doc_id AS kept
FROM s LEFT JOIN m ON m.a = s.doc_id
"""
