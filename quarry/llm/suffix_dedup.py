"""Removal of bytes that repeat in the corpus, by cover samples and one bucket of suffixes at a time.

A string of ``length`` bytes repeats if it also starts anywhere else. Positions belong to a
difference cover D modulo v: for any two positions i and j there is a shift d < v with both
i + d and j + d in the cover. Two equal strings of ``length`` bytes therefore share a *cover
sample*: equal strings of length - v + 1 bytes that start at cover positions.

1. Cover samples go by the top of their keys into buckets, one bucket at a time is sorted, and a
   sample that is alone in the corpus gets no mark. Keys are hashes: a key that occurs once
   proves that its string does.
2. A suffix can repeat to ``length`` bytes only if a marked sample starts within its first v. These
   suffixes, and no others, go by the keys of their first ``length`` bytes into buckets too, each
   bucket is sorted on its own, and ties name the first block of texts that holds them.
3. Ties are settled on bytes. Suffixes of one block are compared there, along whole runs. Runs
   of what is left travel as bytes to the block that their tie names and are compared with it.
   Suffixes that equal nothing there, though their keys do, are grouped by their bytes. So no hash
   decides a removal: hashes only rule out.
4. Positions whose string occurs twice cover ``length`` bytes each; covered bytes go.

What is left out of the method's usual form: buckets are ranges of keys and not of suffixes in
the alphabet's order, and samples carry marks and not ranks. A rank of a sample decides the order
of suffixes beyond ``length`` bytes, but the question here ends there: whether two suffixes agree
to exactly ``length`` bytes, which bytes settle and ranks of longer strings don't.

Memory is bounded by a block of documents and by a bucket; the numbers of both grow with what is
sent. Texts are written once, a file per block in the shared folder. Blocks send a bucket one
packed row of distinct keys and get one packed row back; positions never move. Bytes move once,
compressed, for each block that holds them and isn't the first to, and a block that many others
name is read by several tasks, each with a bounded share of them. What is sent for a byte of text
grows with the bits of the number of blocks only.

Defined results: null text is empty; matches never cross documents; repeated rows repeat each
other, so texts of at least ``length`` bytes vanish; a null doc_id keeps its row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import longs, make_folder, map_batches, maybe, prepare, remove, workspace, written
from quarry.llm.exchange import BUCKET_KEYS, exchange, marked, send_all

LENGTH = 200
#: v of the difference cover and its size (a perfect difference set of q + 1 residues, v = q * q + q + 1).
COVER_ORDER = 11
BLOCK_BYTES = 4 << 20
#: Bits of a sample's and of a string's key beyond those that number what is sent: one in 2 ** 12 and one in 2 ** 11
#: are marked in vain, and bytes end it. More bits cost more in all keys than they save in vain ones.
SPARE_BITS, STRING_BITS = 12, 11
#: Bytes of runs that one task compares with the block they name.
CLAIM_BYTES = 32 << 20
#: Positions in a row of runs.
PIECE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTES = np.random.default_rng(20240602).integers(0, 2**64, 256, dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def difference_cover(q: int) -> np.ndarray:
    """q + 1 residues modulo v = q * q + q + 1 (q prime) whose differences are all residues.

    Singer's construction: powers of a primitive element of GF(q^3) that lie in a plane.
    """
    v = q * q + q + 1

    def times_x(a, poly):
        # a0 + a1 x + a2 x^2, times x, modulo x^3 = poly[0] + poly[1] x + poly[2] x^2
        return (a[2] * poly[0] % q, (a[0] + a[2] * poly[1]) % q, (a[1] + a[2] * poly[2]) % q)

    for code in range(q**3):
        poly = (code % q, code // q % q, code // q // q)
        at, found = (1, 0, 0), []
        for k in range(v):
            if at[2] == 0:
                found.append(k)
            at = times_x(at, poly)
        if len(found) == q + 1 and len({(a - b) % v for a in found for b in found}) == v:
            return np.array(found)
    raise ValueError(f"{q} is not prime")


class Hasher:
    """Hashes of all strings of a length at once: differences of a running polynomial sum."""

    def __init__(self, most: int, bits: int = 64):
        self.dropped = np.uint64(64 - bits)
        self.grow(most)

    def grow(self, most: int) -> None:
        self.powers = np.ones(most + 1, np.uint64)
        np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(most, _BASE, np.uint64)]), out=self.powers)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.inverses = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(most, inverse, np.uint64)]))

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self.grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.powers[: len(data)], out=out[1:])
        return out

    def at(self, sums: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
        x = (sums[begins + length] - sums[begins]) * self.inverses[begins]
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return (x ^ (x >> np.uint64(31))) >> self.dropped << self.dropped

    def windows(self, data: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all strings of the length, in order of where they begin."""
        return self.at(self.sums(data), np.arange(max(0, len(data) - length + 1)), length)


_BLOCK = "task long, place long, file string, doc_ids binary, known binary, n_bytes long"


def _pack(batches: Iterator[pa.RecordBatch], block_bytes: int, folder: str) -> Iterator[pa.RecordBatch]:
    """Whole documents as blocks: one file of compressed sizes and texts each, and a row with ids, numbered within the task.

    Files are named anew by each attempt; only those that the written table of rows names count.
    """
    files, root = fs.FileSystem.from_uri(folder)
    task, place = TaskContext.get().partitionId(), itertools.count()
    ids, known, texts, held = [], [], [], 0

    def block():
        name = uuid.uuid4().hex
        sizes = np.array([len(texts), *map(len, texts)], "<i8")
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(zstandard.ZstdCompressor(level=3).compress(b"".join([sizes.tobytes(), *texts])))
        row = [task, next(place), name, np.array(ids, "<i8").tobytes(), np.array(known, np.uint8).tobytes(), held]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    for batch in batches:
        values, valid = longs(batch["doc_id"])
        for value, ok, text in zip(values.tolist(), valid.tolist(), batch["text"].to_pylist(), strict=True):
            data = (text or "").encode()
            ids.append(value)
            known.append(ok)
            texts.append(data)
            held += len(data)
            if held >= block_bytes:
                yield block()
                ids, known, texts, held = [], [], [], 0
    if texts:
        yield block()


def _read(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, bytes) of a block's documents."""
    files, root = fs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/{name}") as stream:
        held = zstandard.ZstdDecompressor().decompress(stream.read())
    n = int(np.frombuffer(held, "<i8", 1)[0])
    return np.frombuffer(held, "<i8", n, 8), np.frombuffer(held, np.uint8, offset=8 * (n + 1))


class Block:
    """A block of documents with its sums, cover samples and candidate positions."""

    def __init__(self, sizes: np.ndarray, data: np.ndarray, hasher: Hasher, cover: np.ndarray, v: int, length: int):
        self.data, self.sizes = data, sizes
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.hasher, self.cover, self.v, self.length = hasher, cover, v, length
        self.sums = hasher.sums(self.data)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """(begins, hashes) of the cover samples that fit in their documents."""
        short, out = self.length - self.v + 1, []
        mask = np.zeros(self.v, bool)
        mask[self.cover] = True
        for start, size in zip(self.starts[:-1].tolist(), self.sizes.tolist(), strict=True):
            if size >= self.length:  # a shorter document holds no string of the full length
                steps = np.arange(0, size - short + 1, self.v)[:, None] + self.cover
                steps = steps[steps <= size - short]
                out.append(start + steps)
        begins = np.concatenate(out) if out else np.empty(0, np.int64)
        return begins, self.hasher.at(self.sums, begins, short)

    def fits(self) -> np.ndarray:
        """Mask of the positions whose strings end in the document they start in."""
        out = np.ones(len(self.data), bool)
        for start, size in zip(self.starts[:-1].tolist(), self.sizes.tolist(), strict=True):
            out[max(start, start + size - self.length + 1) : start + size] = False
        return out

    def candidates(self, marked_samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begins, hashes) of full strings with a marked sample within the first v bytes."""
        n = len(self.data)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(marked_samples - self.v + 1, 0), 1)
        np.add.at(edge, marked_samples + 1, -1)
        begins = np.flatnonzero((np.cumsum(edge[:n]) > 0) & self.fits())
        return begins, self.hasher.at(self.sums, begins, self.length)


def equal(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of left at a equal those of right at b, byte by byte along runs of both."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    breaks = np.flatnonzero((np.diff(a) != 1) | (np.diff(b) != 1)) + 1
    for x, y in zip(np.r_[0, breaks].tolist(), np.r_[breaks, len(a)].tolist(), strict=True):
        n = y - x + length - 1
        wrong = left[a[x] : a[x] + n] != right[b[x] : b[x] + n]
        if wrong.any():
            sums = np.r_[0, np.cumsum(wrong)]
            out[x:y] = sums[length:] == sums[:-length]
        else:
            out[x:y] = True
    return out


def classes(data: np.ndarray, begins: np.ndarray, keys: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings at begins: (first of its equals, has an equal), both exact."""
    # One plain sort: the upper bits of the key, then the place. Ties of the upper bits are ties like others.
    low = np.uint64((1 << len(begins).bit_length()) - 1)
    packed = np.sort(keys & ~low | np.arange(len(begins), dtype=np.uint64))
    order, upper = (packed & low).astype(np.int64), packed & ~low
    at, same = begins[order], upper[1:] == upper[:-1]
    tied = np.flatnonzero(same)
    by_place = tied[np.argsort(at[tied + 1], kind="stable")]
    linked = np.zeros(len(at), bool)
    linked[by_place + 1] = equal(data, at[by_place + 1], data, at[by_place], length)
    wrong = np.zeros(len(at), bool)
    wrong[tied + 1] = ~linked[tied + 1]
    group = np.cumsum(np.r_[True, ~same]) - 1 if len(at) else np.empty(0, np.int64)
    first, twice = ~linked, np.zeros(len(at), bool)
    twice[1:] = linked[1:]
    twice[:-1] |= linked[1:]
    for g in np.unique(group[wrong]).tolist():  # different strings with one key: by their bytes
        members = np.flatnonzero(group == g)
        seen: dict[bytes, int] = {}
        for k in members.tolist():
            text = data[at[k] : at[k] + length].tobytes()
            first[k] = text not in seen
            twice[k] = text in seen
            twice[seen.setdefault(text, k)] |= twice[k]
    out = np.zeros((2, len(at)), bool)
    out[:, order] = first, twice
    return out[0], out[1]


def _spans(mask: np.ndarray) -> bytes:
    """Maximal runs of a mask as little-endian (begin, end) pairs."""
    return np.flatnonzero(np.diff(np.r_[0, mask.view(np.int8), 0])).astype("<i8").tobytes()


def _mask(spans: bytes | None, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    if spans:
        pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


_CLAIMS = "block long, sure binary, told binary, mine binary, owner long, begins binary, counts binary, n_bytes long, bytes binary"
_JUDGED = "block long, spans binary, position long, string binary"


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class _Plan:
    """What every step needs: the cover, the lengths, the numbers of buckets."""

    def __init__(self, length: int, order: int, samples: int, blocks: int, bucket_keys: int, folder: str, bits: int):
        self.length, self.folder, self.bits, self.bucket_keys, self.number_bits = length, folder, bits, bucket_keys, blocks.bit_length()
        self.sample_buckets = self.buckets = max(1, -(-samples // bucket_keys))
        self.dropped = self.string_dropped = np.uint64(max(0, 64 - SPARE_BITS - samples.bit_length()))
        self.cover, self.v = difference_cover(order), order * order + order + 1
        self.hasher = None

    def strings(self, marked_samples: int) -> None:
        """Numbers the buckets of strings by what marked samples can send: a sample stands for v / (q + 1) positions."""
        strings = marked_samples * self.v // len(self.cover)
        self.buckets = max(1, -(-strings // self.bucket_keys))
        self.string_dropped = np.uint64(max(0, 64 - STRING_BITS - strings.bit_length()))

    def read(self, file: str) -> Block:
        self.hasher = self.hasher or Hasher(BLOCK_BYTES + (1 << 20), self.bits)
        return Block(*_read(self.folder, file), self.hasher, self.cover, self.v, self.length)

    def _samples(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        begins, hashes = block.samples()
        return begins, hashes >> self.dropped << self.dropped

    def send_samples(self, batch: pa.RecordBatch):
        for number, file in zip(batch["block"].to_pylist(), batch["file"].to_pylist(), strict=True):
            yield number, self._samples(self.read(file))[1]

    def _candidates(self, batch: pa.RecordBatch, k: int):
        block = self.read(batch["file"][k].as_py())
        begins, keys = self._samples(block)
        return block, *block.candidates(begins[marked(keys, batch["ranked"][k].as_py(), self.sample_buckets)[0]])

    def send_strings(self, batch: pa.RecordBatch):
        for k, number in enumerate(batch["block"].to_pylist()):
            yield number, self._candidates(batch, k)[2] >> self.string_dropped << self.string_dropped

    def claims(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's positions that repeat in it (sure), are sent (told) or wait for others (mine), and the runs it sends."""
        for batch in batches:
            for k, number in enumerate(batch["block"].to_pylist()):
                block, begins, keys = self._candidates(batch, k)
                hit, owner = marked(keys >> self.string_dropped << self.string_dropped, batch["repeated"][k].as_py(), self.buckets, number, self.number_bits)
                begins, keys, owner = begins[hit], keys[hit], owner[hit]
                foreign = owner != number
                first, twice = classes(block.data, begins, keys, self.length)
                masks = np.zeros((3, len(block.data)), bool)
                for mask, which in zip(masks, (twice, ~twice & foreign, ~twice & ~foreign), strict=True):
                    mask[begins[which]] = True
                yield _table([(number, *map(_spans, masks), *[None] * 5)], _CLAIMS)
                for who in np.unique(owner[first & foreign]).tolist():
                    rows = list(self._runs(block.data, begins[first & (owner == who)]))
                    yield _table([(number, None, None, None, who, *row) for row in rows], _CLAIMS)

    def _runs(self, data: np.ndarray, begins: np.ndarray) -> Iterator[tuple]:
        """(begins, counts, number of bytes, bytes compressed) of runs of positions, PIECE positions or so to a row."""
        breaks = np.flatnonzero(np.diff(begins) != 1) + 1
        starts, counts = begins[np.r_[0, breaks]], np.diff(np.r_[0, breaks, len(begins)])
        pieces = [(a + at, min(n - at, PIECE)) for a, n in zip(starts.tolist(), counts.tolist(), strict=True) for at in range(0, n, PIECE)]
        held, weight = [], 0
        for k, (start, n) in enumerate(pieces):
            held.append((start, n))
            weight += n + self.length - 1
            if weight >= PIECE or k == len(pieces) - 1:
                sent = b"".join(data[x : x + m + self.length - 1].tobytes() for x, m in held)
                yield *(np.array(x, "<i8").tobytes() for x in zip(*held, strict=True)), len(sent), zstandard.ZstdCompressor(level=3).compress(sent)
                held, weight = [], 0

    def judge(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs held against the block they name: spans of that block that they confirm, and strings it doesn't have."""
        last, block, windows, fits = None, None, None, None
        held, weight = [], 0

        def settle():
            nonlocal held, weight
            out = _table(self._judged(block, windows, fits, held), _JUDGED)
            held, weight = [], 0
            return out

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["owner"] != last or weight >= 4 * PIECE):
                    yield settle()
                if row["owner"] != last:
                    last, block = row["owner"], self.read(row["file"])
                    n = max(0, len(block.data) - self.length + 1)
                    windows = np.concatenate([np.empty(0, np.uint64), *(self.hasher.at(block.sums, np.arange(x, min(x + PIECE, n)), self.length) for x in range(0, n, PIECE))])
                    fits = block.fits()[:n]
                held.append(row)
                weight += row["n_bytes"]
        if held:
            yield settle()

    def _judged(self, block: Block, windows: np.ndarray, fits: np.ndarray, rows: list[dict]) -> list[tuple]:
        """Where a run begins decides where it is compared along; only what that leaves is looked up string by string."""
        length, sent = self.length, np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(r["bytes"]) for r in rows), np.uint8)
        starts, counts = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("begins", "counts"))
        whose = np.repeat(np.arange(len(rows)), [len(r["counts"]) // 8 for r in rows])
        offsets = np.cumsum(counts + length - 1) - (counts + length - 1)
        ends = block.starts[1:] - length + 1  # beyond the last string of each document
        confirmed, out, left = np.zeros(len(block.data), bool), [], []
        sums = self.hasher.sums(sent)
        low, high, ordered = self._find(windows, fits, self.hasher.at(sums, offsets, length))
        for k in range(len(counts)):
            n = 0
            if low[k] < high[k]:
                place = int(ordered[low[k]])
                most = int(min(counts[k], ends[np.searchsorted(block.starts, place, side="right") - 1] - place))
                if equal(sent, offsets[k] + np.arange(most), block.data, place + np.arange(most), length).all():
                    n = most
                    confirmed[place : place + n] = True
            if n < counts[k]:
                left.append((k, n))
        if left:
            run = np.concatenate([np.full(counts[k] - n, k) for k, n in left])
            each = np.concatenate([np.arange(n, counts[k]) for k, n in left])
            here = offsets[run] + each
            low, high, ordered = self._find(windows, fits, self.hasher.at(sums, here, length))
            found = low < high
            place = np.full(len(here), -1, np.int64)
            place[found] = ordered[low[found]]
            ok = np.zeros(len(here), bool)
            ok[found] = equal(sent, here[found], block.data, place[found], length)
            for k in np.flatnonzero(~ok).tolist():  # different strings with one key
                text = sent[here[k] : here[k] + length]
                match = next((p for p in ordered[low[k] : high[k]].tolist() if np.array_equal(block.data[p : p + length], text)), None)
                if match is None:
                    out.append((rows[whose[run[k]]]["block"], None, int(starts[run[k]] + each[k]), text.tobytes()))
                else:
                    ok[k], place[k] = True, match
            confirmed[place[ok]] = True
        out.append((rows[0]["owner"], _spans(confirmed), None, None))
        return out

    @staticmethod
    def _find(windows: np.ndarray, fits: np.ndarray, keys: np.ndarray):
        """For each key the range of the places that have it, in places ordered by key."""
        wanted = np.zeros(1 << 20, bool)
        wanted[keys >> np.uint64(44)] = True
        at = np.flatnonzero(wanted[windows >> np.uint64(44)] & fits)
        at = at[np.argsort(windows[at], kind="stable")]
        ordered, order = windows[at], np.argsort(keys)
        low, high = np.empty((2, len(keys)), np.int64)
        low[order] = np.searchsorted(ordered, keys[order])
        high[order] = np.searchsorted(ordered, keys[order], side="right")
        return low, high, at

    def cut(self, batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
        """Each document without its repeats."""
        for batch in batches:
            for row in batch.to_pylist():
                sizes, data = _read(self.folder, row["file"])
                sure, told, mine = (_mask(row[c], len(data)) for c in ("sure", "told", "mine"))
                told[row["failed"] or []] = False
                repeats = sure | told
                for spans in row["spans"] or []:
                    repeats |= mine & _mask(spans, len(data))
                begins = np.flatnonzero(repeats)
                edge = np.zeros(len(data) + self.length + 1, np.int32)
                edge[begins] += 1
                edge[begins + self.length] -= 1
                yield self._documents(row, sizes, data, np.cumsum(edge[: len(data)]) > 0, with_text)

    def _documents(self, row: dict, sizes: np.ndarray, data: np.ndarray, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
        n_removed, n_spans, digests, texts = [], [], [], []
        for start, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
            mask = gone[start : start + size]
            kept = data[start : start + size][~mask].tobytes()
            n_removed.append(size - len(kept))
            n_spans.append(int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept)
        ids = maybe(np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], np.uint8), pa.int64())
        more = [pa.array(texts, pa.binary())] if with_text else []
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string()), *more],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text],
        )


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, order: int = COVER_ORDER, block_bytes: int = BLOCK_BYTES, bucket_keys: int = BUCKET_KEYS, with_text: bool = False, hash_bits: int = 64
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of each row of docs (doc_id, text).

    hash_bits: how much of a hash is a key; the result is the same with any, fewer only make more ties.
    """
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    if order * order + order + 1 > length:
        raise ValueError("the cover is wider than the strings")
    work = workspace(spark, "repeats")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = f"{work}/texts"
    make_folder(spark, folder)
    packed = written(map_batches(docs, lambda b: _pack(b, block_bytes, folder), _BLOCK), f"{work}/blocks")
    # A row a task: blocks are numbered from 0, one task's after another's.
    held = sorted(packed.groupBy("task").agg(F.count(F.lit(1)), F.sum("n_bytes")).collect())
    count, total = sum(r[1] for r in held), sum(r[2] for r in held)
    before = spark.createDataFrame([(r[0], n - r[1]) for r, n in zip(held, itertools.accumulate(r[1] for r in held), strict=True)], "task long, before long")
    blocks = packed.join(F.broadcast(before), "task").withColumn("block", F.col("before") + F.col("place"))
    samples = int(total * (order + 1) / (order * order + order + 1))
    plan = _Plan(length, order, samples, count, bucket_keys, folder, hash_bits)
    # Rows here are numbers, marks and keys; texts are read where they are needed.
    tasks = max(1, min(count, 100_000))
    own = blocks.select("block", "file").repartition(tasks, "block")
    ranked = written(exchange(send_all(own, plan.send_samples, plan.sample_buckets, int(plan.dropped)), tasks), f"{work}/ranked")
    plan.strings(ranked.agg(F.coalesce(F.sum("n_marked"), F.lit(0))).first()[0])
    known = own.join(ranked.select("block", F.col("marks").alias("ranked")).repartition(tasks, "block"), "block")
    # Answers stay where they are gathered: both sides are dealt by block to as many tasks.
    repeated = exchange(send_all(known, plan.send_strings, plan.buckets, int(plan.string_dropped)), tasks, plan.number_bits)
    both = known.join(repeated.select("block", F.col("marks").alias("repeated")), "block")
    claims = written(map_batches(both, plan.claims, _CLAIMS), f"{work}/claims")

    sent = claims.where("owner IS NOT NULL").select("owner", "block", "begins", "counts", "n_bytes", "bytes")
    shares = sent.groupBy("owner").agg(F.ceil(F.sum("n_bytes") / F.lit(float(CLAIM_BYTES))).alias("shares"))
    # A number, a name and a number for each block: small beside the runs, which so move once.
    asked = shares.join(blocks.select(F.col("block").alias("owner"), "file"), "owner")
    dealt = sent.join(F.broadcast(asked), "owner").withColumn("share", F.pmod(F.xxhash64("block"), "shares"))
    dealt = dealt.repartition("owner", "share").sortWithinPartitions("owner", "block")
    judged = written(map_batches(dealt.select("owner", "file", "block", "begins", "counts", "n_bytes", "bytes"), plan.judge, _JUDGED), f"{work}/judged")
    # Strings that the block named by their key doesn't have repeat only among themselves.
    strange = judged.where("string IS NOT NULL").select("block", "position", "string")
    alone = strange.groupBy("string").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("string")
    failed = strange.join(alone, "string").groupBy("block").agg(F.collect_list("position").alias("failed"))
    spans = judged.where("spans IS NOT NULL").groupBy("block").agg(F.collect_set("spans").alias("spans"))
    settled = blocks.join(claims.where("owner IS NULL").select("block", "sure", "told", "mine"), "block", "left").join(spans, "block", "left").join(failed, "block", "left")
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    wanted = settled.select("block", "file", "doc_ids", "known", "sure", "told", "mine", "spans", "failed").repartition(tasks, "block")
    remove(spark, f"{work}/ranked")
    return map_batches(wanted, lambda b: plan.cut(b, with_text), fields)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
