"""Which keys occur in more than one place, and where first, without moving where they are.

Blocks of rows hold 64-bit keys and are numbered from 0. Each block sends every bucket (a range of
keys) one packed row of its distinct keys, sorted; a bucket is sorted on its own and answers each
block with one packed row of marks, and, if asked, with the first block that holds each marked key.
The block computes its keys again and reads the answer off. Memory is bounded by a block and by a
bucket, and a key that a third of the corpus holds counts once per block.

Shuffles don't code entropy, so keys and numbers of blocks are packed to the bit here: a key costs
the bits of its mean distance to the next one and two to three more, a block's number those of the
number of blocks, and only where it isn't the asking block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches

BUCKET_KEYS = 1 << 21


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """The lower bits of values: whole bytes as planes, then what is left of each."""
    whole, left = divmod(width, 8)
    planes = [(values >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(whole)]
    if left:
        top = (values >> np.uint64(8 * whole)).astype(np.uint8)
        planes.append(np.packbits(np.unpackbits(top[:, None], axis=1)[:, 8 - left :]).tobytes())
    return b"".join(planes)


def unpack_bits(data: bytes, n: int, width: int) -> np.ndarray:
    whole, left = divmod(width, 8)
    out = np.zeros(n, np.uint64)
    for k in range(whole):
        out |= np.frombuffer(data, np.uint8, n, k * n).astype(np.uint64) << np.uint64(8 * k)
    if left and n:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-n * left // 8), whole * n), count=n * left)
        top = np.packbits(bits.reshape(n, left), axis=1)[:, 0] >> np.uint8(8 - left)
        out |= top.astype(np.uint64) << np.uint64(8 * whole)
    return out


def pack(ascending: np.ndarray) -> bytes:
    """Ascending numbers (Elias-Fano): lower bits as they are, upper ones as a bit in each number's place."""
    n = len(ascending)
    width = max(0, (int(ascending[-1]) // n).bit_length() - 1)
    upper = (ascending >> np.uint64(width)).astype(np.int64)
    places = np.zeros(int(upper[-1]) + n, bool)
    places[upper + np.arange(n)] = True
    return np.array([n, width], "<u4").tobytes() + pack_bits(ascending, width) + np.packbits(places).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<u4", 2).tolist()
    lower = unpack_bits(memoryview(data)[8:], n, width)
    places = np.frombuffer(data, np.uint8, offset=8 + n * (width // 8) + -(-n * (width % 8) // 8))
    return (np.flatnonzero(np.unpackbits(places)) - np.arange(n)).astype(np.uint64) << np.uint64(width) | lower


def packed_keys(block: int, keys: np.ndarray, buckets: int, dropped: int) -> Iterator[tuple]:
    """(bucket, block, distinct keys of the bucket packed, whether each occurs twice in the block).

    The lowest ``dropped`` bits of all keys are zero. Packed keys count from the bucket's lower end.
    """
    distinct, counts = np.unique(keys, return_counts=True)
    lower = bounds(buckets)
    edges = np.append(np.searchsorted(distinct, lower), len(distinct))
    distinct, lower = distinct >> np.uint64(dropped), lower >> np.uint64(dropped)
    for bucket in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        a, b = edges[bucket], edges[bucket + 1]
        yield bucket, block, pack(distinct[a:b] - lower[bucket]), np.packbits(counts[a:b] > 1).tobytes()


def bounds(buckets: int) -> np.ndarray:
    """Lower ends of equal ranges of keys: a bucket is a run of the sorted order."""
    return np.arange(buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets if buckets > 1 else 0)


_KEYS = "bucket long, block long, keys binary, twice binary"
_MARKS = "block long, bucket long, marks binary, n_marked long, owners binary"


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def send(batches: Iterator[pa.RecordBatch], make, buckets: int, dropped: int) -> Iterator[pa.RecordBatch]:
    kinds, names = [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["bucket", "block", "keys", "twice"]
    for batch in batches:
        for block, keys in make(batch):
            rows = list(packed_keys(block, keys, buckets, dropped))
            if rows:
                yield _rows(rows, kinds, names)


def sort_bucket(table: pa.Table, number_bits: int | None) -> pa.Table:
    """One bucket: which keys of each block occur anywhere else, or twice in it, and the first block that has them."""
    table = table.sort_by("block")
    blocks = table["block"].to_numpy().astype(np.uint64)
    bits = np.uint64(len(blocks).bit_length())
    # One plain sort: the key, then the place of its block, then whether it is there twice.
    parts = []
    for k, (keys, twice) in enumerate(zip(table["keys"].to_pylist(), table["twice"].to_pylist(), strict=True)):
        part = unpack(keys) << bits | np.uint64(k)
        parts.append(part << np.uint64(1) | np.unpackbits(np.frombuffer(twice, np.uint8), count=len(part)))
    ends = np.cumsum([len(p) for p in parts]).tolist()
    packed = np.concatenate(parts)
    del parts
    packed.sort()
    hit = (packed & np.uint64(1)).astype(bool)
    packed >>= np.uint64(1)
    whose = (packed & np.uint64((1 << int(bits)) - 1)).astype(np.uint16 if len(blocks) <= 1 << 16 else np.uint32)
    packed >>= bits
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    del packed
    sizes = np.diff(np.r_[first, len(whose)])
    hit |= np.repeat(sizes > 1, sizes)
    order = np.argsort(whose, kind="stable")  # back to one block after another, keys ascending
    hit, owner = hit[order], np.repeat(whose[first], sizes)[order]
    out = []
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        marks = hit[a:b]
        if marks.any():
            told = None
            if number_bits is not None:
                held = owner[a:b][marks]
                others = held != k
                told = np.packbits(others).tobytes() + pack_bits(blocks[held[others]], number_bits)
            out.append((int(blocks[k]), table["bucket"][0].as_py(), np.packbits(marks).tobytes(), int(marks.sum()), told))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    return pa.Table.from_batches([_rows(out, kinds, [x.split()[0] for x in _MARKS.split(", ")])])


def exchange(sent: DataFrame, tasks: int, number_bits: int | None = None) -> DataFrame:
    """(block, marks, n_marked): the answers of all buckets, dealt to tasks by block and gathered; with first blocks if their bits are given."""
    marks = sent.groupBy("bucket").applyInArrow(lambda t: sort_bucket(t, number_bits), _MARKS).repartition(tasks, "block")
    return marks.groupBy("block").agg(F.collect_list(F.struct("bucket", "marks", "owners")).alias("marks"), F.sum("n_marked").alias("n_marked"))


def marked(keys: np.ndarray, marks: list | None, buckets: int, block: int = 0, number_bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the marked keys, for each key its first block)."""
    if not marks or not len(keys):
        return np.zeros(len(keys), bool), np.full(len(keys), block)
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    distinct, group = ordered[first], np.cumsum(first) - 1
    edges = np.append(np.searchsorted(distinct, bounds(buckets)), len(distinct))
    hit, owner = np.zeros(len(distinct), bool), np.full(len(distinct), block)
    for x in marks:
        a, b = edges[x["bucket"]], edges[x["bucket"] + 1]
        own = np.unpackbits(np.frombuffer(x["marks"], np.uint8), count=b - a).astype(bool)
        hit[a:b] = own
        if x["owners"]:
            others = np.unpackbits(np.frombuffer(x["owners"], np.uint8, -(-int(own.sum()) // 8)), count=int(own.sum())).astype(bool)
            owner[a + np.flatnonzero(own)[others]] = unpack_bits(memoryview(x["owners"])[-(-len(others) // 8) :], int(others.sum()), number_bits)
    out, whose = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    out[order], whose[order] = hit[group], owner[group]
    return out, whose


def send_all(rows: DataFrame, make, buckets: int, dropped: int) -> DataFrame:
    """Packed keys of all blocks, by bucket; make(batch) yields (block, keys), whose lowest ``dropped`` bits are zero."""
    return map_batches(rows, lambda b: send(b, make, buckets, dropped), _KEYS).repartition(max(1, min(buckets, 100_000)), "bucket")
