"""What op8_repeats ships: keys to the bit, runs of bytes once."""

from __future__ import annotations

import random

import numpy as np


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_repeats_shuffle_little(spark):
    """Texts whose halves repeat each other in other blocks (before: 4.3 bytes shuffled for a byte of text, 2.8 since)."""
    from quarry.llm.suffix_dedup import remove_repeats

    rng = random.Random(3)
    texts = [rng.randbytes(15_000).hex() for _ in range(48)]
    docs = spark.createDataFrame([(k, texts[k % 48]) for k in range(96)], "doc_id long, text string").coalesce(1)
    before = shuffled(spark)
    found = remove_repeats(docs, block_bytes=256 << 10, bucket_keys=1 << 18).collect()
    assert len(found) == 96 and all(r.n_removed == r.n_bytes == 30_000 for r in found)
    sent = (shuffled(spark) - before) / (96 * 30_000)
    assert sent < 3.3, sent


def test_keys_are_packed_to_the_bit():
    from quarry.llm.exchange import bounds, pack_bits, packed_keys, unpack, unpack_bits

    rng = np.random.default_rng(4)
    for dropped, n in ((0, 3), (20, 500), (30, 4000)):
        keys = rng.integers(0, 1 << 64 - dropped, n, dtype=np.uint64) << np.uint64(dropped)
        keys = np.r_[keys, keys[:2]]
        for buckets in (1, 3):
            rows = list(packed_keys(7, keys, buckets, dropped))
            lower = bounds(buckets) >> np.uint64(dropped)
            back = np.concatenate([unpack(data) + lower[bucket] for bucket, _, data, _ in rows]) << np.uint64(dropped)
            twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=len(unpack(data))) for _, _, data, t in rows])
            assert np.array_equal(back, np.unique(keys)) and set(back[twice > 0]) == set(keys[:2])
            bits = 8 * sum(len(data) - 8 for _, _, data, _ in rows)
            assert bits <= len(back) * (64 - dropped - np.log2(len(back)) + 3) + 16 * len(rows)
    for width in range(40):
        values = rng.integers(0, 1 << width, 37, dtype=np.uint64)
        assert np.array_equal(unpack_bits(pack_bits(values, width), 37, width), values)


def test_answers_name_the_first_block():
    import pyarrow as pa

    from quarry.llm.exchange import marked, packed_keys, sort_bucket

    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 40, 900, dtype=np.uint64) << np.uint64(24)
    held = {block: rng.choice(pool, 200) for block in (0, 3, 4, 300)}
    rows = [row for block in (300, 4, 0, 3) for row in packed_keys(block, held[block], 2, 24)]
    answers: dict = {block: [] for block in held}
    for bucket in (0, 1):
        table = pa.table(dict(zip(("bucket", "block", "keys", "twice"), map(list, zip(*[r for r in rows if r[0] == bucket], strict=True)), strict=True)))
        for row in sort_bucket(table, 9).to_pylist():
            answers[row["block"]].append(row)
    for block, keys in held.items():
        hit, owner = marked(keys, answers[block], 2, block, 9)
        for key, h, o in zip(keys.tolist(), hit.tolist(), owner.tolist(), strict=True):
            where = [b for b, other in held.items() for k in other.tolist() if k == key]
            assert h == (len(where) > 1) and (not h or o == min(where))
