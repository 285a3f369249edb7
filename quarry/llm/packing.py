"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A document is its token ids and an end id. Documents beyond the capacity are cut into full pieces
and a rest; every other document is one piece. A piece's length is all that packing asks for, so
the packing is planned on the number of pieces of each length, at most ``capacity`` rows, and holds
however many pieces there are. The plan is made of patterns and how often each is repeated:

* fill: the longest piece left, then again and again the longest that still fits;
* best two: take the pattern's smallest piece out again and look among all lengths left for the two
  whose sum fits the expanded gap most tightly; they replace it if they fill more. Repeat while they do.

A pattern is repeated while there are pieces for it, so each pattern uses up some length, or leaves fewer
of it than the pattern takes; there are at most some thousand patterns.

Pieces are numbered within their length where they are made (by task) and by running sums over tasks of
the numbers that those made: one row a task and length, never a row a piece. A piece's number and length
tell its sequence and place by ``searchsorted`` over the plan.

Token ids come from the tokenizers library. Its pre-tokens never contain white space, nor do the special
tokens, so what stands between blanks and line feeds is encoded apart and remembered, ``CACHE_BYTES`` of it a worker.

Defined results: null text is empty and has the end id only; repeated rows are documents of their own;
a null doc_id stays null; an empty table gives no rows; extra columns are ignored. A run of letters
without a blank is one pre-token, which the library takes whole.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, prepare, workspace, written

CAPACITY, END_ID = 4096, 1
CACHE_BYTES = 192 << 20
#: Words of a call, and characters of the texts that are encoded together.
_JOINED, _TOGETHER = 500, 1 << 18
#: Punctuation that ends words.
_MARKS = "!#$%&()*+,-./:;=?@[]^_{|}~"

_PIECES = "task long, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def _is_word(text: str) -> bool:
    """Letters only, in lower case too, and of those that no version of Unicode takes for anything else."""
    return text.isalpha() and (text.isascii() or (max(text) < "\u02b0" and text.lower().isalpha()))


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, as the library encodes them without special tokens added."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        steps = [x["type"] for x in (said["normalizer"] or {}).get("normalizers", ())], [x["type"] for x in (said["pre_tokenizer"] or {}).get("pretokenizers", ())]
        suffix, ids = said["model"].get("end_of_word_suffix"), self.library.get_vocab(with_added_tokens=False)
        #: Of words in lower case these steps leave nothing to do but the bytes. Other tokenizers take every part whole.
        self.knows_words = bool(suffix) and steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
        if self.knows_words:
            self.ends = np.zeros(max(ids.values()) + 1, bool)
            self.ends[[i for x, i in ids.items() if x.endswith(suffix)]] = True
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = normalizers.Sequence([])
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[str, bytes] = {"": b""}
        self.room = self.most = cache_bytes

    def _keep(self, part: str, ids: bytes) -> None:
        self.known[part] = ids
        self.room -= 2 * len(part) + len(ids) + 150

    def _learn(self, parts: Iterable[str]) -> None:
        """Remember the ids of parts without white space.

        A word is a run of letters, and punctuation after one begins a pre-token of its own (an apostrophe may
        not), so a word's ids are those of its letters in any place, and many words are encoded in one call.
        """
        known, heads, words = self.known, {}, {}
        for x in parts:
            word = x.rstrip(_MARKS)
            if self.knows_words and _is_word(word):
                heads[x] = head = word.lower()
                if head not in known:
                    words[head] = None
            else:
                heads[x] = x
        words = list(words)
        joined = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        for own, found in zip(joined, self.words.encode_batch_fast([" ".join(x) for x in joined], add_special_tokens=False) if joined else (), strict=True):
            ids = np.array(found.ids, "<u4")
            data, edges = ids.tobytes(), (4 * np.r_[0, np.flatnonzero(self.ends[ids]) + 1]).tolist()
            if len(edges) == len(own) + 1:
                for x, i, j in zip(own, edges, edges[1:], strict=False):
                    self._keep(x, data[i:j])
        rest = {x for x in heads.values() if x not in known}
        rest.update(x[len(head) :] for x, head in heads.items() if x[len(head) :] not in known)
        for x, found in zip(rest, self.library.encode_batch(list(rest), add_special_tokens=False), strict=True):
            self._keep(x, np.array(found.ids, "<u4").tobytes())
        for x, head in heads.items():
            if x != head:
                self._keep(x, known[head] + known[x[len(head) :]])

    def many(self, texts: list[str]) -> list[bytes]:
        split = [x.replace("\n", " ").split(" ") for x in texts]
        if self.room <= 0:
            self.known, self.room = {"": b""}, self.most
        if new := [x for x in set().union(*split) if x not in self.known]:
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def _encoded(encode: Encoder, batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of each row; short texts are encoded together."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
        held.append((doc_id, text.as_py() or ""))
        size += len(held[-1][1])
        if size > _TOGETHER:
            yield from zip([x for x, _ in held], encode.many([x for _, x in held]), strict=True)
            held, size = [], 0
    yield from zip([x for x, _ in held], encode.many([x for _, x in held]), strict=True)


def _cut(path: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoder(path), TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in _encoded(encode, batch):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((task, doc_id, piece, at // 4, n, zlib.crc32(part), int(made[n])))
                    made[n] += 1
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

    return run


def _best_two(left: np.ndarray, gap: int) -> tuple[int, int]:
    """The two lengths left whose sum fits the gap most tightly, of equal sums with the longest one; (0, 0) if none do."""
    some = np.flatnonzero(left[:gap])
    if not len(some):
        return 0, 0
    upto = np.zeros(gap + 1, np.int64)
    upto[some] = some
    upto = np.maximum.accumulate(upto)
    other = upto[gap - some]
    alone = (other == some) & (left[some] < 2)
    other = np.where(alone, upto[some - 1], other)
    sums = np.where(other > 0, some + other, 0)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return (int(some[best]), int(other[best])) if sums[best] else (0, 0)


def plan(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Runs (length, first, each, times, sequence, offset) by length and first, and the number of sequences.

    counts: of each length from 0 to the capacity, how many pieces have it. Of a run's length the pieces
    numbered from first on go in rows of ``each`` to ``times`` sequences from ``sequence`` on, at ``offset``.
    """
    capacity = len(counts) - 1
    left = np.array(counts, np.int64)
    used = np.zeros_like(left)
    mask = sum(1 << int(x) for x in np.flatnonzero(left))  # bit n: there is a piece of length n
    runs, sequence = [], 0
    while mask:
        taken: dict[int, int] = {}
        gap = capacity

        def take(n: int, many: int) -> None:
            nonlocal gap, mask
            taken[n] = taken.get(n, 0) + many
            left[n] -= many
            gap -= n * many
            if not left[n]:
                mask &= ~(1 << n)

        while (longest := (mask & ((2 << gap) - 1)).bit_length() - 1) > 0:
            take(longest, min(int(left[longest]), gap // longest))
        while gap and sum(taken.values()) > 1:
            smallest = min(taken)
            a, b = _best_two(left, gap + smallest)
            if a + b <= smallest:
                break
            taken[smallest] -= 1
            left[smallest] += 1
            mask |= 1 << smallest
            gap += smallest
            if not taken[smallest]:
                del taken[smallest]
            take(a, 1)
            take(b, 1)
        more = min(int(left[n]) // many for n, many in taken.items())
        times, offset = 1 + more, 0
        for n, many in sorted(taken.items(), reverse=True):
            runs.append((n, int(used[n]), many, times, sequence, offset))
            used[n] += many * times
            left[n] -= many * more
            offset += n * many
            if not left[n]:
                mask &= ~(1 << n)
        sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 6), sequence


def _placed(runs: np.ndarray):
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            _, first, each, _, sequence, offset = runs[np.searchsorted(keys, (length << 48) + number, side="right") - 1].T
            row, place = np.divmod(number - first, np.maximum(each, 1))
            kept = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(sequence + row), pa.array(offset + place * length)], names=[*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    tokenizer: path of a tokenizers file whose pre-tokens hold no white space.
    """
    spark = docs.sparkSession
    prepare(spark)
    work = workspace(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(map_batches(texts, _cut(tokenizer, capacity, end_id), _PIECES), f"{work}/pieces")
    made = written(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), f"{work}/made")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        counts[row["length"]] = row["n"]
    runs, _ = plan(counts)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = made.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(firsts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("number"))
    return map_batches(numbered, _placed(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
