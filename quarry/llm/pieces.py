"""SentencePiece BPE encoding by a table of the unique last token of every prefix.

A sequence of tokens is the BPE encoding of a text exactly if each adjacent pair is: so every
prefix of a text has one last token, and it is the only token that ends there and is compatible
with the last token of the prefix before it. Tokens that end at a position come from an
Aho-Corasick automaton, longest first; compatibility of a pair is whether merging their
characters gives the pair back, remembered by pair. The ids are recovered from the end
backwards through the table.

No piece of such a vocabulary continues from a non-blank into a blank, so the table restarts
where a blank follows a non-blank, and a worker remembers the ids of stretches it has met (at
most twice ``REMEMBERED``; the older half goes beyond that). Time is linear in the text,
however long a stretch without blanks is.

Defined results: null text is empty and encodes to begin and end ids alone; a null doc_id keeps
its row; repeated rows repeat their result; an empty table gives no rows; extra columns pass
through ``keep`` only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import kept_struct, map_kept, prepare

BLANK = "▁"
REMEMBERED = 200_000
LONGEST = 64
PAIRS = 500_000
_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


class _Memory(dict):
    """Encoded stretches of two generations: a full one becomes the old one, and the old one goes."""

    def __init__(self, make, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, part: str) -> bytes:
        out = self.old.get(part)
        if out is None:
            out = self.make(part)
        if len(part) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = out
        return out


class PrefixEncoder:
    """Encodes with the pieces of a BPE model with byte fallback and an identity normaliser."""

    def __init__(self, model: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        usual = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        self.scores = {self.pieces[i]: lib.get_score(i) for i in usual}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.scores):
            raise ValueError("a piece continues from a non-blank into a blank")
        if lib.normalize("x  y") != f"{BLANK}x{BLANK}{BLANK}y":
            raise ValueError("the model's normaliser changes more than blanks")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>").to_bytes(4, "little") for b in range(256)]
        self.begin, self.end = lib.bos_id().to_bytes(4, "little"), lib.eos_id().to_bytes(4, "little")
        self.lengths = [len(p) for p in self.pieces]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for i in usual:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()
        self.alphabet = frozenset(p for p in self.scores if len(p) == 1)
        self.strangers: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.known = _Memory(self.stretch, REMEMBERED)

    def _merged(self, text: str) -> list[str]:
        """Merges by definition: the best-scored adjacent pair first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.pieces[left], self.pieces[right]
        out = self.pairs[left << 24 | right] = self._merged(a + b) == [a, b]
        return out

    def _stranger(self, char: str) -> int:
        """A token of its own, past the vocabulary, for a character outside it."""
        if (i := self.strangers.get(char)) is None:
            i = self.strangers[char] = len(self.pieces)
            self.pieces.append(char)
            self.lengths.append(1)
            self.packed.append(b"".join(self.bytes[b] for b in char.encode()))
        return i

    def table(self, text: str) -> list[int]:
        """The last token of each prefix of the text, by its end."""
        last: list[int] = [-1] * len(text)
        pairs, lengths, compatible = self.pairs, self.lengths, self._compatible
        matches = self.automaton.iter(text)
        if not self.alphabet.issuperset(text):
            # Stable: at each end, matches stay longest first and the character itself comes last.
            own = [(k, self._stranger(c)) for k, c in enumerate(text) if c not in self.alphabet]
            matches = sorted([*matches, *own], key=lambda m: m[0])
        for end, piece in matches:
            if last[end] < 0:
                begin = end - lengths[piece]
                if begin < 0:
                    last[end] = piece
                else:
                    before = last[begin]
                    ok = pairs.get(before << 24 | piece)
                    if compatible(before, piece) if ok is None else ok:
                        last[end] = piece
        return last

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch as little-endian 32-bit integers, recovered backwards through its table."""
        last, out, at, lengths = self.table(text), [], len(text) - 1, self.lengths
        while at >= 0:
            piece = last[at]
            out.append(piece)
            at -= lengths[piece]
        out.reverse()
        packed = self.packed
        return b"".join([packed[i] for i in out])

    def encode(self, text: str | None) -> bytes:
        """All ids of the text, begin and end included, as little-endian 32-bit integers."""
        if not text:
            return self.begin + self.end
        parts = _STRETCH.findall(BLANK + text.replace(" ", BLANK))
        return b"".join([self.begin, *map(self.known.__getitem__, parts), self.end])


@lru_cache(maxsize=2)
def encoder(model: str) -> PrefixEncoder:
    return PrefixEncoder(model)


def _encode(batches: Iterator[pa.RecordBatch], model: str, keep: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    own = encoder(model)
    decode = own.library.decode
    for batch in batches:
        counts, digests, decoded, ids_out = [], [], [], []
        for text in batch["text"].to_pylist():
            packed = own.encode(text)
            ids = np.frombuffer(packed, "<u4")
            counts.append(len(ids))
            digests.append(hashlib.sha256(packed).hexdigest())
            decoded.append(hashlib.sha256(decode(ids.tolist()).encode()).hexdigest())
            if with_ids:
                ids_out.append(ids.astype(np.int32))
        more = [pa.array(ids_out, pa.list_(pa.int32()))] if with_ids else []
        yield pa.RecordBatch.from_arrays(
            [*batch.select(keep).columns, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string()), *more],
            names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids],
        )


def encode_pieces(docs: DataFrame, model: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """keep, n_tokens, ids_sha256, decoded_sha256 (and ids) of each whole text.

    model: path of the model file, the same on every executor. A kept column that bears the name
    of a result comes back with ``_kept`` after it.
    """
    prepare(docs.sparkSession)
    results = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    keep = keep or ["doc_id"]
    return map_kept(docs.select(kept_struct(docs, keep), "text"), keep, lambda b: _encode(b, model, ["kept"], with_ids), results)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_model())
