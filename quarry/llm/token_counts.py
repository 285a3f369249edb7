"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

The best segmentation of a prefix does not depend on what follows, so distinct pre-tokens go
into a trie and each node gets its forward score and token count once, from the nodes of its
own path: over all pieces that end there (an automaton finds them), the best sum of the score before the piece and the
piece's score (of equal sums, the fewest tokens). Terminals hold the counts, and a text's count
is the sum over its pre-tokens. Nothing is shuffled; a worker's trie holds at most ``NODES``
nodes and starts anew beyond that. A pre-token of more than ``LONG`` characters shares no prefix worth keeping: it is
scored in the same way over a window as wide as the longest piece, and leaves nothing behind.

The model is the vocabulary of a public SentencePiece file read as a unigram model under Zipf's
law: a piece's log-probability is minus the logarithm of its rank plus two. Characters without a
piece cost ``UNKNOWN_PENALTY`` more than the worst piece and count as their UTF-8 bytes, as byte
fallback writes them. A pre-token is a run of blanks with the non-blanks after it.

Defined results: null and empty texts have 0 tokens, 0 pre-tokens and score 0; a null doc_id
keeps its row; repeated rows repeat their result; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import map_batches, prepare

BLANK = "▁"
NODES = 1_500_000
#: Pre-tokens of more characters are scored without the trie.
LONG = 20_000
UNKNOWN_PENALTY = 10.0
_TOKENS, _SCORE = operator.itemgetter(0), operator.itemgetter(1)
_PRETOKEN = re.compile(" *[^ ]+| +")


def zipf_pieces(model: str) -> dict[str, float]:
    """Usual pieces of a model file, by rank, with Zipf log-probabilities."""
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    usual = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
    return {lib.id_to_piece(i): -math.log(k + 2) for k, i in enumerate(usual)}


class _Terminals(dict):
    """Pre-token -> (tokens, score); one that is not there is inserted in the trie."""

    def __init__(self, insert):
        self.insert = insert

    def __missing__(self, token: str) -> tuple[int, float]:
        return self.insert(token)


class Trie:
    """Forward scores and token counts of every prefix that any inserted pre-token has."""

    def __init__(self, pieces: dict[str, float], most: int = NODES):
        self.pieces, self.most = pieces, most
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.width = min(pieces.values()) - UNKNOWN_PENALTY, max(map(len, pieces)) + 1
        self.computed = 0
        self.terminals = _Terminals(self._insert)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.scores, self.counts = [0.0], [0]
        self.terminals.clear()

    def insert(self, token: str) -> tuple[int, float]:
        """(tokens, score) of a pre-token."""
        return self.terminals[token]

    def _insert(self, given: str) -> tuple[int, float]:
        """Walk the nodes that are there, and make the others from the pieces that end at each."""
        token = given.replace(" ", BLANK)
        if len(token) > LONG:
            return self._rolled(token)
        if len(self.scores) + len(token) > self.most and len(self.scores) > 1:
            self.clear()
        scores, counts, children, path = self.scores, self.counts, self.children, [0]
        for char in token:
            node = children.get(path[-1] << 21 | ord(char))
            if node is None:
                break
            path.append(node)
        known = len(path) - 1
        if known < len(token):
            best, fewest = -math.inf, 0
            for end, (length, score) in self.automaton.iter(token):
                if end < known:
                    continue
                while len(path) <= end:  # all pieces that end before have been seen
                    self._grow(token, path, best, fewest)
                    best, fewest = -math.inf, 0
                at = path[end + 1 - length]
                total, number = scores[at] + score, counts[at] + 1
                if total > best or (total == best and number < fewest):
                    best, fewest = total, number
            while len(path) <= len(token):
                self._grow(token, path, best, fewest)
                best, fewest = -math.inf, 0
        out = self.terminals[given] = (counts[path[-1]], scores[path[-1]])
        return out

    def _rolled(self, token: str) -> tuple[int, float]:
        """As _insert, for a long pre-token: only the last nodes of its path, as many as a piece can reach back."""
        width, at = self.width, 0
        scores, counts = [0.0] * width, [0] * width
        best, fewest = -math.inf, 0

        def close() -> None:
            nonlocal at, best, fewest
            char = token[at]
            if char not in self.pieces:
                total, number = scores[at % width] + self.unknown, counts[at % width] + len(char.encode())
                if total > best or (total == best and number < fewest):
                    best, fewest = total, number
            at += 1
            scores[at % width], counts[at % width] = best, fewest
            best, fewest = -math.inf, 0

        for end, (length, score) in self.automaton.iter(token):
            while at < end:
                close()
            total, number = scores[(end + 1 - length) % width] + score, counts[(end + 1 - length) % width] + 1
            if total > best or (total == best and number < fewest):
                best, fewest = total, number
        while at < len(token):
            close()
        return counts[at % width], scores[at % width]

    def _grow(self, token: str, path: list[int], best: float, fewest: int) -> None:
        """The next node of the path, with what its pieces give; a character without a piece is one more way."""
        char, before = token[len(path) - 1], path[-1]
        if char not in self.pieces:
            total, number = self.scores[before] + self.unknown, self.counts[before] + len(char.encode())
            if total > best or (total == best and number < fewest):
                best, fewest = total, number
        self.computed += 1
        self.children[before << 21 | ord(char)] = len(self.scores)
        path.append(len(self.scores))
        self.scores.append(best)
        self.counts.append(fewest)


@lru_cache(maxsize=2)
def trie(model: str) -> Trie:
    return Trie(zipf_pieces(model))


def pretokens(text: str | None) -> list[str]:
    """Pre-tokens with plain blanks: texts keep their one byte a character, and a trie takes either blank."""
    if not text:
        return []
    return _PRETOKEN.findall(" " + (text.replace(BLANK, " ") if BLANK in text else text))


def _count(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    look_up = trie(model).terminals.__getitem__
    for batch in batches:
        tokens, words, scores = [], [], []
        for text in batch["text"].to_pylist():
            found = list(map(look_up, pretokens(text)))
            tokens.append(sum(map(_TOKENS, found)))
            words.append(len(found))
            scores.append(round(math.fsum(map(_SCORE, found)), 6))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(tokens, pa.int64()), pa.array(words, pa.int64()), pa.array(scores, pa.float64())], names=["doc_id", "n_tokens", "n_pretokens", "log_likelihood"]
        )


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens and log_likelihood of each whole text."""
    prepare(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return map_batches(docs, lambda b: _count(b, model), "doc_id long, n_tokens long, n_pretokens long, log_likelihood double")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
