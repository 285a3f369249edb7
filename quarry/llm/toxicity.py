"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns words into labels (insult, threat, target, negation, report, word). Five weighted
transducers read and write labels, and their composition scores a clause: what one writes, the
next reads, and weights multiply.

* negation: after one, insults and threats become ``denied`` and weigh half;
* report: after one, they become ``told`` and weigh 0.6;
* target: after one, they become ``aimed`` and weigh 1.5 times;
* insult: insults in a row weigh 1.25 times, and a denied one starts no row;
* threat: threats weigh 1.25 times, and 1.5 times after another, unless that was denied.

The composition is built lazily, arc by arc. A clause's score is the sum over its words of the
lexicon's weight times the arc's, and a text is scored from its matched clauses, not from words
alone, through a logistic curve whose value without a match is what the labels say of such texts.
A word that the lexicon didn't learn has no weight, a threat neither: some threats are everyday
words elsewhere (the German article "die").

The lexicon is learned from labels: word starts of 3 to 8 letters (of longer words) and whole words whose
smoothed log-odds of label 1 have a clear lower bound, taken greedily while they still explain
positive rows that earlier ones explain little. Fitting uses at most ``fit_rows`` labelled rows
(those with the smallest hash of doc_id, one text each), never held-out ones; all rows are scored,
on whole texts. An Aho-Corasick automaton finds lexicon entries, so clean texts cost one pass, and
clauses are walked once, forwards.

Defined results: null and empty texts get the curve's value at no match; a row whose id is null
is not held out and has no label; labels that are null are ignored, and an id labelled twice is
toxic if any of its labels is; without labelled rows of both kinds nothing matches and all
scores are 0; repeated rows repeat their result; an empty table gives no rows; extra columns pass
through ``keep`` only, and one that is called like a result gets ``_kept`` after its name.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import kept_struct, map_batches, map_kept, prepare, workspace, written

FIT_ROWS = 20_000
THRESHOLD = 0.3
#: A lexicon entry must explain this share of the positive rows' remaining weight, and so many rows.
LEAST_SHARE, LEAST_ROWS = 0.004, 2.0
LOWER_BOUND, Z = 1.2, 1.64
STARTS = (3, 4, 5, 6, 7, 8)

# Closed word classes of the grammar in English, German, French and Spanish.
TARGET = frozenset("you your yours yourself he she they him her them du dich dir dein ihr euch sie er tu te toi ton vous il elle ils usted tú ti él ella ellos ustedes".split())
NEGATION = frozenset("not no never none neither nor without isn't aren't don't nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás sin ni".split())
REPORT = frozenset("said says say told wrote claimed quoted called sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
THREAT = frozenset("kill hurt destroy beat attack punch burn die töte töten schlage zerstöre tuer tue frapper détruire mato matar golpear destruir".split())

_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"[\w']+")


class Transducer:
    """arc(state, label) -> (label written, weight, next state), from the state start."""

    def __init__(self, start, arc):
        self.start, self.arc = start, arc

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: other reads what this one writes; its arcs are made when they are first taken."""
        made: dict = {}

        def arc(state, label: str):
            if (out := made.get((state, label))) is None:
                between, weight, left = self.arc(state[0], label)
                written_, factor, right = other.arc(state[1], between)
                out = made[state, label] = (written_, weight * factor, (left, right))
            return out

        return Transducer((self.start, other.start), arc)


def _is(label: str, *kinds: str) -> bool:
    return label.partition(".")[0] in kinds


def _marking(cue: str, mark: str, weight: float, reach: int, lasts: bool = False) -> Transducer:
    """After the cue, insults and threats within reach are marked and weighted; the cue itself becomes a word."""

    def arc(state: int, label: str):
        if label == cue:
            return "word", 1.0, reach
        after = state if lasts else max(0, state - 1)
        if state and _is(label, "insult", "threat"):
            return f"{label}.{mark}", weight, after
        return label, 1.0, after

    return Transducer(0, arc)


def _repeating(kind: str, first: float, again: float, reach: int) -> Transducer:
    """Labels of a kind weigh more after another one that isn't denied."""

    def arc(state: int, label: str):
        if not _is(label, kind):
            return label, 1.0, max(0, state - 1)
        return label, again if state else first, max(0, state - 1) if ".denied" in label else reach

    return Transducer(0, arc)


def parts() -> list[Transducer]:
    return [
        _marking("negation", "denied", 0.5, 3), _marking("report", "told", 0.6, 1, lasts=True), _marking("target", "aimed", 1.5, 4),
        _repeating("insult", 1.0, 1.25, 3), _repeating("threat", 1.25, 1.5, 4),
    ]


def composed() -> Transducer:
    return functools.reduce(Transducer.then, parts())


class Grammar:
    """A learned lexicon and the composed clause grammar; curve: weights of the features."""

    def __init__(self, lexicon: dict[str, float], curve: tuple[float, ...] = (-40.0, 0.0, 0.0, 0.0, 0.0)):
        self.lexicon, self.curve = lexicon, curve
        self._made = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "curve": self.curve, "_made": None}

    def _ready(self):
        if self._made is None:
            automaton = ahocorasick.Automaton()
            for entry in self.lexicon:
                automaton.add_word(entry.lstrip("=").rstrip("*"), entry)
            if self.lexicon:
                automaton.make_automaton()
            self._made = (automaton, composed())
        return self._made

    def _kind(self, word: str) -> tuple[str, float]:
        weight = max((self.lexicon.get(x, 0.0) for x in (f"={word}", *(f"{word[:k]}*" for k in STARTS))), default=0.0)
        if weight:
            return ("threat" if word in THREAT else "insult"), weight
        return ("target" if word in TARGET else "negation" if word in NEGATION else "report" if word in REPORT else "word"), 0.0

    def clauses(self, text: str | None) -> list[tuple[int, int, float]]:
        """(begin, end, score) of the clauses that match."""
        automaton, grammar = self._ready()
        if not text or not self.lexicon:
            return []
        low = text.lower()
        ends = sorted({end for end, _ in automaton.iter(low)})
        out, done = [], -1
        for end in ends:
            if end <= done:
                continue
            begin = max(max(low.rfind(c, done + 1, end) for c in ".!?;:\n"), done) + 1
            stop = _CLAUSE.match(low, begin)
            done = max(end, stop.end() - 1 if stop else end)
            state, score = grammar.start, 0.0
            for m in _WORD.finditer(low, begin, done + 1):
                kind, weight = self._kind(m[0])
                _, factor, state = grammar.arc(state, kind)
                score += weight * factor
            if score:
                out.append((begin, done + 1, score))
        return out

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Of the matched clauses: log of their sum, the largest; if any matched, the log of the text's length, and 1."""
        found = [s for _, _, s in self.clauses(text)]
        return math.log1p(sum(found)), max(found, default=0.0), math.log1p(len(text)) if found else 0.0, float(bool(found))

    def score(self, text: str | None) -> float:
        z = self.curve[0] + sum(w * x for w, x in zip(self.curve[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def entries_of(text: str | None) -> set[str]:
    words = set(_WORD.findall(text.lower())) if text else ()
    return {f"={w}" for w in words} | {f"{w[:k]}*" for w in words for k in STARTS if len(w) > k}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            for entry in entries_of(text):
                counts[entry][toxic] += 1
    n, p = zip(*counts.values(), strict=True) if counts else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(p, pa.int64()), pa.array(n, pa.int64())], names=["entry", "p", "n"])


def _present(batches: Iterator[pa.RecordBatch], odds) -> Iterator[pa.RecordBatch]:
    known = odds.value
    for batch in batches:
        found = [sorted(entries_of(text) & known.keys()) for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["entries"])


def choose(rows: list[list[str]], odds: dict[str, float]) -> dict[str, float]:
    """Entries that each explain positive rows which those before it explain little.

    A row weighs half as much with every chosen entry that it has, so entries that merely come
    along with better ones (passages shared by copies of a text) are never taken.
    """
    at: dict[str, list[int]] = defaultdict(list)
    for k, row in enumerate(rows):
        for entry in row:
            at[entry].append(k)
    index = {e: np.array(v) for e, v in at.items()}
    left, chosen = np.ones(len(rows)), {}
    least = max(LEAST_ROWS, LEAST_SHARE * len(rows))
    gain = {e: float(len(v)) for e, v in index.items()}
    rank = lambda e: (gain[e] * odds[e], len(e), e)
    stem = lambda e: e.lstrip("=").rstrip("*")
    while gain:
        best = max(gain, key=rank)
        own = index[best]
        for e in chosen:  # of two entries for the same words, the second counts where the first isn't
            if stem(e).startswith(stem(best)) or stem(best).startswith(stem(e)):
                own = own[~np.isin(own, index[e])]
        now = float(left[own].sum())
        if now < gain[best] - 1e-9:  # gains only fall: put it back with what it has now
            gain[best] = now
            if now < least:
                del gain[best]
            continue
        if now < least:
            break
        chosen[best] = odds[best]
        left[index[best]] *= 0.5
        del gain[best]
    return chosen


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton steps."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(5)
    ridge = np.diag([1e-3, 1e-2, 1e-2, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _features(batches: Iterator[pa.RecordBatch], grammar) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [grammar.value.features(t) for t in batch["text"].to_pylist()]
        each = zip(*found, strict=True) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.float64()) for x in each), batch["toxic"]], names=["a", "b", "c", "d", "toxic"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Grammar:
    """A grammar from at most fit_rows labelled rows that aren't held out."""
    sc = docs.sparkSession.sparkContext
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # One text of each labelled id: rows stay bounded however often an id is reused.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic").distinct()
    rows = written(rows, f"{workspace(docs.sparkSession, 'toxicity')}/sample")  # documents are read once for it
    counted = map_batches(rows, _count, "entry string, p long, n long").groupBy("entry").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    if not positive or not negative:
        return Grammar({})
    odds = F.ln((F.col("p") + 0.5) / (positive + 1)) - F.ln((F.col("n") + 0.5) / (negative + 1))
    error = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") + 0.5))
    # Entries of a bounded sample: those with two positive rows are bounded too.
    strong = counted.where("p >= 2").withColumn("odds", odds).where(F.col("odds") - Z * error > LOWER_BOUND)
    table = sc.broadcast({r["entry"]: r["odds"] for r in strong.select("entry", "odds").collect()})
    present = [r["entries"] for r in map_batches(rows.where("toxic = 1"), lambda b: _present(b, table), "entries array<string>").collect()]
    lexicon = choose(present, table.value)
    plain = sc.broadcast(Grammar(lexicon))
    points = map_batches(rows, lambda b: _features(b, plain), "a double, b double, c double, d double, toxic int").toPandas()
    return Grammar(lexicon, _curve(points[["a", "b", "c", "d"]].to_numpy(float), points["toxic"].to_numpy(float)))


def _score(batches: Iterator[pa.RecordBatch], grammar, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [grammar.value.score(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, pa.array(scores, pa.float64())], names=[*keep, "score"])


def score_toxicity(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None) -> DataFrame:
    """keep and score of each whole text."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(grammar)
    keep = keep or ["doc_id"]
    return map_kept(docs.select(kept_struct(docs, keep), "text"), keep, lambda b: _score(b, shared, ["kept"]), "score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    grammar = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, grammar)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
