"""Packing, divergence and valid-time enrichment against brute force, and on odd rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from itertools import groupby

import numpy as np
import pytest

ODD = [None, "", " ", "x" * 300_000, "a b c " * 50_000, "same same", "same same", "don't <|endoftext|> X,! 12 é́ İ| ΣΑΣ", "\n\t　tab\x85nel"]


def docs_of(spark, texts, extra=True):
    rows = [(None if i % 7 == 3 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, task string, nth int" if extra else "doc_id long, text string"
    return spark.createDataFrame(rows if extra else [r[:2] for r in rows], schema)


# ---- packing ----


def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    from quarry.llm.packing import Encoder

    library, encode, r = Tokenizer.from_file(tokenizer()), Encoder(tokenizer(), cache_bytes=20_000), random.Random(3)
    alphabet = [*"abcXYZ019 \n\t'.,<|>éß́ΣİŒ‍ 中文\x1c\x85", "<|endoftext|>", "'ll", "'re", "word"]
    texts = [x for x in ODD if x] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(2000)]
    for text in texts:
        assert encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills(seed):
    from quarry.llm.packing import plan

    r = np.random.default_rng(seed)
    n = int(r.integers(1, 3000))
    lengths = np.minimum(256, np.maximum(1, r.lognormal(3 + seed / 3, 1, n).astype(int)))
    counts = np.bincount(lengths, minlength=257)
    runs, sequences = plan(counts)
    used, filled = np.zeros(257, int), np.zeros(sequences, int)
    for length, _, each, times, sequence, offset in runs[np.lexsort([runs[:, 5], runs[:, 4]])]:
        used[length] += each * times
        assert (filled[sequence : sequence + times] == offset).all()  # gapless from 0
        filled[sequence : sequence + times] += each * length
    assert (used == counts).all() and filled.max() <= 256
    bins: list[int] = []  # first fit, longest first
    for length in sorted(lengths, reverse=True):
        at = next((i for i, x in enumerate(bins) if x + length <= 256), len(bins))
        bins[at:] = [bins[at] + length, *bins[at + 1 :]] if at < len(bins) else [length]
    assert -(-lengths.sum() // 256) <= sequences <= len(bins)


def test_best_two_replaces_smallest():
    from quarry.llm.packing import plan

    # Filling takes 60 and 30 and leaves 10; 25 and 15 fill the expanded gap of 40.
    counts = np.zeros(101, int)
    counts[[60, 30, 25, 15]] = 1
    runs, sequences = plan(counts)
    assert sequences == 2 and {tuple(x) for x in runs[:, [0, 4]]} == {(60, 0), (25, 0), (15, 0), (30, 1)}


def test_packing_whole(spark):
    from tokenizers import Tokenizer

    from quarry.llm.packing import pack

    r, library = random.Random(5), Tokenizer.from_file(tokenizer())
    texts = ODD + ["hot copy of one text"] * 300 + [" ".join(r.choice(["one", "Two,", "drei", "quatre é"]) for _ in range(r.randrange(400))) for _ in range(300)]
    docs = docs_of(spark, texts).repartition(5)
    rows = pack(docs, tokenizer(), capacity=128).collect()
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    wanted = Counter()
    for i, x in enumerate(ids):
        for piece, at in enumerate(range(0, len(x), 128)):
            part = x[at : at + 128]
            wanted[None if i % 7 == 3 else i // 2, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == wanted
    sequences = defaultdict(list)
    for x in rows:
        sequences[x.sequence_id].append((x.offset, x.length))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == list(np.cumsum([0, *(n for _, n in places)])[:-1]) and sum(n for _, n in places) <= 128
    assert len(sequences) <= 1.02 * sum(map(len, ids)) / 128 + 2
    assert pack(docs.limit(0), tokenizer()).count() == 0


# ---- divergence ----


def divergence_by_brute_force(rows):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    by_lang, out = defaultdict(list), []
    for lang, source, text in rows:
        by_lang[lang or ""].append((source or "", words(text)))
    for lang, docs in by_lang.items():
        found = Counter(w for _, ws in docs for w in set(ws))
        kept = sorted(w for w, n in found.items() if n >= 3)
        counts = defaultdict(Counter)
        for source, ws in docs:
            counts[source].update(w for w in ws if found[w] >= 3)

        def p(c):
            return {w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept)) for w in kept}

        q = p(sum(counts.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        ps = {s: p(c) for s, c in counts.items()}
        for s, own in ps.items():
            pairs = sorted((-sum(f(own[w], other[w]) for w in kept), o.encode()) for o, other in ps.items() if o != s)
            terms = sorted((-f(own[w], q[w]), w.encode()) for w in kept if counts[s][w] and own[w] > q[w])[:5]
            out += [(lang, s, part, item.decode(), -v, k + 1) for part, ranked in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_divergence(spark, cells):
    from quarry.llm.divergence import audit_sources

    r = random.Random(8)
    word = lambda: "".join(r.choice("abÄé文Z") for _ in range(r.randrange(1, 3)))
    rows = [(r.choice(["en", "de", None]), "hot" if r.random() < 0.4 else r.choice(["a", "b", None, "Ö"]), " ".join(word() for _ in range(r.randrange(30)))) for _ in range(200)]
    rows += [("xx", "only", "lonely words"), ("yy", "a", "1 2 3"), ("yy", "b", None), ("en", "none", ""), ("en", "long", "tail " * 300_000), *[("en", "hot", "same text")] * 5]
    docs = spark.createDataFrame([(*x, i, "clash") for i, x in enumerate(rows)], "lang string, source string, text string, n long, term string")
    found = audit_sources(docs, top=5, cells=cells)
    assert sorted(tuple(x) for x in found.collect()) == divergence_by_brute_force(rows)
    assert audit_sources(docs.limit(0)).count() == 0


def test_scaled_is_exact():
    from quarry.llm.divergence import scaled

    r = random.Random(2)
    for _ in range(200):
        total, kept = r.randrange(1 << 45), r.randrange(1, 1 << 30)
        count = r.randrange(total + 1)
        assert int(scaled(np.array([count]), total, kept)[0]) == 1 + 10**9 * (count + 1) // (total + kept)


# ---- valid time ----


def micros(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def enriched_by_brute_force(sales, changes, batches, days):
    day = lambda t: micros(t) // 86_400_000_000
    cut = lambda d: max(0, min(batches - 1, (d - 19723) * batches // days))
    of_sales, of_changes = defaultdict(list), defaultdict(list)
    for s in sales:
        of_sales[batches - 1 if s["arrived_at"] is None else cut(day(s["arrived_at"]))].append(s)
    for c in {tuple(c.items()) for c in changes if c["valid_at"]}:
        c = dict(c)
        of_changes[cut(day(c["valid_at"]) + zlib.crc32(str(c["change_id"]).encode()) % 4)].append(c)
    order = lambda c: (c["valid_at"], -(2**63) if c["seq"] is None else c["seq"], -(2**63) if c["change_id"] is None else c["change_id"])
    held, waiting, out, tops = [], [], [], [None, None]

    def emit(s, batch):
        own = [c for c in held if s["client_id"] is not None and c["client_id"] == s["client_id"]]
        fit = [c for c in own if s["sold_at"] and c["valid_at"] <= s["sold_at"]]
        best = max(fit, key=order) if fit else None
        cents = None if best is None or best["balance"] is None else int(np.floor(100 * best["balance"] + 0.5))
        out.append(("sale", s["sale_id"], batch, len(own), best and best["change_id"], cents, best and best["op"]))

    for k in range(batches):
        ws, wc = (x and x - timedelta(hours=12) for x in tops)
        h = min(ws, wc) if ws and wc else None
        for c in of_changes[k]:
            if wc and c["valid_at"] < wc:
                out.append(("late", c["change_id"], k, None, None, None, None))
            else:
                held.append(c)
        waiting += of_sales[k]
        due = [s for s in waiting if s["sold_at"] is None or (h and s["sold_at"] < h)]
        waiting = [s for s in waiting if not (s["sold_at"] is None or (h and s["sold_at"] < h))]
        for s in due:
            emit(s, k)
        old = sorted((c for c in held if h and c["valid_at"] <= h and c["client_id"] is not None), key=lambda c: (c["client_id"], order(c)))
        last = [list(g)[-1] for _, g in groupby(old, key=lambda c: c["client_id"])]
        held = [c for c in held if not (h and c["valid_at"] <= h)] + last
        tops = [max([x for x in [tops[0], *(s["sold_at"] for s in of_sales[k])] if x], default=None), max([x for x in [tops[1], *(c["valid_at"] for c in of_changes[k])] if x], default=None)]
    for s in waiting:
        emit(s, batches)
    return Counter(out)


SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, op string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double, city string"


@pytest.mark.parametrize(("seed", "bucket_rows", "large_rows", "part_rows"), [(1, 60, 25, 10), (2, 1 << 16, 1 << 14, 1 << 11)])
def test_valid_time(spark, seed, bucket_rows, large_rows, part_rows):
    from quarry.llm.valid_time import enrich_sales

    r = random.Random(seed)
    client = lambda: None if r.random() < 0.05 else 7 if r.random() < 0.4 else r.randrange(12)
    at = lambda: None if r.random() < 0.04 else datetime(2024, 1, 1) + timedelta(hours=r.randrange(8 * 24))  # noqa: E731  whole hours: ties
    sales = [{"sale_id": i // 2, "client_id": client(), "sold_at": at(), "arrived_at": None, "op": "clash"} for i in range(300)]
    for s in sales:
        s["arrived_at"] = None if r.random() < 0.02 else (s["sold_at"] or datetime(2024, 1, 3)) + timedelta(hours=r.choice([0, 0, 0, 1, 30, 90]))
    changes = [{"change_id": i, "client_id": client(), "seq": r.choice([None, 0, 1]), "op": r.choice(["U", "D", None]), "valid_at": at(), "balance": r.choice([None, 1.005, -3.335, 20.0]), "city": "x"} for i in range(200)]
    changes += r.sample(changes, 20)
    made = [spark.createDataFrame([tuple(x.values()) for x in rows], schema) for rows, schema in ((sales, SALES), (changes, CHANGES))]
    found = enrich_sales(*made, batches=4, days=8, bucket_rows=bucket_rows, large_rows=large_rows, part_rows=part_rows)
    assert Counter(tuple(x) for x in found.collect()) == enriched_by_brute_force(sales, changes, 4, 8)


def test_valid_time_without_rows(spark):
    from quarry.llm.valid_time import enrich_sales

    none = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert enrich_sales(*none).count() == 0
    sale = spark.createDataFrame([(1, 2, None, datetime(2024, 1, 2), "x"), (2, 2, datetime(2024, 1, 1), datetime(2024, 1, 1), "x")], SALES)
    assert sorted(tuple(x) for x in enrich_sales(sale, none[1], batches=2, days=8).collect()) == [("sale", 1, 0, 0, None, None, None), ("sale", 2, 2, 0, None, None, None)]


# ---- exact dedup: hot ids ----


def test_copies_without_ids_are_dealt_evenly(spark):
    from pyspark.sql import functions as F

    from quarry.llm.exact_dedup import exact_dedup, salted

    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit(5).cast("long").alias("bucket"))
    hot = spark.createDataFrame([(5, 12)], "bucket long, salts int")
    sizes = [r.n for r in salted(rows.repartition(4), hot).groupBy("salt").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * sorted(sizes)[6]
    docs = spark.range(3000).select(F.when(F.col("id") >= 1000, F.col("id")).alias("doc_id"), F.lit("Copy").alias("text"))
    found = exact_dedup(docs, bucket_size=4, hot_rows=100).collect()
    assert len(found) == 3000 and {(x.keep_id, x.group_size) for x in found} == {(2999, 3000)} and sum(x.kept for x in found) == 1


# ---- token counts: long pre-tokens ----


def test_long_pretokens_leave_no_nodes(monkeypatch):
    from quarry.llm import token_counts
    from quarry.llm.pieces import default_model

    made = token_counts.Trie(token_counts.zipf_pieces(default_model()))
    r = random.Random(12)
    tokens = ["".join(r.choice("abcetionéß語▁1") for _ in range(r.randrange(1, 400))) for _ in range(60)] + [" the", "x", "語" * 50]
    plain = [made.insert(t) for t in tokens]
    monkeypatch.setattr(token_counts, "LONG", 0)
    rolled = token_counts.Trie(token_counts.zipf_pieces(default_model()))
    assert [rolled.insert(t) for t in tokens] == plain and len(rolled.scores) == 1
    monkeypatch.setattr(token_counts, "LONG", 20_000)
    long_ = "abcdefghij" * 100_000  # a million characters
    count, score = made.insert(long_)
    assert len(made.scores) < 30_000 and count > 100_000 and score < 0
