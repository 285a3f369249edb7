r"""Chat formatting: conversations rebuilt from an event log, then rendered under a template.

Only DataFrame functions. The log has one row per event: conversation, sequence number, message,
kind, role and text, in any order. ``fold`` deals it by conversation, sorts each message's events
by sequence and turns them into final messages:

* ``message``, ``edit`` and ``regenerate`` replace what the message said so far;
* ``delta`` appends to it, in order of sequence (streamed text).

``render`` escapes and marks every message on its own row and only then concatenates a
conversation, in order. A turn is ``### role: text</turn>`` and a line feed. Inside roles and
texts every ``\``, ``#``, ``:`` (roles) and ``</`` carries a backslash, so no control string
can occur there, and dropping those backslashes restores the text exactly. The loss mask is one
(turn, begin, end) per assistant turn, in code points of that turn's segment.

A conversation's formatted text is one value and so meets in one task. Its events are dealt there
once, and folding and rendering need no other exchange. Aggregates there hold one message at a
time, so a conversation that holds a third of the log costs its task a sort that can spill and one
concatenation, linear in its text.

The query has rows and no log, so ``as_log`` makes one: a draft with a streamed piece, an edit or
regeneration that replaces both, and the rest of the text as deltas, out of order.

Defined results: null text or role is empty; a null conversation is a conversation of its own;
rows with the same conversation and turn are turns of their own, ordered by role and text;
repeated rows repeat their turn; of events with the same sequence number all count, the reset
first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESETS = ("message", "edit", "regenerate")
END = "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"([\\#])", r"\\$1"), "</", r"<\\/")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\#/:])", "$1")


def as_log(rows: DataFrame) -> DataFrame:
    """Events of conv_id, turn, role, text: conv_id, seq, message, kind, role, text, where a message is (row, turn).

    Each row is a message of its own, however equal others are: rows are numbered where they are read.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    event = lambda seq, kind, said: F.struct(F.lit(seq).alias("seq"), kind.alias("kind"), said.alias("text"))
    again = F.when(F.pmod(F.xxhash64("turn"), F.lit(2)) == 0, F.lit("edit")).otherwise(F.lit("regenerate"))
    delta = F.lit("delta")
    events = F.array(
        event(4, delta, F.expr("substring(coalesce(text, ''), 2 * CAST(ceil(length(coalesce(text, '')) / 3) AS INT) + 1)")), event(1, delta, F.lit(" not sent")),
        event(2, again, F.substring(text, F.lit(1), third)), event(0, F.lit("message"), F.lit("draft")), event(3, delta, F.substring(text, third + 1, third)),
    )
    numbered = rows.select("conv_id", F.struct(F.monotonically_increasing_id().alias("row"), "turn").alias("message"), "role", events.alias("events"))
    each = numbered.select("conv_id", "message", "role", F.explode("events").alias("event"))
    return each.select("conv_id", "event.seq", "message", "event.kind", F.when(F.col("event.kind") != "delta", F.col("role")).alias("role"), "event.text")


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: final messages of a log of conv_id, seq, message, kind, role, text."""
    reset = F.col("kind").isin(*RESETS)
    base = F.max(F.when(reset, F.col("seq")))
    piece = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role")
    dealt = log.repartition("conv_id")
    folded = dealt.groupBy("conv_id", "message").agg(base.alias("base"), F.sort_array(F.collect_list(piece)).alias("pieces"))
    last = F.filter("pieces", lambda x: x["kind"].isin(*RESETS) & (x["seq"] == F.col("base")))
    deltas = F.filter("pieces", lambda x: (x["kind"] == "delta") & (F.col("base").isNull() | (x["seq"] >= F.col("base"))))
    text = F.concat(F.coalesce(F.try_element_at(last, F.lit(-1))["text"], F.lit("")), F.array_join(F.transform(deltas, lambda x: x["text"]), ""))
    role = F.coalesce(F.try_element_at(last, F.lit(-1))["role"], F.try_element_at("pieces", F.lit(-1))["role"], F.lit(""))
    return folded.select("conv_id", "message", role.alias("role"), text.alias("text"))


def render(messages: DataFrame, order: list[str]) -> DataFrame:
    """conv_id, formatted, mask: each conversation's turns in the given order, ties by role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("### "), F.regexp_replace(escape(role), ":", r"\\:"), F.lit(": "))
    body = escape(text)
    marked = messages.select(
        "conv_id", *order, role.alias("role"), text.alias("text"), F.concat(head, body, F.lit(END)).alias("segment"),
        F.when(role == LOSS_ROLE, F.struct(F.length(head).alias("begin"), (F.length(head) + F.length(body)).alias("end"))).alias("span"),
    )
    turns = F.sort_array(F.collect_list(F.struct(*order, "role", "text", "segment", "span")))
    whole = marked.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform("turns", lambda x, i: F.struct(i.alias("turn"), x["span"]["begin"].alias("begin"), x["span"]["end"].alias("end")))
    return whole.select(
        "conv_id", F.array_join(F.transform("turns", lambda x: x["segment"]), "").alias("formatted"),
        F.filter(spans, lambda x: x["begin"].isNotNull()).alias("mask"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, text>>, loss array<string>: parsed from the output alone."""
    segments = F.split("formatted", END)
    parsed = rendered.withColumn("segments", F.slice(segments, 1, F.size(segments) - 1))
    # A role's colon is escaped, so the first bare one ends it.
    role = lambda s: unescape(F.regexp_extract(s, r"(?s)\A### ((?:[^\\:]++|\\.)*+): ", 1))
    text = lambda s: unescape(F.regexp_replace(s, r"(?s)\A### (?:[^\\:]++|\\.)*+: ", ""))
    turns = F.transform("segments", lambda s: F.struct(role(s).alias("role"), text(s).alias("text")))
    loss = F.transform("mask", lambda m: unescape(F.substring(F.element_at("segments", m["turn"] + 1), m["begin"] + 1, m["end"] - m["begin"])))
    return parsed.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    messages = fold(as_log(rows.unionByName(own))).select("conv_id", F.col("message.turn").alias("turn"), "role", "text")
    back = read_back(render(messages, ["turn"]))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/') AS t,
             replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</', '<\/'), ':', '\:') AS r FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(length(r) + length(t) + 14) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
