r"""Chat formatting by event-sourced reconstruction (operator 8).

A log holds events ``(conv_id, seq, message, op, role, text)``. Events of one message are folded
in sequence order: ``start`` opens (or reopens) it with a role and a text, ``delta`` appends,
``edit`` replaces the text, ``regenerate`` discards the text written so far (later deltas write it
anew), ``delete`` removes the message until it is started again. Each message folds by itself, so a
conversation of any length spreads over all tasks; the messages are then rendered one segment each
and put in order by a sort that streams.

Template: ``<|role|>\n`` + text + ``<|end|>\n`` for each message. Every control string of this and
of the common templates begins with ``<`` or ``[``; inside roles and texts these two and the escape
sign are written ``\l``, ``\o`` and ``\\`` (and ``|`` in a role ``\p``), so no control string can occur
there and the text reads back exactly. The loss mask of a segment is the span of an assistant's text.

Defined cases: null text and null role are empty; a null conversation id is a conversation of its
own; a null sequence number sorts first; events with equal numbers apply in order of op, role and
text; messages that end deleted are left out, empty ones stay; an empty log gives no segments; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ESCAPED = re.compile(r"\\(.)", re.S)
_SEGMENT = re.compile(r"<\|([^<|]*)\|>\n([^<]*)<\|end\|>\n")
_PLAIN = {"\\": "\\", "l": "<", "o": "[", "p": "|"}


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\o"))


def unescape(s: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], s)


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message, seq, role, text)`` of a log; ``seq`` is where the message first appeared."""
    event = F.struct(F.col("seq"), F.col("op"), F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
    def last(*ops):  # position of the last such event, -1 without one
        return F.coalesce(F.array_max(F.transform("events", lambda e, i: F.when(e["op"].isin(*ops), i))), F.lit(-1))

    folded = (log.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("events"))
              .select("conv_id", "message", "events", last("start").alias("opened"), last("delete").alias("deleted"),
                      last("start", "edit", "regenerate", "delete").alias("reset")))
    kept = F.filter(F.slice("events", F.col("reset") + 1, F.size("events")), lambda e: e["op"].isin("start", "edit", "delta"))
    return folded.where("opened > deleted").select(
        "conv_id", "message", F.col("events")[0]["seq"].alias("seq"), F.col("events")[F.col("opened")]["role"].alias("role"),
        F.concat_ws("", F.transform(kept, lambda e: e["text"])).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One formatted segment a message, with its loss mask (code points within the segment; length 0: none)."""
    role, text = F.replace(escape(F.col("role")), F.lit("|"), F.lit("\\p")), escape(F.col("text"))
    head = F.concat(F.lit("<|"), role, F.lit("|>\n"))
    teaches = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "seq", "message", F.concat(head, text, F.lit("<|end|>\n")).alias("segment"),
        F.when(teaches, F.length(head)).otherwise(0).alias("mask_start"),
        F.when(teaches, F.length(text)).otherwise(0).alias("mask_length"))


def format_chats(log: DataFrame) -> DataFrame:
    """Segments of all conversations, ``(conv_id, seq, message, segment, mask_start, mask_length)``.

    A conversation's formatted text is its segments in order of ``(seq, message)``; nothing holds a
    whole conversation in memory.
    """
    return render(fold_events(log))


def in_order(segments: DataFrame) -> DataFrame:
    """Segments clustered by conversation and sorted, ready for a streaming reader."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a table with one row a turn: each row starts one message, ``seq`` is the turn.

    Rows that repeat a turn number are messages of their own, in order of role and text.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return turns.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(w)).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"),
        F.struct(F.col("turn").cast("long").alias("turn"), "n").alias("message"),
        F.lit("start").alias("op"), "role", "text")


class _Digest:
    """What is read back from one conversation's formatted text, in constant memory."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment, start, length):
        at = 0
        for m in _SEGMENT.finditer(segment):
            if m.start() != at:
                raise ValueError("formatted text does not parse")
            at = m.end()
            self.turns += 1
            self.all.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        if at != len(segment):
            raise ValueError("formatted text does not parse")
        self.chars += len(segment)
        if length:
            text = unescape(segment[start:start + length])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self):
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


def _read_back(batches):
    now, rows = None, []
    for b in batches:
        for conv, *segment in zip(*(b.column(c).to_pylist() for c in ("conv_id", "segment", "mask_start", "mask_length"))):
            if now is None or conv != now.conv:
                if now is not None:
                    rows.append(now.row())
                now = _Digest(conv)
            now.add(*segment)
        if len(rows) >= 1000:
            yield _as_batch(rows)
            rows = []
    if now is not None:
        rows.append(now.row())
    yield _as_batch(rows)


def _as_batch(rows):
    names = [x.split()[0] for x in READ_BACK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, _TYPES)], names)


def read_back(segments: DataFrame) -> DataFrame:
    """Parse the formatted texts again: turns, digest of roles and texts, and the text under the loss mask."""
    return in_order(segments).select("conv_id", "segment", "mask_start", "mask_length").mapInArrow(_read_back, READ_BACK)
