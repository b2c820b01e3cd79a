"""Operator 8: chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.
Nothing is assumed about how it marks turns: the conversation is rendered
for successive prefixes of its turns, and the part by which an output
extends the one before it is the span of the new turn.  Where an output
does not extend the one before, the template rewrites history; such spans
are marked, and the loss mask of that conversation can't be used.

Locating the text inside a span is black-box as well: the turn is rendered
with the text and with a text that differs at its first and last character;
what the outputs share at either end is the template's frame, and between
them the text itself must stand: a template that changes it is marked like
one that rewrites history.  The role is located in the frame; a template
need not print it.

Every turn is rendered behind all turns before it, so a template may look
back as far as it likes, and history that it rewrites is found however old.
All prefixes of a conversation of n turns take n renderings of up to n
turns: the work grows with the square of n.  The prefixes of a conversation
are cut into segments of SEGMENT turns or more, SEGMENTS at most; a segment
goes to a task of its own with the turns up to its end, so one long
conversation spreads over many tasks, and a turn is sent at most SEGMENTS
times.  A task holds the turns and two renderings of one conversation, as
the template itself must.

Texts are escaped before rendering and unescaped after reading, so control
strings in a text cannot close or open a turn.

Defined cases: null roles and texts are empty; turns sort by turn (null
first), then role and text, so ties have a fixed order; rows of a null
conv_id form one conversation; an empty table gives only the built-in
conversation; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimledger.llm.common import materialize, table

SEGMENT, SEGMENTS = 32, 64
Template = Callable[[list[tuple[str, str]]], str]


def escape(text: str) -> str:
    """Reversible: the result holds no ``<|`` and no ``|>``."""
    return re.sub(r"<(?=\|)|\|(?=>)", lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    """As ``escape``, on one line."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: "\n" if m[1] == "n" else m[1], role)


def chatml(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def spans(turns: list[tuple[str, str]], template: Template, skip: int = 0) -> list[dict]:
    """For each turn from ``skip`` on: what it adds to the rendering, the
    text's start and length in that, and whether history was rewritten."""
    out, before = [], template(turns[:skip]) if skip else ""
    for k in range(skip, len(turns)):
        now = template(turns[:k + 1])
        stable = now.startswith(before)
        role, text = turns[k]
        piece = now[len(before):] if stable else ""
        start, length = (0, 0)
        if stable:
            start, length = _inside(turns[:k], role, text, template, len(before), piece)
        out.append({"piece": piece, "text_start": start, "text_length": length, "stable": stable and start >= 0,
                    "role_start": piece[:max(start, 0)].find(role), "role_length": len(role)})
        before = now
    return out


def _inside(head, role, text, template, at, piece) -> tuple[int, int]:
    """Place of the text in its piece, from a second rendering with another
    text: both share the frame before and after the text."""
    probe = chr(ord(text[0]) ^ 1) + "\x01" if text else "\x01"
    other = template([*head, (role, probe)])[at:]
    frame = len(other) - len(probe)
    start = other.find(probe)
    # the frame before the text is what both outputs start with, up to the probe
    if start < 0 or len(piece) != frame + len(text) or piece[:start] != other[:start] \
            or piece[start + len(text):] != other[start + len(probe):] or piece[start:start + len(text)] != text:
        return -1, 0
    return start, len(text)


def segments(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> with seq, their place in the
    conversation, segment and first, the seq at which that starts; a turn is
    there for its segment and all later ones."""
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                             F.coalesce("text", F.lit("")).alias("text"))
    # numbered in two levels, so that no task sorts a whole long conversation: rows within
    # (conversation, range of turns), and the counts of these ranges within the conversation
    c = c.withColumn("__c", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    c = c.withColumn("__range", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62))))
    ranges = c.groupBy("__c", "__range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__c").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("__c", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"),
                           F.sum("n").over(Window.partitionBy("__c")).alias("__turns"))
    order = Window.partitionBy("__c", "__range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    c = c.join(ranges, ["__c", "__range"]).withColumn("seq", F.col("__before") + F.row_number().over(order) - 1)
    size = F.greatest(F.lit(SEGMENT).cast("long"), F.ceil(F.col("__turns") / SEGMENTS))
    own, last = F.floor(F.col("seq") / size), F.floor((F.col("__turns") - 1) / size)
    c = c.withColumn("segment", F.explode(F.sequence(own, last))).withColumn("first", F.col("segment") * size)
    return c.drop("__c", "__range", "__before", "__turns")


SPAN_SCHEMA = ("conv_id long, seq long, role string, piece string, text_start long, text_length long, "
               "role_start long, role_length long, loss boolean, stable boolean")
SPAN_ARROW = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("piece", pa.string()),
                        ("text_start", pa.int64()), ("text_length", pa.int64()), ("role_start", pa.int64()),
                        ("role_length", pa.int64()), ("loss", pa.bool_()),
                        ("stable", pa.bool_())])


def _runs(batches, keys: list[str], columns: list[str]):
    """Rows of sorted batches, grouped by equal ``keys``; one group in memory at a time."""
    group, at = [], None
    for b in batches:
        cols = [b.column(c).to_pylist() for c in columns]
        ks = list(zip(*[b.column(c).to_pylist() for c in keys]))
        for k, row in zip(ks, zip(*cols)):
            if k != at and group:
                yield at, group
                group = []
            at = k
            group.append(row)
    if group:
        yield at, group


def format_conversations(conversations: DataFrame, template: Template = chatml,
                         train_on: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn: the piece that it adds to the conversation's
    formatted text, the place of its (escaped) text in it, whether that is
    under the loss mask, and whether the template left history alone.  The
    formatted text is the pieces in order of seq."""
    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (conv, _), rows in _runs(batches, ["conv_id", "segment"], ["seq", "role", "text", "first"]):
            turns = [(escape_role(r), escape(t)) for _, r, t, _ in rows]
            skip = sum(seq < first for seq, _, _, first in rows)
            for (seq, role, text, _), s in zip(rows[skip:], spans(turns, template, skip)):
                out.append({"conv_id": conv, "seq": seq, "role": role, "loss": role in train_on, **s})
                size += len(text) + 100
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(out, schema=SPAN_ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SPAN_ARROW)

    s = segments(conversations)
    # a segment is the unit of work: prefixes of one long conversation are rendered by many tasks
    return (s.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "seq")
            .mapInArrow(render, SPAN_SCHEMA))


DIGEST_SCHEMA = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                 "formatted_chars long, rewrites_history boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation from the formatted turns; roles and texts
    are read from the rendered pieces (a role that its template doesn't print
    comes from the row).  A digest of a
    whole conversation is one sequential pass by definition: turns stream
    through it in order, nothing of a conversation is kept."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []

        def done():
            n, turns, loss, text, chars, rewritten = state
            return (at[0], n, turns.hexdigest(), loss, text.hexdigest(), chars, rewritten)

        for b in batches:
            for conv, role, piece, start, length, rs, rl, loss, stable in zip(*[b.column(c).to_pylist() for c in (
                    "conv_id", "role", "piece", "text_start", "text_length", "role_start", "role_length", "loss", "stable")]):
                if at != (conv,):
                    if at is not None:
                        out.append(done())
                    at, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                text = unescape(piece[start:start + length])
                role = unescape_role(piece[rs:rs + rl]) if rs >= 0 else role
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss:
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(piece)
                state[5] |= not stable
            if out:
                yield _digests(out)
                out = []
        if at is not None:
            yield _digests([done()])

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
            .mapInArrow(digest, DIGEST_SCHEMA))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                        ("rewrites_history", pa.bool_())])
    return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


#: The conversation that the contract adds: a text made of control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def q_chat(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)],
                                  "conv_id long, turn long, role string, text string")
    return read_back(materialize(format_conversations(c.unionByName(extra))))


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'),
e AS (SELECT *, length(text) + (length(text) - length(replace(text, '\\', '')))
    + len(regexp_extract_all(text, '<\\|')) + len(regexp_extract_all(text, '\\|>')) AS escaped FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + escaped + length('<|im_end|>') + 1)::BIGINT AS formatted_chars,
  false AS rewrites_history
FROM e GROUP BY conv_id"""
