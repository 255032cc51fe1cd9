"""Chat formatting from an event log.

A log row is (conv_id, seq, kind, message_id, role, text). Kinds:

* ``message`` opens a message with a role and a first text,
* ``delta`` appends to the message,
* ``edit`` replaces its text,
* ``regenerate`` empties it, and drops every message of the conversation opened between this
  message and the regenerate event (the conversation goes on from here).

A message's text is its last ``message``, ``edit`` or ``regenerate`` text followed by the deltas
after that. A message that is never opened takes the first role among its events. Messages stand
in the order of their first event. Events with equal seq count in the order kind, role, text, so
repeated rows of a delta append twice. Null roles, kinds and texts count as empty text (a null
kind as ``message``); null conversation ids form one conversation.

Rendering is per message, so a conversation of any length is rendered in parallel; the formatted
conversation is the concatenation of its pieces in order. Control strings in texts and roles are
escaped by one backslash between ``<`` and ``|`` (backslashes already there are kept), which is
undone by taking one away; line ends and backslashes in roles are escaped too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, position, role, text) of an event log; position is its first seq.

    Deltas are gathered per message, never per conversation; dropping needs only a running
    maximum over the messages of a conversation.
    """
    kind = F.coalesce("kind", F.lit("message"))
    e = log.select("conv_id", "seq", "message_id", kind.alias("kind"),
                   F.coalesce("role", F.lit("")).alias("role"),
                   F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind") != "delta"
    m = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("position"),
        F.coalesce(F.min_by("role", F.when(F.col("kind") == "message", F.struct("seq", "role"))),
                   F.min_by("role", F.struct("seq", "role"))).alias("role"),
        F.max(F.when(resets, F.struct("seq", "kind", "role", "text"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.sort_array(F.collect_list(F.when(~resets, F.struct("seq", "text")))).alias("deltas"))
    kept = F.filter("deltas", lambda d: F.col("reset").isNull() | (d["seq"] >= F.col("reset.seq")))
    text = F.concat(F.coalesce("reset.text", F.lit("")),
                    F.array_join(F.transform(kept, lambda d: d["text"]), ""))
    before = W.partitionBy("conv_id").orderBy("position", "message_id").rowsBetween(
        W.unboundedPreceding, -1)
    return (m.select("conv_id", "message_id", "position", "role", "again", text.alias("text"))
            .withColumn("cut", F.max("again").over(before))
            .filter(F.col("cut").isNull() | (F.col("cut") < F.col("position")))
            .select("conv_id", "message_id", "position", "role", "text"))


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _escaped_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return _escaped(role)


def render(messages: DataFrame) -> DataFrame:
    """``messages`` with ``piece`` and the loss mask's span in it (code points; length 0: none)."""
    head = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"))
    body = _escaped(F.col("text"))
    return messages.select(
        "conv_id", "position", "message_id", F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.char_length(head).cast("long").alias("loss_start"),
        F.when(F.col("role") == TRAINED_ROLE, F.char_length(body)).otherwise(0).cast("long")
        .alias("loss_length"))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    role = unescape(role)
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", role)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) turns of formatted text; raises if it is anything else."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def digest(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from the rendered pieces.

    Pieces are sorted by conversation and streamed, so a task holds one piece and two hash states
    however long a conversation is.
    """
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
             "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def closed():
            return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
                kinds.values())], names=list(kinds))

        for b in batches:
            rows = []
            for cid, piece, start, length in zip(*(b.column(c).to_pylist() for c in (
                    "conv_id", "piece", "loss_start", "loss_length")), strict=True):
                if (cid,) != now:
                    if state:
                        rows.append(closed())
                    now, state = (cid,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learnt = unescape(piece[start:start + length])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(piece)
            yield batch(rows)
        if state:
            yield batch([closed()])

    return (pieces.withColumn("conv_id", F.col("conv_id").cast("long")).repartition("conv_id")
            .sortWithinPartitions("conv_id", "position", "message_id")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                             "loss_sha256 string, formatted_chars long"))


def log_of_turns(turns: DataFrame) -> DataFrame:
    """An event log of whole turns (conv_id, turn, role, text): a message opened with the first
    half of each text and a delta with the rest. Turns with equal numbers are kept apart."""
    numbered = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = numbered.withColumn("n", F.row_number().over(order).cast("long"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    events = F.array(
        F.struct((F.col("n") * 2).alias("seq"), F.lit("message").alias("kind"), F.col("role"),
                 F.substring(F.col("text"), F.lit(1), half).alias("text")),
        F.struct((F.col("n") * 2 + 1).alias("seq"), F.lit("delta").alias("kind"),
                 F.lit(None).cast("string").alias("role"),
                 F.substring(F.col("text"), half + 1, F.char_length("text")).alias("text")))
    return n.select("conv_id", F.col("n").alias("message_id"), F.explode(events).alias("e")).select(
        "conv_id", "e.seq", "e.kind", "message_id", "e.role", "e.text")
