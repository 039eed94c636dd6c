"""Chat formatting by event-sourced reconstruction.

The input is a log of events. Each names its conversation, its sequence number, the message
it belongs to, and a kind: ``delta`` appends text to the message, ``edit`` replaces what the
message says so far, ``regenerate`` empties it for the deltas that follow, ``delete`` removes
it until an event gives it text again. Folding the events of a message in sequence order
gives its final text; final messages, in order, are rendered with a loss mask.

A conversation of any size is handled in blocks of messages, each rendered in its own task.
What needs the whole conversation (digests over its text) is streamed over its rendered
blocks, never gathered.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
#: Messages in a block.
BLOCK = 256

_TURN = re.compile(r"<turn>((?:[^\\<]|\\.)*)<text>((?:[^\\<]|\\.)*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Control strings start with ``<``: a backslash before it, and before backslashes, keeps
    texts from ever forming one. :func:`unescape` undoes it."""
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text and its loss mask: (start, end) of each assistant text, in code points."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{BODY}", escape(text)
        out += [head, body, CLOSE]
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


def read_back(formatted: str, mask: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns and the texts under the mask, from the formatted text alone."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns, [unescape(formatted[a:b]) for a, b in mask]


def _fold(items, step):
    """Fold a sorted array of structs into the state of a message."""
    start = F.struct(F.lit(False).alias("wiped"), F.lit(False).alias("alive"), F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    return F.aggregate(items, start, step)


def _event(a, e):
    wipes = e["kind"].isin("edit", "regenerate", "delete")
    return F.struct(
        (a["wiped"] | wipes).alias("wiped"),
        (e["kind"] != "delete").alias("alive"),
        F.coalesce(e["role"], a["role"]).alias("role"),
        F.when(e["kind"].isin("regenerate", "delete"), F.lit("")).when(e["kind"] == "edit", e["text"]).otherwise(F.concat(a["text"], e["text"])).alias("text"),
    )


def _join(a, b):
    s = b["state"]
    return F.struct((a["wiped"] | s["wiped"]).alias("wiped"), s["alive"].alias("alive"), F.coalesce(s["role"], a["role"]).alias("role"), F.when(s["wiped"], s["text"]).otherwise(F.concat(a["text"], s["text"])).alias("text"))


def fold_events(log: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, place, role, text, from (conv_id, seq, message, kind,
    role, text).

    Events of a message are folded in sequence order (ties by kind, then text). The fold is
    associative, so a message of any number of events is folded in stretches of the sequence
    first, then over the stretches. ``place`` is the first event's sequence number; the role
    is the last one named; a message whose last event is a deletion is gone.
    """
    whole = _fold_stretches(_stretches(log)).groupBy("conv_id", "message").agg(F.min("place").alias("place"), _fold(F.sort_array(F.collect_list(F.struct("step", "state"))), _join).alias("state"))
    return _alive(whole, "message")


def _stretches(log: DataFrame) -> DataFrame:
    """Events with their stretch of the sequence, ``step``, of as many numbers as a block has."""
    seq = F.coalesce(F.col("seq"), F.lit(-1)).cast("long")
    log = log.select("conv_id", "message", seq.alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role")
    return log.withColumn("step", F.floor(F.col("seq") / BLOCK))


def _fold_stretches(log: DataFrame) -> DataFrame:
    item = F.struct("seq", "kind", "text", "role")
    return log.groupBy("conv_id", "message", "step").agg(F.min("seq").alias("place"), _fold(F.sort_array(F.collect_list(item)), _event).alias("state"))


def _alive(folded: DataFrame, *more: str) -> DataFrame:
    return folded.filter("state.alive").select("conv_id", *more, "place", F.coalesce("state.role", F.lit("")).alias("role"), "state.text")


def to_events(conversations: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """A table of finished turns as a log: each row is a message of one delta, in the order of
    turns (null turns first). Message ids only keep rows apart."""
    return conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("seq"), F.monotonically_increasing_id().alias("message"), F.lit("delta").alias("kind"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))


#: Sequence numbers that a turn of :func:`edited_log` has to itself; a block is a multiple of it.
NUMBERS = 8


def edited_log(conversations: DataFrame, *, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Finished turns as the log of a chat that was streamed, regenerated and edited on the way.

    A turn is a message of five events: a delta with the first half of the text as a draft, which
    names the role; a regeneration, which drops it; a delta with the first third of a new one; an
    edit, which replaces that by the first half; and a delta with the rest. Every fourth turn of a
    conversation also has a message that is streamed and then deleted. So the fold gives the turns
    back. Null turns count as -1, as in :func:`to_events`; message ids only keep rows apart.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    n = F.length(t)
    half, third = F.floor(n / 2).cast("int"), F.floor(n / 3).cast("int")
    at = F.coalesce(F.col(turn).cast("long"), F.lit(-1)) * NUMBERS
    none = F.lit(None).cast("string")

    def event(ghost, k, kind, said, who=none):
        return F.struct(F.lit(ghost).alias("ghost"), (at + k).alias("seq"), F.lit(kind).alias("kind"), who.alias("role"), said.alias("text"))

    who = F.col(role).cast("string")
    told = [event(0, 0, "delta", F.substring(t, F.lit(1), half), who), event(0, 1, "regenerate", none), event(0, 2, "delta", F.substring(t, F.lit(1), third)), event(0, 3, "edit", F.substring(t, F.lit(1), half)), event(0, 4, "delta", F.substring(t, half + 1, n))]
    gone = [event(1, 5, "delta", F.substring(t, F.lit(1), third), who), event(1, 6, "delete", none)]
    events = F.when(F.coalesce(F.col(turn) % 4 == 0, F.lit(False)), F.array(*told, *gone)).otherwise(F.array(*told))
    d = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.monotonically_increasing_id().alias("row"), events.alias("events"))
    d = d.select("conv_id", "row", F.explode("events").alias("e"))
    return d.select("conv_id", "e.seq", (F.col("row") * 2 + F.col("e.ghost")).alias("message"), "e.kind", "e.role", "e.text")


_BLOCKS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("block", T.LongType()), T.StructField("chunk", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("mask", T.ArrayType(T.LongType()))]
)
_DIGEST = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])


def _render_sorted(batches):
    """Rows come sorted by (conv_id, block, place): a formatted row per block, or more
    (chunks) where a block has more messages than usual."""
    schema, key, turns, n, chunk = to_arrow_schema(_BLOCKS), None, [], 0, 0
    out: list = []

    def close():
        text, mask = render(turns)
        return (*key, chunk, len(turns), text, [x for pair in mask for x in pair])

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    for batch in batches:
        for c, b, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if key is not None and (key != (c, b) or len(turns) >= BLOCK):
                out.append(close())
                n += len(out[-1][4])
                turns, chunk = [], chunk + 1 if key == (c, b) else 0
                if len(out) >= 1024 or n > 4 << 20:
                    yield batch_of(out)
                    out, n = [], 0
            key = (c, b)
            turns.append((role, text))
    if key is not None:
        out.append(close())
    if out:
        yield batch_of(out)


def _digest_sorted(batches):
    """Rows come sorted by (conv_id, block): digests of what the formatted text reads back as."""
    schema, out, key, state = to_arrow_schema(_DIGEST), [], None, None

    def close():
        return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    for batch in batches:
        for c, n, text, mask in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
            if key != (c,):
                if key is not None:
                    out.append(close())
                key, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns, loss = read_back(text, list(zip(mask[::2], mask[1::2])))
            state[0] += len(turns)
            for role, t in turns:
                state[1].update(f"{role}\n{t}\n".encode("utf-8", "surrogatepass"))
            for t in loss:
                state[2] += len(t)
                state[3].update(t.encode("utf-8", "surrogatepass"))
            state[4] += len(text)
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
            out = []
    if key is not None:
        out.append(close())
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)


def format_chats(log: DataFrame) -> DataFrame:
    """Formatted blocks of all conversations in an event log: conv_id, block, chunk, n_turns,
    formatted, mask (starts and ends, in turn, of the assistant texts, in code points of
    ``formatted``). A conversation's formatted text is its blocks and chunks, end to end.

    Messages are ordered by place, ties by role, then text. Null texts and roles are empty; a
    null conversation is one of its own; events without a sequence number come first; other
    columns are ignored; no events give no rows.
    """
    events = _stretches(log)
    ends = events.groupBy("conv_id", "message").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    if ends.filter("first <> last").limit(1).count():
        final = fold_events(log).withColumn("block", F.floor(F.col("place") / BLOCK)).repartition("conv_id", "block")
    else:  # every message lies in one stretch, which is its block: one shuffle serves the fold and the rendering
        folded = _fold_stretches(events.repartition("conv_id", "step"))
        final = _alive(folded, "step").withColumnRenamed("step", "block")
    rows = final.sortWithinPartitions("conv_id", "block", "place", "role", "text").select("conv_id", "block", "role", "text")
    return rows.mapInArrow(_render_sorted, _BLOCKS)


def digests(blocks: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted blocks: n_turns, turns_sha256 (role,
    line feed, text, line feed per turn), loss_chars, loss_sha256 (all text under the mask),
    formatted_chars. Blocks stream through the digests in order; none is kept."""
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block", "chunk").mapInArrow(_digest_sorted, _DIGEST)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold escapes and control strings."""
    hard = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
