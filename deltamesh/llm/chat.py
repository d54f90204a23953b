"""Chat formatting from an event log.

The log is partitioned by message within its conversation, sorted by sequence number and folded:
`delta` events add to the message, `edit` replaces it, `regenerate` throws away what was streamed
so far. A conversation of any length is thus folded by many tasks. Every message is rendered on its
own by a template that marks turns, escapes control strings reversibly and says which characters
the loss covers. Reading back walks each conversation's rendered messages in order, parses them and
takes digests as it goes, so that a task never holds more than one batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: "### role: text </turn>\n". A backslash goes before each of these in roles and texts.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
_SPECIAL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.DOTALL)
LOSS_ROLES = ("assistant",)
PIECE = 64  # characters of the deltas that a stored text is streamed in


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's string, and the span of it under the loss mask (empty where the role isn't learned)."""
    head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
    start = len(head)
    return head + body + CLOSE, start, start + len(body) if role in LOSS_ROLES else start


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string; anything else in it is an error."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def events_of(rows: DataFrame) -> DataFrame:
    """An event log (conv_id, message, seq, kind, role, text) that streams stored rows (conv_id, place, role, text).

    Each row opens a message, streams a draft that a regeneration drops, then its text in two
    deltas, so that folding has all kinds of events to undo.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    step = lambda seq, kind, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    told = F.array(
        step(0, "delta", F.substring("text", 1, PIECE)),
        step(1, "regenerate", F.lit("")),
        step(2, "delta", F.expr("substring(text, 1, int(floor(length(text) / 2)))")),
        step(3, "delta", F.substring(F.col("text"), half + 1, F.length("text"))),
    )
    return rows.withColumn("e", F.explode(told)).select("conv_id", "place", F.col("e.seq").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, place, role, text) of a log (conv_id, place, seq, kind, role, text).

    place: any orderable key of the message in its conversation. Kinds other than delta, edit and
    regenerate are an error. The log is shuffled once, by message.
    """
    place = events.schema["place"].dataType
    names = ["conv_id", "place", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            conv, at, kind, role, text = (batch.column(c).to_pylist() for c in ("conv_id", "place", "kind", "role", "text"))
            out: list[tuple] = []
            for c, p, k, r, t in zip(conv, at, kind, role, text, strict=True):
                new = (c, repr(p))
                if new != key:
                    if key is not None:
                        out.append((*message, "".join(parts)))
                    key, parts = new, []
                message = (c, p, r)
                if k == "delta":
                    parts.append(t or "")
                elif k == "edit":
                    parts = [t or ""]
                elif k == "regenerate":
                    parts = []
                else:
                    raise ValueError(f"unknown event {k}")
            yield of(out, batch.schema)
            schema = batch.schema
        if key is not None:
            yield of([(*message, "".join(parts))], schema)

    def of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(n).type) for i, n in enumerate(names)], names)

    sorted_log = events.repartition("conv_id", "place").sortWithinPartitions("conv_id", "place", "seq")
    return sorted_log.mapInArrow(run, f"conv_id long, place {place.simpleString()}, role string, text string")


def format_messages(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, place, formatted, loss_start, loss_end): each message rendered, with the characters under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            cols = [batch.column("conv_id"), batch.column("place"), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "place", "formatted", "loss_start", "loss_end"])

    place = messages.schema["place"].dataType.simpleString()
    return messages.mapInArrow(run, f"conv_id long, place {place}, formatted string, loss_start long, loss_end long")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what reading its formatted messages back gives: turns, texts and loss mask, as counts and SHA-256."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row(s: list) -> tuple:
            return (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])

        for batch in batches:
            out: list[tuple] = []
            for c, f, a, b in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != c:
                    if state is not None:
                        out.append(row(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(f):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                learned = unescape(f[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode())
                state[5] += len(f)
            yield of(out)
        if state is not None:
            yield of([row(state)])

    def of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation whose texts look like the template itself.
PROBE = (("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok"))


def placed(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, place, role, text) of a table of turns. Null roles and texts are empty; turns
    sort with null first, then by role and text; rows alike in all four are told apart by a running
    number, so each stays a turn of its own."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.struct("turn", "role", F.sha1("text").alias("digest"), F.monotonically_increasing_id().alias("nth"))
    return own.select("conv_id", place.alias("place"), "role", "text")


def format_conversations(conversations: DataFrame, probe: bool = True) -> DataFrame:
    """Rows (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), one per conversation.

    Rows with a null conv_id form one conversation with a null id. An empty table gives only the
    probe. Columns other than conv_id, turn, role and text are not read.
    """
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", "role", "text")
    if probe:
        extra = spark.createDataFrame([(-7, i, r, t) for i, (r, t) in enumerate(PROBE)], "conv_id long, turn long, role string, text string")
        rows = rows.unionByName(extra)
    return digests(format_messages(fold(events_of(placed(rows)))))


#: Turn and loss digests by DuckDB; formatted_chars counts the template's own marks and escapes.
CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role || text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) + 15)::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
