"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence; folding
it gives the final messages, which are rendered by a template. Events:

* ``message`` opens a message of a turn (a second one of the same turn is a
  message of its own). If the log has a column ``message``, events of one turn
  belong to the message that it names; else, to the turn's latest;
* ``delta`` appends to the turn's latest message, opening one if there is none;
* ``edit`` replaces the text of the turn's latest message;
* ``regenerate`` clears the turn's latest message for the deltas that follow;
* ``delete`` removes the turn's latest message.

Messages are rendered by turn, within a turn in the order they were opened.
A partition is read in order, in batches of a bounded size, and one conversation
is held at a time, so memory is that of the longest conversation, which has to
fit in a row anyway.

The template marks each turn, and strings that could be taken for marks inside
texts and roles are escaped, reversibly. ``loss_spans`` has the code points of
the assistant's texts in the rendered string.

Null texts and roles are empty; null events are ``message``; null sequences and
turns come first; rows without a conversation id form one conversation; ties
are ordered by turn, role and text, repeated rows are events of their own. Other
columns of any name are not read. Empty logs give no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of chat templates in use.
CONTROLS = [START, END, "<|endoftext|>", "<|im_sep|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_ESCAPE = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS)]))
_CODE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {"\\\\": "\\", "\\l": "<", "\\b": "[", "\\n": "\n"}
SLICE_BYTES = 2 << 20
_UNESCAPE = re.compile(r"\\[\\lbn]")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _CODE[m[0]], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[0]], text)


def fold(events: list[tuple]) -> list[tuple[str, str]]:
    """events in order: turn, kind, role, text and, if messages are named, the
    name. Gives role and text by turn."""
    messages: list[list] = []  # turn, role, parts
    latest: dict[tuple, list[int]] = {}
    for turn, kind, role, text, *name in events:
        own = latest.setdefault((turn, *name), [])
        if kind in (None, "message") or not own and kind != "delete":
            messages.append([turn, role or "", [text or ""]])
            own.append(len(messages) - 1)
        elif own:
            message = messages[own[-1]]
            if kind == "delta":
                message[2].append(text or "")
            elif kind == "edit":
                message[2] = [text or ""]
            elif kind == "regenerate":
                message[2] = [text or ""]
            elif kind == "delete":
                messages[own.pop()][2] = None
            else:
                raise ValueError(f"unknown event: {kind}")
    kept = [m for m in messages if m[2] is not None]
    kept.sort(key=lambda m: (m[0] is not None, m[0] or 0))
    return [(role, "".join(parts)) for _, role, parts in kept]


def render(messages: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        parts += [head, body, END, "\n"]
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a rendered string."""
    found = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.partition("\n")
        found.append((unescape(head), unescape(body[: body.rindex(END)])))
    return found


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """events: conv_id, seq, turn, role, text and, if there, event and message
    (a number). Gives ``(conv_id, formatted, loss_spans)``, a row for each
    conversation."""
    small_batches(events.sparkSession)
    kind = F.col("event").cast("string") if "event" in events.columns else F.lit(None).cast("string")
    name = F.col("message").cast("long") if "message" in events.columns else F.lit(None).cast("long")
    log = events.select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), kind.alias("event"), name.alias("message"))
    id_type = log.schema["conv_id"].dataType.simpleString()

    def run(batches):
        own, log_of, some, id_type = None, [], False, None
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def emit(done):
            rendered = [render(fold(x), loss_role) for _, x in done]
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in done], id_type), pa.array([t for t, _ in rendered], pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for _, s in rendered], span)],
                ["conv_id", "formatted", "loss_spans"],
            )

        for batch in slices(batches, "text", SLICE_BYTES):
            id_type = batch.schema.field("conv_id").type
            done = []
            for key, *event in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "event", "role", "text", "message"))):
                if some and key != own:
                    done.append((own, log_of))
                    log_of = []
                own, some = key, True
                log_of.append(tuple(event))
            yield emit(done)
        if some:
            yield emit([(own, log_of)])

    ordered = log.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "seq", "turn", "role", "text", "message")
    return ordered.mapInArrow(run, f"conv_id {id_type}, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of what the rendered strings say, from the strings and spans alone."""
    id_type = chats.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, "formatted", SLICE_BYTES):
            out = []
            for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.mapInArrow(run, schema)
