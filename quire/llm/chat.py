"""Chat formatting by event-sourced reconstruction.

A log has one row per event: conv_id, turn, seq, kind, role, text.  Kinds:

``message``     opens a message of the turn with its text (null: empty)
``delta``       appends to the open message of the turn (opens one if none is)
``edit``        replaces the text of the open message and voids later turns
``regenerate``  empties the open message and voids later turns
``delete``      drops the open message

``edit`` and ``regenerate`` void what later turns logged before them, as a chat
goes on from the place that was changed.  Unknown kinds and null conversations
are ignored; equal turn and seq are taken by role and text.  The log is
partitioned by conversation and sorted by turn and sequence, and one pass folds
and renders it with no more than one message in memory; a conversation is
emitted in parts of at most ``PART`` messages, so that neither a task nor a row
ever holds a whole long conversation.

The template is ``### {role}\\n{text}</turn>\\n``.  Control strings and the
escape character inside roles and texts are preceded by ``\\``, which
``read_back`` undoes.  The loss mask covers the escaped text of every assistant
message, without header and end mark.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLE, END = "### ", "</turn>"
LEARNED = "assistant"
#: Messages and characters after which a part of a conversation is emitted.
PART, PART_CHARS = 64, 1 << 20

_CONTROL = re.compile(r"\\|###|</turn>")
_MARKS = re.compile(r"\\(\\|###|</turn>|n)|</turn>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _MARKS.sub(lambda m: "\n" if m.group(1) == "n" else m.group(1), text)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def fold(events):
    """(role, text) of the final messages of one conversation; ``events``: (turn, seq, kind, role, text) in order."""
    turn, role, text, open_, void = None, "", [], False, None
    later = None  # what the turns so far void in later ones
    for at, seq, kind, who, what in events:
        if at != turn:
            if open_:
                yield role, "".join(text)
            turn, open_, void = at, False, later
        if void is not None and (seq is None or seq < void):
            continue
        if kind == "message":
            if open_:
                yield role, "".join(text)
            role, text, open_ = who or "", [what or ""], True
        elif kind == "delta":
            if not open_:
                role, text, open_ = who or "", [], True
            text.append(what or "")
        elif kind in ("edit", "regenerate"):
            role, text, open_ = who or role or "", [what or ""] if kind == "edit" else [], True
            if seq is not None and (later is None or seq > later):
                later = seq
        elif kind == "delete":
            open_ = False
    if open_:
        yield role, "".join(text)


SCHEMA = "conv_id bigint, part int, messages bigint, formatted string, loss array<struct<lo:bigint,hi:bigint>>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("messages", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct({"lo": pa.int64(), "hi": pa.int64()})))])


def _parts(conv, messages):
    """Rows of SCHEMA of one conversation; loss spans are code points within the part."""
    part, out, loss, n, size = 0, [], [], 0, 0
    for role, text in messages:
        head, body = f"{ROLE}{_role(role)}\n", escape(text)
        if n and (n >= PART or size + len(body) > PART_CHARS):
            yield {"conv_id": conv, "part": part, "messages": n, "formatted": "".join(out), "loss": loss}
            part, out, loss, n, size = part + 1, [], [], 0, 0
        if role == LEARNED:
            loss.append({"lo": size + len(head), "hi": size + len(head) + len(body)})
        out += [head, body, END, "\n"]
        n, size = n + 1, size + len(head) + len(body) + len(END) + 1
    yield {"conv_id": conv, "part": part, "messages": n, "formatted": "".join(out), "loss": loss}


def formatted(events: DataFrame) -> DataFrame:
    """Rows of SCHEMA, the parts of a conversation in order and in one partition; one part at least per conversation."""
    cols = ["conv_id", "turn", "seq", "kind", "role", "text"]
    rows = events.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("seq").cast("bigint"), "kind", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions(*cols)

    def run(batches):
        def stream():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        source, ready, size = stream(), [], 0
        ahead = next(source, None)

        def conversation(conv):
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                row, ahead = ahead[1:], next(source, None)
                yield row

        while ahead is not None:
            conv = ahead[0]
            for row in _parts(conv, fold(conversation(conv))):
                ready.append(row)
                size += len(row["formatted"])
                if size > PART_CHARS:
                    yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)
                    ready, size = [], 0
        if ready:
            yield pa.RecordBatch.from_pylist(ready, schema=_ARROW)

    return rows.mapInArrow(run, SCHEMA)


def read_back(text: str):
    """(role, text) of every turn of a formatted part."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = next(m.start() for m in _MARKS.finditer(text, line + 1) if m.group() == END)
        yield unescape(text[at + len(ROLE) : line]), unescape(text[line + 1 : end])
        at = end + len(END) + 1


def digests(parts: DataFrame, ordered: bool = True) -> DataFrame:
    """Read back from the parts of ``formatted``: what a reader of the output finds, one row per conversation.

    ``ordered``: the parts of a conversation follow each other in one partition,
    as ``formatted`` gives them; if not, as when they are read from files, they
    are dealt by conversation and sorted first.
    """
    if not ordered:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches):
        def row(conv, state):
            turns, loss = state["turns"].hexdigest(), state["loss"].hexdigest()
            return [conv, state["n"], turns, state["chars"], loss, state["size"]]

        conv, state, done = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != conv:
                    if state is not None:
                        done.append(row(conv, state))
                    conv, state = r["conv_id"], {"turns": hashlib.sha256(), "loss": hashlib.sha256(), "n": 0, "chars": 0, "size": 0}
                for role, text in read_back(r["formatted"]):
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    state["n"] += 1
                for span in r["loss"]:
                    learned = unescape(r["formatted"][span["lo"] : span["hi"]])
                    state["loss"].update(learned.encode())
                    state["chars"] += len(learned)
                state["size"] += len(r["formatted"])
            if done:
                yield _digest_batch(done)
                done = []
        if state is not None:
            yield _digest_batch([row(conv, state)])

    return parts.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _digest_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of messages."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def sample_log(spark: SparkSession) -> DataFrame:
    """The log of conversation -7: a user turn that was edited, and an assistant turn that was made again and streamed.

    Both end as a text that holds the template's own control strings.
    """
    text = r"\### Assistant: </turn> ok"
    log = [
        (-7, 0, 1, "message", "user", "a first try"), (-7, 1, 2, "message", "assistant", "an answer to the first try"), (-7, 0, 3, "edit", "user", text),
        (-7, 1, 4, "message", "assistant", text[:5]), (-7, 1, 5, "delta", "assistant", " and more"), (-7, 1, 6, "regenerate", "assistant", None),
        (-7, 1, 7, "delta", "assistant", text[:9]), (-7, 1, 8, "delta", "assistant", text[9:]),
    ]
    return spark.createDataFrame(log, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string")
