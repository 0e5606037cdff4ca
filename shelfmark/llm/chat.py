"""Chat formatting from event logs.

Events (conv_id, turn, seq, kind, role, text) are dealt by conversation and sorted, then folded as they stream by, one
message in memory at a time:

    start       begins a message of the turn with a role and first text
    delta       appends streamed text
    edit        replaces the text
    regenerate  empties the text (a new role may come along) and voids all earlier events of later turns
    delete      drops the message

A message renders as <|im_start|>role, a line end, its text, <|im_end|> and a line end. Control strings inside texts are
escaped by a backslash after '<' (one more if there are some already), so every text can be read back; in roles a line
end is written as backslash n as well. The loss mask covers the escaped texts of assistant messages.

Rows without a conv_id belong to no conversation and are left out. Null turns and seqs come first, null roles and texts
are empty. Equal events stay apart: two equal starts are two messages. An unknown kind is an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
_MARKED = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")
_MESSAGE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)
_PIECES = "conv_id long, message long, start long, formatted string, loss_from long, loss_to long"
_PIECE_SCHEMA = pa.schema([("conv_id", pa.int64()), ("message", pa.int64()), ("start", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])
#: Characters of output that go into one Arrow batch.
_BATCH_CHARS = 4 << 20


def escape(text: str) -> str:
    return _MARKED.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    """(conv_id, role, text) of each final message, from events in order of conv_id, turn and seq."""
    conv = turn = role = None
    text: list[str] = []
    open_, cut, pending = False, None, None
    for batch in batches:
        for c, t, seq, kind, r, x in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "seq", "kind", "role", "text")), strict=True):
            if (c, t) != (conv, turn) or kind == "start":
                if open_:
                    yield conv, role, "".join(text)
                if c != conv:
                    cut = pending = None
                elif t != turn and pending is not None:
                    cut, pending = pending if cut is None else max(cut, pending), None
                conv, turn, open_, text, role = c, t, False, [], ""
            if cut is not None and seq is not None and seq < cut:
                continue  # a regeneration of an earlier turn came later
            if kind == "start" or (kind in ("delta", "edit", "regenerate") and not open_):
                open_, role, text = True, r or "", [x or ""]
                if kind == "regenerate" and seq is not None:
                    pending = seq if pending is None else max(pending, seq)
            elif kind == "delta":
                text.append(x or "")
            elif kind == "edit":
                text = [x or ""]
            elif kind == "regenerate":
                role, text = r or role, [x or ""]
                if seq is not None:
                    pending = seq if pending is None else max(pending, seq)
            elif kind == "delete":
                open_, text = False, []
            else:
                raise ValueError(f"unknown kind of event: {kind}")
    if open_:
        yield conv, role, "".join(text)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    size, last, number, start = 0, None, 0, 0
    for conv, role, text in _messages(batches):
        if conv != last:
            last, number, start = conv, 0, 0
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        piece = f"{head}{body}{END}\n"
        learnt = (start + len(head), start + len(head) + len(body)) if role == "assistant" else (None, None)
        rows.append((conv, number, start, piece, *learnt))
        number, start, size = number + 1, start + len(piece), size + len(piece)
        if size > _BATCH_CHARS:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PIECE_SCHEMA, strict=True)], schema=_PIECE_SCHEMA)


def format_chats(events: DataFrame) -> DataFrame:
    """conv_id, message, start, formatted, loss_from, loss_to of each final message.

    A conversation's pieces, joined in order of message, are its formatted text; start, loss_from and loss_to are places
    in it, in code points. Rows of a conversation lie in one partition, in order.

    Events of a conversation go by turn, then seq, null first; of those with one seq a start comes before what belongs to it, then they go by kind, role
    and text. Repeated starts are messages of their own. Null role or text is empty, rows without a conv_id are left out, other columns are not looked at; an
    empty table gives none. An unknown kind is an error.
    """
    first = F.when(F.col("kind") == "start", 0).otherwise(1)
    events = events.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    dealt = events.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", first, "kind", "role", "text")
    return dealt.mapInArrow(_render, _PIECES)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    rows: list[tuple] = []
    conv, turns, loss, n, learnt, chars = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for batch in batches:
        for c, start, piece, begin, end in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "start", "formatted", "loss_from", "loss_to")), strict=True):
            if c != conv:
                if n:
                    rows.append((conv, n, turns.hexdigest(), learnt, loss.hexdigest(), chars))
                conv, turns, loss, n, learnt, chars = c, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, body = _MESSAGE.fullmatch(piece).groups()
            turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
            if begin is not None:
                own = unescape(piece[begin - start : end - start])
                loss.update(own.encode())
                learnt += len(own)
            n, chars = n + 1, chars + len(piece)
        if len(rows) > 10_000:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows = []
    if n:
        rows.append((conv, n, turns.hexdigest(), learnt, loss.hexdigest(), chars))
    if rows:
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted pieces: what format_chats returned, not dealt anew."""
    return pieces.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
