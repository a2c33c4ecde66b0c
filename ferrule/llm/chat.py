"""Chat formatting: conversations rebuilt from an event log, then rendered with a loss mask.

Events: ``message`` starts a message, ``delta`` appends streamed text to the message of its
turn, ``edit`` replaces that message's text, ``regenerate`` replaces it and takes back every
later turn that had been logged before (those answered the text that is gone). The log is
partitioned by conversation and sorted by (turn, sequence) inside the partitions; one pass
then folds and renders it turn by turn. The pass holds one message at a time, never a
conversation, so its memory does not follow the longest conversation.

Rendered form of a turn: ``### role:`` newline, text, ``</turn>`` newline. Inside roles and
texts the escape character, the three control strings and, in roles, colon and newline get
the escape character before them; ``read_turn`` takes that back.

Cases: a null text or role is empty; rows without conv_id form one conversation of their
own with id null; events that name a turn without a message start one; repeated
``message`` rows are turns of their own; equal (turn, seq) are ordered by event, role and
text. Empty logs give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

ESC, OPEN, MIDDLE, CLOSE = "\\", "### ", ":\n", "</turn>\n"
#: Strings that may not stand in a text as they are.
CONTROL = ("### ", "</turn>")
_ROLE_END = re.compile(r"[\\:\n]")
_UNESCAPE, PIECE = re.compile(r"\\(.)", re.S), 1 << 20
RENDERED = ("conv_id long, turn_index long, role string, rendered string, loss_start int, loss_length int")


def escape(text: str) -> str:
    text = text.replace(ESC, ESC + ESC)
    for c in CONTROL:
        text = text.replace(c, ESC + c)
    return text


def escape_role(role: str) -> str:
    return escape(role).replace(":", ESC + ":").replace("\n", ESC + "\n")


def _escapes(text: str, start: int, end: int) -> bool:
    """Whether the character at ``end`` is escaped: an odd number of escape characters stands before it, from ``start`` on."""
    at = end
    while at > start and text[at - 1] == ESC:
        at -= 1
    return (end - at) % 2 == 1


def unescape(text: str) -> str:
    """``text`` without its escape characters, in pieces that no escape goes over."""
    if ESC not in text:
        return text
    out, at = [], 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        end += _escapes(text, at, end)
        out.append(_UNESCAPE.sub(r"\1", text[at:end]))
        at = end
    return "".join(out)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span (code points) that the loss covers: an assistant's text."""
    head, body = OPEN + escape_role(role) + MIDDLE, escape(text)
    return head + body + CLOSE, len(head), len(body) if role == "assistant" else 0


def read_turn(rendered: str) -> tuple[str, str]:
    """Role and text of one rendered turn, by plain searches: memory is that of the texts."""
    at, last = len(OPEN), len(rendered) - len(CLOSE)
    if not rendered.startswith(OPEN) or not rendered.endswith(CLOSE):
        raise ValueError("not a rendered turn")
    while (found := _ROLE_END.search(rendered, at)) and found[0] == ESC:
        at = found.start() + 2
    if not found or not rendered.startswith(MIDDLE, found.start()) or found.end() + 1 > last:
        raise ValueError("not a rendered turn")
    body = found.end() + 1
    close = rendered.find(CLOSE, body)
    while close < last and _escapes(rendered, body, close):
        close = rendered.find(CLOSE, close + 1)
    if close != last or _escapes(rendered, body, last):
        raise ValueError("not a rendered turn")
    return unescape(rendered[len(OPEN):found.start()]), unescape(rendered[body:last])


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log of ``message`` events."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("event"),
                                "role", "text")


class _Fold:
    """State of the pass: the conversation, its regenerations so far and the open message."""

    def __init__(self) -> None:
        self.started, self.conv, self.index, self.cut, self.turn_cut = False, None, 0, None, None
        self.turn, self.role, self.parts = None, None, None

    def close(self, out: list) -> None:
        if self.parts is not None:
            rendered, start, length = render(self.role, "".join(self.parts))
            out.append((self.conv, self.index, self.role, rendered, start, length))
            self.index += 1
        self.parts = None

    def feed(self, conv, turn, seq, event: str, role: str, text: str, out: list) -> None:
        if not self.started or conv != self.conv:
            self.close(out)
            self.__init__()
            self.started, self.conv = True, conv
        if turn != self.turn or self.turn is None:
            self.close(out)
            self.turn = turn
            self.cut = self.turn_cut  # what earlier turns took back
        if self.cut is not None and (seq is None or seq < self.cut):
            return
        if event == "message":
            self.close(out)
            self.role, self.parts = role, [text]
        elif event == "delta" and self.parts is not None:
            self.parts.append(text)
        else:  # edit or regenerate, or the first sign of a message
            if self.parts is None:
                self.role = role
            self.role, self.parts = self.role or role, [text]
        if event == "regenerate" and seq is not None:
            self.turn_cut = seq if self.turn_cut is None else max(seq, self.turn_cut)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "turn_index", "role", "rendered", "loss_start", "loss_length"]
    state, out = _Fold(), []
    for batch in batches:
        none = batch[["conv_id", "turn", "seq"]].isna().to_numpy()
        for row, na in zip(batch.itertuples(index=False), none, strict=True):
            state.feed(None if na[0] else int(row.conv_id), None if na[1] else int(row.turn),
                       None if na[2] else int(row.seq), row.event or "message", row.role or "", row.text or "", out)
            if len(out) >= 2000:
                yield _frame(out, names)
                out = []
    state.close(out)
    yield _frame(out, names)


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=names)
    return df.assign(conv_id=df.conv_id.astype("Int64"))


def format_chats(events: DataFrame) -> DataFrame:
    """One row per final turn: conv_id, turn_index (from 0), role, rendered, loss_start, loss_length.

    The formatted conversation is its ``rendered`` strings joined in order of turn_index; the
    loss covers ``loss_length`` code points from ``loss_start`` of each of them. Rows of a
    conversation leave in order, in one partition.
    """
    short_batches(events.sparkSession)
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.col("seq").cast("long").alias("seq"), "event", "role", "text")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", F.col("event").desc(), "role", "text")
    return log.mapInPandas(_fold, RENDERED)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    conv, n, rows = "none yet", 0, []

    def done():
        if n:
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        none = batch.conv_id.isna().to_numpy()
        for row, na in zip(batch.itertuples(index=False), none, strict=True):
            this = None if na else int(row.conv_id)
            if this != conv:
                done()
                conv, n, loss_chars, chars = this, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            role, text = read_turn(row.rendered)
            n, chars = n + 1, chars + len(row.rendered)
            for part in (role, "\n", text, "\n"):
                turns.update(part.encode())
            if row.loss_length:
                under = unescape(row.rendered[row.loss_start:row.loss_start + row.loss_length])
                loss_chars += len(under)
                loss.update(under.encode())
        if len(rows) >= 2000:
            yield _frame(rows, names)
            rows = []
    done()
    yield _frame(rows, names)


def digest_chats(rendered: DataFrame) -> DataFrame:
    """What stands in the rendered turns, read back: one row per conversation.

    Takes ``format_chats``' rows as they leave it (a conversation's in order, in one
    partition) and keeps running digests only.
    """
    return rendered.mapInPandas(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                         "loss_sha256 string, formatted_chars long")
