"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. Partitioned by conversation and sorted by (turn, seq), the log is folded in one
streaming pass: deltas append, edits replace, regenerations start a message anew; each finished message is rendered
at once. A task holds one message at a time, so neither a long nor a hot conversation has to fit in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, END = "<s>", "</s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[BOT] ", END), "system": ("[SYS] ", " [/SYS]")}
OTHER = ("[ROLE] ", "[/ROLE] ", "[/TURN]")
CONTROL = (BEGIN, END, "[INST]", "[/INST]", "[BOT]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]")
_CONTROL_RE = re.compile("|".join(map(re.escape, CONTROL)))
_BACKSLASH_RE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    r"""Backslashes doubled; a single backslash after the first character of each control string."""
    return _CONTROL_RE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACKSLASH_RE.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn as the template writes it, and the span of its text within."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a rendered turn, found from its control strings alone."""
    marks = list(_CONTROL_RE.finditer(turn))
    if marks[0][0] == OTHER[0].strip():
        role = unescape(turn[marks[0].end() + 1 : marks[1].start()])
        return role, unescape(turn[marks[1].end() + 1 : marks[2].start()])
    role = next(k for k, (a, _) in MARKS.items() if a.strip() == marks[0][0])
    stop = marks[1].start() - (role != "assistant")
    return role, unescape(turn[marks[0].end() + 1 : stop])


class Event(NamedTuple):
    conv_id: int | None
    turn: int | None
    kind: str
    role: str | None
    text: str | None


class Message(NamedTuple):
    conv_id: int | None
    turn: int | None
    role: str
    text: str


def fold(events: Iterable[Event]) -> Iterator[Message]:
    """Messages from sorted events. `message` starts one; `delta` appends to the turn's last message, `edit` replaces
    its text, `regenerate` discards it, its role kept, for the deltas that follow; each starts one where there is none."""
    now: tuple | None = None
    role, parts = "", []
    for e in events:
        key = (e.conv_id, e.turn)
        if now is not None and (key != now or e.kind == "message"):
            yield Message(*now, role, "".join(parts))
            now = None
        if now is None:
            now, role, parts = key, e.role or "", []
        if e.kind in ("edit", "regenerate"):
            parts = []
        parts.append(e.text or "")
    if now is not None:
        yield Message(*now, role, "".join(parts))


def as_events(messages: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as complete-message events; rows of one turn keep a fixed order."""
    return messages.select("conv_id", "turn", F.lit(0).cast("bigint").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def _sorted(events: DataFrame) -> DataFrame:
    return (
        events.select("conv_id", "turn", "seq", "kind", "role", "text")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    )


def _events(frames: Iterator[pd.DataFrame]) -> Iterator[Event]:
    def integer(x):
        return None if pd.isna(x) else int(x)

    def string(x):
        return x if isinstance(x, str) else None

    for f in frames:
        for c, t, k, r, x in zip(f["conv_id"], f["turn"], f["kind"], f["role"], f["text"], strict=True):
            yield Event(integer(c), integer(t), string(k) or "message", string(r), string(x))


def _frames(rows: Iterator[tuple], names: list[str], whole: list[str], most: int = 500) -> Iterator[pd.DataFrame]:
    block: list[tuple] = []

    def frame() -> pd.DataFrame:
        return pd.DataFrame(block, columns=names).astype({c: "Int64" for c in whole})

    for row in rows:
        block.append(row)
        if len(block) >= most:
            yield frame()
            block = []
    if block:
        yield frame()


def format_turns(events: DataFrame) -> DataFrame:
    """One row per final message: conv_id, turn, position (from 0 in the conversation), role, text, formatted (the
    template's text; BEGIN precedes position 0), loss_start and loss_end (span in formatted that is trained on, null
    for roles other than assistant). Concatenated by position, formatted is the training text of the conversation.

    Null ids and turns group as values of their own and sort first; null texts and roles count as empty; rows that
    repeat are messages of their own; rows of one turn go by (seq, kind, role, text), equal ones in any order. Texts are
    whole however long: a task holds one message at a time. Further columns are ignored. An empty log gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            last, at = object(), 0
            for m in fold(_events(frames)):
                at, last = (at + 1 if m.conv_id == last else 0), m.conv_id
                formatted, a, b = render(m.role, m.text)
                if at == 0:
                    formatted, a, b = BEGIN + formatted, a + len(BEGIN), b + len(BEGIN)
                trained = m.role == "assistant"
                yield (m.conv_id, m.turn, at, m.role, m.text, formatted, a if trained else None, b if trained else None)

        names = ["conv_id", "turn", "position", "role", "text", "formatted", "loss_start", "loss_end"]
        yield from _frames(rows(), names, ["conv_id", "turn", "position", "loss_start", "loss_end"])

    schema = (
        "conv_id bigint, turn bigint, position bigint, role string, text string, formatted string,"
        " loss_start bigint, loss_end bigint"
    )
    return _sorted(events).mapInPandas(run, schema)


def format_digests(events: DataFrame) -> DataFrame:
    """One row per conversation, all of it read back from the rendered turns: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Rules for nulls, ties and repeats as in format_turns()."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            state = None
            for m in fold(_events(frames)):
                if state is None or state[0] != m.conv_id:
                    if state:
                        yield (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])
                    state = [m.conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), len(BEGIN)]
                formatted, a, b = render(m.role, m.text)
                role, text = parse(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    loss = unescape(formatted[a:b])
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += len(formatted)
            if state:
                yield (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield from _frames(rows(), names, ["conv_id", "n_turns", "loss_chars", "formatted_chars"])

    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    return _sorted(events).mapInPandas(run, schema)
