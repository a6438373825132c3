"""Chat formatting that is proved by reading it back.

The template, a turn at a time (``<role>`` for roles of other names):

    system      <s>[SYS] text [/SYS]
    user        <s>[INST] text [/INST]
    assistant   one space, text, </s>
    other       <s>[TURN role] text [/TURN]

A turn ends at the first closing marker that is not escaped, so a reader never
looks past a turn, and turns read one by one read the same in a row. A backslash
before one of ``\\ < [ ]`` stands for that character; any other backslash is itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.common import bounded_batches, partitions

ROLES = {"system": ("<s>[SYS] ", " [/SYS]"), "user": ("<s>[INST] ", " [/INST]")}
ASSISTANT = (" ", "</s>")
OTHER = ("<s>[TURN ", " [/TURN]")

_MARKER = r"</?s>|\[/?(?:INST|SYS)\]|\[/?TURN"
# What a reader stops at within a text: an escape or a marker.
_STOP = re.compile(rf"\\[\\<\[\]]|{_MARKER}")
_ROLE_STOP = re.compile(r"\\[\\<\[\]]|\]")
# What is escaped, by how much conflicts: nothing, what may be misread, all there is.
_ESCAPES = (None, re.compile(rf"\\(?=[\\<\[\]]|\Z)|{_MARKER}"), re.compile(r"[\\<\[\]]"))


class Unreadable(ValueError):
    """The text is not one this template could have made."""


@dataclass(frozen=True)
class Turn:
    """A turn as read: where the text itself lies, and where the turn ends."""

    role: str
    text: str
    start: int
    stop: int
    end: int


def escape(text: str, level: int) -> str:
    pattern = _ESCAPES[level]
    return pattern.sub(lambda m: "\\" + m[0], text) if pattern else text


def render(role: str, text: str, level: int) -> str:
    body = escape(text, level)
    if role == "assistant":
        opening, closing = ASSISTANT
    elif role in ROLES:
        opening, closing = ROLES[role]
    else:
        opening, closing = f"{OTHER[0]}{escape(role, max(level, 2))}] ", OTHER[1]
    return f"{opening}{body}{closing}"


def _until(source: str, pos: int, stops: re.Pattern, closing: str) -> tuple[str, int]:
    """The unescaped text from ``pos`` to ``closing``, and where that begins."""
    parts = []
    while True:
        found = stops.search(source, pos)
        if found is None:
            raise Unreadable("a turn does not end")
        at = found.start()
        if found[0][0] == "\\":
            parts += source[pos:at], found[0][1]
            pos = found.end()
            continue
        begin = at - (len(closing) - len(closing.lstrip(" ")))
        if begin < pos or not source.startswith(closing, begin):
            raise Unreadable(f"{found[0]} inside a text")
        parts.append(source[pos:begin])
        return "".join(parts), begin


def read_turn(source: str, pos: int = 0) -> Turn:
    """The turn that starts at ``pos``; deterministic, from left to right."""
    if source.startswith(ASSISTANT[0], pos):
        role, (opening, closing) = "assistant", ASSISTANT
        start = pos + len(opening)
    elif source.startswith(OTHER[0], pos):
        role, at = _until(source, pos + len(OTHER[0]), _ROLE_STOP, "]")
        if not source.startswith("] ", at):
            raise Unreadable("a role does not end")
        start, closing = at + 2, OTHER[1]
    else:
        for role, (opening, closing) in ROLES.items():
            if source.startswith(opening, pos):
                start = pos + len(opening)
                break
        else:
            raise Unreadable("no turn starts here")
    text, stop = _until(source, start, _STOP, closing)
    return Turn(role, text, start, stop, stop + len(closing))


def format_turn(role: str, text: str) -> str:
    """The turn as the template writes it, with as few escapes as read back the same.

    Written as it is, read, and compared; while the two differ, more of the content
    is escaped. With everything escaped no marker is left to be misread.
    """
    for level in range(len(_ESCAPES)):
        piece = render(role, text, level)
        try:
            turn = read_turn(piece)
        except Unreadable:
            continue
        if (turn.role, turn.text, turn.end) == (role, text, len(piece)):
            return piece
    raise AssertionError(f"no escape makes this turn readable: {role!r}")


def format_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Every turn as formatted: the conversation, the turn and ``formatted``.

    A conversation's text is its ``formatted`` in the order of turns, joined with
    nothing between. It stays in a row per turn, so that no row grows with the
    length of a conversation. Null texts and roles are empty ones. Null
    conversations and turns are kept. Repeated rows are kept. An empty table gives no
    rows.
    """
    bounded_batches(turns.sparkSession)
    plain = turns.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kinds = dict(plain.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [
                format_turn(r, t)
                for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(pieces, pa.string())],
                ["conversation", "turn", "formatted"],
            )

    schema = f"conversation {kinds['conversation']}, turn {kinds['turn']}, formatted string"
    return plain.mapInArrow(run, schema)


class _Reading:
    """The digests of one conversation, taken while its text comes in."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, piece: str) -> None:
        pos = 0
        while pos < len(piece):
            turn = read_turn(piece, pos)
            self.turns.update(f"{turn.role}\n{turn.text}\n".encode())
            if turn.role == "assistant":
                self.loss.update(turn.text.encode())
                self.loss_chars += len(turn.text)
            self.n_turns += 1
            pos = turn.end
        self.chars += len(piece)

    def row(self, conversation) -> tuple:
        digests = self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest()
        return conversation, self.n_turns, *digests, self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader finds in the conversations of ``format_turns``, a row each.

    ``n_turns``, ``turns_sha256`` over role and text of every turn, each followed by
    a line end; ``loss_chars`` and ``loss_sha256`` of the text under the loss mask,
    the texts of assistants without escapes; ``formatted_chars``.

    A digest is a sequence, so the rows of a conversation go through one task, as a
    sorted stream that keeps only the state of the digests: Spark sorts and spills,
    Python holds one batch. Turns with equal numbers come in the order of their
    formatted text, null turns first; null conversations are read as one.
    """
    n = partitions(formatted.sparkSession)
    kind = dict(formatted.dtypes)["conversation"]
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reading, kept, type_ = None, None, [], None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], type_)] + [pa.array(c) for c in columns[1:]]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            type_ = batch.schema.field(0).type
            for conversation, piece in zip(
                batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ):
                if reading is None or conversation != current:
                    if reading is not None:
                        kept.append(reading.row(current))
                    current, reading = conversation, _Reading()
                reading.feed(piece)
            if len(kept) >= 1000:
                yield out(kept)
                kept = []
        if reading is not None:
            kept.append(reading.row(current))
        if kept:
            yield out(kept)

    return (
        formatted.repartition(n, "conversation")
        .sortWithinPartitions("conversation", "turn", "formatted")
        .mapInArrow(run, schema)
    )
