"""Chat formatting by a finite-state machine over roles and a declarative template.

A ``Template`` states how a turn is marked, which roles are trained on and which role may follow
which state.  The machine reads the turns of a conversation in order and emits three text segments
a turn - opening, body, closing - each with its loss flag, and the state after the turn.

Control strings inside texts are escaped reversibly: every ``<``, backslashes, ``|`` gets one more
backslash, so the two characters with which all marks begin never occur in an escaped text.  In
roles line ends and backslashes are escaped too, as a role ends at the line's end.

The turns of a conversation are brought together by one shuffle and a sort that may spill; a task
then streams over them and holds one batch of turns and the machine's state, never a conversation.
The segments of a conversation lie in one partition, one after another, and ``read_back`` streams over
them in the same way; it finds roles and texts by the marks alone.

Defined results: a null text or role is empty; a role that the machine does not know, or that may
not follow, makes the turn and all after it invalid - they are formatted all the same and the rows say
so; turns of one number are ordered by role, then text (nulls first), and repeated rows are turns of
their own; rows without a conversation id are one conversation, those without a turn number come
first; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowtide.llm.storage import bounded_batches

INVALID = "invalid"


@dataclass(frozen=True)
class Template:
    """How turns are marked: ``opening + role + role_end + text + closing``.

    ``moves[state][role]`` is the state after a turn of that role."""

    opening: str
    role_end: str
    closing: str
    trained: frozenset[str]
    start: str
    moves: dict[str, dict[str, str]] = field(hash=False)
    final: frozenset[str]

    def after(self, state: str, role: str) -> str:
        return self.moves.get(state, {}).get(role, INVALID)


CHAT = Template(
    opening="<|im_start|>",
    role_end="\n",
    closing="<|im_end|>\n",
    trained=frozenset({"assistant"}),
    start="begin",
    moves={
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=frozenset({"answered"}),
)

_MARK, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def arranged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns, those of a conversation together and in order: ``conv_id, role, text``."""
    order = [rows[c] for c in (conv, turn, role, text)]
    together = rows.select(*[c.alias(n) for c, n in zip(order, ("conv_id", "turn", "role", "text"))])
    together = together.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return together.select("conv_id", "role", "text")


def segments(turns: DataFrame, template: Template = CHAT) -> DataFrame:
    """Three segments a turn of arranged turns: ``conv_id, segment, text, loss, state, valid``.

    ``state`` is that of the machine after the turn, ``valid`` whether it has met no unknown move."""
    bounded_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "segment", "text", "loss", "state", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, number, now = template.start, 0, object()
        for batch in batches:
            convs = batch.column("conv_id").to_pylist()
            place, texts, loss, states = [], [], [], []
            for conv, role, text in zip(convs, batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if conv != now:
                    state, number, now = template.start, 0, conv
                role = role or ""
                state = template.after(state, role)
                texts += (template.opening + escape_role(role) + template.role_end, escape(text or ""), template.closing)
                place += (number, number + 1, number + 2)
                loss += (False, role in template.trained, False)
                states += (state, state, state)
                number += 3
            three = pa.array([i for i in range(len(convs)) for _ in range(3)], pa.int64())
            columns = [pa.array(place, pa.int64()), pa.array(texts, pa.string()), pa.array(loss, pa.bool_()), pa.array(states, pa.string())]
            valid = pa.array([s != INVALID for s in states], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(three), *columns, valid], names=names)

    schema = f"conv_id {kind}, segment long, text string, loss boolean, state string, valid boolean"
    return turns.mapInArrow(run, schema)


class _Reader:
    """Digests of one formatted conversation, fed segment by segment."""

    def __init__(self, template: Template):
        self.template, self.rest, self.masked = template, "", []
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.state, self.valid = template.start, True

    def feed(self, text: str, loss: bool) -> None:
        t = self.template
        self.chars += len(text)
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.rest += text
        if not text.endswith(t.closing):  # a body that seems to end a turn holds no mark
            return
        while (end := self.rest.find(t.closing)) >= 0:
            head, _, body = self.rest[len(t.opening) : end].partition(t.role_end)
            role = unescape_role(head)
            self.state = t.after(self.state, role)
            self.valid &= self.state != INVALID
            self.turns += 1
            self.all.update(f"{role}\n{unescape(body)}\n".encode())
            self.rest = self.rest[end + len(t.closing) :]

    def row(self, conv) -> tuple:
        done = self.state in self.template.final
        return (conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid, done)


def read_back(found: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation, from its formatted text: ``conv_id, n_turns, turns_sha256`` (role, line end,
    text, line end a turn), ``loss_chars, loss_sha256`` (text under the loss mask), ``formatted_chars``,
    whether its order is ``valid`` and whether it is ``answered`` at its end.

    The segments of a conversation have to follow each other in one partition, as ``segments`` gives them."""
    kind = found.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean, answered boolean"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, out = None, None, []
        target = None
        for batch in batches:
            target = batch.schema.field("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "text", "loss"))
            for conv, text, loss in zip(*columns):
                if reader is None or conv != now:
                    if reader is not None:
                        out.append(reader.row(now))
                    now, reader = conv, _Reader(template)
                reader.feed(text, loss)
            if out:
                yield _rows(out, target)
                out = []
        if reader is not None:
            yield _rows([reader.row(now)], target)

    return found.select("conv_id", "text", "loss").mapInArrow(run, schema)


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "answered"]
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def format_conversations(rows: DataFrame, template: Template = CHAT, **columns: str) -> DataFrame:
    """Segments of all conversations of a table of turns."""
    return segments(arranged(rows, **columns), template)
