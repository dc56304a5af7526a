"""Chat formatting: a finite-state machine over roles, driven by a declarative template, emits text segments with loss flags.

A template names the marks around the text of each role and whether that text bears loss, the machine's moves, and the control strings.
Every turn is formatted. A turn that the machine has no move for is marked as out of order, and the machine goes on from the state to
which such a turn usually leads. Control strings in texts and in names of roles are broken by an escape character behind their first
character, the escape character is doubled, and reading undoes both, so that no text can pose as a mark.

Conversations go through in order of turns: a shuffle by conversation and a sort that can spill, then one pass that holds the machine's
state and one batch. So a conversation of any length takes bounded memory, in one task, as its digests are chains.

Nulls: a null text or role is empty; a null turn comes first; rows without a conversation's id are one conversation. Ties of a turn and
repeated rows all stay, in order of role and text. Roles without marks of their own are named in the output, the empty one too. Very
long texts are formatted whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import as_batch, columns, tune


@dataclass(frozen=True)
class Marks:
    """What stands before and after the text of a role's turn; loss: whether the text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """named: marks before the name of a role that has none, between name and text, and after the text."""

    roles: dict[str, Marks]
    named: tuple[str, str, str]
    moves: dict[tuple[str, str], str]
    control: tuple[str, ...]
    start: str = "start"
    ends: tuple[str, ...] = ("answered",)
    escape: str = "\\"
    usual: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        if any(len(c) < 2 or self.escape in c for c in self.control):
            raise ValueError("a control string takes two characters or more, and no escape character")
        marks = [m for r in self.roles.values() for m in (r.before, r.after)] + list(self.named)
        if any(sum(m.count(c) for c in self.control) != 1 for m in marks):
            raise ValueError("each mark takes one control string")
        object.__setattr__(self, "usual", {role: state for (_, role), state in reversed(self.moves.items())})

    @cached_property
    def _breaks(self) -> re.Pattern:
        return re.compile(f"{re.escape(self.escape)}|(?={'|'.join(map(re.escape, self.control))})[\\s\\S]")

    @cached_property
    def _mended(self) -> re.Pattern:
        one = re.escape(self.escape)
        return re.compile(f"{one}({one}?)")

    @cached_property
    def _opens(self) -> re.Pattern:
        known = [f"(?P<r{i}>{re.escape(m.before)})" for i, m in enumerate(self.roles.values())]
        return re.compile("|".join([*known, f"(?P<named>{re.escape(self.named[0])})"]))

    def escaped(self, text: str) -> str:
        return self._breaks.sub(lambda m: m[0] + self.escape, text)

    def plain(self, text: str) -> str:
        return self._mended.sub(r"\1", text)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The machine's next state, and whether the role may stand here."""
        to = self.moves.get((state, role))
        return (to, True) if to else (self.usual.get(role, state), False)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The formatted turn as segments, each with its loss flag."""
        marks = self.roles.get(role)
        if marks is None:
            marks = Marks(self.named[0] + self.escaped(role) + self.named[1], self.named[2])
        return [(marks.before, False), (self.escaped(text), marks.loss), (marks.after, False)]

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """The roles and texts of formatted turns, read from the marks alone."""
        at, names = 0, list(self.roles)
        while at < len(formatted):
            found = self._opens.match(formatted, at)
            if not found:
                raise ValueError(f"no mark at {at}")
            if found.lastgroup == "named":
                to = formatted.index(self.named[1], found.end())
                role, begin, after = self.plain(formatted[found.end() : to]), to + len(self.named[1]), self.named[2]
            else:
                role = names[int(found.lastgroup[1:])]
                begin, after = found.end(), self.roles[role].after
            end = formatted.index(after, begin)
            yield role, self.plain(formatted[begin:end])
            at = end + len(after)


INSTRUCT = Template(
    roles={"system": Marks("<<SYS>>\n", "\n<</SYS>>\n"), "user": Marks("[INST] ", " [/INST]"), "assistant": Marks("<s>", "</s>", loss=True)},
    named=("[ROLE]", "[/ROLE] ", " [/TURN]"),
    moves={
        ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked",
    },
    control=("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]"),
)

SEGMENTS = "array<struct<text: string, loss: boolean>>"


def in_order(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text, conversations together and in order of turns."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((role, "role"), (text, "text"))))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def format_chats(spark: SparkSession, turns: DataFrame, template: Template = INSTRUCT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), state after the turn, expected (whether the machine had a move for it) and segments of every turn.

    The rows of a conversation come together and in order.
    """
    tune(spark)
    rows = in_order(turns, conv_id, turn, role, text)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, pos = (), template.start, 0
        for b in batches:
            states, wanted, places, made = [], [], [], []
            for c, r, t in zip(*columns(b, "conv_id", "role", "text"), strict=True):
                if (c,) != now:
                    now, state, pos = (c,), template.start, 0
                state, known = template.step(state, r)
                states.append(state)
                wanted.append(known)
                places.append(pos)
                made.append([{"text": s, "loss": loss} for s, loss in template.segments(r, t)])
                pos += 1
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(places, pa.int64()), pa.array(states, pa.string()), pa.array(wanted, pa.bool_()), pa.array(made, pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))),
            ], names=["conv_id", "pos", "state", "expected", "segments"])

    return rows.mapInArrow(run, f"conv_id {kind}, pos long, state string, expected boolean, segments {SEGMENTS}")


def read_back(formatted: DataFrame, template: Template = INSTRUCT, together: bool = True) -> DataFrame:
    """A row for each conversation, from its segments alone: turns and learned text as counts and digests, and whether its order is valid.

    together: the rows of a conversation come together and in order, as format_chats leaves them; else they are sorted first.
    """
    if not together:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    kind = formatted.schema["conv_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("in_order", pa.bool_()), ("ended", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, held = pa.schema(fields), (), None

        def row() -> tuple:
            return (now[0], held["n"], held["turns"].hexdigest(), held["chars"], held["learned"].hexdigest(), held["all"], held["in_order"], held["state"] in template.ends)

        for b in batches:
            done = []
            for c, state, known, segments in zip(*columns(b, "conv_id", "state", "expected", "segments"), strict=True):
                if (c,) != now:
                    if held:
                        done.append(row())
                    now, held = (c,), {"n": 0, "turns": hashlib.sha256(), "chars": 0, "learned": hashlib.sha256(), "all": 0, "in_order": True}
                for r, t in template.turns("".join(s["text"] for s in segments)):
                    held["n"] += 1
                    held["turns"].update(f"{r}\n{t}\n".encode())
                for s in segments:
                    held["all"] += len(s["text"])
                    if s["loss"]:
                        learned = template.plain(s["text"])
                        held["chars"] += len(learned)
                        held["learned"].update(learned.encode())
                held["state"], held["in_order"] = state, held["in_order"] and known
            if done:
                yield as_batch(done, schema)
        if held:
            yield as_batch([row()], schema)

    return formatted.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean, ended boolean")
