"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its marks, says whether its text bears loss, and lists which role may
follow which. Turns of a conversation stream through the machine in order; it emits segments (marks and
texts, each with a loss flag) and notes turns that the template doesn't allow, which are formatted all the same.
Characters that begin a control string are followed by an escape inside texts and role names, so no control
string survives in them and the reader can undo it.

Each conversation is one sorted stream in one task whose state is a few numbers, so a conversation of any length
needs no more memory than its longest turn. Turns are ordered by turn, ties and repeated rows by role, then
text; a null turn comes first. Null texts and roles are empty. Rows whose conv_id is null are one conversation.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, OTHER = "", "*"


@dataclass(frozen=True)
class Template:
    """marks: text before and after a role's text; OTHER: any role without marks of its own, which are then filled with its name."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), OTHER: ("[ROLE]{role}[TEXT]", "[/ROLE]")})
    loss: frozenset[str] = frozenset({"assistant"})
    #: Which roles may follow which; START is a conversation's beginning.
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user", "tool"}), "tool": frozenset({"assistant"})})
    ends: frozenset[str] = frozenset({"assistant"})
    #: First characters of control strings, and the escape that goes after each of them inside texts.
    openers: str = "<["
    escape: str = "\\"

    def escaped(self, text: str) -> str:
        return re.sub(f"[{re.escape(self.openers + self.escape)}]", lambda m: m[0] + self.escape, text)

    def plain(self, text: str) -> str:
        return re.sub(f"([{re.escape(self.openers + self.escape)}]){re.escape(self.escape)}", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        before, after = self.marks.get(role) or self.marks[OTHER]
        return [(before.replace("{role}", self.escaped(role)), False), (self.escaped(text), role in self.loss), (after, False)]

    def read(self, turn: str) -> tuple[str, str]:
        """role and text of a formatted turn."""
        for role, (before, after) in self.marks.items():
            if role != OTHER and turn.startswith(before):
                return role, self.plain(turn[len(before) : len(turn) - len(after)])
        before, after = self.marks[OTHER]
        head, tail = before.split("{role}")
        role, text = turn[len(head) : len(turn) - len(after)].split(tail, 1)
        return self.plain(role), self.plain(text)


_SEGMENTS = "conv_id {kind}, seq long, part int, role_allowed boolean, start long, segment string, loss boolean"


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """Segments of each conversation in order: conv_id, seq (turn), part (0 to 2), role_allowed, start (code points), segment, loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, seq, at, began = None, START, 0, 0, False
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                rows = []
                for conv, role, text in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns[:3]), strict=True):
                    if not began or conv != now:
                        now, state, seq, at, began = conv, START, 0, 0, True
                    allowed = role in template.follows.get(state, frozenset())
                    for part, (segment, loss) in enumerate(template.segments(role, text)):
                        rows.append((conv, seq, part, allowed, at, segment, loss))
                        at += len(segment)
                    state, seq = role, seq + 1
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], types)

    kind = turns.schema["conv_id"].dataType.simpleString()
    plain = turns.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "turn")
    columns = _SEGMENTS.format(kind=kind)
    types = _arrow(kind)
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, columns)


def _arrow(kind: str) -> pa.Schema:
    conv = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return pa.schema([("conv_id", conv), ("seq", pa.int64()), ("part", pa.int32()), ("role_allowed", pa.bool_()), ("start", pa.int64()), ("segment", pa.string()), ("loss", pa.bool_())])


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """One row per conversation from format_conversations' segments, as they stand in its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state: dict | None = None

        def finish() -> None:
            if state is not None:
                done.append((state["conv"], state["turns"], state["sha"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"], state["valid"] and state["role"] in template.ends))

        def flush() -> pa.RecordBatch:
            cols = [pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), names, strict=True)]
            done.clear()
            return pa.record_batch(cols, names)

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                for conv, part, allowed, segment, loss in zip(*(batch.slice(k, 512).column(c).to_pylist() for c in ("conv_id", "part", "role_allowed", "segment", "loss")), strict=True):
                    if state is None or conv != state["conv"]:
                        finish()
                        state = {"conv": conv, "turns": 0, "sha": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "turn": [], "valid": True, "role": ""}
                    state["chars"] += len(segment)
                    state["turn"].append(segment)
                    state["valid"] &= allowed
                    if loss:
                        text = template.plain(segment)
                        state["loss"] += len(text)
                        state["loss_sha"].update(text.encode())
                    if part == 2:
                        state["role"], text = template.read("".join(state["turn"]))
                        state["sha"].update(f"{state['role']}\n{text}\n".encode())
                        state["turns"] += 1
                        state["turn"] = []
            if len(done) >= 4096:
                yield flush()
        finish()
        if done:
            yield flush()

    kind = segments.schema["conv_id"].dataType.simpleString()
    names = pa.schema([("conv_id", _arrow(kind).field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
