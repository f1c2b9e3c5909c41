"""Chat formatting by a finite-state machine over roles.

A declarative :class:`Template` names each role's opening and closing mark and whether its text carries loss. Turns of a
conversation come in order (turn, then role and text; null turns last); the machine's transitions say which role may
follow which, and each turn leaves as segments (mark, text, mark) with a loss flag each. Control strings inside a text
are broken by an escape character, which is doubled, so reading back is exact: a conversation's text alone, cut anywhere,
gives its turns by the template's marks, and the machine runs again over what was read.

Rows are dealt by conversation and sorted within partitions, and the machine runs over the stream of rows: what it
holds is one state, never a conversation, so a conversation of any length takes no more memory.

Defined cases: null text is empty; null and unknown roles are marked by name (null as the empty name), carry no loss
and are out of order; turn numbers that are null or equal keep the stated order; repeated rows are turns of their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of

ESCAPE = "\\"
#: Characters that a reader gathers before it reads.
READ_CHARS = 1 << 16


@dataclass(frozen=True)
class Role:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>\n", "\n<</SYS>>\n"),
            "user": Role("<s>[INST] ", " [/INST]"),
            "assistant": Role("<a> ", " </s>", loss=True),
        }
    )
    #: Any other role: opening, name, middle, text, closing.
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    #: Strings that mark turns; no text holds one once it is escaped.
    controls: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "<a>", "[INST]", "[/INST]", "<|role|>", "<|text|>", "<|end|>")
    #: Which roles may follow a state; the states are "start" and the roles.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: States in which a conversation may end.
    ends: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def escaper(template: Template) -> re.Pattern:
    return re.compile("|".join([re.escape(ESCAPE), *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)]))


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    """Undo :func:`escape`: the escape character after any character that it broke, or after itself, goes."""
    return re.sub(r"([\s\S])\\", r"\1", text) if ESCAPE in text else text


_SEGMENT = pa.struct([("text", pa.string()), ("loss", pa.bool_())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("in_order", pa.bool_()), ("segments", pa.list_(_SEGMENT))])
_FORMATTED_DDL = "conv_id bigint, position bigint, role string, in_order boolean, segments array<struct<text:string,loss:boolean>>"


def _format_batches(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, here, state, position = escaper(template), object(), "start", 0
        for batch in batches:
            out: list[list] = [[] for _ in _FORMATTED]
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if conv != here:
                    here, state, position = conv, "start", 0
                safe = escape(text or "", pattern)
                if role in template.roles:
                    r = template.roles[role]
                    parts = [(r.opening, False), (safe, r.loss), (r.closing, False)]
                else:
                    a, b, c = template.other
                    parts = [(a, False), (escape(role or "", pattern), False), (b, False), (safe, False), (c, False)]
                row = (conv, position, role, role in template.follows.get(state, ()), [{"text": t, "loss": x} for t, x in parts])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                state, position = role or "", position + 1
            yield rows_of(_FORMATTED, out)

    return run


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return rows.select("conv_id", "role", "text")


def format_turns(turns: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, position, role, in_order, segments: one row a turn, a conversation's rows together and in order."""
    return _ordered(turns).mapInArrow(_format_batches(template), _FORMATTED_DDL)


class Reader:
    """Reads a conversation back from its formatted text, fed in pieces cut anywhere, each with its loss flag.

    Turns are found by the template's marks alone. What is held is the open turn.
    """

    def __init__(self, conv_id: int | None, template: Template) -> None:
        self.conv_id, self.template = conv_id, template
        self.openings = sorted([(r.opening, name) for name, r in template.roles.items()] + [(template.other[0], None)], key=lambda x: -len(x[0]))
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.valid, self.last = True, "start"
        self.held, self.size = [], 0  # pieces (text, loss) that are not read yet

    def feed(self, text: str, loss: bool) -> None:
        self.chars += len(text)
        if text:
            self.held.append((text, loss))
            self.size += len(text)

    def read(self) -> None:
        """Take all whole turns from what is held. To be called now and then, and at the end."""
        whole, at = "".join(text for text, _ in self.held), 0
        while at < len(whole):
            opening, name = next(((o, n) for o, n in self.openings if whole.startswith(o, at)), ("", None))
            if not opening:
                break
            start = at + len(opening)
            if name is None:
                middle, closing = self.template.other[1:]
                between = whole.find(middle, start)
                end = whole.find(closing, between + len(middle)) if between >= 0 else -1
                if end < 0:
                    break
                role, body = unescape(whole[start:between]), whole[between + len(middle) : end]
            else:
                closing = self.template.roles[name].closing
                end = whole.find(closing, start)
                if end < 0:
                    break
                role, body = name, whole[start:end]
            self._turn(role, body, self._masked(at, end + len(closing)))
            at = end + len(closing)
        self._drop(at)

    def _masked(self, a: int, z: int) -> str:
        out, at = [], 0
        for text, loss in self.held:
            if at >= z:
                break
            if loss and at + len(text) > a:
                out.append(text[max(0, a - at) : z - at])
            at += len(text)
        return "".join(out)

    def _drop(self, n: int) -> None:
        kept, at = [], 0
        for text, loss in self.held:
            if at + len(text) > n:
                kept.append((text[max(0, n - at) :], loss))
            at += len(text)
        self.held, self.size = kept, sum(len(text) for text, _ in kept)

    def _turn(self, role: str, body: str, masked: str) -> None:
        self.turns.update(f"{role}\n{unescape(body)}\n".encode())
        masked = unescape(masked)
        self.loss.update(masked.encode())
        self.loss_chars += len(masked)
        self.n_turns += 1
        self.valid, self.last = self.valid and role in self.template.follows.get(self.last, ()), role

    def row(self) -> tuple:
        self.read()
        if self.held:
            raise ValueError(f"conversation {self.conv_id}: its text goes on behind its last turn")
        return self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid and self.last in self.template.ends


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def _read_batches(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: Reader | None = None
        for batch in batches:
            done = []
            for conv, segments in zip(*(batch.column(k).to_pylist() for k in (0, 4)), strict=True):
                if reader is None or reader.conv_id != conv:
                    done += [reader.row()] if reader else []
                    reader = Reader(conv, template)
                for s in segments:
                    reader.feed(s["text"], s["loss"])
                if reader.size > READ_CHARS:
                    reader.read()
            if done:
                yield rows_of(_READ, list(map(list, zip(*done, strict=True))))
        if reader:
            yield rows_of(_READ, [[x] for x in reader.row()])

    return run


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Digests of each conversation as read from :func:`format_turns`'s segments, whose order it relies on."""
    ddl = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"
    return formatted.mapInArrow(_read_batches(template), ddl)
