"""Tokens and line counts of source text.

A language's markers become one alternation whose branches come in order of precedence (line comment, block comment,
string, white space, word, any other byte), so the regular-expression engine does the scanning. Texts are read as
Latin-1, in which a character is a byte: offsets are byte offsets, and a byte beyond ASCII is punctuation without text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cache
from typing import NamedTuple

from .languages import Language, by_key

IDENT, NUMBER, STRING, PUNCT = "i", "n", "s", "p"


class Token(NamedTuple):
    kind: str
    text: str | None
    start: int
    end: int
    line: int
    col: int


class Counts(NamedTuple):
    code: int
    comment: int
    blank: int

    @property
    def total(self) -> int:
        return self.code + self.comment + self.blank


def _longest(markers) -> list:
    return sorted(markers, key=lambda m: -len(m[0] if isinstance(m, tuple) else m))


@cache
def scanner(lang: Language) -> tuple[re.Pattern, list[tuple[str, str]]]:
    """The alternation, and the block comments by group number."""
    blocks = _longest((*lang.block, *lang.nested_comments))
    parts = [f"(?P<line>(?:{'|'.join(map(re.escape, _longest(lang.line)))})[^\n]*)"] if lang.line else []
    for k, (start, end) in enumerate(blocks):
        body = "" if lang.nested else rf"(?:(?!{re.escape(end)})[\s\S])*+(?:{re.escape(end)})?"
        parts.append(f"(?P<b{k}>{re.escape(start)}{body})")
    quotes = [(s, e, True) for s, e in (*lang.quotes, *lang.doc_quotes)] + [(s, e, False) for s, e in lang.verbatim]
    for k, (start, end, escapes) in enumerate(sorted(quotes, key=lambda q: -len(q[0]))):
        inner = r"\\[\s\S]|" if escapes else ""
        parts.append(rf"(?P<s{k}>{re.escape(start)}(?:{inner}(?!{re.escape(end)})[\s\S])*+(?P<e{k}>{re.escape(end)})?)")
    parts += [r"(?P<space>[ \t\n\f\r]+)", r"(?P<word>[A-Za-z0-9_]+)", r"(?P<other>[\s\S])"]
    return re.compile("|".join(parts)), blocks


def _nested_end(text: str, at: int, start: str, end: str) -> int:
    depth = 1
    for m in re.compile(f"{re.escape(end)}|{re.escape(start)}").finditer(text, at):
        depth += -1 if m[0] == end else 1
        if not depth:
            return m.end()
    return len(text)


def scan(content: bytes, lang: Language) -> tuple[list[Token], Counts]:
    """Tokens with all their text, and line counts."""
    text = content.decode("latin-1")
    if lang.literate:
        return [], _literate(text)
    pattern, blocks = scanner(lang)
    raw: list[tuple[str, str | None, int, int]] = []
    code: list[tuple[int, int]] = []
    comment: list[tuple[int, int]] = []
    swallowed: set[int] = set()  # newlines behind an escape character in a string end no line
    at = 0
    while at < len(text):
        m = pattern.match(text, at)
        group, start, at = m.lastgroup, m.start(), m.end()
        if group[0] == "e" or (group[0] == "s" and group != "space"):
            number = group[1:]
            code.append((start, at))
            if "\\\n" in m[0]:
                swallowed.update(start + x.end() - 1 for x in re.finditer(r"\\[\s\S]", m[0]) if x[0][1] == "\n")
            if m[f"e{number}"] is not None:
                raw.append((STRING, m[0], start, at))
        elif group == "line":
            comment.append((start, at))
        elif group[0] == "b":
            if lang.nested:
                at = _nested_end(text, at, *blocks[int(group[1:])])
            comment.append((start, at))
        elif group == "word":
            code.append((start, at))
            raw.append((NUMBER if m[0][0].isdigit() else IDENT, m[0], start, at))
        elif group == "other":
            code.append((start, at))
            raw.append((PUNCT, m[0] if m[0] < "\x80" else None, start, at))
    breaks = [x.start() for x in re.finditer("\n", text) if x.start() not in swallowed]
    tokens = []
    for kind, value, start, end in raw:
        line = bisect_right(breaks, end - 1 if kind == STRING else start)
        begin = breaks[line - 1] + 1 if line else 0
        tokens.append(Token(kind, value, start, end, line + 1, max(start - begin, 0) + 1))
    return tokens, _lines(text, breaks, code, comment)


def _lines(text: str, breaks: list[int], code: list[tuple[int, int]], comment: list[tuple[int, int]]) -> Counts:
    n = len(breaks) + 1
    marks = [0] * n
    for spans, mark in ((comment, 1), (code, 2)):
        for start, end in spans:
            for k in range(bisect_right(breaks, start - 1 if start else -1), bisect_right(breaks, max(start, end - 1)) + 1):
                marks[k] |= mark
    # A string or comment that runs to the end of the text holds the empty line after a final newline, too.
    last = breaks[-1] + 1 if breaks else 0
    runs_on = [mark for spans, mark in ((comment, 1), (code, 2)) if spans and spans[-1][1] == len(text) and spans[-1][0] < last == len(text)]
    if last == len(text):
        marks = marks[:-1] if not runs_on else marks[:-1] + [runs_on[0]]
    return Counts(sum(m >= 2 for m in marks), sum(m == 1 for m in marks), sum(m == 0 for m in marks))


def _literate(text: str) -> Counts:
    """Prose and fence lines are comments; the body of a fence that names a language is left out."""
    comment = blank = 0
    fence: str | None = None
    for line in text.split("\n")[: -1 if text.endswith("\n") or not text else None]:
        line = line.strip(" \t\f\r")
        if not line:
            blank += 1
        elif line.startswith(("```", "~~~")):
            comment += 1
            fence = line[3:].strip(" \t\f\r") if fence is None else None
        elif not fence:
            comment += 1
    return Counts(0, comment, blank)


def blind(kind: str, text: str | None, mode: str) -> str | None:
    """Text that stays of a token: all, all but literals, or punctuation alone."""
    if text is None or mode == "strict" or kind == PUNCT:
        return text
    return text if mode == "mild" and kind == IDENT else None


def key(token: Token, mode: str) -> str:
    """What is hashed of a token: its kind and what blinding leaves of its text."""
    return token.kind + (blind(token.kind, token.text, mode) or "")


_PLAIN = re.compile(r"[A-Za-z0-9_]+|[^ \t\n\f\r]")


def is_plain(lang: Language) -> bool:
    """Whether a language has neither comments nor strings, so that its tokens are words and single characters."""
    return not (lang.literate or lang.line or lang.block or lang.nested_comments or lang.quotes or lang.doc_quotes or lang.verbatim)


class _Kinds(dict):
    """(kind, text) of the tokens of plain text, each found once."""

    def __missing__(self, token: str) -> tuple[str, str | None]:
        if len(self) >= 200_000:
            self.clear()
        c = token[0]
        word = c < "\x80" and (c.isalnum() or c == "_")
        value = self[token] = (NUMBER if c.isdigit() else IDENT, token) if word else (PUNCT, token if c < "\x80" else None)
        return value


class _Keys(dict):
    """Keys of the tokens of plain text under a blinding mode."""

    def __init__(self, mode: str) -> None:
        self.mode = mode

    def __missing__(self, token: str) -> str:
        if len(self) >= 200_000:
            self.clear()
        kind, text = _kinds[token]
        value = self[token] = kind + (blind(kind, text, self.mode) or "")
        return value


_kinds = _Kinds()
_keys: dict[str, _Keys] = {}


def pairs(content: bytes, lang: str) -> list[tuple[str, str | None]]:
    """(kind, text) of each token, without places."""
    found = by_key().get(lang)
    if found is None:
        return []
    if is_plain(found):
        return list(map(_kinds.__getitem__, _PLAIN.findall(content.decode("latin-1"))))
    return [(t.kind, t.text) for t in scan(content, found)[0]]


def keys(content: bytes, lang: str, mode: str) -> list[str]:
    """Key of each token."""
    found = by_key().get(lang)
    if found is None:
        return []
    if is_plain(found):
        return list(map(_keys.setdefault(mode, _Keys(mode)).__getitem__, _PLAIN.findall(content.decode("latin-1"))))
    return [key(t, mode) for t in scan(content, found)[0]]


def counts(content: bytes, lang: str) -> Counts:
    """Line counts; plain text needs no tokens for them."""
    found = by_key().get(lang)
    if found is None:
        return Counts(0, 0, 0)
    if not is_plain(found):
        return scan(content, found)[1]
    lines = content.split(b"\n")
    if not lines[-1]:
        lines.pop()
    code = sum(1 for line in lines if line.strip(b" \t\f\r"))
    return Counts(code, 0, len(lines) - code)


def process(content: bytes, lang: str) -> tuple[list[Token], Counts]:
    """Tokens and counts by language key; an unknown key gives none."""
    found = by_key().get(lang)
    return scan(content, found) if found else ([], Counts(0, 0, 0))
