"""Function slicer: one granule for each function, nested ones too.

Comments and strings are blanked out first (length and line breaks stay), so headers and braces are found by regular
expressions on what is left; Python is sliced by indentation and Ruby by matching ``end``.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .languages import by_key
from .tokens import STRING, scan, scanner


class Granule(NamedTuple):
    name: str | None
    byte_start: int
    byte_end: int
    line_start: int
    line_end: int

    @property
    def line_count(self) -> int:
        return self.line_end - self.line_start + 1


_NAME = r"(?P<name>[A-Za-z_~$][\w$]*)"
_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
_TYPE = r"(?:[A-Za-z_][\w:.<>,\[\]?&* \t]*[\s&*>\]])"
_NOT = r"(?!(?:if|for|while|switch|catch|return|else|do|new|function|using|lock|sizeof|throw|await|foreach|fixed|synchronized|super|this)\b)"
_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|synchronized|native|default|readonly|partial|unsafe|extern|new)\s+)*"

_JS = (
    rf"(?:async\s+)?function\s*\*?\s*{_NAME}\s*(?:<[^<>]*>)?\s*{_ARGS}\s*(?::[^{{;=]+)?",
    rf"(?:^|(?<=[{{}};]))[ \t]*(?P<start>(?:(?:static|async|get|set|public|private|protected|readonly)\s+)*\*?{_NOT}(?P<name2>#?[A-Za-z_$][\w$]*)\s*(?:<[^<>]*>)?\s*{_ARGS}\s*(?::[^{{;=()]+)?)(?=\{{)",
)
_C = (rf"(?:^|(?<=[{{}};]))(?P<start>[ \t]*(?:(?:static|inline|extern|const|constexpr|virtual|explicit|friend|template\s*<[^<>]*>)\s+)*{_TYPE}?{_NOT}(?P<name>[A-Za-z_~][\w:~]*)\s*{_ARGS}\s*(?:const|noexcept|override|final|->\s*[\w:<>*& ]+|:\s*[^{{;]+|\s)*)(?=\{{)",)
HEADERS = {
    "Rust": (rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s+\"\w*\")?)\s+)*fn\s+{_NAME}[^{{;]*",),
    "Go": (rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}[^{{;\n]*",),
    "JavaScript": _JS,
    "TypeScript": _JS,
    "Java": (rf"(?:^|(?<=[{{}};]))[ \t]*(?P<start>{_MODIFIERS}(?:<[^<>]*>\s*)?(?:{_TYPE})?{_NOT}{_NAME}\s*{_ARGS}\s*(?:throws\s+[\w.,\s]+)?)(?=\{{)",),
    "CSharp": (rf"(?:^|(?<=[{{}};]))[ \t]*(?P<start>{_MODIFIERS}(?:{_TYPE})?{_NOT}{_NAME}\s*(?:<[^<>]*>)?\s*{_ARGS}\s*(?::\s*(?:base|this)\s*{_ARGS}\s*)?(?:where[^{{;]+)?)(?=\{{)",),
    "C": _C,
    "Cpp": _C,
    "Gleam": (rf"^(?:pub\s+)?fn\s+{_NAME}\s*{_ARGS}[^{{\n]*",),
}
ALIASES = {"CHeader": "C", "CppHeader": "Cpp", "CppModule": "Cpp", "Tsx": "TypeScript", "Jsx": "JavaScript"}
SUPPORTED = frozenset((*HEADERS, "Python", "Ruby", *ALIASES))


def supports(lang: str) -> bool:
    return lang in SUPPORTED


def bare(content: bytes, lang: str) -> str:
    """The text, a character a byte, with comments and strings turned to spaces."""
    text, language = content.decode("latin-1"), by_key()[lang]
    out, at = list(text), 0
    keep = [(t.start, t.end) for t in scan(content, language)[0] if t.kind != STRING]
    for start, end in [*keep, (len(text), len(text))]:
        out[at:start] = ["\n" if c == "\n" else " " for c in text[at:start]]
        at = end
    return "".join(out)


def _closing(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


def _braces(text: str, key: str) -> list[tuple[str, int, int]]:
    found = {}
    for header in HEADERS[key]:
        for m in re.finditer(header, text, re.M):
            groups = m.groupdict()
            start = m.start("start") if "start" in groups else m.start()
            start += len(text[start : m.end()]) - len(text[start : m.end()].lstrip())
            if text[m.end() : m.end() + 1] == "{" and (end := _closing(text, m.end())) > 0:
                name = groups.get("name") or groups.get("name2")
                found.setdefault(m.end(), (name.rpartition("::")[2] if key in ("C", "Cpp") else name, start, end))
    return sorted(found.values(), key=lambda x: (x[1], -x[2]))


def _python(text: str) -> list[tuple[str, int, int]]:
    out, lines = [], text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    for k, line in enumerate(lines):
        m = re.match(r"([ \t]*)(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)", line)
        if not m:
            continue
        indent, depth, last, header = len(m[1].expandtabs(8)), 0, k, True
        for j in range(k, len(lines)):
            body = lines[j]
            if not header and body.strip() and len(body) - len(body.lstrip()) <= len(m[1]) and len(body[: len(body) - len(body.lstrip())].expandtabs(8)) <= indent and depth <= 0:
                break
            if body.strip():
                last = j
            depth += sum(body.count(c) for c in "([{") - sum(body.count(c) for c in ")]}")
            if header and depth <= 0 and ":" in body:
                header = False
        out.append((m[2], starts[k] + len(m[1]), starts[last] + len(lines[last].rstrip())))
    return out


_RUBY = re.compile(r"(?P<def>\bdef\s+(?:self\.|[A-Za-z_]\w*\.)?(?P<name>[A-Za-z_]\w*[?!=]?))|(?P<open>(?:^|[;=(]|\|\|=)\s*\b(?:if|unless|while|until|case|begin|for)\b|\b(?:class|module|do)\b)|(?P<end>\bend\b)", re.M)


def _ruby(text: str) -> list[tuple[str, int, int]]:
    out, stack = [], []
    for m in _RUBY.finditer(text):
        if m["end"]:
            if stack and (top := stack.pop()):
                out.append((top[0], top[1], m.end()))
        else:
            stack.append((m["name"], m.start()) if m["def"] else None)
    return sorted(out, key=lambda x: (x[1], -x[2]))


def slice_functions(content: bytes, lang: str) -> list[Granule]:
    """Functions in order of their start; none for a language that is not supported."""
    if not supports(lang):
        return []
    text, key = bare(content, lang), ALIASES.get(lang, lang)
    if key == "Python":  # a docstring at the end belongs to its function, so it must not look blank
        text = _with_strings(content, lang, text)
    found = _python(text) if key == "Python" else _ruby(text) if key == "Ruby" else _braces(text, key)
    return [Granule(name, start, end, text.count("\n", 0, start) + 1, text.count("\n", 0, end) + 1) for name, start, end in found]


def _with_strings(content: bytes, lang: str, text: str) -> str:
    out = list(text)
    for m in scanner(by_key()[lang])[0].finditer(content.decode("latin-1")):
        if m.lastgroup[0] == "e" or (m.lastgroup[0] == "s" and m.lastgroup != "space"):
            out[m.start() : m.end()] = ["\n" if c == "\n" else "'" for c in m[0]]
            for x in re.finditer("\n", m[0]):  # string lines are never shallower than the code around them
                at = m.start() + x.end()
                if at < m.end():
                    out[at] = "\t" if out[at] != "\n" else "\n"
    return "".join(out)
