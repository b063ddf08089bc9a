"""Tokens, string literals and calls of Go, Rust and C++ sources; tolerant of anything."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

# The lexical grammar of each language, as far as strings, comments and names go.
_COMMON = r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
_NAME, _NUMBER, _SPACE = r"(?P<name>[^\W\d]\w*)", r"(?P<number>\d[\w.]*)", r"(?P<space>\s+)"
GRAMMARS = {
    "go": rf"{_COMMON}|(?P<string>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`)|(?P<char>'(?:\\.|[^'\\\n])+')|{_NAME}|{_NUMBER}|{_SPACE}|(?P<op>:=|\.\.\.|[-+*/%&|^]=|[-+&|=<>]{{2}}|.)",
    "rust": rf"{_COMMON}|(?P<string>b?r(?P<h>#*)\".*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\")|(?P<char>b?'(?:\\.[^']*|[^'\\\n])')|{_NAME}|{_NUMBER}|{_SPACE}|(?P<op>::|=>|->|.)",
    "cpp": rf"{_COMMON}|(?P<string>(?:u8|[uUL])?R\"(?P<d>[^(\s\\]*)\(.*?\)(?P=d)\"|(?:u8|[uUL])?\"(?:\\.|[^\"\\\n])*\")|(?P<char>'(?:\\.|[^'\\\n])+')|{_NAME}|{_NUMBER}|{_SPACE}|(?P<op>::|->|.)",
}
_PATTERNS = {lang: re.compile(p, re.S) for lang, p in GRAMMARS.items()}
_OPEN = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    at: int


def tokens(lang: str, source: str) -> list[Token]:
    """All but comments and white space. Lines count from 1."""
    starts = [m.end() for m in re.finditer("\n", source)]
    out = []
    for m in _PATTERNS[lang].finditer(source):
        kind = m.lastgroup if m.lastgroup not in ("h", "d") else "string"
        if kind not in ("comment", "space"):
            out.append(Token(kind, m[0], bisect.bisect_right(starts, m.start()) + 1, m.start()))
    return out


def closing(toks: list[Token], i: int) -> int:
    """Index of what closes the bracket at i, or the end."""
    depth = 0
    for j in range(i, len(toks)):
        if toks[j].kind == "op":
            if toks[j].text in _OPEN:
                depth += 1
            elif toks[j].text in _OPEN.values():
                depth -= 1
                if depth == 0:
                    return j
    return len(toks)


def opening(toks: list[Token], i: int) -> int:
    """Index of what opens the bracket closed at i, or 0."""
    depth = 0
    for j in range(i, -1, -1):
        if toks[j].kind == "op":
            if toks[j].text in _OPEN.values():
                depth += 1
            elif toks[j].text in _OPEN:
                depth -= 1
                if depth == 0:
                    return j
    return 0


def split_args(toks: list[Token]) -> list[list[Token]]:
    """Parts between commas outside brackets; empty ones are left out."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in toks:
        if t.kind == "op" and t.text in _OPEN:
            depth += 1
        elif t.kind == "op" and t.text in _OPEN.values():
            depth -= 1
        if t.kind == "op" and t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [a for a in out if a]


def content(text: str) -> str:
    """What a string literal holds, escapes left as a space: they only part words."""
    m = re.match(r'(?:u8|[uUL])?R"([^(\s\\]*)\((.*)\)\1"\Z', text, re.S)
    if m:
        return m[2]
    m = re.match(r'b?r(#*)"(.*)"\1\Z', text, re.S)
    if m:
        return m[2]
    if text.startswith("`"):
        return text[1:-1]
    return re.sub(r"\\.", " ", text[text.index('"') + 1 : -1], flags=re.S)


def unquote(text: str) -> str:
    """A literal without prefix letters, hashes and its quotes; escapes stay as written."""
    t = text.strip().lstrip("rbf").strip("#")
    return t[1:-1] if len(t) >= 2 and t[0] == t[-1] and t[0] in '"`' else t


def literals(lang: str, source: str) -> list[tuple[str, int]]:
    """(content, first line) of each string literal; C++ literals next to each other are one."""
    out: list[tuple[str, int]] = []
    last = None
    for t in tokens(lang, source):
        if t.kind == "string":
            if lang == "cpp" and last is not None and last.kind == "string":
                out[-1] = (out[-1][0] + " " + content(t.text), out[-1][1])
            else:
                out.append((content(t.text), t.line))
        last = t
    return out
