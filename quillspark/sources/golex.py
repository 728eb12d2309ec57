"""A lexer for Go source: tokens with offsets and lines, semicolons inserted as the language defines."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # ident, keyword, int, float, imag, char, string, op, eof
    text: str
    pos: int
    end: int
    line: int


class GoSyntaxError(ValueError):
    """The text isn't a Go source file."""


# The language's keywords and operators.
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
OPERATORS = (
    "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()
)
_ENDS_STATEMENT = frozenset("break continue fallthrough return".split()) | frozenset(("++", "--", ")", "]", "}"))

_SPACE = re.compile(r"[ \t\r]+")
_IDENT = re.compile(r"[^\W\d]\w*")
_NUMBER = re.compile(
    r"(?P<hexfloat>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9_]+)"
    r"|(?P<base>0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+)"
    r"|(?P<float>[0-9][0-9_]*\.[0-9_]*(?:[eE][+-]?[0-9_]+)?|[0-9][0-9_]*[eE][+-]?[0-9_]+|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)"
    r"|(?P<int>[0-9][0-9_]*)"
)
_STRING = re.compile(r'"(?:[^"\\\n]|\\[^\n])*"')
_CHAR = re.compile(r"'(?:[^'\\\n]|\\[^\n]{1,9}?)'")
_OP = re.compile("|".join(map(re.escape, OPERATORS)))


def lex(src: str) -> list[Token]:
    """All tokens but comments, an eof at the end."""
    out: list[Token] = []
    at, n, line = 0, len(src), 1
    if src.startswith("﻿"):
        at = 1

    def wants_semicolon() -> bool:
        if not out:
            return False
        t = out[-1]
        return t.kind not in ("op", "keyword") or t.text in _ENDS_STATEMENT

    while at < n:
        c = src[at]
        if c == "\n":
            if wants_semicolon():
                out.append(Token("op", "\n", at, at + 1, line))
            line, at = line + 1, at + 1
            continue
        if m := _SPACE.match(src, at):
            at = m.end()
            continue
        if src.startswith("//", at):
            end = src.find("\n", at)
            at = n if end < 0 else end
            continue
        if src.startswith("/*", at):
            end = src.find("*/", at + 2)
            if end < 0:
                raise GoSyntaxError("comment not terminated")
            inner = src.count("\n", at, end)
            if inner and wants_semicolon():
                out.append(Token("op", "\n", at, at, line))
            line, at = line + inner, end + 2
            continue
        if c == "`":
            end = src.find("`", at + 1)
            if end < 0:
                raise GoSyntaxError("raw string not terminated")
            out.append(Token("string", src[at : end + 1], at, end + 1, line))
            line, at = line + src.count("\n", at, end), end + 1
            continue
        if m := _IDENT.match(src, at):
            kind = "keyword" if m[0] in KEYWORDS else "ident"
        elif m := _NUMBER.match(src, at):
            kind = "float" if m["float"] or m["hexfloat"] else "int"
            if src.startswith("i", m.end()):
                out.append(Token("imag", m[0] + "i", at, m.end() + 1, line))
                at = m.end() + 1
                continue
        elif m := _STRING.match(src, at):
            kind = "string"
        elif m := _CHAR.match(src, at):
            kind = "char"
        elif m := _OP.match(src, at):
            kind = "op"
        else:
            raise GoSyntaxError(f"unexpected {c!r} in line {line}")
        out.append(Token(kind, m[0], at, m.end(), line))
        at = m.end()
    if wants_semicolon():
        out.append(Token("op", "\n", n, n, line))
    out.append(Token("eof", "", n, n, line))
    return out


def code_lines(src: str) -> int:
    """Distinct lines on which a token starts, inserted semicolons included."""
    return len({t.line for t in lex(src) if t.kind != "eof"}) if src else 0
