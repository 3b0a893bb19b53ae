"""Tokens of C# source: comments, preprocessor lines and white space are dropped.

A string is several tokens, its quotes, runs of content, escapes and, if interpolated, the tokens of
its expressions. Lines are 1-based, columns 1-based and counted in bytes of UTF-8.
"""

from __future__ import annotations

import re
from typing import NamedTuple

KEYWORDS = frozenset(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()
)
PREDEFINED = frozenset("bool byte char decimal double float int long object sbyte short string uint ulong ushort void".split())


class Token(NamedTuple):
    kind: str  # identifier, keyword, integer_literal, real_literal, char_literal, string_quote, string_content, string_escape, punctuation
    text: str
    at: int
    end: int


_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?[fFdDmM]?|\d[\d_]*(?:[eE][+-]?\d+[fFdDmM]?|[fFdDmM])|\d[\d_]*[uUlL]*")
_IDENTIFIER = re.compile(r"@?[^\W\d]\w*")
_PUNCTUATION = re.compile(r">>>=|\?\?=|<<=|\.\.|=>|::|->|&&|\|\||\+\+|--|\?\?|[+\-*/%&|^<>=!]=|<<|[{}()\[\];:,.<>+\-*/%&|^!~=?]")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.)", re.S)
_CHAR = re.compile(r"'(?:\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.)|[^'\\\n])'")
_SPACE = re.compile(r"[\s﻿]+")
_OPEN = re.compile(r'(\$*)(@?)(\$*)("+)')


class Lexer:
    def __init__(self, text: str):
        self.text, self.out, self.errors = text, [], 0

    def run(self) -> list[Token]:
        self._code(0, None)
        return self.out

    def _add(self, kind: str, a: int, b: int) -> None:
        if b > a:
            self.out.append(Token(kind, self.text[a:b], a, b))

    def _code(self, i: int, closing: str | None) -> int:
        """Tokens from i on; inside an interpolation up to its closing brace or format colon."""
        text, n, depth, line_start = self.text, len(self.text), 0, i == 0
        while i < n:
            c = text[i]
            if m := _SPACE.match(text, i):
                line_start |= "\n" in m[0]
                i = m.end()
                continue
            if c == "#" and line_start and closing is None:
                j = text.find("\n", i)
                i = n if j < 0 else j
                continue
            line_start = False
            if text.startswith("//", i):
                j = text.find("\n", i)
                i = n if j < 0 else j
                continue
            if text.startswith("/*", i):
                j = text.find("*/", i + 2)
                self.errors += j < 0
                i = n if j < 0 else j + 2
                continue
            if closing is not None:
                if depth == 0 and (text.startswith(closing, i) or (c == ":" and not text.startswith("::", i))):
                    return i
                depth += (c in "([{") - (c in ")]}")
            if (m := _OPEN.match(text, i)) and (c in '"$@'):
                i = self._string(m)
                continue
            if c == "'":
                m = _CHAR.match(text, i)
                self.errors += m is None
                end = m.end() if m else i + 1
                self._add("char_literal", i, end)
                i = end
                continue
            if c.isdigit() or (c == "." and text[i + 1 : i + 2].isdigit()):
                m = _NUMBER.match(text, i)
                body = m[0].lower()
                real = not body.startswith(("0x", "0b")) and ("." in body or "e" in body or body[-1] in "fdm")
                self._add("real_literal" if real else "integer_literal", i, m.end())
                i = m.end()
                continue
            if m := _IDENTIFIER.match(text, i):
                self._add("keyword" if m[0] in KEYWORDS else "identifier", i, m.end())
                i = m.end()
                continue
            m = _PUNCTUATION.match(text, i)
            self.errors += m is None
            end = m.end() if m else i + 1
            if m:
                self._add("punctuation", i, end)
            i = end
        return i

    def _string(self, m: re.Match) -> int:
        text, dollars, verbatim, quotes = self.text, len(m[1]) + len(m[3]), bool(m[2]), len(m[4])
        prefix = m.start(4)
        if quotes == 2 or (quotes > 2 and verbatim):
            raw, width = False, 1
        else:
            raw, width = quotes >= 3, quotes if quotes >= 3 else 1
        i = prefix + width
        self._add("string_quote", m.start(), i)
        begin, braces = i, "{" * max(1, dollars) if raw else "{"
        while i < len(text):
            if text.startswith('"' * width, i):
                if verbatim and not raw and text.startswith('""', i):
                    self._add("string_content", begin, i)
                    self._add("string_escape", i, i + 2)
                    i = begin = i + 2
                    continue
                self._add("string_content", begin, i)
                self._add("string_quote", i, i + width)
                return i + width
            if not raw and not verbatim and text[i] == "\\":
                self._add("string_content", begin, i)
                e = _ESCAPE.match(text, i)
                end = e.end() if e else i + 1
                self._add("string_escape", i, end)
                i = begin = end
                continue
            if not raw and not verbatim and text[i] == "\n":
                break
            if dollars and text.startswith(braces, i):
                if not raw and text.startswith("{{", i):
                    i += 2
                    continue
                self._add("string_content", begin, i)
                self._add("punctuation", i, i + len(braces))
                i = self._code(i + len(braces), "}" * len(braces))
                if text.startswith(":", i):
                    j = text.find("}", i)
                    j = len(text) if j < 0 else j
                    self._add("string_content", i, j)
                    i = j
                self._add("punctuation", i, min(len(text), i + len(braces)))
                i = begin = i + len(braces)
                continue
            i += 1
        self.errors += 1
        self._add("string_content", begin, i)
        return i


class Places:
    """Line and byte column of offsets."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def __call__(self, at: int) -> tuple[int, int]:
        from bisect import bisect_right

        line = bisect_right(self.starts, at)
        begin = self.starts[line - 1]
        return line, len(self.text[begin:at].encode("utf-8", "surrogatepass")) + 1


def tokens(text: str) -> tuple[list[Token], int]:
    """Tokens, and the number of places that could not be read."""
    lexer = Lexer(text)
    return lexer.run(), lexer.errors
