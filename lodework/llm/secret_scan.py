"""Secret scans (operator 7): fixed patterns, and assignment-aware lexing beside them.

The lexer reads the syntax of sources and configuration: string literals of all usual kinds (escaped,
triple, heredocs, indented YAML blocks), comments, keys, and the operators that bind a literal to a name
(`=`, `:=`, `:`, `=>`, annotated and keyword forms, subscripts, `name`/`value` pairs, XML
attributes and elements, command-line flags, setter calls). A binding holds literals and names of
constants. Constants are followed: a name means its last binding before, or, where there is none,
the first one after, and a binding to anything that can't be read (a call) unsets it. How sensitive
a name is flows along the bindings to every literal that reaches it; a literal is a secret when that
and its own look (length, evenness and mixture of characters) together say so.

Every step is linear in the text but for logarithms: each character is lexed once, bindings are
looked up by bisection, and the sensitivity of names spreads over each binding once.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.llm.common import with_columns

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A maximal run of hex digits; runs under 24 are dropped, so only long ones are sought.
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "lexed")

#: Parts of names that a secret is bound to, and how much each says.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "apikey": 1.0, "token": 0.8, "credential": 0.8,
    "credentials": 0.8, "bearer": 0.8, "auth": 0.6, "private": 0.5, "key": 0.5, "access": 0.4, "api": 0.4, "signing": 0.4, "encryption": 0.4,
}
#: Values that stand for a secret without being one.
PLACEHOLDERS = frozenset(("none", "null", "true", "false", "undefined", "changeme", "example", "placeholder", "your", "xxxx", "todo", "string", "password", "secret", "token"))
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Together a name and a literal reach MIN_SCORE; a literal's own strength is over MIN_STRENGTH.
MIN_LITERAL, MIN_SCORE, MIN_STRENGTH = 8, 1.6, 0.5
#: Literals up to this length are read together with those that they are joined with; longer ones speak for themselves.
JOINED = 256

NAME = r"[.-]*+[A-Za-z_$@][A-Za-z0-9_$]*+(?:[.-]+[A-Za-z0-9_$]++)*+"
BEGIN = r"(?<![A-Za-z0-9_$.-])"
OPERATOR = r"(?::=|=>|\?=|\+=|=|:)(?![=:/])"
STRING = (
    r'(?:\b[rbfuRBFU]{1,2})?(?:"""(?:[^"\\]++|\\.|"(?!""))*+"""|"(?:[^"\\\n]++|\\.)*+")'
    r"|(?<![A-Za-z0-9_])(?:[rbfuRBFU]{1,2})?(?:'''(?:[^'\\]++|\\.|'(?!''))*+'''|'(?:[^'\\\n]++|\\.)*+')"
)
#: What the scan stops at: line ends with a comment mark, comments, strings (keys when an operator follows), bound names, flags and elements.
SITE = re.compile(
    rf"""(?P<line>\n[ \t]*+(?P<note>\#|//|--\s|/?\*|<!--|;|%)?)|(?P<comment>(?<=[ \t;])(?:\#|//)(?=\s))
|(?P<string>{STRING})(?:[\])]*+[ \t]*+(?P<bind>{OPERATOR})|(?P<comma>[ \t]*+,[ \t\n]*+))?
|(?<![\w-])(?P<flag>--[A-Za-z][\w-]*+)(?=[ \t]++["'A-Za-z0-9+/])
|{BEGIN}(?P<name>{NAME})[\])]*+[ \t]*+(?P<op>{OPERATOR})
|<(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*+)>(?P<body>[^<\n]++)(?=</)|(?P<open>\()|(?P<close>\))""",
    re.S | re.X,
)
VALUE = re.compile(rf"[ \t(]*+(?:(?P<string>{STRING})|\$\{{?(?P<var>[A-Za-z_]\w*+)\}}?|(?P<bare>[A-Za-z0-9+/_.=~-]++))", re.S)
JOIN = re.compile(r"""[ \t)]*+(?:(?:\+|\.\.?|&|\|\||\?\?|\\\n|(?:or|else)\b)[ \t\n]*+(?=["'A-Za-z_$(])|(?=["']))""")
ANNOTATED = re.compile(r"[ \t]*+(?P<type>[A-Za-z_][A-Za-z0-9_.]*+)(?:\[[^\]\n=]*+\])?[?!]?[ \t]*+:?=(?![=>])")
BLOCK = re.compile(r"[ \t]*+[|>][+-]?[0-9]?[+-]?[ \t]*+\n")
HEREDOC = re.compile(r"""[ \t]*+(?:"?\$\(cat[ \t]++)?<<[-~]?[ \t]*+["']?([A-Za-z_]\w*+)["']?[^\n]*+\n""")
LONE_WORD = re.compile(r"^[ \t]*+(\w++)[ \t;)\"]*+$", re.M)
INSIDE = re.compile(r"\$\{(\w+)\}|\{(\w+)\}")
IDENTIFIER = re.compile(r"[A-Za-z_$@][A-Za-z0-9_$.-]*")
LABELS, CONTENTS = frozenset(("name", "key", "id", "property")), frozenset(("value", "content", "default"))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The contract's matches: leftmost, non-overlapping per kind, failing ones dropped."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


@functools.lru_cache(1 << 16)
def sensitivity(name: str) -> float:
    """How strongly a name says that its value is secret: the sum over its parts, 1 at most."""
    parts = [p.lower() for p in PART.findall(name)]
    joined = name.lower().replace("_", "").replace("-", "")
    score = sum(SENSITIVE.get(p, 0.0) for p in set(parts))
    return min(1.0, max(score, *(w for s, w in SENSITIVE.items() if len(s) > 5 and joined.endswith(s)), 0.0))


def may_hold(text: str) -> bool:
    """Whether a name with any sensitivity can stand in the text: its parts are found once case and word joiners are gone."""
    low = text.lower().replace("_", "").replace("-", "")
    return any(s in low for s in SENSITIVE)


def strength(value: str) -> float:
    """0 for words, placeholders and running text, towards 1 for long literals of mixed, evenly used characters."""
    lines = value.split("\n")
    if any(" " in x.strip() for x in lines) and "PRIVATE KEY" not in value:
        return 0.0
    value = "".join(x.strip() for x in lines)
    if len(value) < MIN_LITERAL or value.lower() in PLACEHOLDERS or len(set(value)) < 5:
        return 0.0
    n, many = len(value), Counter(value)
    bits = math.log2(n) - sum(c * math.log2(c) for c in many.values() if c > 1) / n
    classes = len({"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "+" for c in many})
    return min(1.0, bits / 4) * (0.4 + 0.2 * classes if classes > 1 else 0.4)


@dataclass
class Binding:
    """Names bound to an expression: the literals (start, end, text) and the names that it is made of."""

    at: int
    names: list[str]
    literals: list[tuple[int, int, str]] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    #: Comments and keyword arguments bind nothing that later names can mean.
    constant: bool = True


def _plain(name: str) -> str:
    return name if name[0] not in "$@.-ts" else re.sub(r"^(?:(?:this|self)\.|[$@.-])+", "", name)


def _content(token: str) -> str:
    token = token.lstrip("rbfuRBFU")
    return token[3:-3] if token[:3] in ('"""', "'''") and len(token) >= 6 else token[1:-1]


class _Lexer:
    def __init__(self, text: str):
        self.text, self.found, self.ends = text, [], None

    def _terminator(self, word: str, at: int) -> re.Match | None:
        """The first line after `at` that holds this word alone."""
        if self.ends is None:
            self.ends = {}
            for m in LONE_WORD.finditer(self.text):
                self.ends.setdefault(m[1], []).append(m)
        rows = self.ends.get(word, [])
        i = bisect_left(rows, at, key=lambda m: m.start())
        return rows[i] if i < len(rows) else None

    def _block(self, at: int, indent: int) -> int:
        """Where the lines that are indented deeper than `indent` end."""
        text = self.text
        while at < len(text):
            to = text.find("\n", at)
            to = len(text) if to < 0 else to
            line = text[at:to]
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            at = to + 1
        return min(at, len(text))

    def _value(self, b: Binding, at: int, colon: bool, indent: int) -> int:
        """Read the expression at `at` into the binding; returns where it ends. An expression that can't be read leaves the binding empty."""
        text = self.text
        if colon and (m := ANNOTATED.match(text, at)):
            b.names.append(m["type"])
            at, colon = m.end(), False
        if colon and (m := BLOCK.match(text, at)):
            to = self._block(m.end(), indent)
            body = text[m.end() : to]
            start = m.end() + len(body) - len(body.lstrip())
            if body.strip():
                b.literals.append((start, m.end() + len(body.rstrip()), body.strip()))
            return max(at, to - 1)
        if m := HEREDOC.match(text, at):
            end = self._terminator(m[1], m.end())
            if end is not None:
                body = text[m.end() : end.start()]
                if body.strip():
                    b.literals.append((m.end(), m.end() + len(body.rstrip()), body.strip()))
                return end.end()
            return m.end() - 1
        first = True
        while m := VALUE.match(text, at):
            if m["string"] is not None:
                inner = _content(m["string"])
                b.literals.append((m.start("string"), m.end("string"), inner))
                if len(inner) <= JOINED:
                    b.refs += [x or y for x, y in INSIDE.findall(inner)]
            elif m["var"] is not None:
                b.refs.append(m["var"])
            else:
                word, nxt = m["bare"], text[m.end() : m.end() + 1]
                if nxt in ("(", "["):  # a call or an element can't be read; what was read before it counts
                    return at
                if IDENTIFIER.fullmatch(word):
                    b.refs.append(_plain(word))
                if first and any(c.isdigit() for c in word) and any(c.isalpha() for c in word) and nxt not in ("'", '"'):
                    b.literals.append((m.start("bare"), m.end("bare"), word))
            at, first = m.end(), False
            if (j := JOIN.match(text, at)) is None:
                break
            at = j.end()
        return at

    def bindings(self) -> list[Binding]:
        text, at, depth, line, label = self.text, 0, 0, 0, None
        note = re.match(r"[ \t]*(?:#|//|--\s|/?\*|<!--|;|%)", text) is not None
        while m := SITE.search(text, at):
            at = m.end()
            if m["line"] is not None:
                note, line = m["note"] is not None, m.start() + 1
                depth = 0 if at == line else depth  # a line that isn't indented begins anew
            elif m["comment"] is not None:
                note = True
            elif m["open"] is not None:
                depth += 1
            elif m["close"] is not None:
                depth = max(0, depth - 1)
            elif m["tag"] is not None:
                body = m["body"].strip()
                start = m.start("body") + m["body"].index(body)
                self.found.append(Binding(m.start(), [m["tag"]], [(start, start + len(body), body)], constant=False))
            elif m["flag"] is not None:
                b = Binding(m.start(), [m["flag"]], constant=False)
                at = max(at, self._value(b, at, False, 0))
                b.refs.clear()  # arguments are no names
                self.found.append(b)
            else:
                group = "name" if m["name"] is not None else "string"
                start, op = m.start(group), m["op"] or m["bind"]
                key = m["name"] if group == "name" else _content(m["string"])
                setter = m["comma"] is not None and text[start - 1 : start] == "("
                if group == "string" and not ((op or setter) and IDENTIFIER.fullmatch(key)):
                    at = m.end("string")
                    continue
                b = Binding(start, [key], constant=not (note or setter or (depth and op == "=")))
                indent = start - line if not text[line:start].strip(" \t-\"'") else 0
                at = max(at, self._value(b, at, op == ":", indent))
                if op == "+=":
                    b.refs.append(_plain(key))
                low = key.lower()
                if label and low in CONTENTS and start - label[1] < 64 and not text[label[1] : start].strip(" \t\n,-"):
                    b.names.append(label[0])
                one = b.literals[0][2] if len(b.literals) == 1 else b.refs[0] if len(b.refs) == 1 else ""
                label = (one, at) if low in LABELS and IDENTIFIER.fullmatch(one) else None
                self.found.append(b)
        return self.found


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    if not may_hold(text):
        return []
    found = _Lexer(text).bindings()
    by_name: dict[str, list[int]] = {}
    for i, b in enumerate(found):
        if b.constant:
            for n in dict.fromkeys(map(_plain, b.names)):
                by_name.setdefault(n, []).append(i)

    def meant(name: str, i: int) -> int | None:
        """The binding that a name means in binding i: the last before, else the first after."""
        rows = by_name.get(name)
        if not rows:
            return None
        j = bisect_left(rows, i)
        if j:
            return rows[j - 1]
        return next((r for r in rows[:2] if r != i), None)

    leads = [[j for r in dict.fromkeys(b.refs) if (j := meant(r, i)) is not None] for i, b in enumerate(found)]
    own = [max(map(sensitivity, b.names)) for b in found]
    reach = [0.0] * len(found)
    for i in sorted(range(len(found)), key=lambda i: -own[i]):  # the most sensitive first, so that each binding is reached once
        if own[i] + 1.0 < MIN_SCORE:
            break
        work = [i]
        while work:
            j = work.pop()
            if reach[j] == 0.0:
                reach[j] = own[i]
                work += leads[j]
    out = set()
    for i, b in enumerate(found):
        if reach[i] == 0.0:
            continue
        # A bare word that names a constant is no literal.
        known = {r for r in b.refs if meant(r, i) is not None}
        mine = [x for x in b.literals if text[x[0] : x[1]] != x[2] or _plain(x[2]) not in known]
        parts = mine + [x for j in leads[i] for x in found[j].literals if len(x[2]) <= JOINED]
        for group in (parts, *([x] for x in mine if len(parts) > 1)):
            score = strength("".join(x[2] for x in group))
            if score > MIN_STRENGTH and reach[i] + score >= MIN_SCORE:
                out.update((a, e, "lexed") for a, e, t in group if t)
    return sorted(out)


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base ones and lexed ones that overlap none of them."""
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    starts, ends, most = [b[0] for b in base], [], 0
    for b in base:
        most = max(most, b[1])
        ends.append(most)
    more = []
    for s in lexed_spans(text):
        n = bisect_left(starts, s[1])  # base spans that begin before this one ends
        if not n or ends[n - 1] <= s[0]:
            more.append(s)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with the counts, base_sha256 and spans of every row; no shuffle.

    Null and empty texts have no spans. Positions are code points, ends exclusive. Texts of any length
    are scanned whole, in time linear in their length. Repeated rows are scanned one by one; a
    column of docs that has the name of a result is replaced, other columns stay. An empty table
    gives an empty result.
    """

    def begin():
        def work(texts):
            rows = []
            for t in texts:
                base, spans = scan(t)
                n = Counter(k for *_, k in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            return list(zip(*rows, strict=True)) if rows else [[]] * 5

        return work

    return with_columns(docs, text, {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}, begin)


def masked(text: str, mask: str) -> str:
    out, at = [], 0
    for a, b in sorted((a, b) for a, b, _ in scan(text)[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of every text replaced by the mask; overlapping spans are masked as one. Nulls stay null, all other columns, whatever their names, as they are."""

    def begin():
        return lambda texts: [[masked(t, mask) for t in texts]]

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__text"))
    made = with_columns(packed, "__text", {"__clean": pa.string()}, begin)
    clean = F.when(F.col("__row")[text].isNotNull(), F.col("__clean"))
    return made.select(*[(clean if c == text else F.col("__row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; n_chars follows the new text where docs has it."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out
