"""Scalar functions on columns: severity, rounding, path order, globs, labels and texts of breakdowns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity(metric: Column, threshold: Column) -> Column:
    """metric / threshold, or the metric where the threshold is 0."""
    return F.when(threshold == 0, metric.cast("double")).otherwise(metric / F.when(threshold != 0, threshold))


def rounded(value: Column, digits: int) -> Column:
    """round(value * 10^digits) / 10^digits in binary floating point, halves away from zero."""
    f = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * f + 0.5) / f


def path_order(path: Column) -> Column:
    """Orders paths by component, so that a/b comes before a-b."""
    return F.split(path, "/")


def line_count(text: Column) -> Column:
    """Last line number; a trailing newline begins one more line."""
    return F.size(F.split(text, "\n", -1)).cast("long")


def glob_regex(glob: str) -> str | None:
    """An anchored expression for a glob in which * and ? cross slashes; None for one that leaves its folder.

    A trailing slash means everything below. ** / [..] / {a,b} are known.
    """
    if ".." in glob.split("/"):
        return None
    glob = glob.removeprefix("./")
    if glob.endswith("/"):
        glob += "**"
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while glob.startswith("*", i + 1):
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 2)
            body = glob[i + 1 : j]
            out += "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]"
            i = j
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c) if not c.isalnum() and c not in "/_" else c
        i += 1
    return f"^(?:{out})$"


def any_glob(path: Column, globs: list[str]) -> Column:
    """Whether the path matches one of the globs."""
    tests = [path.rlike(r) for r in map(glob_regex, globs) if r]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


#: Endings of generated files, compared in lower case.
GENERATED_SUFFIXES = (".g.cs", ".g.i.cs", ".generated.cs", ".designer.cs", ".assemblyinfo.cs", ".assemblyattributes.cs")


def generated_by_path(path: Column, suffixes: tuple[str, ...] = GENERATED_SUFFIXES, folder: str = "obj") -> Column:
    low = F.lower(path)
    test = F.array_contains(F.split(low, "/"), folder)
    for s in suffixes:
        test = test | low.endswith(s)
    return test


def generated_by_header(content: Column, mark: bytes = b"<auto-generated", within: int = 1024) -> Column:
    """Whether the mark lies in the first bytes of binary content."""
    return F.instr(F.hex(F.substring(content, 1, within)), mark.hex().upper()) > 0
