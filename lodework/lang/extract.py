"""Tables of facts from source files: one pass of Python over the files, then plain columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lodework.functions.tables import Scratch
from lodework.lang.csharp import parse
from lodework.lang.lexer import Places, tokens

DECL = "idx int, name string, kind string, namespace string, parent int, modifiers int, attributes array<string>, bases array<array<string>>, explicit boolean, extension boolean, auto_property boolean, has_body boolean, arity int, cyclomatic int, cognitive int, body_lines int, required int, optional int, out int, line int, col int, fqn string"
FACTS = f"file_id int, path string, project int, generated_path boolean, is_generated boolean, has_errors boolean, top_level boolean, line_count int, decls array<struct<{DECL.replace(' ', ':').replace(',:', ',')}>>, refs array<struct<kind:string,path:array<string>,origin:int>>, usings array<struct<path:string,alias:string,is_global:boolean,is_static:boolean>>, lines array<string>"
HEADER = b"<auto-generated"
MARK = "lodework:"


@dataclass
class Facts:
    """files: a row a file; decls, refs and usings: a row each, with file_id; markers: lines that may hold a marker."""

    files: DataFrame
    decls: DataFrame
    refs: DataFrame
    usings: DataFrame
    markers: DataFrame


def facts_of(content: bytes | None, generated_path: bool) -> dict:
    if content is None:
        return {"is_generated": generated_path, "has_errors": True, "top_level": False, "line_count": 0, "decls": [], "refs": [], "usings": [], "lines": []}
    text = content.decode("utf-8-sig", "replace").replace("\r\n", "\n")
    p = parse(text)
    decls = [
        {"idx": i, "name": d.name, "kind": d.kind, "namespace": ".".join(d.namespace), "parent": d.parent, "modifiers": d.modifiers, "attributes": d.attributes, "bases": d.base_names, "explicit": d.explicit, "extension": d.extension, "auto_property": d.auto_property, "has_body": d.has_body, "arity": d.arity, "cyclomatic": d.cyclomatic, "cognitive": d.cognitive, "body_lines": d.body_lines, "required": d.required, "optional": d.optional, "out": d.out, "line": d.line, "col": d.column, "fqn": d.fqn}
        for i, d in enumerate(p.decls)
    ]
    refs = [{"kind": k, "path": path, "origin": o} for k, path, o in p.refs]
    usings = [{"path": ".".join(path), "alias": alias, "is_global": g, "is_static": s} for path, alias, g, s in p.usings]
    lines = text.split("\n")
    return {"is_generated": generated_path or HEADER in content[:1024], "has_errors": p.errors > 0, "top_level": p.top_level, "line_count": len(lines), "decls": decls, "refs": refs, "usings": usings, "lines": [f"{i + 1}:{x}" for i, x in enumerate(lines) if MARK in x]}


def extract(files: DataFrame, scratch: Scratch) -> Facts:
    """Facts of (file_id, path, project, is_generated, content); every file is parsed once, and all analyses share the written result."""

    schema = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, path, project, generated, content in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                row = {"file_id": i, "path": path, "project": project, "generated_path": generated} | facts_of(content, bool(generated))
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    made = scratch.save(files.select("file_id", "path", "project", "is_generated", "content").mapInArrow(run, FACTS), "facts")
    decls = made.select("file_id", "path", "project", "generated_path", "is_generated", F.inline("decls"))
    refs = made.select("file_id", "project", "has_errors", F.inline("refs")).withColumnRenamed("path", "segments")
    usings = made.select("file_id", "project", F.posexplode("usings").alias("n", "u")).select("file_id", "project", "n", "u.*")
    text = made.select(F.col("path").alias("file"), F.explode("lines").alias("x"))
    lines = text.select("file", F.substring_index("x", ":", 1).cast("int").alias("line"), F.expr("substr(x, instr(x, ':') + 1)").alias("content"))
    return Facts(made.drop("decls", "refs", "usings", "lines"), decls, refs, usings, lines)


def file_tokens(files: DataFrame) -> DataFrame:
    """(file_id, pos, kind, token, line, col, end_line, end_col) of each file, without using directives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
        for b in batches:
            for i, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = (content or b"").decode("utf-8-sig", "replace").replace("\r\n", "\n")
                found, place = _without_usings(tokens(text)[0]), Places(text)
                rows = [(i, n, t.kind, t.text, *place(t.at), *place(t.end)) for n, t in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["file_id", "pos", "kind", "token", "line", "col", "end_line", "end_col"])

    return files.select("file_id", "content").mapInArrow(run, "file_id int, pos int, kind string, token string, line int, col int, end_line int, end_col int")


def _without_usings(found: list) -> list:
    """Directives are those before and between namespaces: using ...; that opens no bracket and declares nothing."""
    out, i = [], 0
    while i < len(found):
        j = i + (found[i].text == "global")
        if j < len(found) and found[j].text == "using" and (not out or out[-1].text in ("{", "}", ";")):
            k = j + 1
            while k < len(found) and found[k].text not in (";", "(", "{"):
                k += 1
            inner = found[j + 1 : k]
            named = len(inner) > 1 and inner[0].kind == "identifier" and inner[1].kind == "identifier"
            if k < len(found) and found[k].text == ";" and inner and inner[0].text != "var" and not named:
                i = k + 1
                continue
        out.append(found[i])
        i += 1
    return out
