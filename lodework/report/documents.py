"""JSON documents, version 1: camelCase keys, nulls left out."""

from __future__ import annotations

import json
import math
from typing import Any

from lodework.plans.dead_code import DeadCode
from lodework.plans.dupes import Dupes
from lodework.plans.health import Health
from lodework.sources.workspace import Workspace

VERSION = 1


def rounded(value: float, digits: int) -> float:
    """Halves away from zero, in binary floating point."""
    f = 10**digits
    return math.copysign(math.floor(abs(value) * f + 0.5) / f, value)


def _no_nulls(row: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in row.items() if v is not None}


def _project(workspace: Workspace, i: int | None) -> str | None:
    return workspace.projects[i].name if i is not None else None


def _relative(workspace: Workspace, path: str) -> str:
    return path.removeprefix(workspace.root + "/")


def dead_code(workspace: Workspace, result: DeadCode, elapsed_ms: int) -> dict:
    rows = [_no_nulls({"kind": r["kind"], "symbolKind": r["symbol_kind"], "name": r["name"], "project": _project(workspace, r["project"]), "file": _relative(workspace, r["file"]), "line": r["line"], "column": r["col"], "visibility": r["visibility"]}) for r in result.findings.toLocalIterator()]
    c = result.counts
    summary = {"projects": c["projects"], "filesScanned": c["files"], "symbols": c["symbols"], "unusedTypes": c.get("unused-type", 0), "unusedMembers": c.get("unused-member", 0), "unusedFiles": c.get("unused-file", 0), "elapsedMs": elapsed_ms}
    return {"version": VERSION, "root": workspace.root, "summary": summary, "notes": result.notes, "findings": rows}


def dupes(workspace: Workspace, result: Dupes, mode: str, elapsed_ms: int) -> dict:
    names = {"file": "file", "startLine": "start_line", "startColumn": "start_column", "endLine": "end_line", "endColumn": "end_column"}
    groups = []
    for g in result.groups.toLocalIterator():
        places = [{k: _relative(workspace, o[v]) if k == "file" else o[v] for k, v in names.items()} for o in g["occurrences"]]
        groups.append({"tokenCount": g["token_count"], "lineCount": g["line_count"], "occurrences": places})
    summary = {"projects": len(workspace.projects), "filesScanned": result.counts["files"], "groups": result.counts["groups"], "duplicatedLines": result.counts["duplicated_lines"], "elapsedMs": elapsed_ms}
    return {"version": VERSION, "root": workspace.root, "mode": mode, "summary": summary, "groups": groups}


def health(workspace: Workspace, result: Health, elapsed_ms: int, commits_walked: int | None = None, excluded_tests: list[str] | None = None) -> dict:
    rows = [
        _no_nulls({"kind": r["kind"], "name": r["name"], "project": _project(workspace, r["project"]), "file": _relative(workspace, r["file"]), "line": r["line"], "column": r["col"], "metric": r["metric"], "threshold": r["threshold"], "breakdown": r["breakdown"] and r["breakdown"].asDict(), "parameters": r["parameters"] and r["parameters"].asDict()})
        for r in result.findings.toLocalIterator()
    ]
    hot = [] if result.hotspots is None else [_no_nulls({"file": h["path"], "project": _project(workspace, h["project"]), "score": rounded(h["score"], 1), "weightedCommits": rounded(h["weight"], 2), "cyclomatic": h["cyclomatic"], "lines": h["line_count"], "complexityDensity": rounded(h["density"], 4)}) for h in result.hotspots.toLocalIterator()]
    c = result.counts
    kinds = {"highComplexity": "high-complexity", "highCognitiveComplexity": "high-cognitive-complexity", "longMethods": "long-method", "tooManyParameters": "too-many-parameters", "largeFiles": "large-file", "largeTypes": "large-type"}
    summary = {"projects": c["projects"], "filesScanned": c["files"], "symbols": c["symbols"]} | {k: c.get(v, 0) for k, v in kinds.items()} | {"circularDependencies": c["cycles"]}
    summary |= _no_nulls({"commitsWalked": commits_walked, "baselined": result.baselined, "elapsedMs": elapsed_ms})
    if excluded_tests or c["ignored_files"]:
        summary["excluded"] = {"testProjects": excluded_tests or [], "ignoredFiles": c["ignored_files"]}
    member = lambda m: _no_nulls({"name": m["name"], "project": _project(workspace, m["project"]), "file": _relative(workspace, m["file"]), "line": m["line"], "column": m["column"]})
    cycles = [{k: [member(m) for m in r[k]] for k in ("path", "others")} for r in result.cycles.toLocalIterator()]
    return {"version": VERSION, "root": workspace.root, "summary": summary, "findings": rows, "cycles": cycles, "hotspots": hot}


def check(workspace: Workspace, parts: dict[str, dict]) -> dict:
    return {"version": VERSION, "root": workspace.root, **parts}


def dumps(document: dict) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False)
