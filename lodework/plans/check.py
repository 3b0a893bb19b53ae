"""The three analyses over one workspace: one scan and one parse for all of them."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from lodework.functions.tables import Scratch
from lodework.lang.extract import Facts, extract
from lodework.operators.findings import unknown_rules
from lodework.plans import dead_code, dupes, health
from lodework.report import documents
from lodework.sources import config, history
from lodework.sources.workspace import Workspace, discover, source_files


@dataclass
class Session:
    """A workspace with its settings; sources and facts are read once, when they are first asked for."""

    spark: SparkSession
    path: str
    config: config.Config
    workspace: Workspace = None
    warnings: list[str] = field(default_factory=list)
    _files = None
    _facts: Facts | None = None
    _built: tuple | None = None

    def __post_init__(self):
        self.workspace = discover(self.path)
        self.scratch = Scratch(self.spark, "workspace")
        self.warnings = list(dict.fromkeys([*self.config.warnings, *self.workspace.warnings]))

    @property
    def files(self):
        if self._files is None:
            self._files = self.scratch.save(source_files(self.spark, self.workspace), "files")
        return self._files

    def warn_of_unknown_rules(self) -> None:
        known = [*dead_code.RULES, *health.KINDS]
        rows = unknown_rules(self.facts.markers, known).orderBy("file", "line", "rule").collect()
        self.warnings += [w for r in rows if (w := f"{r['file']}:{r['line']}: unknown rule {r['rule']} in a marker") not in self.warnings]

    @property
    def facts(self) -> Facts:
        if self._facts is None:
            self._facts = extract(self.files, self.scratch)
        return self._facts

    @property
    def built(self) -> tuple[dead_code.Symbols, dead_code.Graph]:
        """Symbols and references, built once for dead code and health."""
        if self._built is None:
            self._built = dead_code.build(self.facts, self.workspace, self.scratch)
        return self._built


def start(spark: SparkSession, path: str, settings: str | None = None) -> Session:
    return Session(spark, path, config.parse(settings) if settings else config.find(path if os.path.exists(path) else "."))


def run_dead_code(s: Session, aggressive: bool = False, roots: tuple[str, ...] | None = None, libraries: tuple[str, ...] | None = None) -> dict:
    """Arguments come before settings; aggressive is either's."""
    began, c = time.time(), s.config
    options = dead_code.Options(aggressive or c.aggressive, tuple(roots if roots is not None else c.roots), tuple(libraries if libraries is not None else c.libraryProjects), tuple(c.ignored("deadCode")))
    s.warn_of_unknown_rules()
    found = dead_code.dead_code(s.workspace, s.facts, s.scratch, options, s.built)
    return documents.dead_code(s.workspace, found, int(1000 * (time.time() - began)))


def run_dupes(s: Session, mode: str | None = None, min_tokens: int | None = None, min_lines: int | None = None, min_occurrences: int | None = None) -> dict:
    began, c = time.time(), s.config.dupes
    pick = lambda a, b, d: a if a is not None else b if b is not None else d
    options = dupes.Options(pick(mode, c.mode, "exact"), pick(min_tokens, c.minTokens, 50), pick(min_lines, c.minLines, 5), pick(min_occurrences, c.minOccurrences, 2), tuple(s.config.ignored("dupes")))
    found = dupes.duplicates(s.files, s.scratch, options, s.workspace.root)
    return documents.dupes(s.workspace, found, options.mode, int(1000 * (time.time() - began)))


def run_health(s: Session, limits: dict[str, int] | None = None, exclude_tests: bool = False, hotspots: bool = False, top: int = 10, baseline: str | None = None, write_baseline: str | None = None) -> dict:
    began, c = time.time(), s.config.health
    if baseline and write_baseline:
        raise config.ConfigError("a baseline is either read or written")
    known = {"complexity": c.maxComplexity, "cognitive": c.maxCognitive, "method_lines": c.maxMethodLines, "parameters": c.maxParameters, "file_lines": c.maxFileLines, "type_members": c.maxTypeMembers}
    values = {k: v for k, v in known.items() if v is not None} | {k: v for k, v in (limits or {}).items() if v is not None}
    commits, walked = None, None
    s.warn_of_unknown_rules()
    if hotspots:
        commits, walked, warnings = history.commits(s.spark, s.workspace.root, s.scratch)
        s.warnings += [w for w in warnings if w not in s.warnings]
    options = health.Options(health.Limits(**values), exclude_tests or c.excludeTests, tuple(s.config.ignored("health")), hotspots, top, int(time.time()))
    path = baseline or (os.path.join(s.config.folder, c.baseline) if c.baseline and not write_baseline else None)
    recorded = config.load_baseline(s.spark, path) if path else None
    found = health.health(s.workspace, s.facts, s.scratch, options, commits, recorded, s.built)
    s.warnings += [f"baseline: {kind} {name} is no longer found" for kind, name in found.stale]
    tests = [p.name for p in s.workspace.projects if p.test_framework] if options.exclude_tests else None
    doc = documents.health(s.workspace, found, int(1000 * (time.time() - began)), walked, tests)
    if write_baseline:
        config.write_baseline(write_baseline, doc["findings"], [[m["name"] for m in r["path"] + r["others"]] for r in doc["cycles"]], health.KINDS)
    return doc


def run_check(s: Session) -> dict:
    return documents.check(s.workspace, {"deadCode": run_dead_code(s), "dupes": run_dupes(s), "health": run_health(s)})


def has_findings(doc: dict) -> bool:
    """Hotspots are no findings."""
    if "deadCode" in doc:
        return any(has_findings(doc[k]) for k in ("deadCode", "dupes", "health"))
    return bool(doc.get("findings") or doc.get("groups") or doc.get("cycles"))
