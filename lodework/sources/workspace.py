"""Source trees: walking, solutions and projects, and which project a file belongs to.

Project files are few and are read on the driver. Sources are rows (path, content) of a binaryFile
scan, or of the walk's list of files, read in the tasks.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodework.functions.scalars import GENERATED_SUFFIXES

#: Larger sources are left out.
MOST_BYTES = 5 * 1024 * 1024
SKIPPED_FOLDERS = ("bin", "obj")
#: Package prefixes of the test frameworks, in order.
TEST_PACKAGES = ("xunit", "nunit", "mstest")
AUXILIARY = ("benchmark", "sample", "example", "demo", "playground")


class WorkspaceError(Exception):
    pass


@dataclass
class Project:
    name: str
    root: str
    path: str | None = None
    kind: str = "library"
    sdk_style: bool = True
    default_items: bool = True
    test_framework: str | None = None
    packable: bool = False
    packages: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    usings: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    remove: list[str] = field(default_factory=list)

    @property
    def auxiliary(self) -> bool:
        return any(a in self.name.lower() for a in AUXILIARY)


@dataclass
class Workspace:
    root: str
    projects: list[Project]
    files: list[tuple[str, int | None, bool]]  # path, project index, generated by path
    warnings: list[str]
    has_obj: bool


def parse_solution(text: str) -> list[tuple[str, str]]:
    """(name, path) of the C# projects that the Project lines of a solution name."""
    out = []
    for line in text.splitlines():
        if line.strip().startswith("Project("):
            quoted = line.split('"')[1::2]
            if len(quoted) > 2 and quoted[2].lower().endswith(".csproj"):
                out.append((quoted[1], quoted[2].replace("\\", "/")))
    return out


def parse_project(text: str, name: str, path: str) -> Project:
    """A project file. Conditions are not evaluated: every element counts."""
    p = Project(name, str(PurePosixPath(path).parent), path)
    try:
        tree = ET.fromstring(re.sub(r"^﻿", "", text))
    except ET.ParseError:
        return p
    strip = lambda tag: tag.rsplit("}", 1)[-1]
    sdks = [tree.get("Sdk") or ""]
    output, packable, metadata, default_items = "", None, False, True
    for e in tree.iter():
        tag, value, include = strip(e.tag), (e.text or "").strip(), e.get("Include")
        if tag == "Sdk":
            sdks.append(e.get("Name") or "")
        elif tag == "Import":
            sdks.append(e.get("Sdk") or "")
        elif tag == "OutputType":
            output = value.lower()
        elif tag == "EnableDefaultCompileItems":
            default_items = value.lower() != "false"
        elif tag == "IsPackable":
            packable = value.lower() == "true"
        elif tag == "ProjectReference" and include:
            p.references.append(include.replace("\\", "/"))
        elif tag == "PackageReference" and include:
            p.packages.append(include)
        elif tag == "Using" and include:
            p.usings.append(include)
        elif tag == "Compile":
            p.include += [x.strip().replace("\\", "/") for x in (include or "").split(";") if x.strip()]
            p.remove += [x.strip().replace("\\", "/") for x in (e.get("Remove") or "").split(";") if x.strip()]
        elif tag.startswith("Package") and not include:
            metadata = True
    p.sdk_style = any(sdks)
    p.default_items = p.sdk_style and default_items
    p.kind = "web" if any("Microsoft.NET.Sdk.Web" in s for s in sdks) else "exe" if output in ("exe", "winexe") else "library"
    p.packable = metadata if packable is None else packable
    p.test_framework = next((t for t in TEST_PACKAGES if any(x.lower().startswith(t) for x in p.packages)), None)
    return p


class Ignored:
    """The .gitignore rules of a tree; later rules and deeper files win."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def read(self, folder: str, rel: str) -> None:
        try:
            text = Path(folder, ".gitignore").read_text(errors="replace")
        except OSError:
            return
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.lstrip("!")
            folder_only, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            parts = re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", line.lstrip("/"))
            known = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
            body = "".join(known.get(x, re.escape(x)) for x in parts)
            self.rules.append((rel, re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z"), keep, folder_only))

    def __call__(self, rel: str, is_dir: bool) -> bool:
        out = False
        for base, pattern, keep, folder_only in self.rules:
            inner = rel[len(base) + 1 :] if base else rel
            if (not base or rel.startswith(base + "/")) and (is_dir or not folder_only) and pattern.match(inner):
                out = not keep
        return out


def walk(root: str) -> tuple[list[str], list[str], list[str]]:
    """Sources, project files with solutions, and warnings below a folder, in the order of path components. Links aren't followed."""
    ignored, sources, projects, warnings = Ignored(), [], [], []
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel
        ignored.read(folder, rel)
        inner = lambda n, rel=rel: f"{rel}/{n}" if rel else n
        dirs[:] = [d for d in dirs if d.lower() not in SKIPPED_FOLDERS and d != ".git" and not os.path.islink(f"{folder}/{d}") and not ignored(inner(d), True)]
        for n in names:
            path, low = f"{folder}/{n}", n.lower()
            if os.path.islink(path) or ignored(inner(n), False):
                continue
            if low.endswith(".cs"):
                if os.path.getsize(path) > MOST_BYTES:
                    warnings.append(f"{inner(n)} is larger than {MOST_BYTES >> 20} MiB and was left out")
                else:
                    sources.append(path)
            elif low.endswith((".sln", ".csproj")):
                projects.append(path)
    order = lambda p: p.split("/")
    return sorted(sources, key=order), sorted(projects, key=order), warnings


def _obj_sources(folder: str) -> list[str]:
    out = []
    for d, _, names in os.walk(f"{folder}/obj"):
        out += [f"{d}/{n}" for n in names if n.endswith(".cs") and os.path.getsize(f"{d}/{n}") <= MOST_BYTES]
    return out


def is_generated(path: str) -> bool:
    low = path.lower()
    return low.endswith(GENERATED_SUFFIXES) or "obj" in low.split("/")


def _claims(project: Project, path: str) -> str:
    """What the project nearest to a file says of it: dropped, included or unlisted."""
    rel = os.path.relpath(path, project.root).replace(os.sep, "/")
    hit = lambda globs: any(re.match(r, rel) for r in (_project_glob(g) for g in globs))
    if hit(project.remove):
        return "dropped"
    return "included" if project.default_items or hit(project.include) else "unlisted"


def _project_glob(glob: str) -> str:
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob.removeprefix("./"))
    known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(known.get(x, re.escape(x)) for x in parts) + r"\Z"


def discover(path: str) -> Workspace:
    """The workspace at a folder, a solution or a project."""
    if not os.path.exists(path):
        raise WorkspaceError(f"{path} does not exist")
    full = os.path.realpath(path)
    low = full.lower()
    if os.path.isfile(full) and not low.endswith((".sln", ".csproj")):
        raise WorkspaceError(f"{path} is no folder, solution or project")
    root = full if os.path.isdir(full) else os.path.dirname(full)
    sources, found, warnings = walk(root)
    csprojs = [p for p in found if p.lower().endswith(".csproj")]
    solutions = [full] if low.endswith(".sln") else sorted((p for p in found if p.lower().endswith(".sln")), key=lambda p: (p.count("/"), p.split("/")))
    named: list[tuple[str, str]] = []
    if low.endswith(".csproj"):
        named = [(Path(full).stem, full)]
    elif solutions:
        if len(solutions) > 1:
            warnings.append(f"several solutions found, {os.path.relpath(solutions[0], root)} is used")
        base = os.path.dirname(solutions[0])
        listed = parse_solution(Path(solutions[0]).read_text(encoding="utf-8-sig", errors="replace"))
        named = [(n, os.path.realpath(f"{base}/{p}")) for n, p in listed if os.path.exists(f"{base}/{p}")]
    if not named:
        named = [(Path(p).stem, p) for p in csprojs]
    projects = [parse_project(Path(p).read_text(encoding="utf-8-sig", errors="replace"), n, p) for n, p in dict.fromkeys(named)]
    if not projects:
        projects = [Project(os.path.basename(root) or "root", root)]
    deep = sorted(range(len(projects)), key=lambda i: -projects[i].root.count("/"))
    files: dict[str, tuple[int | None, bool]] = {}
    for s in sources:
        owner = next((i for i in deep if s.startswith(projects[i].root.rstrip("/") + "/")), None)
        claim = "included" if owner is None or projects[owner].path is None else _claims(projects[owner], s)
        if claim != "dropped":
            files[s] = (owner if claim == "included" else None, is_generated(os.path.relpath(s, root)))
    for i, p in enumerate(projects):
        for g in p.include:  # literal items may lie outside the tree
            extra = os.path.realpath(f"{p.root}/{g}")
            if not re.search(r"[*?]", g) and os.path.isfile(extra):
                if files.get(extra, (None, False))[0] is None:
                    files[extra] = (i, is_generated(os.path.relpath(extra, root)))
    has_obj = False
    for i, p in enumerate(projects):
        if p.path:
            has_obj |= os.path.isdir(f"{p.root}/obj")
            for s in _obj_sources(p.root):
                files.setdefault(s, (i, True))
    rows = [(s, *files[s]) for s in sorted(files, key=lambda s: s.split("/"))]
    return Workspace(root, projects, rows, warnings, has_obj)


def source_files(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """(file_id, path, project, is_generated, content) of a workspace; ids in the order of path components. Contents are read in the tasks; null where a file can't be read."""
    rows = [(i, s, p, g) for i, (s, p, g) in enumerate(workspace.files)]
    listed = spark.createDataFrame(rows, "file_id int, path string, project int, is_generated boolean")

    def load(batches):
        import pyarrow as pa

        for b in batches:
            contents = []
            for path in b.column(1).to_pylist():
                try:
                    contents.append(Path(path).read_bytes())
                except OSError:
                    contents.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(contents, pa.binary())], names=[*b.schema.names, "content"])

    n = max(1, min(len(rows) // 16, 4 * spark.sparkContext.defaultParallelism))
    return listed.repartition(n).mapInArrow(load, "file_id int, path string, project int, is_generated boolean, content binary")


def deepest_prefix(files: DataFrame, id_: str, path: str, roots: DataFrame, prefix: str) -> DataFrame:
    """(id, prefix): for each file the longest root that is one of its path's prefixes by components, or null.

    Every prefix of a path is a key of one equi-join; no range join.
    """
    parts = F.split(F.col(path), "/")
    each = files.select(id_, F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias(prefix)))).alias("__e"))
    each = each.select(id_, "__e.depth", f"__e.{prefix}")
    best = each.join(roots.select(prefix).distinct(), prefix).groupBy(id_).agg(F.max_by(prefix, "depth").alias(prefix))
    return files.select(id_).join(best, id_, "left")
