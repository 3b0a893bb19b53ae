"""Health: members, types and files over their limits, cycles between types, and hotspots of change."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.functions.scalars import any_glob, severity
from lodework.functions.tables import Scratch
from lodework.lang.csharp import BIT
from lodework.lang.extract import Facts
from lodework.operators import checks, churn, findings, graph, symbols
from lodework.plans.dead_code import Graph, Symbols, build
from lodework.sources.workspace import Workspace

#: The six kinds, in the order of reports and baselines.
KINDS = ("high-complexity", "high-cognitive-complexity", "long-method", "too-many-parameters", "large-file", "large-type")


BREAKDOWN, PARAMETERS = "struct<methods:bigint,properties:bigint,fields:bigint,events:bigint>", "struct<required:int,optional:int,out:int>"


@dataclass
class Limits:
    complexity: int = 10
    cognitive: int = 15
    method_lines: int = 40
    parameters: int = 5
    file_lines: int = 750
    type_members: int = 20


@dataclass
class Options:
    limits: Limits = field(default_factory=Limits)
    exclude_tests: bool = False
    ignore: tuple[str, ...] = ()
    hotspots: bool = False
    top: int = 10
    now: int | None = None


@dataclass
class Health:
    findings: DataFrame
    cycles: DataFrame
    hotspots: DataFrame | None
    counts: dict[str, int]
    baselined: int | None = None
    stale: list[tuple[str, str]] = field(default_factory=list)


def _member_category():
    """Constants and enum members don't count; what is called counts as a method."""
    methods = ("method", "constructor", "static_constructor", "destructor", "operator", "conversion_operator", "indexer")
    constant = (F.col("kind") == "field") & (F.col("modifiers").bitwiseAND(BIT["const"]) != 0)
    return F.when(F.col("kind").isin(*methods), "method").when(constant, None).when(F.col("kind").isin("property", "field", "event"), F.col("kind"))


def member_findings(facts: Facts, table: Symbols, limits: Limits, outside: DataFrame) -> DataFrame:
    """Per declaration with a body; overloads of one name in a file are told apart by how many parameters they take."""
    names = table.decl_map.join(table.symbols.select("key", "display", "is_type"), "key").filter("not is_type").select("file_id", "idx", "display")
    d = facts.decls.join(names, ["file_id", "idx"]).withColumn("total", F.col("required") + F.col("optional") + F.col("out"))
    takes = F.col("kind").isin("method", "constructor", "operator", "conversion_operator", "indexer")
    d = checks.suffixed(d, ["file_id"], "display", F.col("total"), takes)
    d = d.filter("has_body and not is_generated").join(outside, "file_id", "left_anti")
    rows = _unpivot(d, limits)
    parameters = F.when(F.col("kind") == "too-many-parameters", F.struct("required", "optional", "out")).cast(PARAMETERS)
    return rows.select("kind", F.col("display").alias("name"), F.col("symbol_kind"), "project", F.col("path").alias("file"), "line", "col", "metric", "threshold", "severity", F.lit(None).cast(BREAKDOWN).alias("breakdown"), parameters.alias("parameters"))


def _unpivot(d: DataFrame, limits: Limits) -> DataFrame:
    d = d.withColumnRenamed("kind", "symbol_kind")
    metrics = {"high-complexity": (F.col("cyclomatic"), limits.complexity), "high-cognitive-complexity": (F.col("cognitive"), limits.cognitive), "long-method": (F.col("body_lines"), limits.method_lines), "too-many-parameters": (F.col("required"), limits.parameters)}
    return checks.tripped(d, ["path", "project", "line", "col", "display", "symbol_kind", "required", "optional", "out"], metrics)


def file_findings(facts: Facts, limits: Limits, root: str, outside: DataFrame) -> DataFrame:
    f = facts.files.filter("not is_generated").join(outside, "file_id", "left_anti")
    rows = checks.tripped(f, ["path", "project"], {"large-file": (F.col("line_count"), limits.file_lines)})
    none = F.lit(None).cast("string")
    return rows.select("kind", _relative("path", root).alias("name"), none.alias("symbol_kind"), "project", F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("col"), "metric", "threshold", "severity", F.lit(None).cast(BREAKDOWN).alias("breakdown"), F.lit(None).cast(PARAMETERS).alias("parameters"))


def type_findings(table: Symbols, limits: Limits, outside: DataFrame) -> DataFrame:
    s = table.symbols
    members = s.filter("not is_type and not is_generated").select("parent_key", "kind", "modifiers")
    counts = checks.breakdown(members, ["parent_key"], _member_category(), ["method", "property", "field", "event"], limits.type_members)
    t = s.filter("is_type and not is_generated").join(outside, "file_id", "left_anti").join(counts.withColumnRenamed("parent_key", "key"), "key")
    parts = F.struct(*[F.col(f"n_{one}").alias(many) for one, many in (("method", "methods"), ("property", "properties"), ("field", "fields"), ("event", "events"))]).cast(BREAKDOWN)
    limit = F.lit(limits.type_members).cast("long")
    return t.select(F.lit("large-type").alias("kind"), F.col("display").alias("name"), F.col("kind").alias("symbol_kind"), "project", F.col("path").alias("file"), "line", "col", F.col("total").cast("long").alias("metric"), limit.alias("threshold"), severity(F.col("total"), limit).alias("severity"), parts.alias("breakdown"), F.lit(None).cast(PARAMETERS).alias("parameters"))


def _relative(column: str, root: str):
    return F.when(F.col(column).startswith(root + "/"), F.expr(f"substr({column}, {len(root) + 2})")).otherwise(F.col(column))


def cycles(table: Symbols, edges: DataFrame, outside: DataFrame, scratch: Scratch) -> DataFrame:
    """(path, others, files; members with name, project, file, line and column): shortest cycles between types, in the order of their anchors; none that touches generated or left-out code."""
    s = table.symbols
    owner = s.select("key", F.when(F.col("is_type"), F.col("key")).otherwise(F.col("parent_key")).alias("owner")).filter("owner like 'T:%'")
    between = edges.join(owner.select(F.col("key").alias("src"), F.col("owner").alias("a")), "src").join(owner.select(F.col("key").alias("dst"), F.col("owner").alias("b")), "dst").filter("a <> b").select("a", "b").distinct()
    ids = symbols.dense_ids(s.filter("is_type").select("key", "display", "project", "path", "line", "col", "file_id", "is_generated", "ord"), scratch, "ord", "id")
    ids = scratch.save(ids, "type-ids")
    e = between.join(ids.select(F.col("key").alias("a"), F.col("id").alias("src")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst")
    e = scratch.save(e, "type-edges")
    found = scratch.save(graph.strong_components(e, scratch), "scc")
    off = found.join(ids.filter("is_generated").select("id").unionByName(ids.join(outside, "file_id", "left_semi").select("id")), "id", "left_semi").select("component").distinct()
    found = scratch.save(found.join(off, "component", "left_anti"), "scc-kept")
    short = graph.shortest_cycles(e, found, scratch)
    spread = short.select("component", F.posexplode("path").alias("pos", "id"), F.lit(True).alias("on")).unionByName(short.select("component", F.posexplode("others").alias("pos", "id"), F.lit(False).alias("on")))
    member = F.struct("pos", F.col("display").alias("name"), "project", F.col("path").alias("file"), "line", F.col("col").alias("column"))
    named = spread.join(ids.select("id", "display", "project", "path", "line", "col"), "id").groupBy("component").agg(F.array_sort(F.collect_list(F.when(F.col("on"), member))).alias("p"), F.array_sort(F.collect_list(F.when(~F.col("on"), member))).alias("o"))
    files = F.transform(F.concat("p", "o"), lambda x: x["file"])
    shown = lambda c: F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["project"].alias("project"), x["file"].alias("file"), x["line"].alias("line"), x["column"].alias("column")))
    return named.select("component", shown("p").alias("path"), shown("o").alias("others"), files.alias("files"))


def hot_files(facts: Facts, commits: DataFrame, root: str, globs: list[str], outside: DataFrame, top: int, now: int) -> DataFrame:
    """Ignored and left-out files go before the maxima are taken, so the others are measured against each other."""
    sums = facts.decls.groupBy("file_id").agg(F.sum("cyclomatic").alias("cyclomatic"))
    f = facts.files.filter("not is_generated").join(outside, "file_id", "left_anti").withColumn("rel", _relative("path", root)).filter(~any_glob(F.col("rel"), globs))
    weights = churn.decayed(commits, ["path"], F.col("commit_ts"), now).select(F.col("path").alias("rel"), "weight")
    f = f.join(sums, "file_id", "left").join(weights, "rel", "left").select(F.col("rel").alias("path"), "project", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("cyclomatic", F.lit(0)).alias("cyclomatic"), "line_count")
    return churn.top(churn.hotspots(f, "path", "weight", "cyclomatic", "line_count"), top)


def health(workspace: Workspace, facts: Facts, scratch: Scratch, options: Options = Options(), commits: DataFrame | None = None, baseline: tuple[DataFrame, list[list[str]]] | None = None, built: tuple[Symbols, Graph] | None = None) -> Health:
    """Findings, cycles and hotspots after ignore globs, inline markers and a baseline, in this order."""
    tests = [i for i, p in enumerate(workspace.projects) if p.test_framework] if options.exclude_tests else []
    outside = facts.files.filter(F.col("project").isin(tests) if tests else F.lit(False)).select("file_id")
    table, references = built or build(facts, workspace, scratch)
    edges = references.edges
    found = member_findings(facts, table, options.limits, outside).unionByName(file_findings(facts, options.limits, workspace.root, outside)).unionByName(type_findings(table, options.limits, outside))
    globs = list(options.ignore)
    found = findings.not_ignored(found.withColumn("__rel", _relative("file", workspace.root)), "__rel", globs).drop("__rel")
    found = findings.unmarked(found, findings.markers(facts.markers, rules=list(KINDS)), ("large-file",))
    rings = scratch.save(cycles(table, edges, outside, scratch), "cycles")
    if globs:
        n = len(workspace.root) + 2
        rings = rings.withColumn("__rel", F.transform("files", lambda x: F.substring(x, F.lit(n), F.length(x))))
        rings = findings.cycles_not_ignored(rings, F.col("__rel"), globs).drop("__rel")
    found, baselined, stale = scratch.save(found, "findings"), None, []
    if baseline is not None:
        recorded, known = baseline
        over, before = scratch.save(findings.over_baseline(found, recorded), "over"), found.count() + rings.count()
        stale = [(r["kind"], r["name"]) for r in findings.stale_records(recorded, found).select("kind", "name").collect()]
        keys = ["\n".join(sorted(m)) for m in known]
        if keys:
            rings = rings.filter(~findings.cycle_key(F.transform(F.concat("path", "others"), lambda m: m["name"])).isin(keys))
        found = over
        baselined = before - found.count() - rings.count()
    hot = None
    if options.hotspots and commits is not None:
        now = options.now if options.now is not None else int(commits.agg(F.max("commit_ts")).first()[0] or 0)
        hot = hot_files(facts, commits, workspace.root, globs, outside, options.top, now)
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    kept = facts.files.filter("not generated_path").join(outside, "file_id", "left_anti").withColumn("rel", _relative("path", workspace.root))
    row = kept.agg(F.count_if(any_glob(F.col("rel"), globs)).alias("i"), F.count("*").alias("n")).first()
    counts |= {"projects": len(workspace.projects) - len(tests), "files": row["n"] - row["i"], "ignored_files": row["i"], "cycles": rings.count(), "symbols": table.symbols.count() + facts.files.count()}
    return Health(found.orderBy(F.split("file", "/"), "line", "col", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "name"), rings.orderBy("component"), hot, counts, baselined, stale)
