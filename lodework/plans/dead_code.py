"""Dead code: symbols that no root reaches, and files of which nothing is reached."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodework.functions.tables import Scratch
from lodework.lang.csharp import BIT
from lodework.lang.extract import Facts
from lodework.operators.findings import markers, not_ignored, unmarked
from lodework.operators.graph import closure, gated_reach, reach
from lodework.operators.symbols import by_full_name, by_segment, merged, unresolved
from lodework.sources.workspace import Project, Workspace

TYPES = ("class", "struct", "interface", "enum", "record", "delegate")
#: Attributes that don't mean that a framework uses a declaration.
INERT_ATTRIBUTES = ("Obsolete", "DebuggerDisplay", "DebuggerStepThrough", "DebuggerBrowsable", "DebuggerNonUserCode", "EditorBrowsable", "ExcludeFromCodeCoverage", "CompilerGenerated")
#: Types that only the compiler refers to.
COMPILER_TYPES = (
    "System.Runtime.CompilerServices.IsExternalInit",
    "System.Runtime.CompilerServices.RequiredMemberAttribute",
    "System.Runtime.CompilerServices.CompilerFeatureRequiredAttribute",
    "System.Runtime.CompilerServices.ModuleInitializerAttribute",
    "System.Diagnostics.CodeAnalysis.AllowNullAttribute",
    "System.Diagnostics.CodeAnalysis.DisallowNullAttribute",
    "System.Diagnostics.CodeAnalysis.DoesNotReturnAttribute",
    "System.Diagnostics.CodeAnalysis.DoesNotReturnIfAttribute",
    "System.Diagnostics.CodeAnalysis.MaybeNullAttribute",
    "System.Diagnostics.CodeAnalysis.MaybeNullWhenAttribute",
    "System.Diagnostics.CodeAnalysis.MemberNotNullAttribute",
    "System.Diagnostics.CodeAnalysis.MemberNotNullWhenAttribute",
    "System.Diagnostics.CodeAnalysis.NotNullAttribute",
    "System.Diagnostics.CodeAnalysis.NotNullIfNotNullAttribute",
    "System.Diagnostics.CodeAnalysis.NotNullWhenAttribute",
)
#: Members that live with their type because no call names them.
STRUCTURAL = ("constructor", "static_constructor", "destructor", "operator", "conversion_operator", "indexer")
RULES = ("unused-file", "unused-type", "unused-member")


def has(bit: str, column: str = "modifiers"):
    return F.col(column).bitwiseAND(BIT[bit]) != 0


def visibility():
    """The widest keyword, or the default: internal for types outside types, else private."""
    default = F.when(F.col("is_type") & F.col("parent_key").startswith("F:"), F.lit("internal")).otherwise(F.lit("private"))
    return F.when(has("public"), "public").when(has("protected") & has("internal"), "protected internal").when(has("protected"), "protected").when(has("internal"), "internal").when(has("private"), "private").otherwise(default)


@dataclass
class Symbols:
    """symbols by key; decl_map (file_id, idx, key); key of the file root is F:<file_id>."""

    symbols: DataFrame
    decl_map: DataFrame


def build_symbols(facts: Facts, scratch: Scratch) -> Symbols:
    """Declarations merged: types by full name and arity, members by parent, name and kind; one root a file."""
    d = facts.decls.withColumn("is_type", F.col("kind").isin(*TYPES)).withColumn("type_key", F.when(F.col("is_type"), F.concat_ws("`", F.concat(F.lit("T:"), "fqn"), F.col("arity").cast("string"))))
    up = d.filter("is_type").select("file_id", F.col("idx").alias("parent"), F.col("type_key").alias("up_key"), F.col("kind").alias("up_kind"), F.col("fqn").alias("up_fqn"))
    d = d.join(up, ["file_id", "parent"], "left").withColumn("parent_key", F.coalesce("up_key", F.concat(F.lit("F:"), F.col("file_id").cast("string"))))
    # Members of interfaces are public unless they say otherwise.
    silent = F.col("modifiers").bitwiseAND(BIT["public"] | BIT["private"] | BIT["protected"] | BIT["internal"]) == 0
    d = d.withColumn("modifiers", F.when(~F.col("is_type") & (F.col("up_kind") == "interface") & silent, F.col("modifiers").bitwiseOR(BIT["public"])).otherwise(F.col("modifiers")))
    d = d.withColumn("key", F.coalesce("type_key", F.concat_ws("\1", "parent_key", "name", "kind")))
    d = scratch.save(d, "decls")
    first = ["name", "kind", "parent_key", "file_id", "path", "project", "line", "col", "namespace", "fqn", "is_type", "arity", "up_fqn", "up_kind"]
    flags = ["explicit", "extension", "auto_property", "has_body", "is_generated"]
    s = merged(d, ["key"], ["file_id", "idx"], first=first, bits=["modifiers"], flags=flags, unions=["attributes", "bases"]).withColumnRenamed("first_seen", "ord")
    s = s.withColumn("display", F.coalesce("fqn", F.concat_ws(".", "up_fqn", "name"))).withColumn("visibility", visibility())
    return Symbols(scratch.save(s, "symbols"), d.select("file_id", "idx", "key"))


@dataclass
class Graph:
    edges: DataFrame
    names: DataFrame
    targets: DataFrame


def dotted_prefixes(column):
    """Every leading part of a dotted name, and the empty one."""
    parts = F.split(column, "\\.")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ".")))


def build_graph(facts: Facts, symbols: Symbols, projects: list[Project], scratch: Scratch) -> Graph:
    """References to everything that they can mean: edges (src, dst) between symbols, and member names that symbols use (src, name)."""
    s, spark = symbols.symbols, symbols.symbols.sparkSession
    u = facts.usings.filter("not is_static")
    plain = u.filter("alias is null")
    extra = spark.createDataFrame([(i, x) for i, p in enumerate(projects) for x in p.usings], "project int, path string")
    files = facts.files.select("file_id", "project")
    shared = plain.filter("is_global").select("project", "path").filter("project is not null").union(extra).distinct()
    # Files outside projects see every file's global usings, as a project of its own.
    shared = shared.unionByName(plain.filter("is_global").select(F.lit(-1).alias("project"), "path")).distinct()
    shared = shared.groupBy("project").agg(F.collect_list("path").alias("shared"))
    local = plain.groupBy("file_id").agg(F.collect_set("path").alias("local"))
    opened = files.withColumn("project", F.coalesce("project", F.lit(-1))).join(shared, "project", "left").join(local, "file_id", "left")
    none = F.array().cast("array<string>")
    opened = opened.select("file_id", F.concat(F.coalesce("local", none), F.coalesce("shared", none)).alias("opened"))
    aliases = u.filter("alias is not null").groupBy("file_id", "alias").agg(F.max_by("path", "n").alias("target"))  # the later one wins
    # Where a reference stands: the symbol, and the type around it.
    own = s.select("key", F.when(F.col("is_type"), F.col("fqn")).otherwise(F.col("up_fqn")).alias("around"), "namespace")
    r = facts.refs.join(symbols.decl_map.withColumnRenamed("idx", "origin"), ["file_id", "origin"], "left").join(own, "key", "left")
    r = r.withColumn("src", F.coalesce("key", F.concat(F.lit("F:"), F.col("file_id").cast("string"))))
    r = r.withColumn("first", F.col("segments")[0]).join(aliases.withColumnRenamed("alias", "first"), ["file_id", "first"], "left")
    rest = F.slice("segments", 2, F.greatest(F.lit(1), F.size("segments")))
    r = r.withColumn("path", F.when(F.col("target").isNotNull(), F.concat_ws(".", F.col("target"), rest)).otherwise(F.concat_ws(".", "segments")))
    r = r.join(opened, "file_id", "left")
    scopes = F.array_distinct(F.concat(dotted_prefixes(F.coalesce("around", F.lit(""))), dotted_prefixes(F.coalesce("namespace", F.lit(""))), F.coalesce("opened", F.array().cast("array<string>"))))
    r = r.select("src", "kind", "path", "has_errors", scopes.alias("scopes")).distinct().withColumn("id", F.xxhash64("src", "kind", "path", "scopes"))
    r = scratch.save(r, "refs")
    lookups = r.filter("kind <> 'Member'").withColumn("p", F.explode(F.when(F.col("kind") == "Attribute", F.array(F.col("path"), F.concat("path", F.lit("Attribute")))).otherwise(F.array("path"))))
    types = s.filter("is_type").select(F.col("key").alias("dst"), "fqn", F.col("name").alias("simple"))
    hits = scratch.save(by_full_name(lookups, F.col("scopes"), "p", types, "fqn", "dst", ["id", "src", "kind"]), "hits")
    missed = unresolved(lookups.select("id", "src", "kind", "p", "has_errors"), hits, "id", F.col("has_errors"))
    loose = by_segment(missed, "p", types, "simple", "dst", ["src", "kind"])
    missed = missed.select("src", "kind", F.split("p", "\\.").alias("segs")).distinct()
    found = scratch.save(hits.select("src", "kind", "dst").union(loose).distinct(), "found")
    words = missed.filter("kind <> 'ScanTarget' and size(segs) > 1").select("src", F.explode("segs").alias("name"))
    names = r.filter("kind = 'Member'").select("src", F.substring_index("path", ".", -1).alias("name"))
    names = names.union(r.filter("kind = 'Ambient' and instr(path, '.') = 0").select("src", F.col("path").alias("name"))).union(words).distinct()
    return Graph(found.filter("kind <> 'ScanTarget'").select("src", "dst").distinct(), names, found.filter("kind = 'ScanTarget'").select("dst").distinct())


def build(facts: Facts, workspace: Workspace, scratch: Scratch) -> tuple[Symbols, Graph]:
    """What dead code and health both start from."""
    symbols = build_symbols(facts, scratch)
    return symbols, build_graph(facts, symbols, workspace.projects, scratch)


@dataclass
class Options:
    aggressive: bool = False
    roots: tuple[str, ...] = ()
    libraries: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()


@dataclass
class DeadCode:
    findings: DataFrame
    counts: dict[str, int]
    notes: list[str] = field(default_factory=list)


def _flags(symbols: Symbols, graph: Graph, workspace: Workspace, facts: Facts, options: Options, scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """Symbols with root, ungated and with_type."""
    s, notes = symbols.symbols, []
    spark = s.sparkSession
    types = s.filter("is_type")
    # Bases by simple name, whatever the project: too many rather than too few.
    base = types.select("key", F.explode("bases").alias("b")).select("key", F.element_at("b", -1).alias("base"))
    up = base.join(types.select(F.col("name").alias("base"), F.col("key").alias("dst")), "base").select(F.col("key").alias("src"), "dst").distinct()
    above = closure(up, scratch)
    chain = scratch.save(above.unionByName(types.select(F.col("key").alias("src"), F.col("key").alias("dst"))).distinct(), "above")
    foreign = base.join(types.select(F.col("name").alias("base")).distinct(), "base", "left_anti").filter(F.col("base").rlike(r"^I\p{Lu}")).select(F.col("key").alias("dst")).distinct()
    open_types = chain.join(foreign, "dst").select(F.col("src").alias("parent_key")).distinct().withColumn("foreign", F.lit(True))
    members = s.filter("not is_type")
    promised = above.join(types.filter("kind = 'interface'").select(F.col("key").alias("dst")), "dst").join(members.select(F.col("parent_key").alias("dst"), "name"), "dst")
    promised = promised.select(F.col("src").alias("parent_key"), "name").distinct().withColumn("promised", F.lit(True))
    # Scanned types: concrete ones with a base that is registered by a generic call.
    scanned = types.filter(~has("abstract") & (F.col("kind") != "interface") & (F.size("bases") > 0)).select("key")
    scanned = scanned.join(above.join(graph.targets, "dst").select(F.col("src").alias("key")).distinct(), "key", "left_semi").withColumn("scanned", F.lit(True))
    parents = types.select(F.col("key").alias("parent_key"), F.col("name").alias("p_name"), F.col("bases").alias("p_bases"), F.col("modifiers").alias("p_modifiers"))
    hidden = F.col("visibility").isin("private", "internal")
    # A symbol is public when all the types around it are.
    inner = types.filter(~F.col("parent_key").startswith("F:")).select(F.col("key").alias("src"), F.col("parent_key").alias("dst"))
    closed = scratch.save(types.filter(hidden).select("key"), "hidden")
    closed = reach(inner, closed, scratch, "dst", "src", "key").withColumn("closed", F.lit(True)) if not closed.isEmpty() else closed.withColumn("closed", F.lit(True))
    tests = [i for i, p in enumerate(workspace.projects) if p.test_framework]
    shipped = [i for i, p in enumerate(workspace.projects) if p.packable or p.name in options.libraries]
    apps = [p for p in workspace.projects if p.kind in ("exe", "web") and not p.auxiliary]
    if any(p.path for p in workspace.projects):
        library = not apps
    else:
        has_main = not members.filter((F.col("kind") == "method") & (F.col("name") == "Main") & has("static")).isEmpty()
        library = not (has_main or not facts.files.filter("top_level").isEmpty())
    if library:
        notes.append("no executable project: public declarations count as used")
    f = s.join(open_types, "parent_key", "left").join(promised, ["parent_key", "name"], "left").join(scanned, "key", "left").join(parents, "parent_key", "left")
    f = f.join(closed.select("key", "closed"), "key", "left").join(closed.select(F.col("key").alias("parent_key"), F.col("closed").alias("p_closed")), "parent_key", "left")
    member, method, public = ~F.col("is_type"), F.col("kind") == "method", has("public")
    with_type = F.col("kind").isin(*STRUCTURAL) | (method & (F.col("name") == "Deconstruct")) | has("override") | F.col("explicit") | F.coalesce("promised", F.lit(False))
    with_type |= F.coalesce("foreign", F.lit(False)) & ~has("static") & F.col("visibility").isin("public", "internal")
    if not options.aggressive:
        with_type |= (F.col("auto_property") & F.col("visibility").isin("public", "protected", "protected internal")) | (F.col("kind") == "enum_member")
    if not workspace.has_obj:
        with_type |= F.coalesce(F.col("p_modifiers").bitwiseAND(BIT["partial"]) != 0, F.lit(False))
    controls = lambda name, bases: F.coalesce(name.endswith("Controller") | F.exists(bases, lambda b: F.element_at(b, -1).isin("Controller", "ControllerBase")), F.lit(False))
    inert = [a + x for a in INERT_ATTRIBUTES for x in ("", "Attribute")]
    root = F.col("is_generated") | (method & has("partial") & ~F.col("has_body"))
    root |= method & ((F.col("name") == "Main") & has("static") | F.col("name").isin("ConfigureServices", "Configure"))
    root |= method & public & controls(F.col("p_name"), F.col("p_bases"))
    root |= F.col("is_type") & (controls(F.col("name"), F.col("bases")) | (F.col("name") == "Startup") | F.col("fqn").isin(*COMPILER_TYPES))
    root |= F.exists("attributes", lambda a: ~a.isin(inert)) | F.coalesce("scanned", F.lit(False))
    contract = F.lit(library) & ~F.coalesce(F.col("project").isin(tests), F.lit(False)) if tests else F.lit(library)
    if shipped:
        contract |= F.coalesce(F.col("project").isin(shipped), F.lit(False))
    root |= contract & ~hidden & ~F.coalesce("closed", F.lit(False)) & ~F.coalesce("p_closed", F.lit(False))
    if options.roots:
        root |= F.col("display").isin(*options.roots)
        known = {r[0] for r in s.filter(F.col("display").isin(*options.roots)).select("display").distinct().collect()}
        notes += [f"root {x}: no such symbol" for x in options.roots if x not in known]
    f = f.withColumn("with_type", member & with_type).withColumn("ungated", F.col("extension")).withColumn("root", root)
    roots_of_files = facts.files.select(F.concat(F.lit("F:"), F.col("file_id").cast("string")).alias("key"))
    flags = f.select("key", "parent_key", "name", "is_type", "with_type", "ungated", "root")
    flags = flags.unionByName(roots_of_files.select("key", F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("is_type"), F.lit(False).alias("with_type"), F.lit(False).alias("ungated"), F.lit(True).alias("root")))
    return scratch.save(flags, "flags"), notes


def dead_code(workspace: Workspace, facts: Facts, scratch: Scratch, options: Options = Options(), built: tuple[Symbols, Graph] | None = None) -> DeadCode:
    """Findings (kind, symbol_kind, name, project, file, line, col, visibility): dead files, then types and members in their order."""
    symbols, graph = built or build(facts, workspace, scratch)
    flags, notes = _flags(symbols, graph, workspace, facts, options, scratch)
    nodes = flags.select(F.col("key").alias("id"), F.col("parent_key").alias("parent"), "name", (~F.col("is_type")).alias("is_member"), "ungated", "root")
    children = flags.filter("with_type").select(F.col("parent_key").alias("parent"), F.col("key").alias("child"))
    live = gated_reach(nodes, graph.edges, graph.names, children, scratch).select(F.col("id").alias("key"))
    s = symbols.symbols.join(flags.select("key", "with_type", "root"), "key").filter("not is_generated and not root").join(live, "key", "left_anti")
    alive_parent = live.select(F.col("key").alias("parent_key"))
    dead = s.filter("is_type").unionByName(s.filter("not is_type and not with_type").join(alive_parent, "parent_key", "left_semi").select(*s.columns))
    dead = scratch.save(dead, "dead")
    gone = dead.select("key", F.lit(True).alias("gone"))
    decls = symbols.decl_map.join(symbols.symbols.select("key", "parent_key", "is_type"), "key").join(gone, "key", "left").join(gone.select(F.col("key").alias("parent_key"), F.col("gone").alias("up_gone")), "parent_key", "left")
    all_gone = decls.groupBy("file_id").agg(F.bool_and(F.coalesce("gone", F.lit(False)) | (~F.col("is_type") & F.coalesce("up_gone", F.lit(False)))).alias("all")).filter("all")
    files = facts.files.filter("not generated_path").join(all_gone, "file_id", "left_semi")
    rel = lambda c: F.when(F.col(c).startswith(workspace.root + "/"), F.expr(f"substr({c}, {len(workspace.root) + 2})")).otherwise(F.col(c))
    none = F.lit(None).cast("string")
    file_rows = files.select(F.lit("unused-file").alias("kind"), none.alias("symbol_kind"), rel("path").alias("name"), "project", F.col("path").alias("file"), F.lit(1).alias("line"), F.lit(1).alias("col"), none.alias("visibility"))
    rows = dead.join(files.select("file_id"), "file_id", "left_anti").select(F.when(F.col("is_type"), "unused-type").otherwise("unused-member").alias("kind"), F.col("kind").alias("symbol_kind"), F.col("display").alias("name"), "project", F.col("path").alias("file"), "line", "col", "visibility")
    found = unmarked(file_rows.unionByName(rows), markers(facts.markers, rules=list(RULES)), ("unused-file",))
    found = not_ignored(found.withColumn("__rel", rel("file")), "__rel", list(options.ignore)).drop("__rel")
    found = scratch.save(found, "findings")
    counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
    total = facts.files.count()
    counts |= {"projects": len(workspace.projects), "files": total, "symbols": symbols.symbols.count() + total}
    return DeadCode(found.orderBy(F.col("kind") != "unused-file", F.split("file", "/"), "line", "col", "name"), counts, notes)
