"""The C# reader: metrics and declarations of hand cases, and the analyses over small trees."""

import json
import os

import pytest

from lodework.__main__ import main
from lodework.functions.tables import Scratch
from lodework.lang.csharp import parse
from lodework.lang.extract import extract
from lodework.lang.lexer import tokens
from lodework.plans import dead_code
from lodework.sources import config, workspace

BODIES = [
    ("{}", 1, 0), ("{ if (a) b(); else c(); }", 2, 2), ('{ return a && b || s != null && (s ?? "x").Length > 0; }', 4, 3), ("{ var x = a ?? b ?? c ?? d; }", 1, 0),
    ("{ for(;;){} foreach(var x in y){} while(a){} do {} while(b); }", 5, 4), ("{ if(a){} if(b){} if(c){} }", 4, 3), ("{ if(a){ if(b){ if(c){} } } }", 4, 6), ("{ if(a){} else if(b){} else {} }", 3, 3),
    ("{ if (a && b) {} }", 3, 2), ("{ if(a){} else if(b){ if(c){} } else { if(d){} } }", 5, 7), ("{ if(a){ goto x; } x: ; }", 2, 2), ("{ switch(a){ case 1: break; case 2: break; case 3: break; default: break; } }", 5, 1),
    ("{ return a && b && c; }", 3, 1), ("{ return a && b || c; }", 3, 2), ("{ Run(() => { if (a) {} }); }", 2, 2), ("{ switch(a){ case 1: case 2: default: break; } }", 4, 1), ("{ return x switch { 1 => a, 2 => b, _ => c }; }", 4, 1),
]


@pytest.mark.parametrize("body,cyclomatic,cognitive", BODIES)
def test_metrics(body, cyclomatic, cognitive):
    d = parse(f"class C {{ void M() {body} }}").decls[1]
    assert (d.cyclomatic, d.cognitive) == (cyclomatic, cognitive)


@pytest.mark.parametrize("text,want", [("int a, int b" + "".join(f", int x{i} = 1" for i in range(14)), (2, 14, 0)), ("int a, B b, C c, D d, out int e, out int f", (4, 0, 2)), ("this S s, ref int a, in int b", (3, 0, 0)), ("int a, params int[] b", (1, 1, 0))])
def test_parameters(text, want):
    d = parse(f"class C {{ static void M({text}) {{}} }}").decls[1]
    assert (d.required, d.optional, d.out) == want


def test_properties_and_lines():
    d = parse("class C\n{\n int P { get { return 1; } set { if (a) b(); } }\n int Q { get; set; }\n void M()\n {\n }\n}\n").decls
    assert [(x.name, x.cyclomatic, x.auto_property, x.body_lines) for x in d[1:]] == [("P", 3, False, 1), ("Q", 0, True, 0), ("M", 1, False, 2)]


def test_errors_still_give_declarations():
    p = parse("class A { void M( { } int Q => ; }\nclass B { void N() { } } }}")
    assert "B" in [d.name for d in p.decls] and p.errors


def test_tokens():
    kinds = [(t.kind, t.text) for t in tokens('a = $"x{b:N}y\\n" + @"c""d" + """r"q""" + \'z\' + 1.5e3 + 0x1F; // c\n#if X\n/* d */ e')[0]]
    assert ("string_escape", "\\n") in kinds and ("identifier", "b") in kinds and ("string_escape", '""') in kinds and ("real_literal", "1.5e3") in kinds and ("integer_literal", "0x1F") in kinds and kinds[-1] == ("identifier", "e")


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


EXE = '<Project Sdk="Microsoft.NET.Sdk"><PropertyGroup><OutputType>Exe</OutputType></PropertyGroup></Project>'


def dead(spark, root, **options):
    w = workspace.discover(str(root))
    s = Scratch(spark, "t")
    got = dead_code.dead_code(w, extract(workspace.source_files(spark, w), s), s, dead_code.Options(**options))
    return {(r["kind"], r["name"]) for r in got.findings.collect()}, got


def test_dead_code(spark, tmp_path):
    write(tmp_path, {
        "App/App.csproj": EXE,
        "App/Program.cs": 'using Lib.Deep; namespace App; static class Program { static void Main() { new Kiosk().Serve(); "x".Louder(); Reg.Add<IJob>(); } }',
        "App/Kiosk.cs": "namespace App; class Kiosk { public void Serve() { } void Unused() { } // lodework:off unused-member\n void AlsoUnused() { } public int P { get; set; } [Json] void Marked() { } ~Kiosk() { } }",
        "App/Dead.cs": "namespace App { class Dead { void A() { new Dead().B(); } void B() { } } }",
        "App/Ext.cs": "namespace Lib.Deep { public static class Ext { public static string Louder(this string s) => s; public static string Softer(this string s) => s; } }",
        "App/Jobs.cs": "interface IJob { void Run(); } class Sweep : IJob { public void Run() { } void Helper() { } } static class Reg { public static void Add<T>() { } }",
        "App/Own.g.cs": "class Generated { void X() { } }",
        "App/bin/Skip.cs": "class Skipped { }",
    })
    got, result = dead(spark, tmp_path)
    assert got == {("unused-file", "App/Dead.cs"), ("unused-member", "App.Kiosk.AlsoUnused"), ("unused-member", "Lib.Deep.Ext.Softer"), ("unused-member", "Sweep.Helper"), ("unused-member", "IJob.Run")}
    assert result.counts["files"] == 6  # those below bin are no sources
    assert ("unused-member", "App.Kiosk.P") in dead(spark, tmp_path, aggressive=True)[0]
    rooted, result = dead(spark, tmp_path, roots=("App.Dead", "No.Such"), ignore=("App/Ext.cs",))
    assert ("unused-file", "App/Dead.cs") not in rooted and not any("Softer" in n for _, n in rooted) and any("No.Such" in n for n in result.notes)


def test_resolution_tells_names_apart(spark, tmp_path):
    """Of two types of one name, exactly the one that the scope of the reference means is live."""
    cases = {
        "using": ("using A; namespace X; static class P { static void Main() { T t; } }", "A.T"),
        "own": ("namespace B; static class P { static void Main() { T t; } }", "B.T"),
        "ancestor": ("namespace A.In.Deep; static class P { static void Main() { T t; } }", "A.T"),
        "full": ("namespace X; static class P { static void Main() { B.T t; } }", "B.T"),
        "alias": ("using Q = B.T; namespace X; static class P { static void Main() { Q t; } }", "B.T"),
    }
    for name, (source, live) in cases.items():
        root = tmp_path / name
        write(root, {"a.cs": "namespace A { class T { } }", "b.cs": "namespace B { class T { } }", "p.cs": source, "x.csproj": EXE})
        got, _ = dead(spark, root)
        assert got == {("unused-file", "b.cs" if live == "A.T" else "a.cs")}, name


def test_library_mode(spark, tmp_path):
    write(tmp_path, {"L.csproj": '<Project Sdk="Microsoft.NET.Sdk"/>', "a.cs": "public class Api { public void Used() { } private void Not() { } internal class Hidden { public void X() { } } }", "b.cs": "class Inner { }"})
    got, result = dead(spark, tmp_path)
    assert got == {("unused-member", "Api.Not"), ("unused-type", "Api.Hidden"), ("unused-file", "b.cs")} and result.notes


def test_workspace(tmp_path):
    write(tmp_path, {
        "All.sln": 'Project("{1}") = "One", "src\\One\\One.csproj", "{2}"\nEndProject\n',
        "src/One/One.csproj": '<Project Sdk="Microsoft.NET.Sdk.Web"><ItemGroup><PackageReference Include="xunit.core"/><Compile Remove="Old/**"/><Using Include="G"/></ItemGroup></Project>',
        "src/One/A.cs": "", "src/One/Old/B.cs": "", "src/One-b/C.cs": "", "ignored/D.cs": "", ".gitignore": "ignored/\n*.tmp.cs\n", "E.tmp.cs": "", "obj/F.cs": "", "src/One/obj/G.cs": "",
    })
    w = workspace.discover(str(tmp_path))
    p = w.projects[0]
    assert (p.kind, p.test_framework, p.usings, w.has_obj) == ("web", "xunit", ["G"], True)
    assert [(os.path.relpath(f, tmp_path), i, g) for f, i, g in w.files] == [("src/One/A.cs", 0, False), ("src/One/obj/G.cs", 0, True), ("src/One-b/C.cs", None, False)]
    with pytest.raises(workspace.WorkspaceError):
        workspace.discover(str(tmp_path / "no"))


def test_settings(spark, tmp_path):
    write(tmp_path, {"lodework.json": json.dumps({"ignore": ["gen/", "../x"], "health": {"maxComplexity": 3, "ignore": ["a"]}}), "lodework.yaml": "aggressive: true", "bad.json": '{"nope": 1}', "b.json": '{"version": 2}'})
    c = config.find(str(tmp_path))
    assert c.health.maxComplexity == 3 and c.ignored("health") == ["gen/", "a"] and len(c.warnings) == 2
    for bad in ("bad.json",):
        with pytest.raises(config.ConfigError):
            config.parse(str(tmp_path / bad))
    with pytest.raises(config.ConfigError):
        config.load_baseline(spark, str(tmp_path / "b.json"))


def test_command_line(spark, tmp_path, capsys):
    branches = "\n".join(f"if (a{i} && b) {{ c{i}(d); }}" for i in range(12))
    write(tmp_path, {"A.cs": f"namespace N;\npublic class Alpha {{ Beta b;\npublic void Big(int a)\n{{\n{branches}\n}}\n}}", "B.cs": f"namespace N;\npublic class Beta {{ Alpha a;\npublic void Same(int z)\n{{\n{branches}\n}}\n}}"})
    assert main(["dupes", str(tmp_path), "--format", "json"], spark) == 1
    doc = json.loads(capsys.readouterr().out)
    assert doc["summary"]["groups"] == 1 and [o["startLine"] for o in doc["groups"][0]["occurrences"]] == [4, 4]
    saved = str(tmp_path / "baseline.json")
    assert main(["health", str(tmp_path), "--write-baseline", saved], spark) == 0
    assert {f["kind"] for f in json.loads(open(saved).read())["findings"]} == {"high-complexity", "high-cognitive-complexity"} and json.loads(open(saved).read())["cycles"] == [{"members": ["N.Alpha", "N.Beta"]}]
    capsys.readouterr()
    assert main(["health", str(tmp_path), "--baseline", saved, "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["summary"]["baselined"] == 5
    assert main(["nonsense"], spark) == 2 and main(["health", str(tmp_path / "none")], spark) == 2


def test_texts_of_reports(spark, tmp_path, capsys):
    """Headlines, bands, groups and what was left out, without and with styles."""
    from lodework.report import text

    branches = "\n".join(f"if (a{i}) {{ }}" for i in range(24))
    write(tmp_path, {
        "One/One.csproj": '<Project Sdk="Microsoft.NET.Sdk"/>', "Tests/Tests.csproj": '<Project Sdk="Microsoft.NET.Sdk"><ItemGroup><PackageReference Include="nunit"/></ItemGroup></Project>',
        "One/A.cs": f"namespace N;\npublic class Ring {{ Link l;\npublic void Mild(int a, int b, int c, int d, int e, int f, int g = 1) {{ }}\npublic void Wild()\n{{\n{branches}\n}}\n}}",
        "One/B.cs": "namespace N;\npublic class Link { Ring r; Chain c; }\npublic class Chain { Link l; }", "Tests/T.cs": "class T { }",
    })
    assert main(["health", str(tmp_path), "--exclude-tests", "--color", "never"], spark) == 1
    out = capsys.readouterr().out.split("\n")
    assert out[0] == "One/A.cs (One)" and out[1].endswith("N.Ring.Wild/0") or out[1].endswith("N.Ring.Wild")
    assert "cyclomatic 25/10 · cognitive 24/15" in out[2] and any("6/5 params (7 declared: 6 required, 1 optional)" in x for x in out)
    assert "  N.Ring → N.Link → N.Ring" in out and "    One/A.cs 2:14" in out and any("+ 1 more type in this cycle: N.Chain" in x for x in out)
    assert any(x.startswith("found 4 issues in 2 places of 1 file; 1 project, 2 files") for x in out) and any("excluded: 1 test project (Tests)" in x for x in out)
    assert main(["health", str(tmp_path), "--limit", "1", "--color", "always", "--format", "text"], spark) == 1
    styled = capsys.readouterr().out
    assert "\x1b[31;1mcyclomatic 25/10\x1b[0m" in styled and "\x1b[33mcognitive 24/15\x1b[0m" in styled and "… and 1 more" in styled
    text.use_color(False)
    assert main(["health", str(tmp_path), "--format", "json"], spark) == 1
    doc = json.loads(capsys.readouterr().out)
    assert [f["parameters"] for f in doc["findings"] if "parameters" in f] == [{"required": 6, "optional": 1, "out": 0}] and "symbols" in doc["summary"]
    assert doc["cycles"][0]["path"][0] == {"name": "N.Ring", "project": "One", "file": "One/A.cs", "line": 2, "column": 14}
    assert text.breakdown_text({"methods": 1, "properties": 3, "fields": 0, "events": 1}) == "3 properties, 1 event, 1 method"
    hot = {"summary": {"projects": 1, "filesScanned": 1, "elapsedMs": 1, "commitsWalked": 2}, "findings": [], "cycles": [], "hotspots": [{"file": "a", "score": 61.0, "weightedCommits": 1.5, "cyclomatic": 3, "lines": 1}]}
    assert text.health(hot).split("\n")[-1] == "     61  a  complexity 3 in 1 line, 1.5 weighted commits"


def test_rules_of_liveness(spark, tmp_path):
    """What lives without being named: rules of kinds, interfaces, attributes, frameworks and registrations, and what they don't cover."""
    source = """using System;
static class Program { static void Main() { var t = new Tools(); t.Use(); Registry.Add<ITask>(); IRun r = t; r.Go(); "a".Twice(); Later later; } }
class Tools : IOutside, IRun {
  public Tools() { } public void Use() { } public void Go() { } public void External() { } public static void Stat() { } void Hidden() { }
  public void Deconstruct(out int a) { a = 1; } public override string ToString() => ""; public int this[int i] => i; ~Tools() { } void IRun.Go() { }
}
interface IRun { void Go(); }
interface ITask { }
class Job : ITask { void Work() { } }
abstract class Template : ITask { }
static class Registry { public static void Add<T>() { } }
class Marked { [Inject] void Set() { } [Obsolete] void Gone() { } }
class HomeController { public void Index() { } void Help() { } }
class Startup { public void Configure() { } void Other() { } }
enum Kind { One, Two }
class Ghost { public void Use() { } }
static class Ext { public static string Twice(this string s) => s; public static string Thrice(this string s) => s; }
partial class Half { partial void Half1(); }
class Later { public int Auto { get; set; } internal int Inner { get; set; } public int Computed { get { return 1; } } }
"""
    write(tmp_path, {"App/App.csproj": EXE, "App/All.cs": source})
    got, result = dead(spark, tmp_path)
    members = {"Tools.Stat", "Tools.Hidden", "Job.Work", "Marked.Gone", "HomeController.Help", "Startup.Other", "Ext.Thrice", "Later.Inner", "Later.Computed"}
    assert got == {("unused-member", m) for m in members} | {("unused-type", t) for t in ("Kind", "Ghost", "Template")}
    more = dead(spark, tmp_path, aggressive=True)[0] - got
    assert more == {("unused-member", "Later.Auto")}
    assert result.counts["unused-type"] == 3 and result.counts["unused-member"] == len(members) and not result.notes
