"""The C# reader against the rules of declarations and references, one by one."""

import pytest

from lodework.lang.csharp import parse
from lodework.lang.extract import facts_of


def refs(body, members=""):
    """References of a method's body, as (kind, dotted path), in a class of its own."""
    p = parse(f"class Host {{ {members} void Run() {{ {body} }} }}")
    assert p.errors == 0
    return {(k, ".".join(path)) for k, path, _ in p.refs}


def decls(text):
    p = parse(text)
    assert p.errors == 0
    return [(d.kind, d.fqn or d.name) for d in p.decls]


def test_kinds_of_types_and_members():
    """E1, E12, E13: six kinds of types, eleven of members, names for those that have none."""
    got = decls("""namespace Zoo {
  interface IPen { void Feed(); int this[int i] { get; } event System.Action Fed; }
  struct Spot { public int X; }
  enum Size { Small, Large = 4 }
  record Tag(string Text);
  delegate int Count(int a);
  class Pen<T> : IPen {
    static Pen() { }
    public Pen(int n) { }
    ~Pen() { }
    public const int Most = 3, Least = 1;
    public string Name { get; set; }
    public int this[int i] => i;
    public event System.Action Fed { add { } remove { } }
    public static Pen<T> operator +(Pen<T> a, Pen<T> b) => a;
    public static implicit operator int(Pen<T> a) => 1;
    public void Feed() { }
  }
}""")
    assert got == [
        ("interface", "Zoo.IPen"), ("method", "Feed"), ("indexer", "this[]"), ("event", "Fed"), ("struct", "Zoo.Spot"), ("field", "X"), ("enum", "Zoo.Size"), ("enum_member", "Small"),
        ("enum_member", "Large"), ("record", "Zoo.Tag"), ("delegate", "Zoo.Count"), ("class", "Zoo.Pen"), ("static_constructor", "Pen"), ("constructor", "Pen"), ("destructor", "Pen"),
        ("field", "Most"), ("field", "Least"), ("property", "Name"), ("indexer", "this[]"), ("event", "Fed"), ("operator", "operator +"), ("conversion_operator", "conversion operator"), ("method", "Feed"),
    ]


def test_details_of_declarations():
    """E12-E16: arity, bases, attributes, modifiers, extension, auto and explicit members, positions."""
    p = parse("namespace A.B;\n[Keep, Sys.Old(\"x\")] public sealed partial class C<T, U> : Base<T>, N.IThing { }\nstatic class E { public static void Go(this C<int, int> c) { } }\nclass F : IThing { void IThing.Do() { } int P { get; private set; } int Q { get => 1; } int R => 2; partial void Half(); }")
    by = {d.name: d for d in p.decls}
    c = by["C"]
    assert (c.arity, c.base_names, c.attributes, (c.line, c.column), c.fqn) == (2, [["Base"], ["N", "IThing"]], ["Keep", "Old"], (2, 50), "A.B.C")
    assert by["Go"].extension and not by["Do"].extension and by["Do"].explicit and not by["Half"].has_body and by["R"].has_body
    assert [by[n].auto_property for n in "PQR"] == [True, False, False]


def test_fields_give_one_declaration_each():
    """E14: the type is referred to once a declarator, attributes once."""
    p = parse("class C { [Mark] Widget a = new Widget(), b; }")
    assert [(d.kind, d.name, d.has_body) for d in p.decls[1:]] == [("field", "a", True), ("field", "b", True)]
    assert [x for x in p.refs if x[0] == "Attribute"] == [("Attribute", ["Mark"], 1)]
    assert {o for k, path, o in p.refs if path == ["Widget"]} == {1, 2}


@pytest.mark.parametrize("body,want", [
    ("Box b = null;", {("Type", "Box")}), ("var b = make;", {("Ambient", "make")}), ("Shop.Cart.Total.ToString();", {("Ambient", "Shop.Cart.Total.ToString")}),
    ("cart.Items[0].Price = 1;", {("Ambient", "cart.Items"), ("Member", "Price")}), ("make().Item.Cost();", {("Ambient", "make"), ("Member", "Item"), ("Member", "Cost")}),
    ("var x = y as Box;", {("Ambient", "y"), ("Type", "Box")}), ("if (y is Box z) { }", {("Ambient", "y"), ("Type", "Box")}), ("new List<Box>();", {("Type", "List"), ("Type", "Box")}),
    ("typeof(Box).ToString();", {("Type", "Box"), ("Member", "ToString")}), ("Box[] b = new Box[n];", {("Type", "Box"), ("Ambient", "n")}), ("nameof(Box);", {("Ambient", "Box")}),
    ("global::Shop.Cart c;", {("Type", "Shop.Cart")}), ("foreach (Box b in all) { }", {("Type", "Box"), ("Ambient", "all")}), ("_ = done;", {("Ambient", "done")}), ("dynamic d = e;", {("Ambient", "e")}),
    ("Go(size: 3);", {("Ambient", "Go")}), ("a?.Open();", {("Ambient", "a"), ("Member", "Open")}), ("(Box b, int n) = pair;", {("Type", "Box"), ("Ambient", "pair")}), ("(var a, Box c) = pair;", {("Type", "Box"), ("Ambient", "pair")}), ("foreach ((Box k, int v) in all) { }", {("Type", "Box"), ("Ambient", "all")}), ("(x, y) = pair;", {("Ambient", "x"), ("Ambient", "y")}), ("goto end; end: ;", set()),
])
def test_references(body, want):
    """E2-E7: positions that declare a name refer to nothing; types, ambient chains and members of results do."""
    assert want <= refs(body) and {r for r in refs(body) if r[1] in ("b", "z", "size", "end", "var", "_", "dynamic", "n", "a", "c", "k", "v")} <= want


def test_scan_targets_have_one_type_argument():
    """E8."""
    assert ("ScanTarget", "IJob") in refs("reg.Add<IJob>();") and not [r for r in refs("reg.Add<IJob, Job>();") if r[0] == "ScanTarget"] and not [r for r in refs("new Reg<IJob>();") if r[0] == "ScanTarget"]


def test_namespaces_and_usings():
    """E10, E11: block namespaces end, file-scoped ones don't; only static and alias usings refer to something."""
    assert decls("namespace A { class X { } namespace B.C { class Y { } } } class Z { }") == [("class", "A.X"), ("class", "A.B.C.Y"), ("class", "Z")]
    assert decls("namespace A.B; class X { class Y { } } class Z { }") == [("class", "A.B.X"), ("class", "A.B.X.Y"), ("class", "A.B.Z")]
    p = parse("global using G.H; using A.B; using static C.D; using E = F.G; class X { }")
    assert [(".".join(path), alias, g, s) for path, alias, g, s in p.usings] == [("G.H", None, True, False), ("A.B", None, False, False), ("C.D", None, False, True), ("F.G", "E", False, False)]
    assert {(k, ".".join(path)) for k, path, _ in p.refs} == {("Type", "C.D"), ("Type", "F.G")}


def test_files():
    """E17, S10, M1: a trailing newline begins a line, a mark in the first kilobyte means generated, unreadable files are empty with errors."""
    assert facts_of(b"class C\n{\n}\n", False)["line_count"] == 4 and facts_of(None, False)["has_errors"]
    assert facts_of(b"// <auto-generated/>\nclass C { }", False)["is_generated"] and not facts_of(b" " * 1024 + b"// <auto-generated/>", False)["is_generated"]
    assert facts_of(b"Go();", False)["top_level"] and not facts_of(b"class C { }", False)["top_level"]
    assert facts_of("﻿class C { } // lodework:off\n".encode(), False)["lines"] == ["1:class C { } // lodework:off"]
