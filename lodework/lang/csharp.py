"""Declarations, references, usings and metrics of one C# file.

A recursive descent over tokens that never gives up: what it can't read is skipped token by token and
counted as an error. Where a name could be a type or a value it becomes an ambient reference, which
later steps resolve to everything that it can mean.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from lodework.lang.lexer import PREDEFINED, Places, Token, tokens

#: Modifier keywords, one bit each in this order.
MODIFIERS = ("public", "private", "protected", "internal", "static", "abstract", "sealed", "virtual", "override", "readonly", "const", "partial", "async", "extern", "new", "unsafe")
BIT = {m: 1 << i for i, m in enumerate(MODIFIERS)}
OTHER_MODIFIERS = frozenset(("volatile", "required", "file", "ref", "fixed"))
TYPE_WORDS = ("class", "struct", "interface", "enum", "record", "delegate")
NO_REFERENCE = frozenset(("var", "nameof", "global", "dynamic", "_"))
STARTS_PRIMARY = frozenset("this new typeof default base true false null sizeof checked unchecked object string int uint long ulong short ushort byte sbyte bool char float double decimal".split())
AFTER_GENERIC = frozenset("( ) ] } : ; , . ? == != | ^ && || & [ {".split()) | {">", "=>", "?."}
FILE_ROOT = -1


@dataclass
class Declaration:
    name: str
    kind: str
    namespace: list[str]
    parent: int | None
    modifiers: int
    line: int
    column: int
    attributes: list[str] = field(default_factory=list)
    base_names: list[list[str]] = field(default_factory=list)
    explicit: bool = False
    extension: bool = False
    auto_property: bool = False
    has_body: bool = False
    arity: int = 0
    cyclomatic: int = 0
    cognitive: int = 0
    body_lines: int = 0
    required: int = 0
    optional: int = 0
    out: int = 0
    fqn: str | None = None


class Parser:
    def __init__(self, text: str):
        self.t, self.errors = tokens(text)
        self.place = Places(text)
        self.i, self.origin = 0, FILE_ROOT
        self.decls: list[Declaration] = []
        self.refs: list[tuple[str, list[str], int]] = []
        self.usings: list[tuple[list[str], str | None, bool, bool]] = []
        self.top_level = False
        self.decisions = self.cognitive = 0
        self.namespace: list[str] = []

    # Tokens

    def text(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j].text if 0 <= j < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        j = self.i + k
        return self.t[j].kind if 0 <= j < len(self.t) else ""

    def take(self, text: str) -> bool:
        if self.text() == text and self.kind() in ("punctuation", "keyword", "identifier"):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            self.errors += 1

    def close_of(self, i: int) -> int:
        """The index of the bracket that closes the one at i; without one, the token before the bracket that closes something around it."""
        pairs, depth = {"(": ")", "[": "]", "{": "}"}, []
        for j in range(i, len(self.t)):
            if self.t[j].kind != "punctuation":
                continue
            x = self.t[j].text
            if x in pairs:
                depth.append(pairs[x])
            elif x in (")", "]", "}"):
                if x not in depth:
                    return j - 1
                while depth.pop() != x:
                    pass
                if not depth:
                    return j
        return len(self.t) - 1

    def ref(self, kind: str, path: list[str]) -> None:
        if path and not (len(path) == 1 and path[0] in NO_REFERENCE):
            self.refs.append((kind, [p.lstrip("@") for p in path], self.origin))

    def line(self, tok: Token) -> tuple[int, int]:
        return self.place(tok.at)

    # Types

    def type_(self) -> bool:
        """One type, emitted as references; false, and nothing consumed, if there is none."""
        start, n = self.i, len(self.refs)
        while self.text() in ("ref", "readonly", "scoped") and self.kind(1) in ("identifier", "keyword"):
            self.i += 1
        if self.text() == "(":
            close = self.close_of(self.i)
            self.i += 1
            while self.i < close:
                if not self.type_():
                    break
                if self.kind() == "identifier":
                    self.i += 1
                if not self.take(","):
                    break
            if self.i != close:
                self.i = start
                del self.refs[n:]
                return False
            self.i += 1
        elif self.text() in PREDEFINED:
            self.i += 1
        elif self.kind() == "identifier":
            path = []
            while self.kind() == "identifier":
                name = self.text()
                self.i += 1
                if self.take("::"):
                    continue
                path.append(name)
                if self.text() == "<" and not self.type_arguments():
                    self.i = start
                    del self.refs[n:]
                    return False
                if not (self.text() == "." and self.kind(1) == "identifier"):
                    break
                self.i += 1
            self.ref("Type", path)
            self.last_path = path
        else:
            self.i = start
            return False
        while True:
            if self.text() == "[" and self.text(1) in ("]", ","):
                self.i = self.close_of(self.i) + 1
            elif self.text() in ("?", "*") and self.kind() == "punctuation":
                self.i += 1
            else:
                return True

    last_path: list[str] = []

    def type_arguments(self) -> bool:
        """<...> of types; the number of them is left in `n_args`, the path of the last in `arg_path`."""
        start, n = self.i, len(self.refs)
        self.i += 1
        count, path = 0, []
        while True:
            if self.text() in (",", ">"):  # an open generic
                count += 1
            else:
                while self.text() == "[":
                    self.attributes()
                self.take("in") or self.take("out")
                self.last_path = []
                if not self.type_():
                    self.i = start
                    del self.refs[n:]
                    return False
                count, path = count + 1, self.last_path
            if self.take(">"):
                self.n_args, self.arg_path = count, path
                return True
            if not self.take(","):
                self.i = start
                del self.refs[n:]
                return False

    n_args, arg_path = 0, []

    def is_type_then_name(self) -> bool:
        """Whether a type and an identifier follow, as in a declaration."""
        start, n = self.i, len(self.refs)
        ok = self.type_() and self.kind() == "identifier" and self.text() not in ("is", "as", "when", "and", "or", "switch", "with")
        self.i = start
        del self.refs[n:]
        return ok

    # Units and declarations

    def unit(self) -> None:
        while self.i < len(self.t):
            before = self.i
            self.unit_item([], None)
            if self.i == before:
                self.errors += 1
                self.i += 1

    def unit_item(self, outer: list[str], parent: int | None) -> None:
        x = self.text()
        if x == "extern" and self.text(1) == "alias":
            self.skip_to(";")
        elif x in ("using", "global") and self.is_using():
            self.using()
        elif x == "namespace":
            self.namespace_()
        elif x == "[" or self.is_declaration():
            attrs, refs = self.attribute_lists()
            self.declaration(parent, attrs, refs)
        elif x == "}":
            self.errors += 1
            self.i += 1
        elif x == ";":
            self.i += 1
        else:
            self.top_level = True
            self.statement(0)

    def is_using(self) -> bool:
        k = 1 if self.text() == "global" else 0
        if self.text(k) != "using" or self.text(k + 1) in ("(", "var"):
            return False
        j = self.i + k + 1
        while j < len(self.t) and self.t[j].text not in (";", "(", "{"):
            j += 1
        names = [t for t in self.t[self.i + k + 1 : j]]
        return j < len(self.t) and self.t[j].text == ";" and not (len(names) > 2 and names[1].kind == "identifier" and names[0].kind == "identifier" and names[0].text != "static" and names[1].text != "=")

    def using(self) -> None:
        is_global = self.take("global")
        self.i += 1
        self.take("unsafe")
        is_static, alias = self.take("static"), None
        if self.kind() == "identifier" and self.text(1) == "=":
            alias, self.i = self.text(), self.i + 2
        n = len(self.refs)
        self.last_path = []
        self.type_()
        if not (is_static or alias):
            del self.refs[n:]
        self.usings.append((self.last_path, alias, is_global, is_static))
        self.skip_to(";")

    def skip_to(self, text: str) -> None:
        while self.i < len(self.t) and self.text() != text:
            self.i = self.close_of(self.i) + 1 if self.text() in ("{", "(", "[") else self.i + 1
        self.i += 1

    def namespace_(self) -> None:
        self.i += 1
        path = []
        while self.kind() == "identifier":
            path.append(self.text())
            self.i += 1
            if not self.take("."):
                break
        if self.take(";"):
            self.namespace = self.namespace + path  # to the end of the file
            return
        outer, self.namespace = self.namespace, self.namespace + path
        self.need("{")
        while self.i < len(self.t) and self.text() != "}":
            before = self.i
            self.unit_item([], None)
            self.i += self.i == before
        self.take("}")
        self.namespace = outer

    def attribute_lists(self) -> tuple[list[str], list]:
        """Names of the attributes, and what they refer to, to be owned by the declaration that follows."""
        names, n = [], len(self.refs)
        while self.text() == "[":
            names += self.attributes()
        refs = self.refs[n:]
        del self.refs[n:]
        return names, refs

    def attributes(self) -> list[str]:
        close, names = self.close_of(self.i), []
        self.i += 1
        if self.kind() in ("identifier", "keyword") and self.text(1) == ":":
            self.i += 2
        while self.i < close:
            n, self.last_path = len(self.refs), []
            if not self.type_():
                break
            args = [r for r in self.refs[n:] if r[1] != self.last_path]
            del self.refs[n:]
            self.ref("Attribute", self.last_path)
            self.refs += args
            names.append(self.last_path[-1] if self.last_path else "")
            if self.text() == "(":
                self.brackets(0)
            if not self.take(","):
                break
        self.i = close + 1
        return names

    def is_declaration(self) -> bool:
        k = 0
        while self.text(k) in BIT or (self.text(k) in OTHER_MODIFIERS and self.kind(k + 1) in ("identifier", "keyword") and self.text(k) != "fixed"):
            k += 1
        x = self.text(k)
        if x == "record":
            return self.kind(k + 1) == "identifier" or self.text(k + 1) in ("class", "struct")
        if x == "delegate":
            return self.text(k + 1) not in ("(", "{", "*")
        return x in TYPE_WORDS and self.kind(k + 1) == "identifier"

    def modifiers(self) -> int:
        bits = 0
        while True:
            x = self.text()
            if x in BIT and not (x in ("partial", "async") and self.text(1) in ("(", ";", "=", ",", "{")):
                bits |= BIT[x]
            elif not (x in OTHER_MODIFIERS and self.kind(1) in ("identifier", "keyword")):
                return bits
            self.i += 1

    def add(self, tok: Token, name: str, kind: str, parent: int | None, modifiers: int, attrs: list[str], refs: list) -> int:
        line, column = self.line(tok)
        d = Declaration(name.lstrip("@"), kind, list(self.namespace), parent, modifiers, line, column, list(attrs))
        self.decls.append(d)
        at = len(self.decls) - 1
        self.refs += [(k, p, at) for k, p, _ in refs]
        return at

    def declaration(self, parent: int | None, attrs: list[str], refs: list) -> None:
        modifiers = self.modifiers()
        if self.text() not in TYPE_WORDS or not (self.kind(1) == "identifier" or self.text(1) in ("class", "struct") or self.text() == "delegate"):
            self.member(parent, modifiers, attrs, refs)
            return
        kind = self.text()
        self.i += 1
        if kind == "record" and self.text() in ("class", "struct"):
            kind = "record" if self.text() == "class" else "struct"
            self.i += 1
        outer = self.origin
        if kind == "delegate":
            n = len(self.refs)
            self.type_()
            refs = refs + self.refs[n:]
            del self.refs[n:]
        tok = self.t[self.i] if self.i < len(self.t) else Token("", "", 0, 0)
        at = self.add(tok, tok.text, kind, parent, modifiers, attrs, refs)
        d = self.decls[at]
        above = self.decls[parent].fqn if parent is not None else ".".join(self.namespace)
        d.fqn = f"{above}.{d.name}" if above else d.name
        self.i, self.origin = self.i + 1, at
        if self.text() == "<":
            n = len(self.refs)
            if self.type_arguments():
                d.arity = self.n_args
            del self.refs[n:]
        if self.text() == "(":
            self.parameters(d)
            d.required = d.optional = d.out = 0
        if self.take(":"):
            while self.i < len(self.t):
                self.last_path = []
                if kind == "enum":
                    self.type_()
                    break
                if not self.type_():
                    break
                if self.last_path:
                    d.base_names.append(self.last_path)
                if self.text() == "(":
                    self.brackets(0)
                if not self.take(","):
                    break
        self.constraints()
        if self.take("{"):
            while self.i < len(self.t) and self.text() != "}":
                before = self.i
                if kind == "enum":
                    self.enum_member(at)
                else:
                    inner, inner_refs = self.attribute_lists()
                    if self.text() == ";":
                        self.i += 1
                    else:
                        self.declaration(at, inner, inner_refs)
                if self.i == before:
                    self.errors += 1
                    self.i += 1
            self.need("}")
        self.take(";")
        self.origin = outer

    def constraints(self) -> None:
        while self.text() == "where" and self.kind(1) == "identifier" and self.text(2) == ":":
            self.i += 3
            while True:
                if self.text() in ("class", "struct", "new", "notnull", "unmanaged", "default"):
                    self.i += 1
                    self.take("?")
                    if self.text() == "(":
                        self.i = self.close_of(self.i) + 1
                elif not self.type_():
                    break
                if not self.take(","):
                    break

    def enum_member(self, parent: int) -> None:
        attrs, refs = self.attribute_lists()
        if self.kind() != "identifier":
            return
        at, outer = self.add(self.t[self.i], self.text(), "enum_member", parent, 0, attrs, refs), self.origin
        self.decls[at].has_body = True
        self.i, self.origin = self.i + 1, at
        if self.take("="):
            self.expression({",", "}"}, 0)
        self.take(",")
        self.origin = outer

    def member(self, parent: int | None, modifiers: int, attrs: list[str], refs: list) -> None:
        start, n = self.i, len(self.refs)
        owner = self.decls[parent] if parent is not None else None
        if self.text() == "~" and self.kind(1) == "identifier":
            self.i += 1
            self.callable(self.t[self.i], self.text(), "destructor", parent, modifiers, attrs, refs)
            return
        if owner is not None and self.kind() == "identifier" and self.text(1) == "(" and self.text().lstrip("@") == owner.name:
            kind = "static_constructor" if modifiers & BIT["static"] else "constructor"
            self.callable(self.t[self.i], self.text(), kind, parent, modifiers, attrs, refs)
            return
        is_event = self.take("event")
        conversion = self.text() in ("implicit", "explicit") and self.text(1) in ("operator",)
        if conversion:
            tok = self.t[self.i + 1]
            self.i += 2
            self.take("checked")
            self.type_()
            refs = refs + self.refs[n:]
            del self.refs[n:]
            self.i -= 1
            self.callable(tok, "conversion operator", "conversion_operator", parent, modifiers, attrs, refs)
            return
        if not self.type_():
            if parent is None:
                self.top_level = True
                self.statement(0)
            elif self.i == start:
                self.errors += 1
                self.i += 1
            return
        types = refs + self.refs[n:]
        del self.refs[n:]
        if self.take("operator"):
            tok = self.t[self.i] if self.i < len(self.t) else self.t[-1]
            self.take("checked")
            name = self.text()
            while self.text(1) not in ("(", ""):
                self.i += 1
                name += self.text()
            self.callable(tok, f"operator {name}", "operator", parent, modifiers, attrs, types)
            return
        explicit, path = False, []
        while self.kind() == "identifier" and (self.text(1) == "." or (self.text(1) == "<" and self.explicit_after_generic())):
            explicit = True
            path.append(self.text())
            self.i += 1
            if self.text() == "<":
                self.type_arguments()
            self.i += 1
        if explicit:
            types = [*types, ("Type", path, self.origin), *self.refs[n:]]
            del self.refs[n:]
        if self.text() == "this" and self.text(1) == "[":
            at = self.property_(self.t[self.i], "this[]", "indexer", parent, modifiers, attrs, types)
            self.decls[at].explicit = explicit
            return
        if self.kind() != "identifier":
            if parent is None and not (modifiers or attrs):
                self.i = start
                self.top_level = True
                self.statement(0)
            else:
                self.errors += 1
                self.i = max(self.i, start + 1)
            return
        if self.text(1) in ("(", "<") and not is_event:
            at = self.callable(self.t[self.i], self.text(), "method", parent, modifiers, attrs, types)
        elif self.text(1) in ("{", "=>"):
            at = self.property_(self.t[self.i], self.text(), "event" if is_event else "property", parent, modifiers, attrs, types)
        else:
            self.fields("event" if is_event else "field", parent, modifiers, attrs, refs, types[len(refs) :])
            return
        self.decls[at].explicit = explicit

    def explicit_after_generic(self) -> bool:
        start, n = self.i, len(self.refs)
        self.i += 1
        ok = self.type_arguments() and self.text() == "."
        self.i = start
        del self.refs[n:]
        return ok

    def fields(self, kind: str, parent: int | None, modifiers: int, attrs: list[str], refs: list, types: list) -> None:
        """One declaration for each declarator; each repeats the type, only the first has the attributes' references."""
        outer, first = self.origin, True
        while self.kind() == "identifier":
            at = self.add(self.t[self.i], self.text(), kind, parent, modifiers, attrs, (refs if first else []) + types)
            self.decls[at].has_body = True
            self.i, self.origin, first = self.i + 1, at, False
            if self.text() == "[":
                self.brackets(0)
            if self.take("="):
                self.expression({",", ";"}, 0)
            if not self.take(","):
                break
        self.origin = outer
        if not self.take(";"):
            self.errors += 1
            self.skip_to(";")

    def callable(self, tok: Token, name: str, kind: str, parent: int | None, modifiers: int, attrs: list[str], refs: list) -> int:
        at, outer = self.add(tok, name, kind, parent, modifiers, attrs, refs), self.origin
        d = self.decls[at]
        self.i, self.origin = self.i + 1, at
        if self.text() == "<":
            n = len(self.refs)
            if self.type_arguments():
                d.arity = self.n_args
            del self.refs[n:]
        if self.text() == "(":
            d.extension = self.parameters(d)
        if self.take(":") and self.text() in ("base", "this"):
            self.i += 1
            if self.text() == "(":
                self.brackets(0)
        self.constraints()
        self.bodies(d, [self.body])
        self.origin = outer
        return at

    def property_(self, tok: Token, name: str, kind: str, parent: int | None, modifiers: int, attrs: list[str], refs: list) -> int:
        at, outer = self.add(tok, name, kind, parent, modifiers, attrs, refs), self.origin
        d = self.decls[at]
        self.i, self.origin = self.i + 1, at
        if self.text() == "[":
            self.parameters(d)
        if self.text() == "=>":
            self.bodies(d, [self.body])
        elif self.text() == "{":
            close, spans, plain = self.close_of(self.i), [], True
            self.i += 1
            self.decisions = self.cognitive = 0
            while self.i < close:
                self.attribute_lists()
                self.modifiers()
                if self.kind() not in ("identifier", "keyword"):
                    self.i += 1
                    continue
                self.i += 1
                span = self.body()
                if span:
                    spans.append(span)
                    plain = False
            self.i = close + 1
            d.has_body, d.auto_property = True, plain and kind == "property"
            self.measure(d, spans)
            if self.take("="):
                self.expression({";"}, 0)
                self.take(";")
        self.origin = outer
        return at

    def bodies(self, d: Declaration, readers: list) -> None:
        self.decisions = self.cognitive = 0
        spans = [s for r in readers if (s := r())]
        d.has_body = bool(spans)
        self.measure(d, spans)

    def measure(self, d: Declaration, spans: list[tuple[int, int]]) -> None:
        if spans:
            d.cyclomatic, d.cognitive = len(spans) + self.decisions, self.cognitive
            d.body_lines = spans[-1][1] - spans[0][0] + 1

    def body(self) -> tuple[int, int] | None:
        """A block or an expression body; its first and last line."""
        begin = self.t[self.i] if self.i < len(self.t) else None
        if self.text() == "{":
            self.statement(0)
        elif self.take("=>"):
            self.expression({";"}, 0)
            self.take(";")
        else:
            self.take(";")
            return None
        return self.line(begin)[0], self.place(max(begin.at, self.t[min(self.i, len(self.t)) - 1].end - 1))[0]

    def parameters(self, d: Declaration) -> bool:
        """Counts parameters by kind; whether the first is `this`."""
        close, extension, first = self.close_of(self.i), False, True
        self.i += 1
        while self.i < close:
            self.attribute_lists_kept()
            words = set()
            while self.text() in ("this", "ref", "out", "in", "params", "scoped", "readonly"):
                words.add(self.text())
                self.i += 1
            extension |= first and "this" in words
            first = False
            if not self.type_():
                self.i += 1
                continue
            if self.kind() == "identifier":
                self.i += 1
            default = self.take("=")
            if default:
                self.expression({",", ")", "]"}, 0)
            if "out" in words:
                d.out += 1
            elif default or "params" in words:
                d.optional += 1
            else:
                d.required += 1
            self.take(",")
        self.i = close + 1
        return extension

    def attribute_lists_kept(self) -> None:
        while self.text() == "[":
            self.attributes()

    # Statements

    def statement(self, nest: int) -> None:
        x, start = self.text(), self.i
        if x == "{":
            close = self.close_of(self.i)
            self.i += 1
            while self.i < close:
                before = self.i
                self.statement(nest)
                if self.i == before:
                    self.errors += 1
                    self.i += 1
            self.i = close + 1
        elif x == ";":
            self.i += 1
        elif x == "if":
            self.if_(nest, 1 + nest)
        elif x in ("for", "foreach", "while"):
            self.decisions += 1
            self.cognitive += 1 + nest
            self.i += 1
            self.header(nest)
            self.statement(nest + 1)
        elif x == "await" and self.text(1) in ("foreach", "using"):
            self.i += 1
            self.statement(nest)
        elif x == "do":
            self.decisions += 1
            self.cognitive += 1 + nest
            self.i += 1
            self.statement(nest + 1)
            if self.take("while"):
                self.brackets(nest)
            self.take(";")
        elif x == "switch" and self.text(1) == "(":
            self.switch(nest)
        elif x == "try":
            self.i += 1
            self.statement(nest)
            while self.take("catch"):
                self.decisions += 1
                self.cognitive += 1 + nest
                if self.take("("):
                    self.type_()
                    if self.kind() == "identifier":
                        self.i += 1
                    self.take(")")
                if self.take("when"):
                    self.brackets(nest)
                self.statement(nest + 1)
            if self.take("finally"):
                self.statement(nest)
        elif x == "goto":
            self.cognitive += 1
            self.i += 1
            if self.take("case"):
                self.expression({";"}, nest)
            self.skip_to(";")
        elif x in ("return", "throw") or (x == "yield" and self.text(1) in ("return", "break")):
            self.i += 2 if x == "yield" else 1
            self.expression({";"}, nest)
            self.take(";")
        elif x in ("break", "continue"):
            self.i += 1
            self.take(";")
        elif x in ("lock", "fixed") or (x == "using" and self.text(1) == "("):
            self.i += 1
            self.header(nest)
            self.statement(nest)
        elif x == "using":
            self.i += 1
            self.statement(nest)
        elif x in ("checked", "unchecked", "unsafe") and self.text(1) == "{":
            self.i += 1
            self.statement(nest)
        elif x == "[":
            self.attribute_lists_kept() if self.text(1) != "]" and self.kind(1) == "identifier" else self.expression({";"}, nest)
            if self.i == start:
                self.i += 1
        elif self.kind() == "identifier" and self.text(1) == ":" and x != "default":
            self.i += 2
        elif x == "const":
            self.i += 1
            self.local(nest)
        elif x == "var" and self.text(1) == "(":
            self.i = self.close_of(self.i + 1) + 1
            self.expression({";"}, nest)
            self.take(";")
        elif self.local_function(nest):
            pass
        elif x not in ("await", "this", "base", "new") and self.is_type_then_name():
            self.local(nest)
        else:
            self.expression({";", "}"}, nest)
            if not self.take(";"):
                self.errors += 1

    def if_(self, nest: int, cost: int) -> None:
        self.decisions += 1
        self.cognitive += cost
        self.i += 1
        self.brackets(nest)
        self.statement(nest + 1)
        if self.take("else"):
            if self.text() == "if":
                self.if_(nest, 1)
            else:
                self.cognitive += 1
                self.statement(nest + 1)

    def header(self, nest: int) -> None:
        """( declarations or expressions ), as of loops, using, lock and fixed."""
        if self.text() != "(":
            self.errors += 1
            return
        close = self.close_of(self.i)
        self.i += 1
        while self.i < close:
            if self.text() == "var" and self.text(1) == "(":
                self.i = self.close_of(self.i + 1) + 1
            elif self.is_type_then_name():
                self.type_()
                self.i += 1
            if self.take("in"):
                pass
            self.expression({";", ")"}, nest)
            if not self.take(";") and self.i < close:
                self.i += 1
        self.i = close + 1

    def switch(self, nest: int) -> None:
        self.cognitive += 1 + nest
        self.i += 1
        self.brackets(nest)
        if self.text() != "{":
            self.errors += 1
            return
        close = self.close_of(self.i)
        self.i += 1
        while self.i < close:
            before = self.i
            if self.text() == "case":
                self.decisions += 1
                self.i += 1
                self.pattern({":"}, nest + 1)
                self.take(":")
            elif self.text() == "default" and self.text(1) == ":":
                self.decisions += 1
                self.i += 2
            else:
                self.statement(nest + 1)
            self.i += self.i == before
        self.i = close + 1

    def pattern(self, stops: set[str], nest: int) -> None:
        if self.is_type_then_name():
            self.type_()
            self.i += 1
        self.expression(stops, nest)

    def local(self, nest: int) -> None:
        if not self.type_():
            self.i += 1
            return
        while self.kind() == "identifier":
            self.i += 1
            if self.take("="):
                self.expression({",", ";", "}"}, nest)
            if not self.take(","):
                break
        if not self.take(";"):
            self.errors += 1

    def local_function(self, nest: int) -> bool:
        start, n = self.i, len(self.refs)
        while self.text() in ("static", "async", "unsafe", "extern"):
            self.i += 1
        if self.type_() and self.kind() == "identifier" and self.text(1) in ("(", "<"):
            self.i += 1
            if self.text() != "<" or self.type_arguments():
                if self.text() == "(":
                    after = self.t[self.close_of(self.i) + 1].text if self.close_of(self.i) + 1 < len(self.t) else ""
                    if after in ("{", "=>", "where"):
                        self.parameters(Declaration("", "", [], None, 0, 0, 0))
                        self.constraints()
                        if self.take("=>"):
                            self.expression({";"}, nest + 1)
                            self.take(";")
                        else:
                            self.statement(nest + 1)
                        return True
        self.i = start
        del self.refs[n:]
        return False

    # Expressions

    def brackets(self, nest: int) -> None:
        """(...), [...] or {...}: expressions between commas and the like."""
        if self.text() not in ("(", "[", "{"):
            self.errors += 1
            return
        close = self.close_of(self.i)
        self.i += 1
        while self.i < close:
            before = self.i
            self.expression({",", ";", ")", "]", "}"}, nest)
            if self.i < close:
                self.i += 1
            self.i += self.i == before
        self.i = close + 1

    def is_ternary(self) -> bool:
        if self.text(1) in (".", "[") and self.t[self.i + 1].at == self.t[self.i].end:
            return False
        depth, j, open_ = 0, self.i + 1, 0
        while j < len(self.t):
            x = self.t[j].text if self.t[j].kind == "punctuation" else ""
            if x in ("(", "[", "{"):
                depth += 1
            elif x in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    return False
            elif depth == 0:
                if x in (";", ","):
                    return False
                if x == "?" and not (self.t[j + 1].text in (".", "[") if j + 1 < len(self.t) else False):
                    open_ += 1
                if x == ":":
                    if not open_:
                        return True
                    open_ -= 1
            j += 1
        return False

    def generic_here(self) -> bool:
        """At `<`: whether type arguments follow and after them something that can't follow a comparison."""
        start, n = self.i, len(self.refs)
        ok = self.type_arguments() and (self.text() in AFTER_GENERIC or self.i >= len(self.t))
        self.i = start
        del self.refs[n:]
        return ok

    def name(self, member: bool) -> None:
        """A dotted chain of plain names from here: one ambient path, or, after something else, a member."""
        path, simple = [self.text()], not member
        self.i += 1
        if self.text() == "::":
            self.i += 1
            path = [self.text()]
            self.i += 1
        while simple and self.text() == "." and self.kind(1) == "identifier" and not (self.text(2) == "<" and self.generic_after(2)):
            path.append(self.text(1))
            self.i += 2
        generic = self.text() == "<" and self.generic_here()
        self.ref("Member" if member else "Ambient", path)
        if generic:
            self.type_arguments()
            if self.text() == "(" and self.n_args == 1 and self.arg_path:
                self.ref("ScanTarget", self.arg_path)

    def generic_after(self, k: int) -> bool:
        self.i += k
        ok = self.generic_here()
        self.i -= k
        return ok

    def lambda_body(self, stops: set[str], nest: int) -> None:
        if self.text() == "{":
            self.statement(nest + 1)
        else:
            self.expression(stops, nest + 1)

    def expression(self, stops: set[str], nest: int) -> None:
        ops: list[str] = []

        def flush() -> None:
            # A chain of one operator is one; each run of && below an || is another.
            if ops:
                runs = "".join("1" if o == "&&" else "0" for o in ops).split("0")
                self.cognitive += ("||" in ops) + sum(bool(r) for r in runs)
                ops.clear()

        while self.i < len(self.t):
            tok = self.t[self.i]
            x, kind = tok.text, tok.kind
            if kind == "punctuation" and (x in stops or x in (")", "]", "}")):
                break
            if kind == "identifier":
                if self.text(1) == "=>":
                    self.i += 2
                    self.lambda_body(stops, nest)
                elif self.text(1) == ":" and ":" not in stops and self.text(-1) in ("(", ",", "["):
                    self.i += 2
                elif x == "when" and self.kind(1) in ("identifier", "keyword", "punctuation") and self.text(1) not in (")", ".", ";", ","):
                    self.i += 1
                elif x in ("and", "or", "not") and self.kind(1) != "punctuation":
                    self.i += 1
                    if self.is_type_then_name():
                        self.type_()
                        self.i += 1
                elif x == "await" and (self.kind(1) in ("identifier", "keyword") or self.text(1) == "("):
                    self.i += 1
                elif x in ("async", "static") and (self.text(1) in ("(", "delegate") or self.text(2) == "=>"):
                    self.i += 1
                elif x == "with" and self.text(1) == "{":
                    self.i += 1
                elif self.text(-1) in ("(", ",") and self.designation():
                    pass
                else:
                    self.name(self.text(-1) == "." or (self.text(-1) == "->"))
            elif kind == "keyword":
                self.i += 1
                if x == "new":
                    if self.text() not in ("(", "[", "{"):
                        self.type_()
                elif x in ("typeof", "sizeof", "default") and self.text() == "(":
                    close = self.close_of(self.i)
                    self.i += 1
                    self.type_()
                    self.i = close + 1
                elif x == "as":
                    self.type_()
                elif x == "is":
                    while self.text() == "not":
                        self.i += 1
                    if self.kind() == "identifier" or self.text() in PREDEFINED:
                        self.type_no_nullable()
                        if self.kind() == "identifier" and self.text() not in ("and", "or", "when"):
                            self.i += 1
                elif x == "switch" and self.text() == "{":
                    flush()
                    self.switch_arms(nest)
                elif x == "delegate":
                    if self.text() == "(":
                        self.parameters(Declaration("", "", [], None, 0, 0, 0))
                    if self.text() == "{":
                        self.statement(nest + 1)
                elif x == "out" and self.is_type_then_name():
                    self.type_()
                    self.i += 1
                elif x in PREDEFINED and self.kind() == "identifier":
                    self.i += 1  # a designation, as in (int a, var b) = ...
            elif kind != "punctuation":
                self.i += 1
            elif x == "(":
                self.open(stops, nest)
            elif x in ("[", "{"):
                self.brackets(nest)
            elif x == "?" and self.is_ternary():
                flush()
                self.decisions += 1
                self.cognitive += 1 + nest
                self.i += 1
                self.expression({":"}, nest + 1)
                self.take(":")
                self.expression(stops, nest + 1)
                break
            elif x in ("&&", "||"):
                self.decisions += 1
                ops.append(x)
                self.i += 1
            elif x in ("??", "??=", "=", "=>", ":") or (len(x) > 1 and x.endswith("=") and x not in ("==", "!=", "<=", ">=")):
                flush()
                self.i += 1
            elif x in (";", ","):
                break
            else:
                self.i += 1
        flush()

    def designation(self) -> bool:
        """A type and the name that it declares inside a tuple, as in (Box b, var c) = ...; false, and nothing consumed, if there is none."""
        start, n = self.i, len(self.refs)
        if self.type_() and self.kind() == "identifier" and self.text(1) in (",", ")") and self.text() not in ("is", "as", "when", "and", "or"):
            self.i += 1
            return True
        self.i = start
        del self.refs[n:]
        return False

    def type_no_nullable(self) -> None:
        """A type after `is`, where a ? begins a conditional if a colon follows."""
        self.type_()
        if self.text(-1) == "?":
            self.i -= 1
            if not self.is_ternary():
                self.i += 1

    def switch_arms(self, nest: int) -> None:
        self.cognitive += 1 + nest
        close = self.close_of(self.i)
        self.i += 1
        while self.i < close:
            before = self.i
            self.decisions += 1
            self.pattern({"=>", ","}, nest + 1)
            if self.take("=>"):
                self.expression({",", "}"}, nest + 1)
            self.take(",")
            self.i += self.i == before
        self.i = close + 1

    def open(self, stops: set[str], nest: int) -> None:
        """( of a lambda, a cast, or an argument list, tuple or group."""
        close = self.close_of(self.i)
        after = self.t[close + 1] if close + 1 < len(self.t) else Token("", "", 0, 0)
        if after.text == "=>" and self.text(-1) not in ("switch",) and self.kind(-1) != "identifier":
            self.parameters_of_lambda(close)
            self.need("=>")
            self.lambda_body(stops, nest)
            return
        before = self.t[self.i - 1] if self.i else Token("", "", 0, 0)
        called = before.kind == "identifier" or before.text in (")", "]", ">", "base", "this")
        if not called and (after.kind not in ("punctuation", "keyword") or after.text in STARTS_PRIMARY or after.text in ("(", "~", "!")) and after.kind:
            start, n = self.i, len(self.refs)
            self.i += 1
            plain = self.kind() == "identifier"
            if self.type_() and self.i == close and not (plain and after.text == "("):
                self.i = close + 1
                return
            self.i = start
            del self.refs[n:]
        self.brackets(nest)

    def parameters_of_lambda(self, close: int) -> None:
        self.i += 1
        while self.i < close:
            if self.kind() == "identifier" and self.text(1) in (",", ")"):
                self.i += 1
            elif not self.text() or not (self.is_type_then_name() and self.type_()):
                self.i += 1
        self.i = close + 1


def parse(text: str) -> Parser:
    p = Parser(text)
    try:
        p.unit()
    except (IndexError, RecursionError):
        p.errors += 1
    return p
