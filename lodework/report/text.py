"""Reports for people, made from the JSON documents."""

from __future__ import annotations

from itertools import groupby
from pathlib import Path

WIDTH = 60
#: How each check is worded, from metric and limit.
HEADLINES = {
    "high-complexity": "cyclomatic {}/{}", "high-cognitive-complexity": "cognitive {}/{}", "long-method": "{}/{} lines",
    "too-many-parameters": "{}/{} params", "large-file": "large file {}/{} lines", "large-type": "{}/{} members",
}
#: Categories of members in singular and plural.
CATEGORIES = {"methods": "method", "properties": "property", "fields": "field", "events": "event"}
#: A finding is severe from this multiple of its limit on; scores are high and middling from these on.
SEVERE, HIGH, MIDDLING = 2.0, 60.0, 25.0
#: Terminal codes of the styles that reports use.
STYLES = {"bold": "1", "dim": "2", "red": "31", "green": "32", "yellow": "33", "cyan": "36"}

_color = False


def use_color(on: bool) -> None:
    global _color
    _color = on


def styled(text: str, *styles: str) -> str:
    return f"\x1b[{';'.join(STYLES[s] for s in styles)}m{text}\x1b[0m" if _color and text else text


def many(n: int, noun: str, plural: str | None = None) -> str:
    return f"{n} {noun if n == 1 else plural or noun + 's'}"


def rule(title: str) -> str:
    return styled(f"── {title} ".ljust(WIDTH, "─"), "dim")


def shown(names: list[str], most: int = 3) -> str:
    return ", ".join(names[:most]) + (f", +{len(names) - most} more" if len(names) > most else "")


def _scanned(summary: dict) -> str:
    """What a run has read, and how long that took."""
    parts = [many(summary[k], noun) for k, noun in (("projects", "project"), ("filesScanned", "file"), ("symbols", "symbol")) if k in summary]
    return f"{', '.join(parts)} in {summary['elapsedMs']} ms"


def _clean(what: str, summary: dict) -> str:
    return f"{styled('✓', 'green', 'bold')} no {what} found; {_scanned(summary)}"


def _place(line: int, column: int) -> str:
    return styled(f"{line}:{column}".rjust(7), "dim")


def _file_line(name: str, project: str | None) -> str:
    return styled(name, "bold") + (" " + styled(f"({project})", "dim") if project else "")


def dead_code(doc: dict) -> str:
    """By file; findings come in their order, dead files first."""
    s, out = doc["summary"], [f"{styled('note:', 'cyan', 'bold')} {n}" for n in doc["notes"]]
    if not doc["findings"]:
        return "\n".join([*out, _clean("dead code", s)])
    for (name, project), rows in groupby(doc["findings"], key=lambda f: (f["file"], f.get("project"))):
        out.append(_file_line(name, project))
        for f in rows:
            if f["kind"] == "unused-file":
                label, rest = styled("dead file".ljust(13), "red", "bold"), styled("nothing in it is used", "dim")
            else:
                label = styled("unused type".ljust(13), "yellow", "bold") if f["kind"] == "unused-type" else styled("unused member", "yellow")
                rest = f["name"] + " " + styled(f"({f.get('visibility', '')} {f['symbolKind'].replace('_', ' ')})".replace("( ", "("), "dim")
            out.append(f"  {_place(f['line'], f['column'])}  {label}  {rest}")
    counts = [styled(many(s[k], noun), "red", "bold") for k, noun in (("unusedFiles", "dead file"), ("unusedTypes", "unused type"), ("unusedMembers", "unused member"))]
    return "\n".join([*out, "", f"{styled('found', 'bold')} {', '.join(counts)}; {_scanned(s)}"])


def snippet(root: str, place: dict) -> list[str]:
    """The lines of an occurrence, as far as the file still has them."""
    name = place["file"]
    try:
        lines = Path(root, name).read_text(errors="replace").split("\n")
    except OSError as e:
        return ["  " + styled(f"({name} can't be read any more: {e.strerror})", "dim")]
    part, width = lines[place["startLine"] - 1 : place["endLine"]], len(str(place["endLine"]))
    out = [f"  {styled(f'{n:>{width}} │', 'dim')} {x}" for n, x in enumerate(part, place["startLine"])]
    if len(part) < place["endLine"] - place["startLine"] + 1:
        out.append("  " + styled(f"({name} has become shorter since it was read)", "dim"))
    return out


def dupes(doc: dict, code: bool = True) -> str:
    s, out = doc["summary"], []
    if not doc["groups"]:
        return _clean("duplicate code", s)
    for g in doc["groups"]:
        lines = many(g["lineCount"], "line")
        out.append(styled(many(len(g["occurrences"]), "occurrence"), "yellow", "bold") + " " + styled(f"({g['tokenCount']} tokens, {lines})", "dim"))
        out += [f"  {o['file']}:{o['startLine']}:{o['startColumn']}-{o['endLine']}:{o['endColumn']}" for o in g["occurrences"]]
        if code:
            if doc["mode"] == "semantic":
                out.append("  " + styled("(the first occurrence; names and numbers may differ in the others)", "dim"))
            out += snippet(doc["root"], g["occurrences"][0])
        out.append("")
    found = styled(many(s["groups"], "duplicate group"), "red", "bold")
    return "\n".join([*out, f"{styled('found', 'bold')} {found}, {many(s['duplicatedLines'], 'duplicated line')}; {_scanned(s)}"])


def severity(finding: dict) -> float:
    return finding["metric"] / finding["threshold"] if finding["threshold"] else float(finding["metric"])


def breakdown_text(counts: dict[str, int]) -> str:
    """'3 methods, 1 field': categories that occur, by count and then name."""
    known = sorted((-n, CATEGORIES[c]) for c, n in counts.items() if n)
    return ", ".join(many(-n, c, "properties" if c == "property" else None) for n, c in known)


def parameter_text(counts: dict[str, int]) -> str:
    """Empty if all are required, else how many are declared and of which kinds."""
    if not counts["optional"] and not counts["out"]:
        return ""
    kinds = [f"{counts[k]} {k}" for k in ("required", "optional", "out") if counts[k] or k == "required"]
    return f"{sum(counts.values())} declared: {', '.join(kinds)}"


def described(finding: dict) -> str:
    """A check in a few words: the redder, the further over its limit."""
    head = HEADLINES[finding["kind"]].format(finding["metric"], finding["threshold"])
    head = styled(head, "red", "bold") if severity(finding) >= SEVERE else styled(head, "yellow")
    more = breakdown_text(finding["breakdown"]) if "breakdown" in finding else parameter_text(finding["parameters"]) if "parameters" in finding else ""
    return head + (" " + styled(f"({more})", "dim") if more else "")


def _hotspots(doc: dict) -> list[str]:
    walked = doc["summary"].get("commitsWalked")
    if walked is None:
        return []
    out = ["", styled("hotspots", "bold") + " " + styled(f"(complexity and change, over {many(walked, 'commit')})", "dim")]
    for h in doc["hotspots"]:
        score = f"{h['score']:5.0f}"
        score = styled(score, "red", "bold") if h["score"] >= HIGH else styled(score, "yellow") if h["score"] >= MIDDLING else styled(score, "dim")
        rest = f"complexity {h['cyclomatic']} in {many(h['lines'], 'line')}, {h['weightedCommits']:.1f} weighted commits"
        out.append(f"  {score}  {h['file']}  {styled(rest, 'dim')}")
    return out if doc["hotspots"] else [*out, "  " + styled("no file is both complex and changed", "dim")]


def _cycle(c: dict) -> list[str]:
    names = [m["name"] for m in c["path"]]
    out = ["  " + styled(" → ".join([*names, names[0]]), "red", "bold")]
    out += [f"    {styled(m['file'], 'dim')} {m['line']}:{m['column']}" for m in c["path"]]
    if c["others"]:
        out.append("    " + styled(f"+ {many(len(c['others']), 'more type', 'more types')} in this cycle: {', '.join(m['name'] for m in c['others'])}", "dim"))
    return out


def _left_out(summary: dict) -> list[str]:
    """What was never looked at, and what a baseline hides; nothing where there is neither."""
    parts, gone = [], summary.get("excluded", {})
    if gone.get("testProjects"):
        parts.append(f"{many(len(gone['testProjects']), 'test project')} ({shown(gone['testProjects'])})")
    if gone.get("ignoredFiles"):
        parts.append(many(gone["ignoredFiles"], "ignored file"))
    out = ["  " + styled(f"excluded: {', '.join(parts)}", "dim")] if parts else []
    if "baselined" in summary:
        out.append("  " + styled(f"{many(summary['baselined'], 'finding')} hidden by the baseline", "dim"))
    return out


def health(doc: dict, sort: str = "severity", limit: int | None = None) -> str:
    """Findings by file and, within it, by place; the worst first or in the order of places. `limit` places at most, 0 or None for all."""
    s = doc["summary"]
    if not doc["findings"] and not doc["cycles"]:
        return "\n".join([_clean("health issues", s), *_left_out(s), *_hotspots(doc)])
    files = []
    for name, rows in groupby(doc["findings"], key=lambda f: f["file"]):
        places = [list(p) for _, p in groupby(rows, key=lambda f: (f["line"], f["column"], f["name"]))]
        files.append((name, places))
    worst = lambda place: max(map(severity, place))
    if sort == "severity":
        files = [(name, sorted(places, key=lambda p: (-worst(p), p[0]["line"], p[0]["column"]))) for name, places in files]
        files.sort(key=lambda f: (-max(map(worst, f[1])), f[0].split("/")))
    total = sum(len(places) for _, places in files)
    left, out = limit or total, []
    for name, places in files:
        if left <= 0:
            break
        out += [*([""] if out else []), _file_line(name, places[0][0].get("project"))]
        for place in places[:left]:
            checks = " · ".join(map(described, place))
            if all(f["kind"] == "large-file" for f in place):
                out.append(f"  {_place(place[0]['line'], place[0]['column'])}  {checks}")
            else:
                out += [f"  {_place(place[0]['line'], place[0]['column'])}  {place[0]['name']}", f"  {' ' * 7}  {checks}"]
        left -= len(places[:left])
    if limit and total > limit:
        out.append("  " + styled(f"… and {total - limit} more (--limit 0 lists all)", "dim"))
    if doc["cycles"]:
        out += [*([""] if out else []), styled("circular dependencies", "bold")]
        for c in doc["cycles"]:
            out += _cycle(c)
    out += [*_hotspots(doc), ""]
    kinds = {"highComplexity": "complex method", "highCognitiveComplexity": "hard-to-follow method", "longMethods": "long method", "tooManyParameters": "over-parameterized method", "largeFiles": "large file", "largeTypes": "large type"}
    issues = sum(s[k] for k in kinds) + s["circularDependencies"]
    out.append(f"{styled('found', 'bold')} {styled(many(issues, 'issue'), 'red', 'bold')} in {many(total, 'place')} of {many(len(files), 'file')}; {_scanned(s)}")
    out.append("  " + " · ".join([*(many(s[k], noun) for k, noun in kinds.items()), many(s["circularDependencies"], "circular dependency", "circular dependencies")]))
    return "\n".join([*out, *_left_out(s)])


def check(doc: dict) -> str:
    """The three reports, each under a rule, with nothing left out."""
    parts = [("dead-code", dead_code(doc["deadCode"])), ("dupes", dupes(doc["dupes"])), ("health", health(doc["health"]))]
    return "\n\n".join(f"{rule(title)}\n\n{body}" for title, body in parts)
