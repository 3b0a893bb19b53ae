"""Command line: python -m lodework [check|dead-code|dupes|health] PATH. Exit code 0: clean, 1: findings, 2: error."""

from __future__ import annotations

import argparse
import os
import sys

COMMANDS = ("check", "dead-code", "dupes", "health")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodework")
    sub = p.add_subparsers(dest="command", required=True)
    made = {}
    for name in COMMANDS:
        made[name] = c = sub.add_parser(name)
        c.add_argument("path", nargs="?", default=".")
        c.add_argument("--format", choices=("text", "json"), default="text")
        c.add_argument("--config")
        c.add_argument("--color", choices=("auto", "always", "never"), default="auto")
    made["dead-code"].add_argument("--aggressive", action="store_true")
    made["dead-code"].add_argument("--root", action="append")
    made["dead-code"].add_argument("--library", action="append")
    d = made["dupes"]
    d.add_argument("--mode", choices=("exact", "semantic"))
    d.add_argument("--no-code", action="store_true")
    for x in ("min-tokens", "min-lines", "min-occurrences"):
        d.add_argument(f"--{x}", type=int)
    h = made["health"]
    for x in ("complexity", "cognitive", "method-lines", "parameters", "file-lines", "type-members"):
        h.add_argument(f"--max-{x}", type=int)
    h.add_argument("--exclude-tests", action="store_true")
    h.add_argument("--sort", choices=("severity", "file"), default="severity")
    h.add_argument("--limit", type=int, default=0, help="places that are listed; 0 for all")
    h.add_argument("--hotspots", action="store_true")
    h.add_argument("--top", type=int, default=10)
    both = h.add_mutually_exclusive_group()
    both.add_argument("--baseline")
    both.add_argument("--write-baseline")
    return p


def main(args: list[str] | None = None, spark=None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    if not args or (args[0] not in COMMANDS and not args[0].startswith("-")):
        if args and not os.path.exists(args[0]) and "/" not in args[0] and "." not in args[0]:
            print(f"error: {args[0]} is neither a command ({', '.join(COMMANDS)}) nor a path", file=sys.stderr)
            return 2
        args = ["check", *args]
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    from pyspark.sql import SparkSession

    from lodework.plans import check
    from lodework.report import documents, text
    from lodework.sources.config import ConfigError
    from lodework.sources.history import HistoryError
    from lodework.sources.workspace import WorkspaceError

    spark = spark or SparkSession.builder.appName("lodework").getOrCreate()
    try:
        s = check.start(spark, a.path, a.config)
        if a.command == "dead-code":
            doc, show = check.run_dead_code(s, a.aggressive, tuple(a.root) if a.root else None, tuple(a.library) if a.library else None), text.dead_code
        elif a.command == "dupes":
            doc, show = check.run_dupes(s, a.mode, a.min_tokens, a.min_lines, a.min_occurrences), lambda d: text.dupes(d, not a.no_code)
        elif a.command == "health":
            limits = {x: getattr(a, f"max_{x}") for x in ("complexity", "cognitive", "method_lines", "parameters", "file_lines", "type_members")}
            doc, show = check.run_health(s, limits, a.exclude_tests, a.hotspots, a.top, a.baseline, a.write_baseline), lambda d: text.health(d, a.sort, a.limit)
        else:
            doc, show = check.run_check(s), text.check
    except (WorkspaceError, ConfigError, HistoryError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    for w in dict.fromkeys(s.warnings):
        print(f"warning: {w}", file=sys.stderr)
    text.use_color(a.color == "always" or (a.color == "auto" and sys.stdout.isatty() and not os.environ.get("NO_COLOR")))
    print(documents.dumps(doc) if a.format == "json" else show(doc))
    wrote = a.command == "health" and a.write_baseline
    return 0 if wrote or not check.has_findings(doc) else 1


if __name__ == "__main__":
    sys.exit(main())
