"""Change history: which files each commit on the first-parent line touched, and when."""

from __future__ import annotations

import itertools
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from lodework.functions.tables import Scratch


class HistoryError(Exception):
    pass


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "core.quotePath=false", "-C", root, *args], capture_output=True, text=True, errors="replace")
    if done.returncode:
        raise HistoryError(done.stderr.strip() or "git failed")
    return done.stdout


#: Rows that the driver holds before they are written.
AT_ONCE = 100_000


def _changes(root: str) -> Iterator[tuple[str | None, int]]:
    """(path, commit time) of each change, and (None, time) for each commit, as git prints them."""
    args = ["log", "--first-parent", "-m", "--root", "--no-renames", "--relative", "--name-only", "--format=%x01%ct"]
    with subprocess.Popen(["git", "-c", "core.quotePath=false", "-C", root, *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as p:
        at = 0
        for line in p.stdout:
            line = line.rstrip("\n")
            if line.startswith("\x01"):
                at = int(line[1:])
                yield None, at
            elif line:
                yield line, at


def commits(spark: SparkSession, root: str, scratch: Scratch) -> tuple[DataFrame, int, list[str]]:
    """(path, commit_ts) rows with paths relative to root, the number of commits, and warnings.

    Each commit is compared with its first parent; renames are a removal and an addition. The log is read
    as a stream and written in parts, so the driver never holds all of it.
    """
    warnings = []
    if _git(root, "rev-parse", "--is-bare-repository").strip() == "true":
        raise HistoryError("a bare repository has no files")
    if _git(root, "rev-parse", "--is-shallow-repository").strip() == "true":
        warnings.append("the clone is shallow: older changes are missing")
    n, table, changes = 0, None, _changes(root)
    while rows := list(itertools.islice(changes, AT_ONCE)):
        n += sum(path is None for path, _ in rows)
        part = scratch.save(spark.createDataFrame([r for r in rows if r[0] is not None], "path string, commit_ts long"), "commits")
        table = part if table is None else table.unionByName(part)
    if not n:
        warnings.append("no commits yet")
    return (table if table is not None else spark.createDataFrame([], "path string, commit_ts long")), n, warnings
