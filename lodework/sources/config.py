"""Settings and baselines: JSON or YAML files read on the driver; unknown fields are errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

NAMES = ("lodework.json", "lodework.yaml", "lodework.yml")
BASELINE_VERSION = 1


class ConfigError(Exception):
    pass


@dataclass
class DeadCodeConfig:
    ignore: list[str] = field(default_factory=list)


@dataclass
class DupesConfig:
    mode: str | None = None
    minTokens: int | None = None
    minLines: int | None = None
    minOccurrences: int | None = None
    ignore: list[str] = field(default_factory=list)


@dataclass
class HealthConfig:
    maxComplexity: int | None = None
    maxCognitive: int | None = None
    maxMethodLines: int | None = None
    maxParameters: int | None = None
    maxFileLines: int | None = None
    maxTypeMembers: int | None = None
    excludeTests: bool = False
    baseline: str | None = None
    ignore: list[str] = field(default_factory=list)


@dataclass
class Config:
    aggressive: bool = False
    roots: list[str] = field(default_factory=list)
    libraryProjects: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    deadCode: DeadCodeConfig = field(default_factory=DeadCodeConfig)
    dupes: DupesConfig = field(default_factory=DupesConfig)
    health: HealthConfig = field(default_factory=HealthConfig)
    folder: str = ""
    warnings: list[str] = field(default_factory=list)

    def ignored(self, part: str) -> list[str]:
        """The globs of everything and of one analysis; those that leave the folder are dropped with a warning."""
        out = []
        for g in [*self.ignore, *getattr(self, part).ignore]:
            if ".." in g.split("/"):
                self.warnings.append(f"ignore glob {g} leaves the folder of the settings")
            else:
                out.append(g)
        return out


def _fill(kind: type, data: Any, where: str) -> Any:
    if not isinstance(data, dict):
        raise ConfigError(f"{where} is no object")
    known = {f.name: f for f in fields(kind) if f.name not in ("folder", "warnings")}
    if extra := set(data) - set(known):
        raise ConfigError(f"{where}: unknown field {sorted(extra)[0]}")
    parts = {"deadCode": DeadCodeConfig, "dupes": DupesConfig, "health": HealthConfig}
    return kind(**{k: _fill(parts[k], v or {}, f"{where}.{k}") if kind is Config and k in parts else v for k, v in data.items()})


def parse(path: str) -> Config:
    text = Path(path).read_text()
    try:
        if path.endswith(".json"):
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text) or {}
    except Exception as e:
        raise ConfigError(f"{path}: {e}") from e
    made = _fill(Config, data, Path(path).name)
    made.folder = str(Path(path).resolve().parent)
    return made


def find(start: str) -> Config:
    """The settings of the nearest folder upwards that has some; JSON comes before YAML."""
    here = Path(start).resolve()
    for folder in [here, *here.parents] if here.is_dir() else here.parents:
        found = [str(folder / n) for n in NAMES if (folder / n).is_file()]
        if found:
            made = parse(found[0])
            if len(found) > 1:
                made.warnings.append(f"several settings in {folder}, {Path(found[0]).name} is used")
            return made
    return Config(folder=str(here))


def load_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, list[list[str]]]:
    """(kind, name, file, metric) rows and the members of each cycle. The version is looked at first."""
    try:
        data = json.loads(Path(path).read_text())
    except (OSError, ValueError) as e:
        raise ConfigError(f"baseline {path}: {e}") from e
    if data.get("version") != BASELINE_VERSION:
        raise ConfigError(f"baseline {path}: version {data.get('version')} is not {BASELINE_VERSION}")
    rows = [(f["kind"], f["name"], f["file"], int(f["metric"])) for f in data.get("findings", [])]
    return spark.createDataFrame(rows, "kind string, name string, file string, metric long"), [list(c["members"]) for c in data.get("cycles", [])]


def write_baseline(path: str, findings: list[dict], cycles: list[list[str]], kinds: tuple[str, ...]) -> None:
    """The greatest metric of each kind and name, in the order of kinds and names; cycles by their sorted members."""
    best: dict = {}
    for f in findings:
        key = (f["kind"], f["name"])
        if key not in best or f["metric"] > best[key]["metric"]:
            best[key] = {k: f[k] for k in ("kind", "name", "file", "metric")}
    rows = [best[k] for k in sorted(best, key=lambda k: (kinds.index(k[0]), k[1]))]
    rings = [{"members": list(m)} for m in sorted({tuple(sorted(c)) for c in cycles})]
    Path(path).write_text(json.dumps({"version": BASELINE_VERSION, "findings": rows, "cycles": rings}, indent=2) + "\n")
