"""Settings of a project: which profile, severities, exclusions and patterns of its own a scan uses."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.plans.engines import PROFILES, SCANNERS, Profile, Scanner

#: Names of settings files, the first found counts.
NAMES = (".sieveline.json", ".sieveline.yaml", ".sieveline.yml")
DEPTH = 10


@dataclass(frozen=True)
class Project:
    profile: str | None = None
    severity_overrides: dict[str, str] = field(default_factory=dict)
    exclude_paths: list[str] = field(default_factory=list)
    custom_patterns: list[dict] = field(default_factory=list)
    path: str | None = None

    @property
    def scan_profile(self) -> Profile:
        return PROFILES[self.profile or "general"]

    def applied(self, findings: DataFrame) -> DataFrame:
        """The findings with the project's own severities."""
        if not self.severity_overrides:
            return findings
        own = F.try_element_at(X.literal_map(self.severity_overrides), F.coalesce("pattern_name", F.lit("")))
        f = findings.withColumn("severity", F.coalesce(own, F.col("severity")))
        return f.withColumn("severity_rank", X.rank(F.col("severity")).cast("int"))


def _read(path: Path) -> dict:
    kind = path.suffix.lower()
    if not path.is_file():
        raise FileNotFoundError(str(path))
    text = path.read_text(encoding="utf-8")
    if kind == ".json":
        return json.loads(text)
    if kind in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError:
            raise ImportError(f"{path} needs a YAML library; write it as JSON instead") from None
        return yaml.safe_load(text) or {}
    raise ValueError(f"settings of kind {kind or 'none'} can't be read")


def load(path: str) -> Project:
    said = _read(Path(path))
    keys = ("profile", "severity_overrides", "exclude_paths", "custom_patterns")
    return Project(**{k: said[k] for k in keys if k in said}, path=str(path))


def discover(start: str = ".", depth: int = DEPTH) -> Project | None:
    """The settings in the folder or the nearest one above it, ``depth`` folders up at most."""
    here = Path(start).resolve()
    for folder in [here, *here.parents][:depth]:
        for name in NAMES:
            if (folder / name).is_file():
                return load(str(folder / name))
    return None


def load_profile(path: str) -> Profile:
    """A profile from a JSON or YAML file: name, and for each scanner enabled, sensitivity and engines."""
    said = _read(Path(path))
    base = Profile(said["name"], tuple(said.get("blocked_categories", ())))
    levels = {s: Scanner(said.get(s, {}).get("enabled", True), said.get(s, {}).get("sensitivity", "medium")) for s in SCANNERS}
    return replace(base, scanners=levels, engines=tuple(said.get("code_scanner", {}).get("engines", ["regex"])))
