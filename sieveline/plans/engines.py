"""Profiles, the registry of analysis engines, and the plans that compose scanners."""

from __future__ import annotations

import fnmatch
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.operators import findings as P
from sieveline.operators import flows, scanners, versions
from sieveline.sources import manifests

SCANNERS = ("code_scanner", "secret_scanner", "injection_detector", "pii_detector", "content_moderator")


@dataclass(frozen=True)
class Scanner:
    enabled: bool = True
    sensitivity: str = "medium"


@dataclass(frozen=True)
class Profile:
    name: str
    blocked: tuple[str, ...] = ()
    engines: tuple[str, ...] = ("regex",)
    scanners: dict[str, Scanner] = field(default_factory=lambda: {s: Scanner() for s in SCANNERS})

    def level(self, scanner: str) -> Scanner:
        return self.scanners.get(scanner, Scanner())

    def with_engines(self, *names: str) -> Profile:
        if unknown := [n for n in names if n not in ENGINES]:
            raise ValueError(f"unknown engines: {', '.join(unknown)}")
        return replace(self, engines=names)


def _all(level: str) -> dict[str, Scanner]:
    return {s: Scanner(True, level) for s in SCANNERS}


PROFILES = {
    p.name: p
    for p in (
        Profile("general"), Profile("education", ("violence", "self_harm")),
        Profile("healthcare", ("violence",), scanners=_all("high")), Profile("finance", ("illegal_activity",), scanners=_all("high")),
        Profile("children", ("violence", "self_harm", "illegal_activity"), scanners=_all("high")),
    )
}

Engine = Callable[[DataFrame, str], DataFrame]
#: An engine takes documents and a sensitivity and returns findings.
ENGINES: dict[str, Engine] = {"regex": scanners.scan_code, "deep": flows.scan_flows}
#: What the engines can do.
CAPABILITIES: dict[str, dict] = {
    "regex": {"analysis": "line patterns", "speed": "fast", "cross_line": False, "data_flow": False, "languages": sorted(set(scanners.R.LANGUAGE_RULES))},
    "deep": {"analysis": "tainted data flows", "speed": "moderate", "cross_line": True, "data_flow": True, "languages": ["javascript", "python"]},
}
#: Everything that a caller can ask for; ``status`` lists it.
OPERATIONS = (
    "scan_code", "scan_input", "scan_output", "check_secrets", "scan_all", "read_tree", "scan_diff", "match_pattern", "check_dependencies", "scan_dependencies",
    "upsert", "mark", "list_marks", "list_engines", "with_engines", "document", "save", "load", "quality_gate",
)


def register(name: str, engine: Engine, **capabilities) -> None:
    if not callable(engine):
        raise TypeError("an engine is a function of documents and a sensitivity")
    if name in ENGINES:
        raise ValueError(f"engine {name} exists")
    ENGINES[name] = engine
    CAPABILITIES[name] = capabilities


def get_engine(name: str) -> Engine:
    if name not in ENGINES:
        raise KeyError(f"unknown engine {name}; there are {', '.join(sorted(ENGINES)) or 'none'}")
    return ENGINES[name]


def list_engines(spark: SparkSession, enabled: tuple[str, ...] | None = None) -> DataFrame:
    """name, enabled and capabilities (JSON) of each engine; without a list all are enabled."""
    rows = [(n, enabled is None or n in enabled, json.dumps(CAPABILITIES.get(n, {}), sort_keys=True)) for n in sorted(ENGINES)]
    return spark.createDataFrame(rows, "name string, enabled boolean, capabilities string")


def enabled_engines(names: tuple[str, ...]) -> list[Engine]:
    """In the order asked for; names that aren't known are passed over, so that old profiles still work."""
    return [ENGINES[n] for n in names if n in ENGINES]


def timed(docs: DataFrame, profile: Profile) -> DataFrame:
    """Runs each engine of the profile by itself: engine, duration_ms, finding_count."""
    rows = []
    for name in profile.engines:
        if name in ENGINES:
            began = time.monotonic()
            n = ENGINES[name](docs, profile.level("code_scanner").sensitivity).count()
            rows.append((name, round((time.monotonic() - began) * 1000, 2), n))
    return docs.sparkSession.createDataFrame(rows, "engine string, duration_ms double, finding_count long")


def status(spark: SparkSession, profile: Profile, vulns: DataFrame | None = None, marks: DataFrame | None = None, timings: DataFrame | None = None) -> DataFrame:
    """name and value (JSON) of what is set, stored and on offer."""
    said = [("profile", json.dumps(profile.name)), ("engines", json.dumps(list(profile.engines))), ("operations", json.dumps(list(OPERATIONS)))]
    said += [(f"scanner.{s}", json.dumps({"enabled": profile.level(s).enabled, "sensitivity": profile.level(s).sensitivity})) for s in SCANNERS]
    rows = spark.createDataFrame(said, "name string, value string")
    for name, df in (("vulnerabilities", vulns), ("false_positives", marks.where("is_active") if marks is not None else None)):
        if df is not None:
            rows = rows.unionByName(df.agg(F.count("*").cast("string").alias("value")).select(F.lit(name).alias("name"), "value"))
    if timings is not None:
        rows = rows.unionByName(timings.select(F.concat(F.lit("engine."), "engine").alias("name"), F.to_json(F.struct("duration_ms", "finding_count")).alias("value")))
    return rows


def scan_dependencies(files: DataFrame, vulns: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """Findings of the manifests (path, content) of a tree: each package once, as its first manifest has it."""
    for glob in exclude or []:
        files = files.where(~F.col("path").rlike(fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")))
    return versions.check_dependencies(manifests.first_of_each(manifests.parse(files)), vulns)


def scan_code(docs: DataFrame, profile: Profile = PROFILES["general"], semantic: bool = False, marker: str = P.MARKER) -> DataFrame:
    """All engines of the profile, merged; adjusted by structure if asked; then secrets; then inline suppressions."""
    parts = []
    code = profile.level("code_scanner")
    if code.enabled:
        found = [ENGINES[e](docs, code.sensitivity) for e in profile.engines if e in ENGINES]
        if found:
            merged = reduce(DataFrame.unionByName, found)
            if len(found) > 1:
                merged = P.merge_engines(merged).select(*scanners.COLUMNS)
            if semantic:
                merged = _adjusted(merged, docs)
            parts.append(merged)
    if profile.level("secret_scanner").enabled:
        parts.append(scanners.check_secrets(docs, profile.level("secret_scanner").sensitivity))
    every = reduce(DataFrame.unionByName, parts) if parts else scanners.check_secrets(docs.limit(0))
    return P.suppress(every, P.directives(docs, marker)).select(*scanners.COLUMNS)


def _adjusted(found: DataFrame, docs: DataFrame) -> DataFrame:
    return flows.adjust(found, flows.facts(docs)).select(*scanners.COLUMNS)


def scan_all(docs: DataFrame, profile: Profile = PROFILES["general"]) -> DataFrame:
    """Every enabled scanner over the documents."""
    on = profile.level
    parts = [scan_code(docs, profile)]
    if on("injection_detector").enabled:
        parts.append(scanners.check_injection(docs, on("injection_detector").sensitivity))
    if on("pii_detector").enabled:
        parts.append(scanners.check_pii(docs, on("pii_detector").sensitivity))
    if on("content_moderator").enabled:
        parts.append(scanners.check_content(docs, on("content_moderator").sensitivity, list(profile.blocked) or None))
    return reduce(DataFrame.unionByName, parts)
