"""Dependency manifests: files (path, content) in, one row for each versioned dependency out.

The JSON kinds are read with schemas; the line kinds carry their state - the header or the block that a line stands
in - along a window over the lines of one file. Only TOML and nested lock files of the first version go through Python.
A file whose JSON is broken gives no rows; files of other names are left out, as is what has no version.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions.text import lines

SCHEMA = "path string, position int, name string, version string, ecosystem string"
#: A specifier is a name, extras, an operator and a version.
SPECIFIER = r"^([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)(?:\[[^\]]*\])?\s*(===|==|~=|>=|<=|!=|>|<)\s*([^\s;,]+)"
NPM_PREFIX, COMPOSER_PREFIX = r"^[~^>=<!\s]+", r"^[~^>=<!\s|]+"
PNPM_KEY = r"^\s+/?(@?[^@\s(][^@(]*?)@(\d[^:\s(]*)(?:\([^)]*\))?:"
ECOSYSTEM = {
    "package.json": "npm", "package-lock.json": "npm", "yarn.lock": "npm", "pnpm-lock.yaml": "npm", "Pipfile.lock": "PyPI", "pyproject.toml": "PyPI",
    "requirements.txt": "PyPI", "go.mod": "Go", "go.sum": "Go", "composer.json": "Packagist", "composer.lock": "Packagist",
}


def kind_of(path: Column) -> Column:
    base = F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "[^/]*$", 0)
    return F.when(base.isin(*ECOSYSTEM), base).when(base.rlike(r"(?i)^requirements[-_]?\w*\.txt$"), "requirements.txt")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _requirements(rows: DataFrame) -> DataFrame:
    line = _trim(F.col("line"))
    cut = _trim(F.get(F.split(_trim(F.get(F.split(line, " #", 2), F.lit(0))), ";", 2), F.lit(0)))
    r = rows.where(~line.rlike("^$|^#|^-")).withColumn("_c", cut).where(F.col("_c").rlike(SPECIFIER))
    return r.select("path", "position", F.regexp_extract("_c", SPECIFIER, 1).alias("name"), F.regexp_extract("_c", SPECIFIER, 3).alias("version"))


def _maps(files: DataFrame, keys: list[str], value: str, version) -> DataFrame:
    """Entries of top-level objects, one key after the other."""
    schema = ", ".join(f"`{k}` map<string,{value}>" for k in keys)
    f = files.select("path", F.from_json("content", schema).alias("j"))
    some = F.flatten(F.array(*[F.coalesce(F.map_entries(f"j.`{k}`"), F.array()) for k in keys]))
    f = f.select("path", F.posexplode(some).alias("position", "e")).select("path", "position", F.col("e.key").alias("name"), version(F.col("e.value")).alias("version"))
    return f.where("version is not null and version <> ''")


def _numbered(prefix: str):
    def version(v: Column) -> Column:
        bare = F.regexp_replace(v, prefix, "")
        return F.when(bare.rlike("^[0-9]"), bare)

    return version


def _package_lock(files: DataFrame) -> DataFrame:
    f = files.select("path", F.from_json("content", "packages map<string,struct<version:string>>").alias("j")).where("j.packages is not null")
    f = f.select("path", F.posexplode("j.packages").alias("position", "key", "v")).where("key <> ''")
    return f.select("path", "position", F.substring_index("key", "node_modules/", -1).alias("name"), F.col("v.version").alias("version")).where("version is not null and version <> ''")


def _composer_lock(files: DataFrame) -> DataFrame:
    item = "array<struct<name:string,version:string>>"
    f = files.select("path", F.from_json("content", f"packages {item}, `packages-dev` {item}").alias("j"))
    f = f.select("path", F.posexplode(F.concat(F.coalesce("j.packages", F.array().cast(item)), F.coalesce("j.`packages-dev`", F.array().cast(item)))).alias("position", "e"))
    return f.select("path", "position", "e.name", F.regexp_replace("e.version", "^v", "").alias("version")).where("name <> '' and version <> ''")


def _state(rows: DataFrame, mark: Column) -> DataFrame:
    """The latest mark at or before each line of its file."""
    w = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mark", mark).withColumn("state", F.last("mark", True).over(w))


def _first_seen(df: DataFrame) -> DataFrame:
    return df.groupBy("path", "name", "version").agg(F.min("position").alias("position")).select("path", "position", "name", "version")


def _yarn(rows: DataFrame) -> DataFrame:
    spec = F.regexp_replace(_trim(F.get(F.split(F.regexp_replace("line", r"[\s:]+$", ""), ","), F.lit(0))), '^"+|"+$', "")
    name = F.when(spec.startswith("@"), F.regexp_extract(spec, "^(@[^@]*)@", 1)).otherwise(F.when(F.locate("@", spec) > 1, F.substring_index(spec, "@", 1)).otherwise(spec))
    hit = F.col("line").rlike('^\\s+version\\s+"[^"]+"')
    mark = F.when(F.col("line").rlike("^$|^#"), "").when(~F.col("line").rlike("^\\s"), name)
    w = Window.partitionBy("path", "state", "_block").orderBy("position")
    block = F.sum(F.when(F.col("mark").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("path").orderBy("position"))
    r = _state(rows, mark).withColumn("_block", block).where(hit & (F.col("state") != "")).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return _first_seen(r.select("path", "position", F.col("state").alias("name"), F.regexp_extract("line", '^\\s+version\\s+"([^"]+)"', 1).alias("version")))


def _pnpm(rows: DataFrame) -> DataFrame:
    bare = _trim(F.col("line"))
    mark = F.when(bare.isin("packages:", "packages: ~"), "in").when(~F.col("line").rlike("^[ \\t]") & bare.endswith(":"), "out")
    r = _state(rows, mark).where((F.col("state") == "in") & F.col("mark").isNull() & F.col("line").rlike(PNPM_KEY))
    return _first_seen(r.select("path", "position", F.regexp_extract("line", PNPM_KEY, 1).alias("name"), F.regexp_extract("line", PNPM_KEY, 2).alias("version")))


def _go_mod(rows: DataFrame) -> DataFrame:
    bare = _trim(F.col("line"))
    r = rows.where(~bare.rlike("^$|^//")).withColumn("_b", bare)
    single = F.col("_b").startswith("require ") & ~F.col("_b").contains("(")
    mark = F.when(single, None).when(F.col("_b").startswith("require") & F.col("_b").contains("("), "require").when(F.col("_b") == ")", "none").when(F.col("_b").endswith("("), "other")
    r = _state(r, mark)
    parts = F.split("_b", r"\s+")
    one = r.where(single & (F.size(parts) >= 3)).select("path", "position", F.get(parts, F.lit(1)).alias("name"), F.get(parts, F.lit(2)).alias("version"))
    form = r"^\s+(\S+)\s+(v\S+)"
    many = r.where((F.col("state") == "require") & F.col("mark").isNull() & ~single & F.col("line").rlike(form))
    return one.unionByName(many.select("path", "position", F.regexp_extract("line", form, 1).alias("name"), F.regexp_extract("line", form, 2).alias("version")))


def _go_sum(rows: DataFrame) -> DataFrame:
    parts = F.split(_trim(F.col("line")), r"\s+")
    r = rows.where(F.size(parts) >= 3).select("path", "position", F.get(parts, F.lit(0)).alias("name"), F.replace(F.get(parts, F.lit(1)), F.lit("/go.mod"), F.lit("")).alias("version"))
    return _first_seen(r)


def _from_python(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Project tables in TOML, and lock files that nest their dependencies."""
    def specifiers(path, text):
        try:
            project = tomllib.loads(text).get("project", {})
        except (tomllib.TOMLDecodeError, AttributeError):
            return
        groups = project.get("optional-dependencies", {})
        for said in [*project.get("dependencies", []), *(x for g in groups.values() for x in g)]:
            if m := re.match(SPECIFIER, str(said).split(";")[0].strip()):
                yield m[1], m[3]

    def nested(path, text):
        try:
            top = json.loads(text)
        except ValueError:
            return
        if not isinstance(top, dict) or top.get("packages"):
            return
        todo = list(reversed(list((top.get("dependencies") or {}).items())))
        while todo:
            name, entry = todo.pop()
            if isinstance(entry, dict):
                if entry.get("version"):
                    yield name, str(entry["version"])
                todo += reversed(list((entry.get("dependencies") or {}).items()))

    for b in batches:
        out = []
        for path, kind, text in zip(b["path"], b["kind"], b["content"], strict=True):
            found = (specifiers if kind == "pyproject.toml" else nested)(path, text or "")
            out += [(path, n, *x) for n, x in enumerate(found)]
        yield pd.DataFrame(out, columns=["path", "position", "name", "version"])


def parse(files: DataFrame) -> DataFrame:
    """path, position, name, version, ecosystem of every dependency of the files."""
    f = files.select("path", kind_of(F.col("path")).alias("kind"), F.coalesce("content", F.lit("")).alias("content")).where("kind is not null")
    one = lambda *k: f.where(F.col("kind").isin(*k))
    by_line = lambda k: one(k).select("path", F.posexplode(lines(F.col("content"))).alias("position", "line"))
    skip = ~F.col("name").rlike("^php$|^ext-")
    parts = [
        (_requirements(by_line("requirements.txt")), "PyPI"),
        (_maps(one("package.json"), ["dependencies", "devDependencies"], "string", _numbered(NPM_PREFIX)), "npm"),
        (_package_lock(one("package-lock.json")), "npm"), (_yarn(by_line("yarn.lock")), "npm"), (_pnpm(by_line("pnpm-lock.yaml")), "npm"),
        (_maps(one("Pipfile.lock"), ["default", "develop"], "struct<version:string>", lambda v: F.regexp_replace(v["version"], "^=+", "")), "PyPI"),
        (_go_mod(by_line("go.mod")), "Go"), (_go_sum(by_line("go.sum")), "Go"),
        (_maps(one("composer.json"), ["require", "require-dev"], "string", _numbered(COMPOSER_PREFIX)).where(skip), "Packagist"),
        (_composer_lock(one("composer.lock")), "Packagist"),
    ]
    schema = "path string, position int, name string, version string"
    parts += [(one("pyproject.toml").mapInPandas(_from_python, schema), "PyPI"), (one("package-lock.json").mapInPandas(_from_python, schema), "npm")]
    out = None
    for df, eco in parts:
        row = df.select("path", F.col("position").cast("int").alias("position"), "name", "version", F.lit(eco).alias("ecosystem"))
        out = row if out is None else out.unionByName(row)
    return out


def first_of_each(deps: DataFrame) -> DataFrame:
    """One row for each package of a tree of files: the first by path and position."""
    return deps.groupBy("name", "ecosystem").agg(F.min_by(F.struct("path", "position", "version"), F.struct("path", "position")).alias("x")).select("x.*", "name", "ecosystem")
