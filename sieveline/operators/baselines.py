"""Baselines as files: a table of JSON lines, whose first kind of row is the header."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import fingerprint

VERSION = "1.0"
_ROW = "version string, created_at string, tool_version string, fingerprint string"


def save(findings: DataFrame, path: str, created_at: str, tool_version: str = "0.1.0") -> None:
    """Writes the fingerprint of every finding, repeats included."""
    none = F.lit(None).cast("string")
    rows = findings.select(none.alias("version"), none.alias("created_at"), none.alias("tool_version"), fingerprint().alias("fingerprint"))
    head = findings.sparkSession.createDataFrame([(VERSION, created_at, tool_version, None)], _ROW)
    head.unionByName(rows).write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The distinct fingerprints. A path that isn't there, rows that are no objects and another version are errors of
    their own kinds."""
    try:
        rows = spark.read.schema(_ROW + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    seen = rows.agg(F.count("_bad").alias("bad"), F.array_sort(F.collect_set("version")).alias("versions")).first()
    if seen["bad"] or not seen["versions"]:
        raise ValueError(f"{path} is no baseline: it needs a header and rows of objects")
    if list(seen["versions"]) != [VERSION]:
        raise ValueError(f"baseline version {', '.join(seen['versions'])} isn't {VERSION}")
    return rows.where("fingerprint is not null").select("fingerprint").distinct()
