"""The audit store: scans and their findings as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import digest

AUDIT = "audit_id bigint, at string, scan_type string, profile string, input_hash string, finding_count bigint"
STORED = "audit_id bigint, finding_type string, severity string, message string, matched_text string, line_number int, file_path string, scanner string, finding_id string"


def scans(docs: DataFrame, findings: DataFrame, scan_type: str, profile: str, at: str) -> DataFrame:
    """An audit row for each document, with the digest of its text and the number of its findings."""
    n = findings.groupBy("doc_id").agg(F.count("*").alias("finding_count"))
    d = docs.join(n, "doc_id", "left")
    return d.select(
        F.col("doc_id").cast("bigint").alias("audit_id"), F.lit(at).alias("at"), F.lit(scan_type).alias("scan_type"), F.lit(profile).alias("profile"),
        digest(16, F.col("text")).alias("input_hash"), F.coalesce("finding_count", F.lit(0)).cast("bigint").alias("finding_count"),
    )


def stored(findings: DataFrame) -> DataFrame:
    """Findings as the store keeps them: empty texts and line 0 are null."""
    return findings.select(
        F.col("doc_id").alias("audit_id"), "finding_type", "severity", "message", F.nullif("matched_text", F.lit("")).alias("matched_text"),
        F.nullif("line_number", F.lit(0)).alias("line_number"), "file_path", "scanner", "finding_id",
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def record(audit: DataFrame, found: DataFrame, path: str, scan: str) -> None:
    """Stores a scan's findings and then its audit rows under one name; a repeated scan replaces itself.

    The audit rows are the commit: ``load`` gives only the findings of scans that have them, so that a scan that broke off
    between the two is not seen.
    """
    found.write.mode("overwrite").parquet(f"{path}/findings/scan={scan}")
    audit.write.mode("overwrite").parquet(f"{path}/audit/scan={scan}")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The audit rows and the findings of all whole scans; both have ``scan``."""
    names = "scan string"
    audit = spark.read.schema(f"{AUDIT}, {names}").parquet(f"{path}/audit")
    found = spark.read.schema(f"{STORED}, {names}").parquet(f"{path}/findings")
    return audit, found.join(audit.select("scan", "audit_id").distinct(), ["scan", "audit_id"], "left_semi")


def query_log(audit: DataFrame, scan_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the log, the latest first."""
    a = audit if scan_type is None else audit.where(F.col("scan_type") == scan_type)
    return a.orderBy(F.desc("audit_id")).offset(offset).limit(limit)


def get_findings(found: DataFrame, audit_id: int | None = None, finding_type: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    for name, value in (("audit_id", audit_id), ("finding_type", finding_type), ("severity", severity)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return found.orderBy(F.desc("audit_id"), "finding_id").limit(limit)


def stats(found: DataFrame) -> DataFrame:
    """dimension, value, n: findings in all, by severity and by type, in one pass."""
    g = found.groupingSets([["severity"], ["finding_type"], []], "severity", "finding_type").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "severity").when(F.col("g") == 2, "finding_type").otherwise("all")
    return g.select(kind.alias("dimension"), F.coalesce("severity", "finding_type", F.lit("")).alias("value"), "n")
