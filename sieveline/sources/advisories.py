"""Vulnerability advisories in the public OSV format, flattened to one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = """id string, summary string, details string, aliases array<string>, published string, modified string,
severity array<struct<type:string,score:string>>,
affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<map<string,string>>>>>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a line or one a file."""
    return flatten(spark.read.schema(SCHEMA).json(path))


def flatten(raw: DataFrame) -> DataFrame:
    """The package of the first entry, the ranges of all, the last fix, and the score of the newest scale."""
    events = F.flatten(F.transform(F.flatten(F.transform("affected", lambda a: F.coalesce(a["ranges"], F.array()))), lambda r: F.coalesce(r["events"], F.array())))
    fixes = F.filter(F.transform(events, lambda e: F.try_element_at(e, F.lit("fixed"))), lambda x: x.isNotNull())
    score = lambda kind: F.get(F.transform(F.filter("severity", lambda s: s["type"] == kind), lambda s: F.regexp_extract(s["score"], r"(\d+(?:\.\d+)?)$", 1).try_cast("double")), F.lit(0))
    return raw.select(
        F.col("id").alias("vuln_id"), F.get("affected", F.lit(0))["package"]["ecosystem"].alias("ecosystem"), F.get("affected", F.lit(0))["package"]["name"].alias("package"),
        "summary", F.coalesce(score("CVSS_V3"), score("CVSS_V4"), score("CVSS_V2"), F.lit(0.0)).alias("severity_score"),
        F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.startswith("CWE-")).alias("cwe_ids"),
        F.flatten(F.transform("affected", lambda a: F.coalesce(a["ranges"], F.array()))).alias("affected_ranges"),
        F.element_at(F.when(F.size(fixes) > 0, fixes), -1).alias("fixed_version"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "published",
    )


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The row fetched last of each vulnerability; both have ``fetched_at``."""
    w = Window.partitionBy("vuln_id").orderBy(F.desc("fetched_at"))
    return stored.unionByName(fresh, allowMissingColumns=True).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stats(vulns: DataFrame, synced: DataFrame) -> DataFrame:
    """For each ecosystem its advisories, packages and last synchronisation (ecosystem, last_sync); a null ecosystem is all."""
    n = vulns.rollup("ecosystem").agg(F.count("*").alias("n_vulnerabilities"), F.countDistinct("package").alias("n_packages"))
    return n.join(synced.select("ecosystem", "last_sync"), "ecosystem", "left")


def stale(ecosystems: DataFrame, synced: DataFrame, now: float, max_age_hours: float = 24.0) -> DataFrame:
    """The ecosystems never synchronised (ecosystem, last_sync in seconds) or longer ago than that."""
    return ecosystems.join(synced, "ecosystem", "left").where(F.col("last_sync").isNull() | (F.lit(now) - F.col("last_sync") > max_age_hours * 3600)).select("ecosystem")
