"""Findings as documents of the public SARIF 2.1.0 format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import fingerprint, literal_map

# Fixed values of the format.
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "none"}
SCORE = {"critical": "9.0", "high": "7.0", "medium": "4.0", "low": "1.0", "info": "0.1"}


def _rule_id() -> Column:
    return F.concat_ws("/", "finding_type", F.nullif("pattern_name", F.lit("")))


def results(findings: DataFrame, base: str = "") -> DataFrame:
    """rule_id and the JSON of the result of each finding."""
    uri = F.replace(F.regexp_replace("file_path", f"^\\Q{base.rstrip('/')}\\E/" if base else "(?!)", ""), F.lit("\\"), F.lit("/"))
    region = F.when(F.col("range").isNotNull(), F.struct(
        (F.col("range.start_line") + 1).alias("startLine"), (F.col("range.start_col") + 1).alias("startColumn"),
        (F.col("range.end_line") + 1).alias("endLine"), (F.col("range.end_col") + 1).alias("endColumn"),
    )).when(F.col("line_number") > 0, F.struct(F.col("line_number").alias("startLine"), F.lit(None).cast("int").alias("startColumn"), F.lit(None).cast("int").alias("endLine"), F.lit(None).cast("int").alias("endColumn")))
    place = F.when(F.col("file_path").isNotNull(), F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))))
    r = F.struct(
        _rule_id().alias("ruleId"), F.try_element_at(literal_map(LEVEL), F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        place.alias("locations"), F.struct(fingerprint().alias("primaryLocationLineHash")).alias("partialFingerprints"),
    )
    return findings.select("doc_id", "seq", _rule_id().alias("rule_id"), "severity", "message", "cwe_ids", F.to_json(r).alias("result"))


def rules(findings: DataFrame) -> DataFrame:
    """One definition for each rule, from its first finding, with help from its remediation and its weaknesses."""
    f = findings.withColumn("rule_id", _rule_id()).groupBy("rule_id").agg(F.min_by(F.struct("severity", "message", "cwe_ids", "remediation"), F.struct("doc_id", "seq")).alias("x"))
    code = lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```"))
    fix = F.col("x.remediation")
    both = F.when((F.length(fix["before"]) > 0) & (F.length(fix["after"]) > 0), F.concat(F.lit("**Before:**\n"), code(fix["before"]), F.lit("\n\n**After:**\n"), code(fix["after"])))
    weak = F.transform("x.cwe_ids", lambda c: F.struct(F.struct(c.alias("id"), F.struct(F.lit("CWE").alias("name"), F.lit(0).alias("index")).alias("toolComponent")).alias("target"), F.array(F.lit("superset")).alias("kinds")))
    one = F.struct(
        F.col("rule_id").alias("id"), F.struct(F.col("x.message").alias("text")).alias("shortDescription"),
        F.struct(F.try_element_at(literal_map(LEVEL), F.col("x.severity")).alias("level")).alias("defaultConfiguration"),
        F.when(fix.isNotNull(), F.struct(fix["description"].alias("text"), both.alias("markdown"))).alias("help"),
        F.when(F.size("x.cwe_ids") > 0, weak).alias("relationships"),
        F.struct(F.try_element_at(literal_map(SCORE), F.col("x.severity")).alias("security-severity"), F.col("x.cwe_ids").alias("tags")).alias("properties"),
    )
    return f.select("rule_id", F.to_json(one).alias("rule"))


def taxa(findings: DataFrame) -> DataFrame:
    """The weaknesses that occur: cwe_id and its entry of the taxonomy."""
    c = findings.select(F.explode("cwe_ids").alias("cwe_id")).distinct()
    return c.select("cwe_id", F.to_json(F.struct(F.col("cwe_id").alias("id"), F.struct(F.col("cwe_id").alias("text")).alias("shortDescription"))).alias("taxon"))


def document(findings: DataFrame, tool: str = "sieveline", version: str = "0.1.0", base: str = "") -> DataFrame:
    """One row with the whole log. It gathers all findings and is meant for one scan's report; large exports write
    ``results``, ``rules`` and ``taxa``, whose rows are the log's parts."""
    def joined(df: DataFrame, key: list[str], value: str) -> DataFrame:
        rows = df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, value))), lambda x: x[value]), ",").alias("x"))
        return rows.select(F.lit(value).alias("part"), "x")

    parts = joined(results(findings, base), ["doc_id", "seq"], "result").unionByName(joined(rules(findings), ["rule_id"], "rule")).unionByName(joined(taxa(findings), ["cwe_id"], "taxon"))
    p = parts.agg(F.map_from_entries(F.collect_list(F.struct("part", "x"))).alias("p"))
    head = f'{{"$schema":"{SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{tool}","version":"{version}","rules":['
    cwe = ',"taxonomies":[{"name":"CWE","organization":"MITRE","shortDescription":{"text":"Common Weakness Enumeration"},"taxa":['
    weak = F.when(F.length("p.taxon") > 0, F.concat(F.lit(cwe), "p.taxon", F.lit("]}]"))).otherwise("")
    return p.select(F.concat(F.lit(head), "p.rule", F.lit("]}}"), weak, F.lit(',"results":['), "p.result", F.lit("]}]}")).alias("sarif"))
