"""Versions as comparable columns, and dependencies matched to vulnerable version ranges.

Keys are structs whose order is the versions' order: numbers of the release, whether it is final, the kind and number
of a pre-release, the number of a post-release. The join is an equi-join on (ecosystem, package); whether a version
is affected is worked out on each pair by a fold over the ranges' events. Both sides shuffle by the package, unless
Spark finds one small enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the two version syntaxes.
PEP440 = r"(?i)^v?(\d+!)?(\d+(?:\.\d+)*)(?:[-_.]?(dev|a|alpha|b|beta|rc|c)(\d*))?(?:\.post(\d*))?"
SEMVER = r"(?i)^v?(\d+(?:\.\d+)*)(?:-([a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*))?"
PRE_ORDER = {"dev": 0, "a": 1, "alpha": 1, "b": 2, "beta": 2, "rc": 3, "c": 3}
RANGES = "array<struct<type:string,events:array<map<string,string>>>>"


def _release(text: Column) -> Column:
    return F.transform(F.split(text, "\\."), lambda x: x.cast("decimal(38,0)"))


def pep440(version: Column) -> Column:
    v = F.trim(version)
    part = lambda k: F.regexp_extract(v, PEP440, k)
    num = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0))
    kind = F.lower(part(3))
    order = F.lit(0)
    for name, k in PRE_ORDER.items():
        order = F.when(kind == name, k).otherwise(order)
    has_post = v.rlike("(?i)" + PEP440[4:].replace("(?:\\.post(\\d*))?", "\\.post"))
    pre = kind != ""
    return F.when(v.rlike(PEP440), F.struct(
        _release(part(2)).alias("release"), (~pre).alias("final"), F.when(pre, order).otherwise(99).alias("kind"),
        F.when(pre, num(part(4))).otherwise(0).alias("pre"), F.when(~pre & has_post, num(part(5)) + 1).otherwise(0).alias("post"), F.lit("").alias("label"),
    ))


def semver(version: Column) -> Column:
    v = F.trim(version)
    label = F.regexp_extract(v, SEMVER, 2)
    zero = F.lit(0)
    return F.when(v.rlike(SEMVER), F.struct(_release(F.regexp_extract(v, SEMVER, 1)).alias("release"), (label == "").alias("final"), zero.alias("kind"), zero.alias("pre"), zero.alias("post"), label.alias("label")))


def version_key(version: Column, ecosystem: Column) -> Column:
    """Null if the version can't be read."""
    return F.when(ecosystem == "npm", semver(version)).otherwise(pep440(version))


def affected(version: Column, ranges: Column, ecosystem: Column) -> Column:
    """True or false, or null if no range can be used.

    A version that can't be read is affected by a range from 0 on, and by no other.
    """
    mine = version_key(version, ecosystem)

    def walk(r: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("since"), F.lit(False).alias("hit"), F.lit(False).alias("used"))

        def step(s: Column, e: Column) -> Column:
            since, fixed = F.try_element_at(e, F.lit("introduced")), F.try_element_at(e, F.lit("fixed"))
            ends = since.isNull() & fixed.isNotNull() & s["since"].isNotNull()
            low, high = version_key(s["since"], ecosystem), version_key(fixed, ecosystem)
            from_ok = F.when(s["since"] == "0", True).otherwise(mine >= low)
            # Null: a comparison that can't be made, which leaves the range open.
            inside = F.when(from_ok, mine < high).otherwise(from_ok)
            return F.struct(
                F.when(since.isNotNull(), since).when(ends & inside.isNotNull(), F.lit(None)).otherwise(s["since"]).alias("since"),
                (s["hit"] | F.coalesce(ends & inside, F.lit(False))).alias("hit"), (s["used"] | ends).alias("used"),
            )

        def last(s: Column) -> Column:
            open_ = s["since"].isNotNull()
            return F.struct((s["hit"] | (open_ & ((s["since"] == "0") | F.coalesce(mine >= version_key(s["since"], ecosystem), F.lit(False))))).alias("hit"), (s["used"] | open_).alias("used"))

        return F.aggregate(F.coalesce(r["events"], F.array().cast("array<map<string,string>>")), start, step, last)

    usable = F.filter(F.coalesce(ranges, F.array().cast(RANGES)), lambda r: r["type"].isin("ECOSYSTEM", "SEMVER"))
    seen = F.transform(usable, walk)
    return F.when(F.exists(seen, lambda x: x["hit"]), True).when(F.exists(seen, lambda x: x["used"]), False)


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def check_dependencies(deps: DataFrame, vulns: DataFrame) -> DataFrame:
    """Findings of deps (name, version, ecosystem) against vulns (vuln_id, ecosystem, package, summary, severity_score,
    cwe_ids, affected_ranges, fixed_version, aliases); sure where a range holds, 0.7 where none can be used."""
    d = deps.select(F.col("name").alias("package"), "version", "ecosystem")
    both = d.join(vulns, ["ecosystem", "package"]).withColumn("_a", affected(F.col("version"), F.col("affected_ranges"), F.col("ecosystem"))).where("_a is null or _a")
    cves = F.filter("aliases", lambda a: a.startswith("CVE-"))
    label = F.when(F.size(cves) > 0, F.array_join(cves, ", ")).otherwise(F.col("vuln_id"))
    what = F.concat("package", F.lit("=="), "version")
    return both.select(
        F.lit("dependency_vulnerability").alias("finding_type"), cvss_severity(F.coalesce("severity_score", F.lit(0.0))).alias("severity"),
        F.concat(label, F.lit(": "), F.coalesce("summary", F.lit("Known vulnerability")), F.lit(" in "), what, F.lit(" ("), "ecosystem", F.lit(")")).alias("message"),
        what.alias("matched_text"), F.lit("osv").alias("scanner"), F.when(F.col("_a"), 1.0).otherwise(0.7).alias("confidence"),
        "cwe_ids", "vuln_id", "ecosystem", "package", "version", "fixed_version", "aliases",
        F.when(F.col("fixed_version").isNotNull(), F.concat(F.lit("Upgrade "), "package", F.lit(" to >= "), "fixed_version")).alias("remedy"),
    )
