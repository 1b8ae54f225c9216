"""Operators over tables of findings: merge, suppress, mark, compare, gate, enrich."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import rules as R
from sieveline.functions import text as X
from sieveline.operators.scanners import by_line

MARKER = "sieveline:ignore"
#: Bytes of input for each task that findings are dealt to.
TASK = 1 << 20
#: Bytes that stand for an input of no known size.
UNKNOWN = 1 << 62


def spread(findings: DataFrame) -> DataFrame:
    """Findings dealt by document to tasks that grow in number with the input files, so that a task's memory doesn't. Spark's
    own count is fixed, and is made smaller yet where rows compress well."""
    leaves = findings._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    tasks = sum(n for n in sizes if n < UNKNOWN) // TASK
    return findings.repartition(tasks, "doc_id") if tasks > findings.sparkSession.sparkContext.defaultParallelism else findings


def merge_engines(findings: DataFrame) -> DataFrame:
    """One row where several engines report one place and kind - the surest one, surer by a tenth for each engine more -
    and every row where one engine does. Adds ``engines``, the surest first, ``engine_evidence``, the flow of each engine that
    has one, and ``multi_engine_confirmed``."""
    key = ["doc_id", "file_path", "line_number", "finding_type"]
    # Of equally sure ones the line patterns' finding comes first. One order serves all, so that rows are sorted once.
    best = Window.partitionBy(*key).orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), F.coalesce(F.col("engine") != "regex", F.lit(False)), "seq", "engine", "pattern_name")
    place = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.collect_list(F.struct(F.coalesce("engine", F.lit("regex")).alias("e"), "flow")).over(place)
    f = spread(findings).withColumns({"_r": F.row_number().over(best), "_e": named}).withColumn("engines", F.array_distinct(F.transform("_e", lambda x: x["e"]))).withColumn("_n", F.size("engines"))
    # The last of an engine's flows counts.
    flows = F.transform("engines", lambda n: F.struct(n.alias("n"), F.element_at(F.filter("_e", lambda x: x["e"] == n), -1)["flow"].alias("f")))
    f = f.withColumn("engine_evidence", F.when(F.col("_n") > 1, F.map_from_entries(F.filter(flows, lambda x: x["f"].isNotNull()))))
    f = f.where((F.col("_n") == 1) | (F.col("_r") == 1)).withColumn("multi_engine_confirmed", F.col("_n") > 1)
    surer = F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)) + 0.1 * (F.col("_n") - 1))
    return f.withColumn("confidence", F.when(F.col("_n") > 1, surer).otherwise(F.col("confidence"))).drop("_n", "_r", "_e")


def directives(docs: DataFrame, marker: str = MARKER) -> DataFrame:
    """doc_id, line_number, rules, reason of every inline suppression; no rules: it holds for all."""
    form = "(?:#|//|/\\*)\\s*\\Q" + marker + "\\E(?:\\[([^\\]]*)\\])?\\s*(?:\\*/)?\\s*(?:--\\s*(.*))?"
    names = F.filter(F.transform(F.split(F.regexp_extract("line", form, 1), ","), lambda x: F.trim(x)), lambda x: x != "")
    found = by_line(docs).where(F.col("line").contains(marker) & F.col("line").rlike(form))
    return found.select("doc_id", "line_number", names.alias("rules"), F.trim(F.regexp_replace(F.regexp_extract("line", form, 2), "\\s*\\*/\\s*$", "")).alias("reason"))


def suppress(findings: DataFrame, found: DataFrame) -> DataFrame:
    """Marks the findings on the lines of directives that name their rule or kind, or nothing."""
    both = findings.join(found.withColumnRenamed("doc_id", "_d").withColumnRenamed("line_number", "_l"), (F.col("doc_id") == F.col("_d")) & (F.col("line_number") == F.col("_l")), "left")
    holds = F.coalesce(F.col("_d").isNotNull() & ((F.size("rules") == 0) | F.array_contains("rules", F.col("finding_type")) | F.coalesce(F.array_contains("rules", F.col("pattern_name")), F.lit(False))), F.lit(False))
    said = F.when(holds, F.nullif("reason", F.lit("")))
    return both.withColumn("suppressed", F.coalesce("suppressed", F.lit(False)) | holds).withColumn("suppression_reason", F.coalesce(said, F.col("suppression_reason"))).drop("_d", "_l", "rules", "reason")


def mark(marks: DataFrame, fresh: DataFrame) -> DataFrame:
    """False positives after new marks or unmarks: the latest row of each fingerprint.

    Rows: fingerprint, pattern_name, finding_type, scanner, reason, created_at, is_active.
    """
    latest = Window.partitionBy("fingerprint").orderBy(F.desc("created_at"), F.desc("is_active"))
    return marks.unionByName(fresh).withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")


def list_marks(marks: DataFrame, scanner: str | None = None, limit: int = 100) -> DataFrame:
    """The active marks, the latest first."""
    m = marks.where("is_active")
    return (m if scanner is None else m.where(F.col("scanner") == scanner)).orderBy(F.desc("created_at"), "fingerprint").limit(limit)


def mark_stats(marks: DataFrame) -> DataFrame:
    """Active marks by scanner, and in all under a null scanner."""
    return marks.where("is_active").rollup("scanner").agg(F.count("*").alias("n"))


def annotate_marks(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """``false_positive`` where the very finding is marked, else ``potential_false_positive`` where its pattern is."""
    active = marks.where("is_active")
    exact = active.select(F.col("fingerprint").alias("_fp")).distinct().withColumn("_exact", F.lit(True))
    alike = active.where("pattern_name <> ''").select(F.col("pattern_name").alias("_p"), F.col("finding_type").alias("_t"), F.col("scanner").alias("_s")).distinct().withColumn("_alike", F.lit(True))
    f = findings.withColumn("_k", X.feedback_fingerprint())
    f = f.join(exact, F.col("_k") == F.col("_fp"), "left")
    f = f.join(alike, (F.coalesce("pattern_name", "injection_type") == F.col("_p")) & (F.col("finding_type") == F.col("_t")) & (F.col("scanner") == F.col("_s")), "left")
    hit = F.coalesce("_exact", F.lit(False))
    return f.withColumn("false_positive", hit).withColumn("potential_false_positive", ~hit & F.coalesce("_alike", F.lit(False))).drop("_k", "_fp", "_exact", "_p", "_t", "_s", "_alike")


def baseline(findings: DataFrame) -> DataFrame:
    return findings.select(X.fingerprint().alias("fingerprint")).distinct()


def against_baseline(findings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New findings, unchanged ones (every copy), and the fingerprints that are gone."""
    f, k = findings.withColumn("fingerprint", X.fingerprint()), known.select("fingerprint").distinct()
    return f.join(k, "fingerprint", "left_anti"), f.join(k, "fingerprint", "left_semi"), k.join(f, "fingerprint", "left_anti").orderBy("fingerprint")


def baseline_counts(findings: DataFrame, known: DataFrame) -> DataFrame:
    """status - new, unchanged or fixed - and how many of ``against_baseline`` there are: each side is read once, and only
    fingerprints that are counted already are shuffled."""
    f = findings.select(X.fingerprint().alias("fingerprint"), F.lit(1).alias("one"), F.lit(False).alias("known"))
    k = known.select("fingerprint", F.lit(0).alias("one"), F.lit(True).alias("known"))
    each = f.unionByName(k).groupBy("fingerprint").agg(F.sum("one").alias("n"), F.bool_or("known").alias("known"))
    one = each.agg(F.sum(F.when(~F.col("known"), F.col("n"))).alias("new"), F.sum(F.when(F.col("known"), F.col("n"))).alias("unchanged"), F.count_if(F.col("known") & (F.col("n") == 0)).alias("fixed"))
    rows = F.array(*[F.struct(F.lit(c).alias("status"), F.coalesce(c, F.lit(0)).cast("bigint").alias("n")) for c in ("new", "unchanged", "fixed")])
    return one.select(F.inline(rows))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """fingerprint and delta_status - new, unchanged or removed - of two scans' sets of findings."""
    b, a = baseline(before).withColumn("_b", F.lit(True)), baseline(after).withColumn("_a", F.lit(True))
    said = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "removed").otherwise("unchanged")
    return b.join(a, "fingerprint", "full").select("fingerprint", said.alias("delta_status"))


def delta_of(findings: DataFrame, before: Column, after: Column) -> DataFrame:
    """The same for two scans within one table, told apart by conditions on its rows: one aggregation by fingerprint."""
    f = findings.where(before | after).groupBy(X.fingerprint().alias("fingerprint")).agg(F.bool_or(before).alias("b"), F.bool_or(after).alias("a"))
    return f.select("fingerprint", F.when(~F.col("b"), "new").when(~F.col("a"), "removed").otherwise("unchanged").alias("delta_status"))


def quality_gate(findings: DataFrame, fail_on: str = "high", warn_on: str = "medium", max_findings: int | None = None, exclude_suppressed: bool = True) -> DataFrame:
    """One row: verdict, passed, exit_code, total and the counts by severity."""
    f = findings.where(~F.coalesce("suppressed", F.lit(False))) if exclude_suppressed else findings
    level = X.rank(F.col("severity"))
    fail, warn = R.SEVERITY_RANK[fail_on], R.SEVERITY_RANK[warn_on]
    one = f.agg(
        F.count("*").alias("total"), F.count_if(level >= fail).alias("failures"), F.count_if((level >= warn) & (level < fail)).alias("warnings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in R.SEVERITY_RANK],
    )
    bad = F.col("failures") > 0
    if max_findings is not None:
        bad = bad | (F.col("total") > max_findings)
    one = one.withColumn("verdict", F.when(bad, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))
    return one.withColumn("passed", F.col("verdict") != "fail").withColumn("exit_code", F.when(F.col("verdict") == "fail", 1).otherwise(0))


def with_context(findings: DataFrame, docs: DataFrame, window: int = 3) -> DataFrame:
    """Adds ``code_context``: the line and up to ``window`` lines on either side; empty if there is no such line."""
    held = docs.select(F.col("doc_id").alias("_d"), F.col("text").alias("_t"))
    n, size = F.col("line_number"), F.size("_l")
    there = (n >= 1) & (n <= size)
    none = F.array().cast("array<string>")
    low = F.greatest(F.lit(1), n - window)
    ctx = F.struct(
        F.when(there, F.slice("_l", low, F.greatest(F.lit(0), n - low))).otherwise(none).alias("before"), F.when(there, F.get("_l", n - 1)).otherwise("").alias("target_line"),
        F.when(there, F.slice("_l", n + 1, F.greatest(F.lit(0), F.least(F.lit(window), size - n)))).otherwise(none).alias("after"), n.alias("line_number"),
    )
    both = findings.join(held, F.col("doc_id") == F.col("_d"), "left").withColumn("_l", F.when(F.col("_d").isNotNull(), X.lines(F.col("_t"))))
    return both.withColumn("code_context", F.when(F.col("_l").isNotNull(), ctx)).drop("_d", "_l", "_t")


_REFERENCE = "struct<type:string,id:string,url:string,name:string>"


def references(cwe_ids: Column, vuln_id: Column) -> Column:
    """Each weakness, each category of the public ranking once, and the advisory."""
    one = lambda kind, ident, url, name: F.struct(F.lit(kind).alias("type"), ident.alias("id"), url.cast("string").alias("url"), name.cast("string").alias("name"))
    none = F.lit(None)
    weak = F.transform(cwe_ids, lambda c: one("CWE", c, F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.regexp_replace(c, "^CWE-", ""), F.lit(".html")), none))
    category = X.literal_map({c: i for (i, _), cs in R.OWASP.items() for c in cs})
    title = X.literal_map({i: t for i, t in R.OWASP})
    ranked = F.array_distinct(F.filter(F.transform(cwe_ids, lambda c: F.try_element_at(category, c)), lambda x: x.isNotNull()))
    tops = F.transform(ranked, lambda i: one("OWASP", i, none, F.try_element_at(title, i)))
    advisory = F.when(vuln_id.startswith("CVE-"), one("CVE", vuln_id, F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), vuln_id), none)).when(vuln_id.isNotNull(), one("OSV", vuln_id, F.concat(F.lit("https://osv.dev/vulnerability/"), vuln_id), none))
    empty = F.array().cast(f"array<{_REFERENCE}>")
    return F.concat(F.coalesce(weak.cast(f"array<{_REFERENCE}>"), empty), F.coalesce(tops.cast(f"array<{_REFERENCE}>"), empty), F.filter(F.array(advisory.cast(_REFERENCE)), lambda x: x.isNotNull()))


def with_references(findings: DataFrame) -> DataFrame:
    """Adds ``references``. The advisory is ``vuln_id``, or else the first CVE of ``aliases``, if there are such columns."""
    cols = findings.columns
    first = F.get(F.filter("aliases", lambda a: a.startswith("CVE-")), F.lit(0)) if "aliases" in cols else F.lit(None).cast("string")
    return findings.withColumn("references", references(F.col("cwe_ids"), F.coalesce(F.col("vuln_id"), first) if "vuln_id" in cols else first))


def with_details(findings: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Adds ``details``: the code around, the explanation, the references, class, scanner and pattern."""
    f = with_explanation(with_references(findings))
    f = with_context(f, docs) if docs is not None else f.withColumn("code_context", F.lit(None).cast("struct<before:array<string>,target_line:string,after:array<string>,line_number:int>"))
    return f.withColumn("details", F.struct(
        "code_context", "match_explanation", "references", F.col("finding_type").alias("vulnerability_class"), "scanner", F.coalesce("pattern_name", "injection_type").alias("pattern_name"), "flow",
    )).drop("code_context", "match_explanation", "references")


def with_explanation(findings: DataFrame) -> DataFrame:
    """Adds ``match_explanation`` where a rule has a name and text was matched."""
    name = F.coalesce("pattern_name", "injection_type")
    cut = F.when(F.length("matched_text") > 80, F.concat(F.substring("matched_text", 1, 77), F.lit("..."))).otherwise(F.col("matched_text"))
    sure = F.coalesce(F.concat(F.lit(" ("), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% confidence)")), F.lit(""))
    said = F.concat(F.lit("Rule "), name, F.lit(" matched '"), cut, F.lit("'"), sure)
    return findings.withColumn("match_explanation", F.when(name.isNotNull() & (F.length("matched_text") > 0), said))


def redacted(findings: DataFrame) -> DataFrame:
    """The findings as they may leave the house: what was matched is replaced by the start of its digest."""
    return findings.withColumn("matched_text", X.redacted(F.col("matched_text")))
