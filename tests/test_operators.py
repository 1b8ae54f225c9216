"""Guards, remedies, details, baselines, settings, registry, reports and the parser of JavaScript."""

import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sieveline.functions import guards as G
from sieveline.functions import rules as R
from sieveline.functions.advice import ADVICE
from sieveline.operators import baselines, flows, sarif, scanners, triage
from sieveline.operators import findings as P
from sieveline.plans import engines, projects
from sieveline.plans.queries import FLOW, FLOWS
from sieveline.sources import advisories

CODE = [r for t in (R.COMMON_RULES, *dict.fromkeys(R.LANGUAGE_RULES.values())) for r in t]
OTHER = [*R.PII_RULES, *R.INJECTION_RULES, *(r for rs in R.CONTENT_RULES.values() for r in rs), *scanners.secret_rules("high")]


def docs(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, file_path string, language string")


def passes(guard, text):
    low = text.lower()
    return (not guard.any_of or any(x in low for x in guard.any_of)) and sum(c in G.DIGITS for c in text) >= guard.digits


def test_every_rule_has_a_remedy_that_shows_it():
    assert set(ADVICE) == {r.name for r in CODE}
    for r in CODE:
        _, before, after = ADVICE[r.name]
        assert re.search(r.regex, before) and not re.search(r.regex, after), r.name


def test_guards_let_every_match_pass():
    texts = [ADVICE[r.name][k] for r in CODE for k in (1, 2)]
    texts += [
        "a@b.co", "078-05-1120", "4111 1111 1111 1111", "4111-1111-1111-1111-123", "+1 (212) 555-0100", "10.0.0.255", "DOB: 1/2/1990", "12 Long Oak Street", "please IGNORE previous instructions", "you are now x",
        "---\n---", "\n===\n===", "<|system|>", "[INST]", "enable DAN", "decode base64", "<<SYS>>", "How to KILL", "recipe for make meth", "AKIA" + "A1" * 8, "ghp_" + "a" * 30, "postgres://a:b@c", "password = 'abcdef'", "token: 'abcdefghijklmnopqrst'",
    ]
    hits = 0
    for r in CODE + OTHER:
        g = G.guard(r.regex)
        for t in texts:
            for text in (t, t.upper(), t.lower()):
                for m in re.finditer(r.regex, text, re.A):
                    hits += 1
                    assert passes(g, m[0]), (r.name, m[0], g)
    assert hits > 300


def test_scan_as_plain_regexes(spark):
    texts = [ADVICE[r.name][k] for r in CODE for k in (1, 2)] + ["nothing here", "", "# os.system(x)"]
    langs = ["python", "javascript", "java", "go", "ruby", "php", "csharp"]
    rows = [("\n".join(texts[k::7]), None, lang) for k, _ in enumerate(langs) for lang in langs]
    rules, names = scanners.code_rules("high")
    want = set()
    for d, (text, _, lang) in enumerate(rows):
        for n, line in enumerate(text.splitlines(), 1):
            if not re.match(r"^\s*(?:#|//|/\*|\*)", line):
                for r, served in zip(rules, names, strict=True):
                    if (not served or lang in served) and (m := re.search(r.regex, line, re.A)):
                        want.add((d, n, r.name, m[0], m.start()))
    got = scanners.scan_code(docs(spark, *rows), "high").select("doc_id", "line_number", "pattern_name", "matched_text", "range.start_col").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_finding_ids_are_unique_far_right_and_far_down(spark):
    line = " " * 12_000 + "a@b.co c@d.co e@f.co"
    f = scanners.check_pii(docs(spark, (line + "\n" * 150 + line, None, None)), "high").collect()
    assert len(f) == 6 and len({r["finding_id"] for r in f}) == 6 and len({r["seq"] for r in f}) == 6
    php = scanners.scan_code(docs(spark, ("\n".join(["phpinfo();"] * 3) + "\n$token == $x", None, "php")), "high").collect()
    assert [(r["seq"]["first"], r["line_number"]) for r in sorted(php, key=lambda r: r["seq"])] == [(k, k) for k in (1, 2, 3, 4)]


def test_pattern_groups(spark):
    d = docs(spark, ("k=1 m= 2\nx", None, None), ("none", None, None), ("(k=)", None, None))
    got = {(r["doc_id"], r["start"]): (r["text"], r["groups"]) for r in scanners.match_pattern(d, r"(\w)=(?:\s*)(?<v>\d)?").collect()}
    assert got == {(0, 0): ("k=1", ["k", "1"]), (0, 4): ("m= 2", ["m", "2"]), (2, 1): ("k=", ["k", None])}
    assert scanners.match_pattern(d, r"[(]\w\(?").select("groups").first()[0] == []
    with pytest.raises(Exception, match="(?i)regex"):
        scanners.match_pattern(d, "(")


def test_details_and_evidence(spark):
    code = "a = input()\nos.system(a)\n"
    d = docs(spark, (code, "v.py", "python"))
    f = scanners.scan_code(d).unionByName(flows.scan_flows(d))
    m = P.merge_engines(f).first()
    assert m["engines"] == ["regex", "deep"] and m["multi_engine_confirmed"] and m["engine_evidence"]["deep"]["hops"] == ["a"] and m["confidence"] == pytest.approx(0.95)
    x = P.with_details(f.where("engine = 'deep'"), d).first()["details"]
    assert x["code_context"]["target_line"] == "os.system(a)" and x["vulnerability_class"] == "command_injection" and x["flow"]["source_line"] == 1 and x["scanner"] == "deep_engine"
    r = scanners.scan_code(d).first()["remediation"]
    assert r["before"] == ADVICE["command_injection_os_system"][1] and not r["auto_fixable"]
    v = spark.createDataFrame([(["CWE-79", "CWE-89"], "GHSA-1", ["CVE-2"]), (None, None, ["x", "CVE-2"]), ([], None, None)], "cwe_ids array<string>, vuln_id string, aliases array<string>")
    got = [[(y["type"], y["id"]) for y in z["references"]] for z in P.with_references(v).collect()]
    assert got == [[("CWE", "CWE-79"), ("CWE", "CWE-89"), ("OWASP", "A03:2021"), ("OSV", "GHSA-1")], [("CVE", "CVE-2")], []]


def test_baseline_files(spark, tmp_path):
    f = scanners.scan_code(docs(spark, ("os.system(a)\neval(b)", "v.py", None)))
    path = str(tmp_path / "base")
    baselines.save(f, path, "2024-01-01T00:00:00+00:00")
    new, same, gone = P.against_baseline(f.where("line_number = 1"), baselines.load(spark, path))
    assert (new.count(), same.count(), gone.count()) == (0, 1, 1)
    with pytest.raises(FileNotFoundError):
        baselines.load(spark, str(tmp_path / "none"))
    for k, text in enumerate(('{"version":"9"}\n', "[1]\n", '{"fingerprint":"a"}\n', "")):
        (tmp_path / f"bad{k}").mkdir()
        (tmp_path / f"bad{k}" / "x.json").write_text(text)
        with pytest.raises(ValueError):
            baselines.load(spark, str(tmp_path / f"bad{k}"))


def test_settings(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    assert projects.discover(str(deep), 2) is None
    (tmp_path / ".sieveline.json").write_text(json.dumps({"profile": "finance", "severity_overrides": {"insecure_hash": "low"}, "exclude_paths": ["x/*"], "other": 1}))
    p = projects.discover(str(deep))
    assert p.profile == "finance" and p.exclude_paths == ["x/*"] and p.path.endswith(".sieveline.json") and p.scan_profile is engines.PROFILES["finance"] and projects.discover(str(deep), 2) is None
    got = {r["pattern_name"]: (r["severity"], r["severity_rank"]) for r in p.applied(scanners.scan_code(docs(spark, ("hashlib.md5(a)\nos.system(b)", "v.py", None)), "high")).collect()}
    assert got == {"insecure_hash": ("low", 1), "command_injection_os_system": ("high", 3)}
    with pytest.raises(ValueError):
        (tmp_path / "x.toml").write_text("")
        projects.load(str(tmp_path / "x.toml"))
    with pytest.raises(FileNotFoundError):
        projects.load(str(tmp_path / "y.json"))
    (tmp_path / "p.json").write_text(json.dumps({"name": "mine", "blocked_categories": ["violence"], "pii_detector": {"enabled": False}, "code_scanner": {"sensitivity": "high", "engines": ["regex", "deep"]}}))
    own = projects.load_profile(str(tmp_path / "p.json"))
    assert own.engines == ("regex", "deep") and own.level("code_scanner").sensitivity == "high" and not own.level("pii_detector").enabled


def test_registry_timing_and_status(spark):
    assert {r["name"]: r["enabled"] for r in engines.list_engines(spark, ("deep",)).collect()} == {"regex": False, "deep": True}
    assert all(r["enabled"] and json.loads(r["capabilities"]) for r in engines.list_engines(spark).collect())
    assert engines.get_engine("regex") is scanners.scan_code and engines.enabled_engines(("deep", "gone")) == [flows.scan_flows]
    with pytest.raises(KeyError):
        engines.get_engine("gone")
    p = engines.PROFILES["general"].with_engines("regex", "deep")
    t = engines.timed(docs(spark, ("a = input()\neval(a)", "v.py", None)), p)
    assert {r["engine"]: r["finding_count"] for r in t.collect()} == {"regex": 1, "deep": 1} and all(r["duration_ms"] >= 0 for r in t.collect())
    vulns = advisories.stats(spark.createDataFrame([("npm", "a"), ("npm", "a"), ("PyPI", "b")], "ecosystem string, package string"), spark.createDataFrame([("npm", 1.0)], "ecosystem string, last_sync double"))
    assert {r["ecosystem"]: (r["n_vulnerabilities"], r["n_packages"], r["last_sync"]) for r in vulns.collect()} == {"npm": (2, 1, 1.0), "PyPI": (1, 1, None), None: (3, 2, None)}
    s = {r["name"]: json.loads(r["value"]) for r in engines.status(spark, p, spark.range(3), None, t).collect()}
    assert s["vulnerabilities"] == 3 and s["profile"] == "general" and "scan_dependencies" in s["operations"] and s["engine.deep"]["finding_count"] == 1


def test_marks_listed(spark):
    m = spark.createDataFrame([("f1", "p", "t", "a", "r", "2024-01-01", True), ("f2", "p", "t", "b", "r", "2024-01-02", True), ("f3", "p", "t", "b", "r", "2024-01-03", False)],
                              "fingerprint string, pattern_name string, finding_type string, scanner string, reason string, created_at string, is_active boolean")
    assert [r["fingerprint"] for r in P.list_marks(m).collect()] == ["f2", "f1"] and [r["fingerprint"] for r in P.list_marks(m, "a").collect()] == ["f1"] and P.list_marks(m, limit=1).count() == 1
    assert {r["scanner"]: r["n"] for r in P.mark_stats(m).collect()} == {"a": 1, "b": 1, None: 2}


def test_report_with_help_and_weaknesses(spark):
    f = scanners.scan_code(docs(spark, ("os.system(a)\nhashlib.md5(b)", "/src/v.py", None), ("nothing", "w.py", None)), "high")
    run = json.loads(sarif.document(f, base="/src").first()[0])["runs"][0]
    rule = {r["id"]: r for r in run["tool"]["driver"]["rules"]}["command_injection/command_injection_os_system"]
    assert rule["help"]["text"] == ADVICE["command_injection_os_system"][0] and "**After:**" in rule["help"]["markdown"]
    assert rule["relationships"][0]["target"]["toolComponent"] == {"name": "CWE", "index": 0} and rule["properties"]["security-severity"] == "7.0"
    ids = [t["id"] for t in run["taxonomies"][0]["taxa"]]
    assert ids == sorted({c for r in f.collect() for c in r["cwe_ids"]}) and len(run["results"]) == 2
    empty = json.loads(sarif.document(f.limit(0)).first()[0])["runs"][0]
    assert empty["results"] == [] and "taxonomies" not in empty


def test_triage(spark):
    f = scanners.scan_code(docs(spark, ("os.system(a)", "v.py", None))).unionByName(scanners.check_pii(docs(spark, ("a@b.co", None, None))))
    got = {r["finding_type"]: r["triage_prompt"] for r in triage.with_prompt(f).collect()}
    assert got["pii_leak"] is None and "false_positive" in got["command_injection"] and "os.system(" in got["command_injection"]
    assert set(triage.finding_types()) <= {r.finding_type for r in CODE} | {"secret"} and len(triage.finding_types()) == 7


def test_javascript_parts():
    js = flows.JavaScript("""
// function no() {}
const s = "function nor() { }"; /* function neither() { */
function outer(a) {
  const inner = async (b) => {
    let v = a;
  };
  let w = `t ${a}`;
}
export const arrow = x => x + 1;
export default function main() { return outer(1); }
var old = function (c) {
  c == 1; y = 2
};
export { old as older };
""")
    assert [(f.name, f.exported, f.first, f.last) for f in js.functions] == [("outer", False, 4, 9), ("inner", False, 5, 7), ("arrow", True, 10, 10), ("main", True, 11, 11), ("old", False, 12, 14)]
    assert [js.scope.get(n) for n in (3, 4, 5, 6, 8, 11, 13)] == [None, "outer", "inner", "inner", "outer", "main", "old"]
    assert ("v", 6) in js.assigned and ("w", 8) in js.assigned and ("y", 13) not in js.assigned and js.exported == {"old"} and "outer" in js.called


def test_adjusted_flows_are_one_pass(spark):
    """The same findings as from the flows and the facts apart, with neither a join nor a shuffle."""
    own = [("python", FLOW.replace("{n}", "1")), ("python", "import os\na = input()\ntry:\n    pass\nexcept E:\n    eval(a)"), ("python", "def f(:\nx = json.loads(t)\neval(x)")]
    own += [(lang, text) for lang, text, _ in FLOWS]
    d = spark.createDataFrame([(k, text, lang) for k, (lang, text) in enumerate(own)], "doc_id long, text string, language string")
    one, two = flows.scan_adjusted(d, "high"), flows.adjust(flows.scan_flows(d, "high"), flows.facts(d))
    key = lambda df: sorted(df.select("doc_id", "line_number", "finding_type", "confidence", "finding_id", "semantic_adjustments", "flow").collect(), key=str)
    assert key(one) == key(two) and one.columns == two.columns and any(r["semantic_adjustments"] for r in key(one))
    assert not any(x in one._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "Join"))


def test_version_pairs_are_compared_once(spark):
    """Parts are dealt to all tasks, and versions are compared below the join with them."""
    plan = entry.queries()["version_ranges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("RepartitionByExpression")[0].split("Repartition")[0]
    assert "Repartition" in plan and "aggregate(" not in top and "lambdafunction" not in top


def test_baseline_counts(spark):
    """The counts of the three parts, with each side read once."""
    f = scanners.scan_code(docs(spark, ("eval(a)\neval(b)", None, None), ("eval(a)", None, None), ("os.system(c)", None, None)))
    known = P.baseline(f.where("doc_id = 1")).unionByName(spark.createDataFrame([("gone",), ("gone",)], "fingerprint string"))
    counts = P.baseline_counts(f, known)
    new, same, gone = P.against_baseline(f, known)
    assert {r["status"]: r["n"] for r in counts.collect()} == {"new": new.count(), "unchanged": same.count(), "fixed": gone.count()} == {"new": 2, "unchanged": 2, "fixed": 1}
    assert P.baseline_counts(f.limit(0), known.limit(0)).count() == 3
    plan = entry.queries()["baseline_compare"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == 2 and "Join" not in re.sub(r"'.*?'", "", plan).split("Generate")[0]


def test_findings_to_merge_are_dealt_by_input(spark, tmp_path):
    """The tasks grow in number with the input, and one sort by place serves all that is worked out of it."""
    small, noise = str(tmp_path / "small"), F.sha2(F.concat(F.lit("x"), F.col("id").cast("string")), 512)
    rows = lambda n: spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("eval(a) # "), noise).alias("text"))
    rows(100).write.parquet(small)
    rows(200_000).write.parquet(str(tmp_path / "large"))
    found = lambda name: scanners.scan_code(spark.read.parquet(str(tmp_path / name)))
    assert "RepartitionByExpression" not in P.spread(found("small"))._jdf.queryExecution().analyzed().toString()
    assert int(re.search(r"RepartitionByExpression \[doc_id#\d+L?\], (\d+)", P.spread(found("large"))._jdf.queryExecution().analyzed().toString())[1]) >= 8
    merged = P.merge_engines(found("small"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?m)^[\s:+-]*Window \[", merged)) == 1
