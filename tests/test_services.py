"""The advisory service against a local server, marks and progress of streams, the audit store and summaries."""

import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sieveline import streaming
from sieveline.functions import text as X
from sieveline.operators import audit, scanners
from sieveline.operators import findings as P
from sieveline.sources import advisory_service, diffs, files

MARKS = "fingerprint string, pattern_name string, finding_type string, scanner string, reason string, created_at string, is_active boolean"


def docs(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, file_path string, language string")


class Service(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        name, token = said["package"]["name"], said.get("page_token")
        self.asked.append((name, token))
        if name == "gone" or name == "busy" and self.asked.count((name, token)) == 1:
            self.send_response(404 if name == "gone" else 503)
            self.end_headers()
            return
        record = {"id": f"V-{name}-{token or 0}", "affected": [{"package": {"ecosystem": "PyPI", "name": name}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2.0"}]}]}]}
        page = {"vulns": [record] if name != "safe" else []} | ({"next_page_token": "1"} if name == "long" and not token else {})
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(page).encode())

    def log_message(self, *_):
        pass


def test_advisory_service(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = advisory_service.fetch(spark, f"http://127.0.0.1:{server.server_port}/query", "PyPI", ["one", "long", "safe", "busy", "gone"], 3)
        got = spark.createDataFrame(got.collect(), got.schema)
    finally:
        server.shutdown()
    assert [(r["package"], "404" in r["error"]) for r in got.where("error is not null").collect()] == [("gone", True)]
    v = {r["vuln_id"]: (r["package"], r["fixed_version"]) for r in advisory_service.read(got).collect()}
    assert v == {"V-one-0": ("one", "2.0"), "V-long-0": ("long", "2.0"), "V-long-1": ("long", "2.0"), "V-busy-0": ("busy", "2.0")}
    with pytest.raises(ValueError):
        advisory_service.fetch(spark, "http://127.0.0.1", "none", [])


def test_stream_meets_marks_and_tells_progress(spark, tmp_path):
    d = docs(spark, ("os.system(a)", "a.py", None), ("eval(x)", "b.py", None))
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    marks = scanners.scan_code(d).where("doc_id = 0").select(
        X.feedback_fingerprint().alias("fingerprint"), "pattern_name", "finding_type", "scanner", F.lit("known").alias("reason"), F.lit("2024").alias("created_at"), F.lit(True).alias("is_active")
    )
    marks.write.parquet(str(tmp_path / "marks"))
    told = []
    listener = streaming.Progress(lambda number, rows, took: told.append((number, rows)))
    spark.streams.addListener(listener)
    try:
        live = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        read = streaming.Kept(lambda: spark.read.schema(MARKS).parquet(str(tmp_path / "marks")))
        q = streaming.sink(streaming.scan_stream(live, scanners.scan_code), str(tmp_path / "out"), str(tmp_path / "ck"), read)
        q.processAllAvailable()
        q.stop()
        for _ in range(100):
            if told:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert {(r["doc_id"], r["false_positive"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, True), (1, False)}
    assert told[0] == (0, 2)


def test_kept_tables_are_read_again_when_old():
    now, reads = [0.0], []
    kept = streaming.Kept(lambda: reads.append(now[0]), hours=1, clock=lambda: now[0])
    for t in (0.0, 3600.0, 3601.0, 3700.0):
        now[0] = t
        kept()
    assert reads == [0.0, 3601.0]


def test_audit_store_shows_whole_scans_only(spark, tmp_path):
    d = docs(spark, ("os.system(a)", "a.py", None), ("fine", "b.py", None))
    found = scanners.scan_code(d)
    rows = audit.scans(d, found, "code", "general", "2024-01-01")
    for _ in range(2):  # a repeated scan replaces itself
        audit.record(rows, audit.stored(found), str(tmp_path), "one")
    audit.stored(found).write.parquet(str(tmp_path / "findings" / "scan=broken"))
    a, f = audit.load(spark, str(tmp_path))
    assert a.count() == 2 and [(r["scan"], r["audit_id"]) for r in f.collect()] == [("one", 0)]


def test_summaries_and_redaction(spark):
    d = spark.createDataFrame([(1, "+++ b/x.py\n@@ -1 +1,2 @@\n+eval(x)\n+y\n"), (2, "")], "diff_id long, diff_text string")
    assert sorted(tuple(r) for r in diffs.summary(d, diffs.scan_diff(d)).collect()) == [(1, 1, 2, 1), (2, 0, 0, 0)]
    src = docs(spark, ("eval(x)", "a.py", None), ("fine", "b.py", None))
    asked = files.requested(spark, [("a.py", None), ("b.py", None), ("c.py", None)], src)
    got = {r["file_path"]: (r["finding_count"], r["error"]) for r in files.summary(asked, scanners.scan_code(src)).collect()}
    assert got == {"a.py": (1, None), "b.py": (0, None), "c.py": (None, "not found")}
    shown = P.redacted(scanners.scan_code(src)).first()["matched_text"]
    assert shown.startswith("[REDACTED:") and len(shown) == 23


def test_diffs_are_read_without_a_shuffle(spark):
    """Each diff is read by itself; overlapping hunks, files that come again and hunks without a file keep their lines."""
    texts = ["@@ -1 +1 @@\n+no\n+++ b/x.py\n+no\n@@ -1 +9,2 @@\n+eval(a)\n+b\n--- c\n+d\n@@ -1 +2 @@\n-e\n+os.system(f)\n+++ b/y.js\n@@ -0,0 +1 @@\n+\n+++ b/x.py\n@@ -1 +5 @@\n+g", None, "+++ b/\n@@ -1 +1 @@\n+no"]
    d = spark.createDataFrame(list(enumerate(texts)), "diff_id long, diff_text string")
    rows = diffs.added_lines(d)
    want = [("x.py", 2, "os.system(f)", 1), ("x.py", 5, "g", 2), ("x.py", 9, "eval(a)", 3), ("x.py", 10, "b", 4), ("x.py", 12, "d", 5), ("y.js", 1, "", 1)]
    assert sorted(tuple(r)[1:] for r in rows.collect()) == want
    found = diffs.scan_diff(d, "high")
    assert sorted((r["line_number"], r["range"]["start_line"], r["pattern_name"]) for r in found.collect()) == [(2, 0, "command_injection_os_system"), (9, 2, "command_injection_eval")]
    assert sorted(tuple(r) for r in diffs.summary(d, found).collect()) == [(0, 2, 6, 2), (1, 0, 0, 0), (2, 0, 0, 0)]
    for df in (rows, found):
        assert not re.search(r"(?m)^[\s:+*()0-9-]*(Exchange|Sort|Window|\w*Join)\b", df._jdf.queryExecution().executedPlan().toString())
