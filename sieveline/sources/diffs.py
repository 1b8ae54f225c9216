"""Unified diffs: added lines with the numbers that they have in the new file.

A diff is one value, read from its first line to its last in Python, batch by batch, so that nothing is sorted or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sieveline.operators import scanners

_FILE, _HUNK = re.compile(r"\+\+\+ b/(.+)"), re.compile(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", re.A)


def added(text: str | None) -> list[tuple[str, int, str]]:
    """(file, number, line) of the added lines of a diff, in its order."""
    out, file, n = [], None, None
    for x in (text or "").splitlines():
        if x.startswith("+++ b/") and (m := _FILE.match(x)):
            file, n = m[1], None  # without a hunk yet it has no lines
        elif x.startswith("@@ -") and (m := _HUNK.match(x)):
            n = int(m[1]) if file is not None else None
        elif n is not None:
            if x.startswith("+") and not x.startswith("+++"):
                out.append((file, n, x[1:]))
            n += not x.startswith("-") or x.startswith("---")
    return out


def _each(diffs: DataFrame, kinds: str, rows) -> DataFrame:
    """diff_id and what ``rows`` makes of each diff's added lines: a list of tuples, of ``kinds`` ``name type``."""
    fields = StructType.fromDDL(kinds)
    schema = StructType([StructField("diff_id", diffs.schema["diff_id"].dataType), *fields])
    types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    kinds_of = [(f.name, types[f.dataType.simpleString()]) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                made = rows(added(text))
                at += [k] * len(made)
                out += made
            cols = [pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds_of)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names=["diff_id", *[n for n, _ in kinds_of]])

    return diffs.select("diff_id", "diff_text").mapInArrow(run, schema)


def _placed(lines: list[tuple[str, int, str]]) -> list[tuple[str, int, str, int]]:
    """With its ordinal within the file, by number, and by place where hunks overlap."""
    out, seen = [], {}
    for file, n, line in sorted(lines, key=lambda x: x[1]):
        seen[file] = seen.get(file, 0) + 1
        out.append((file, n, line, seen[file]))
    return out


def added_lines(diffs: DataFrame) -> DataFrame:
    """diff_id, file_path, line_number, line, ordinal (from 1 within the file) of rows (diff_id, diff_text)."""
    return _each(diffs, "file_path string, line_number int, line string, ordinal int", _placed)


def scan_diff(diffs: DataFrame, sensitivity: str = "medium") -> DataFrame:
    """Code findings of the added lines of each file; line numbers are the new file's, ranges the excerpt's."""
    rows = added_lines(diffs).select(F.col("diff_id").cast("bigint").alias("doc_id"), "file_path", F.lit(None).cast("string").alias("language"), F.col("ordinal").alias("line_number"), "line", F.col("line_number").alias("_n"))
    return scanners.scan_lines(rows, sensitivity, False, "_n").withColumn("line_number", F.col("_n")).select(*scanners.COLUMNS)


def summary(diffs: DataFrame, found: DataFrame) -> DataFrame:
    """For each diff its files with added lines, those lines, and its findings."""
    counted = _each(diffs, "n_files bigint, lines_added bigint", lambda lines: [(len({f for f, _, _ in lines}), len(lines))])
    n = found.groupBy("doc_id").agg(F.count("*").alias("n_findings"))
    both = counted.join(n, F.col("diff_id") == F.col("doc_id"), "left")
    return both.select("diff_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_files", "lines_added", "n_findings")])
