"""Column expressions over texts and findings. Positions are code points, from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline.functions.rules import SEVERITY_RANK, TEST_FILES

#: The language of each file extension.
EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby",
    ".php": "php", ".cs": "csharp",
}
_BREAKS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
COMMENT = "^\\s*(?:#|//|/\\*|\\*)"


def lines(text: Column) -> Column:
    """The lines of a text, ended by any line break of Unicode; no empty line after the last break."""
    all_ = F.split(F.coalesce(text, F.lit("")), _BREAKS, -1)
    return F.when(F.element_at(all_, -1) == "", F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def language_of(path: Column, hint: Column | None = None) -> Column:
    """The hint in lower case, else what the extension says, else null."""
    name = F.regexp_extract(path, "[^/]*$", 0)
    ext = F.lower(F.regexp_extract(name, "^\\.*[^.].*?(\\.[^.]*)$", 1))
    found = F.try_element_at(literal_map(EXTENSIONS), ext)
    return found if hint is None else F.coalesce(F.lower(hint), found)


def rank(severity: Column) -> Column:
    return F.try_element_at(literal_map(SEVERITY_RANK), severity)


def is_test_file(path: Column) -> Column:
    return F.coalesce(F.replace(path, F.lit("\\"), F.lit("/")).rlike("|".join(TEST_FILES)), F.lit(False))


def first_match(text: Column, regex: str) -> Column:
    """struct(at, hit) of the first match, null if there is none."""
    at = F.length(F.get(F.split(text, regex, 2), F.lit(0)))
    return F.when(text.rlike(regex), F.struct(at.alias("at"), F.regexp_extract(text, regex, 0).alias("hit")))


def all_matches(text: Column, regex: str) -> Column:
    """Array of struct(at, hit) of every match that isn't empty.

    A match begins after all pieces up to its own and all matches before it; one fold adds them up.
    """
    hits, pieces = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    both = F.arrays_zip(pieces.alias("p"), hits.alias("h"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,hit:string>>").alias("out"))
    folded = F.aggregate(
        F.filter(both, lambda x: x["h"].isNotNull()),
        start,
        lambda s, x: F.struct(
            (s["end"] + F.length(x["p"]) + F.length(x["h"])).alias("end"),
            F.concat(s["out"], F.array(F.struct((s["end"] + F.length(x["p"])).alias("at"), x["h"].alias("hit")))).alias("out"),
        ),
    )
    return F.when(text.rlike(regex), folded["out"]).otherwise(F.array().cast("array<struct<at:int,hit:string>>"))


def digest(size: int, *parts: Column) -> Column:
    """The first digits of the SHA-256 of the parts joined by colons; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, size)


def fingerprint() -> Column:
    """A finding's identity for deltas, baselines and exports."""
    return digest(16, F.col("file_path"), F.coalesce("line_number", F.lit(0)), F.col("finding_type"), F.col("pattern_name"), F.col("matched_text"))


def feedback_fingerprint() -> Column:
    """A finding's identity for marks; prompt injections have their own kind of name."""
    return digest(16, F.col("file_path"), F.coalesce("line_number", F.lit(0)), F.col("finding_type"), F.coalesce("pattern_name", "injection_type"), F.col("matched_text"))


def redacted(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.concat(F.lit("[REDACTED:"), F.substring(F.sha2(text, 256), 1, 12), F.lit("]"))).otherwise(text)
