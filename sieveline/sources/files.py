"""Trees of source files as documents."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import EXTENSIONS

#: Folders that are never read.
SKIPPED = ("node_modules", "__pycache__")


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """doc_id, file_path, text of the files below ``root`` with an extension of the list, without the excluded globs."""
    kinds = [e if e.startswith(".") else f".{e}" for e in extensions] if extensions else sorted(EXTENSIONS)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), f"^\\Q{base}\\E/?", "")
    f = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("file_path"), rel.alias("_rel"), "content")
    f = f.where(F.lower(F.regexp_extract("_rel", r"(\.[^./]*)$", 1)).isin(*kinds))
    f = f.where(~F.col("_rel").rlike(r"(^|/)\.[^/]+/") & ~F.col("_rel").rlike("(^|/)(" + "|".join(SKIPPED) + ")/"))
    for glob in exclude or []:
        f = f.where(~F.col("_rel").rlike(fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")))
    return f.select(F.xxhash64("file_path").alias("doc_id"), "file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def requested(spark: SparkSession, wanted: list[tuple[str, str | None]], found: DataFrame) -> DataFrame:
    """The listed files with their text, or an error row for each that wasn't found."""
    ask = spark.createDataFrame(wanted or [("", None)], "file_path string, language string").where("file_path <> ''")
    both = ask.join(found.select("file_path", "doc_id", "text"), "file_path", "left")
    return both.withColumn("error", F.when(F.col("doc_id").isNull(), "not found"))


def summary(asked: DataFrame, found: DataFrame) -> DataFrame:
    """The number of findings of each requested file, null where it has an error; equal requests are one row each."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n"))
    count = F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0)))
    return asked.select("file_path", "doc_id", "error").join(n, "doc_id", "left").select("file_path", count.alias("finding_count"), "error")
