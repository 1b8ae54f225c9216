"""Expressions and storage helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of ASCII white space: blank and U+0009 to U+000D.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
#: Letters and digits of ASCII in lower case, and everything beyond ASCII.
ALNUM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Bits of a sieve: as 64-bit words at most 2 ** 20 rows, some 50 MB as a broadcast relation, however many the keys.
SIEVE_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and leaves every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Words between ASCII white space; null gives no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def alnum_words(text: Column) -> Column:
    """Normalised words of a text as decontamination compares them; null gives no words."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))


def window_hash(hashes: Column, start: Column, width: int, function=F.xxhash64) -> Column:
    """Hash of ``width`` numbers of an array from index ``start``; equals the hash of that slice as an array.

    A slice inside a lambda copies the whole array for each element, so the numbers are fetched one by one.
    """
    return function(*[F.get(hashes, start + k) for k in range(width)])


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one, as in tests, gets a folder of its own:
    on a cluster a folder of one machine would be lost with it, so that there its lack is an error."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sieveline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def keep(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder; partitions and their order stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder: compressed, but without its partitions' order."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sieveline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores before it as no column of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def packed(df: DataFrame, **parts: Column) -> DataFrame:
    """The frame's columns as one struct ``_row`` beside the given columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in parts.items()])


def sifted(rows: DataFrame, key: Column, keys: DataFrame, among: Column) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be one of ``among`` the keys, and those whose key surely isn't.

    ``key`` and ``among`` are hashes of 64 bits. A bitmap of ``SIEVE_BITS`` tells them apart where the rows lie, so that only the
    former have to be shuffled to meet the keys. The bitmap has one size for any table; up to some four million keys it
    lets through one row of sixteen that has no key, and beyond ever more, which costs shuffle and changes no result.
    """
    low = lambda h: h.bitwiseAND(F.lit(SIEVE_BITS - 1).cast("long"))
    word = lambda h: F.shiftright(low(h), 6)
    bit = lambda h: low(h).bitwiseAND(F.lit(63).cast("long")).cast("int")
    words = keys.select(word(among).alias("_sieve"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(among)).alias("b")).groupBy("_sieve").agg(F.bit_or("b").alias("_bits"))
    both = rows.withColumn("_at", key)
    both = both.join(F.broadcast(words), word(F.col("_at")) == F.col("_sieve"), "left")
    maybe = F.coalesce(F.call_function("shiftright", F.col("_bits"), bit(F.col("_at"))).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    return both.where(maybe).select(*rows.columns), both.where(~maybe).select(*rows.columns)
