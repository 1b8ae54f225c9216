"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import chat, decontam, htmltext, langid, mixing, oracles, quality, sharding, simhash, tokens, url_filters
from sieveline.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.sharded(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    parts = [a.unionByName(b) for a, b in zip(chat.dialogue(turns), chat.embedded(turns), strict=True)]
    f = chat.formatted(*parts)
    absent = {c: F.coalesce(F.col(f"{c}.turn"), F.lit(-1)) for c in ("call_place", "result_place")}
    return f.withColumns({**absent, "level": F.coalesce("level", F.lit(-1)), "n_problems": F.size("problems").cast("long")}).drop("problems")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "source", F.col("_n_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_passes").alias("passes"), F.col("_pass").alias("pass"), F.col("_block").alias("block"), F.col("_order").alias("order_key"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counts(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return s.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = simhash.grouped(table(spark, sf_dir, "documents"))
    return g.select("doc_id", simhash.hex_digits(F.get("fps", F.lit(0))).alias("fingerprint"), "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_sharding, op3_chat_formatting, op4_quality_rules, op5_mixing,
        op6_token_counts, op7_decontamination, op8_language_id, op9_simhash, op10_html_text,
    )
}

ORACLES = {"op3_chat_formatting": oracles.OP3, "op4_quality_rules": oracles.OP4, "op7_decontamination": oracles.OP7}
