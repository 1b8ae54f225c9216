"""Quality rules: a threshold table compiled into one projection, evaluated without user functions.

Every measure is an expression over the row itself, so the operator is one narrow stage: no shuffle, no
broadcast, no state, whatever the size or skew of the table.

Defined results: a null or empty text has no words and fails; a text is measured whole, however long - one whose
words do not fit a task's memory twice fails with Spark's own error; repeated rows are judged each by itself, so ties
don't occur; other columns are passed through untouched, whatever their names - they travel as one struct - and only an
input column that bears the name of a measure is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE_RUN, WORD, packed, window_hash

WINDOW = 8
SYMBOLS = "[^#*$%&|<>]+"

#: Frequent function words of the languages served; fixed values.
STOP_WORDS = (
    "the of and to a in is it that for on with as was be by this are from at an or not "
    "de la le et les des en un une du que qui est pour dans par sur pas au avec "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine "
    "el los las y del se por con una para es al lo como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document with at least ``min_words`` words is rejected if ``low <= measure <= high`` does not hold."""

    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The table that a caller may replace. Ratios are per word, or per line for line_dup_ratio.
THRESHOLDS = (
    Rule("mean_word_chars", 2.0, 14.0),
    Rule("symbol_ratio", high=0.1),
    Rule("shout_ratio", high=0.3),
    Rule("upper_ratio", high=0.7),
    Rule("stop_ratio", low=0.01, min_words=200),
    Rule("line_dup_ratio", high=0.5),
    Rule("repeat_word_ratio", high=0.6),
)


def _n(array: Column) -> Column:
    return F.size(array).cast("long")


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """_row (the document's own columns), its measures, and _at."""
    own = ["_row"]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a = packed(docs, _t=body, _w=F.filter(F.split(body, SPACE_RUN), lambda w: w != ""))
    a = a.select(
        *own, "_t", "_w",
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)).alias("_l"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        _n(F.col("_w")).alias("n_words"),
    )
    starts = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    a = a.withColumn("_g", F.transform(starts, lambda i: window_hash(F.col("_h"), i, WINDOW)))
    # Only a text that repeats a window pays for the sort that finds where.
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    none = F.array().cast("array<struct<g:bigint,i:int>>")
    a = a.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), pairs).otherwise(none))
    twice = F.filter("_s", lambda x, k: (F.get("_s", k - 1)["g"] == x["g"]) | (F.get("_s", k + 1)["g"] == x["g"]))
    spots = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        spots,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    letters = F.length(F.regexp_replace("_t", "[^\\p{L}]+", ""))
    uppers = F.length(F.regexp_replace("_t", "[^\\p{Lu}]+", ""))
    a = a.select(
        *own, "n_words", "_w",
        F.aggregate("_w", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (_n(F.col("_l")) - _n(F.array_distinct("_l"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _n(F.col("_l")).alias("n_lines"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        letters.cast("long").alias("n_letters"), uppers.cast("long").alias("n_uppers"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stops"),
    )
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x).cast("double") / F.col(y)).otherwise(F.lit(0.0))
    return a.select(
        *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        per("word_chars", "n_words").alias("mean_word_chars"), per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_shouts", "n_words").alias("shout_ratio"), per("n_uppers", "n_letters").alias("upper_ratio"),
        per("n_stops", "n_words").alias("stop_ratio"), per("n_dup_lines", "n_lines").alias("line_dup_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        # Filters on the verdict would otherwise be pushed below, where the measures' expressions nest in each other
        # and are evaluated again for every word.
        F.monotonically_increasing_id().alias("_at"),
    )


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbol_ratio",
    "shout_ratio", "upper_ratio", "stop_ratio", "line_dup_ratio", "repeat_word_ratio", "base_failed", "kept",
)


def compiled(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The table as one boolean expression: true where no rule rejects."""
    ok = F.lit(True)
    for r in rules:
        fine = F.lit(True)
        if r.low is not None:
            fine &= F.col(r.measure) >= r.low
        if r.high is not None:
            fine &= F.col(r.measure) <= r.high
        ok &= fine | (F.col("n_words") < r.min_words) if r.min_words else fine
    return ok


def _judged(docs: DataFrame, rules: tuple[Rule, ...], text: str) -> DataFrame:
    bad = (F.col("_at") < 0) | (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return _measured(docs, text).withColumn("base_failed", bad).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """The documents with their measures, ``base_failed`` (under 20 words, or over 30 % of words in repeated windows) and ``kept``."""
    own = [c for c in docs.columns if c.lower() not in MEASURES]
    return _judged(docs, rules, text).select(*[F.col(f"_row.`{c}`") for c in own], *MEASURES)


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = THRESHOLDS, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    return _judged(docs, rules, text).where("kept").select("_row.*")
