"""Benchmark decontamination: a hash set of normalised test n-grams against the windows of training texts.

Each window of a text is hashed within its row and tested against a bitmap of the n-grams' hashes, a literal of at most
``BITS`` bits; what is left, some hundredth of the windows as long as the n-grams are fewer than a sixteenth of the bits,
leaves the row with its words and meets the n-grams in an equi-join on hash and words, so that a hit is always one of
the words themselves. The n-grams are broadcast while their number is at most ``BROADCAST_GRAMS``, and joined by a
shuffle beyond. The items that share an n-gram are one array beside it, so that a hit is one row, in however many items
it occurs. All but the hits and one row a document are dropped before the one shuffle, which therefore is a few bytes a
document.

Defined results: a null or empty text has no words and no hits; a very long text is scanned whole, its hashes in one
task's memory; an item without words has no window; items with the same text all count; an item whose id is null makes
hits but has no name, so it is not in ``items``; repeated documents are scanned each by itself, so ties don't occur;
other columns pass through ``clean`` and ``cut``, whatever their names - they travel as one struct; an empty table on
either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import alnum_words, packed, sifted, window_hash, written

N = 10
#: About 50 MB of hash relation.
BROADCAST_GRAMS = 250_000
#: The bitmap grows with the n-grams up to this size, 256 kB.
BITS = 1 << 21


def grams(benchmark: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each distinct window: said (its words), width, h and the items that have it (sorted ids as text)."""
    words = alnum_words(F.col(f"`{text}`"))
    a = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    a = a.select("item", "w", F.least(F.lit(n), F.size("w")).alias("width"))
    a = a.select("item", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))).alias("g"))
    a = a.select("item", "width", F.array_join("g", " ").alias("said"), F.xxhash64(F.transform("g", lambda w: F.xxhash64(w))).alias("h"))
    return a.groupBy("said", "width", "h").agg(F.collect_set("item").alias("items"))


def _bitmap(table: DataFrame, bits: int) -> Column:
    """An array of 64-bit words in which the bit of each n-gram's hash is set: bit ``h`` modulo ``bits``."""
    at = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    one = table.select(F.shiftright(at, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int")).alias("b"))
    set_ = {r["i"]: r["b"] for r in one.groupBy("i").agg(F.bit_or("b").alias("b")).collect()}  # bits / 64 rows at most
    return F.from_json(F.lit("[" + ",".join(str(set_.get(k, 0)) for k in range(bits // 64)) + "]"), "array<bigint>")


def _may_be(bitmap: Column, h: Column, bits: int) -> Column:
    at = h.bitwiseAND(F.lit(bits - 1).cast("long"))
    return F.call_function("shiftright", F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, spans (array of first word and width, in order), n_hit, items (sorted ids as text)."""
    table = written(grams(benchmark, n))
    sizes = table.groupBy("width").count().collect()  # one row for each width, n at most
    widths, total = sorted(r["width"] for r in sizes), sum(r["count"] for r in sizes)
    bits = min(BITS, max(64, 1 << (16 * total).bit_length()))
    bitmap = _bitmap(table, bits)
    table = F.broadcast(table) if total <= BROADCAST_GRAMS else table
    words = alnum_words(F.col(f"`{text}`"))
    a = docs.select(F.col(f"`{doc}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.monotonically_increasing_id().alias("_row"), words.alias("_w"))
    a = a.select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_x"))
    kind = "array<struct<at:int,width:int,h:bigint,said:string>>"

    def windows(w: int) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size("_x") - w), lambda i: F.struct(i.alias("i"), window_hash(F.col("_x"), i, w).alias("h")))
        some = F.filter(hashed, lambda x: _may_be(bitmap, x["h"], bits))
        said = F.transform(some, lambda x: F.struct((x["i"] + 1).alias("at"), F.lit(w).alias("width"), x["h"].alias("h"), F.array_join(F.slice("_w", x["i"] + 1, w), " ").alias("said")))
        return F.when(F.size("_x") >= w, said).otherwise(F.array().cast(kind))

    wins = [windows(w) for w in widths] or [F.array().cast(kind)]
    a = a.select("doc_id", "text_key", "_row", F.size("_w").cast("long").alias("n_words"), F.posexplode_outer(F.concat(*wins) if len(wins) > 1 else wins[0]).alias("_k", "_v"))
    a = a.select("doc_id", "text_key", "_row", "n_words", "_k", "_v.at", "_v.width", "_v.h", "_v.said")
    found = a.join(table.withColumn("_hit", F.lit(True)), ["h", "said", "width"], "left").where(F.col("_hit") | F.col("_k").isNull() | (F.col("_k") == 0))
    per = found.groupBy("_row", "doc_id", "text_key", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("_hit"), F.struct("at", "width")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["at"] + x["width"] - 1 - F.greatest(s["end"], x["at"] - 1))).alias("n"),
            F.greatest(s["end"], x["at"] + x["width"] - 1).alias("end"),
        ),
        lambda s: s["n"],
    )
    return per.select("doc_id", "text_key", "n_words", "spans", covered.alias("n_hit"), "items")


def _known(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """The documents as _row, with what they are known by: their id and their whole text."""
    return packed(docs, _d=F.col(f"`{doc}`"), _k=F.xxhash64(F.col(f"`{text}`")), _body=F.col(f"`{text}`"))


def _hits(docs: DataFrame, benchmark: DataFrame, n: int, doc: str, text: str) -> DataFrame:
    """Kept as a table, so that the texts are scanned once."""
    hits = scan(docs, benchmark, n, doc, text).where("n_hit > 0").select(F.col("doc_id").alias("_i"), F.col("text_key").alias("_h"), F.col("spans").alias("_spans"))
    return written(hits.dropDuplicates(["_i", "_h"]))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any hit, with their own columns."""
    dirty = _hits(docs, benchmark, n, doc, text).select("_i", "_h")
    some, rest = sifted(_known(docs, doc, text).drop("_body"), F.xxhash64("_d", "_k"), dirty, F.xxhash64("_i", "_h"))
    some = some.join(dirty.hint("merge"), F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_h")), "left_anti")
    return rest.unionByName(some).select("_row.*")


def cut(docs: DataFrame, benchmark: DataFrame, n: int = N, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with the hit words removed instead: text becomes its normalised words outside every span."""
    hits = _hits(docs, benchmark, n, doc, text)
    both = _known(docs, doc, text).join(hits, F.col("_d").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_h")), "left")
    # One pass over the sorted spans collects the words between them.
    gaps = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("gap")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["at"] + x["width"] - 1).alias("end"),
            F.when(x["at"] - 1 > s["end"], F.concat(s["gap"], F.array(F.struct((s["end"] + 1).alias("a"), (x["at"] - 1).alias("b"))))).otherwise(s["gap"]).alias("gap"),
        ),
    )
    both = both.withColumn("_w", alnum_words(F.col("_body"))).withColumn("_s", gaps)
    rest = F.concat(F.col("_s.gap"), F.array(F.struct((F.col("_s.end") + 1).alias("a"), F.size("_w").alias("b"))))
    left = F.array_join(F.flatten(F.transform(rest, lambda x: F.slice("_w", x["a"], F.greatest(F.lit(0), x["b"] - x["a"] + 1)))), " ")
    said = F.when(F.col("_spans").isNull(), F.col("_body")).otherwise(left)
    return both.select(*[said.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])
