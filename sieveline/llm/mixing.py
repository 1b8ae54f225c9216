"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent between 0 (all alike) and 1 (as they are) and
normalised. The exponent is bisected: it is the smallest that repeats no source more than ``repeat_limit`` times
as often as the largest one, or the one whose weights have ``target_entropy``. Each round of the search evaluates
``GRID`` exponents in one aggregation over the table of sources, so that only a few numbers reach the driver.

The weights become a budget for each source, in tokens: the least budget at which no document is dropped, unless
one is given. It is spent in passes. In every pass a source's documents are permuted in blocks - a hash deals them
to blocks, and the blocks and the documents within each are ordered by hashes of the pass - and the last
pass ends with the document that fills the budget. Running totals are taken within (source, block), so that a
source with a third of all rows is still dealt over many tasks.

The number of blocks grows with the table, so that the order in which a document is dealt is a function of the table,
the seed and the document, and not of the document alone.

Defined results: a null source is a source of its own; a document without words, or a null text, counts one token, so
that it can be placed; a text is counted whole, however long; repeated rows are placed each by itself, in any order
among themselves; ties of the order are broken by id and checksum; extra columns pass through, whatever their names -
they travel as one struct; of input columns that bear the name of an added one the added one is given; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import WORD, packed, written

GRID = 33
SEARCH_ROUNDS = 8
#: Blocks of a source: as many as leave some 65,536 rows each if all rows had one source.
LEAST_BLOCKS, BLOCK_ROWS = 64, 1 << 16
#: No document is seen more than twice, and half of the smallest sources' documents twice.
REPEAT_LIMIT = 1.5
ADDED = ("_n_tokens", "_weight", "_passes", "_pass", "_block", "_order")


def tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))).cast("long")


def exponent(sources: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None) -> float:
    """``sources``: a row for each source with n_tokens. Entropies are in nats."""
    whole = sources.agg(F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("m")).first()
    if not whole["t"]:
        return 1.0
    share = F.col("n_tokens") / F.lit(float(whole["t"]))
    low, high = 0.0, 1.0
    for _ in range(SEARCH_ROUNDS):
        grid = [low + (high - low) * k / (GRID - 1) for k in range(GRID)]
        raised = sources.select(share.alias("s"), F.explode(F.array(*[F.lit(x) for x in grid])).alias("a")).withColumn("q", F.pow("s", F.col("a")))
        # weight / share is largest for the smallest source; the largest source is seen once.
        top = whole["m"] / whole["t"]
        got = raised.groupBy("a").agg(
            F.max(F.col("q") / F.col("s")).alias("r"), F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("l")
        ).select("a", (F.col("r") * F.lit(float(top)) / F.pow(F.lit(float(top)), F.col("a"))).alias("repeats"), (F.log("z") - F.col("l") / F.col("z")).alias("entropy"))
        rows = sorted(got.collect(), key=lambda r: r["a"])
        if target_entropy is not None:
            fine = [r["entropy"] <= target_entropy for r in rows]
        else:
            fine = [r["repeats"] <= (repeat_limit or 1.0) + 1e-12 for r in rows]
        k = next((i for i, ok in enumerate(fine) if ok), GRID - 1)
        low, high = grid[max(0, k - 1)] if k else grid[0], grid[k]
        if k == 0:
            break
    return high


def mixed(
    docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, budget: float | None = None,
    seed: int = 5, doc: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Every placement of every document: its own columns, then _n_tokens, _weight, _passes, _pass, _block and _order."""
    name, ident, body = (F.col(f"`{c}`") for c in (source, doc, text))
    a = packed(docs, _src=F.struct(F.coalesce(name, F.lit("")), name.isNull()), _doc=ident, _n_tokens=tokens(body), _h=F.xxhash64(F.lit(seed), ident, body))
    n_blocks = max(LEAST_BLOCKS, docs.count() // BLOCK_ROWS)
    a = a.withColumn("_block", F.pmod(F.col("_h"), F.lit(n_blocks)).cast("int"))
    blocks = a.groupBy("_src", "_block").agg(F.sum("_n_tokens").alias("b"))
    # Kept, as every step of the search reads it, and the texts are to be counted once.
    blocks = written(blocks.withColumn("_turn", F.xxhash64(F.lit(seed + 1), "_src", "_block")))
    sources = blocks.groupBy("_src").agg(F.sum("b").alias("n_tokens"))
    whole = sources.agg(F.sum("n_tokens").alias("t")).first()["t"] or 1
    e = exponent(sources, repeat_limit, target_entropy)
    q = F.pow(F.col("n_tokens") / F.lit(float(whole)), F.lit(e))
    norm = sources.agg(F.sum(q).alias("z"), F.max(F.col("n_tokens") / q).alias("m")).first()
    z = norm["z"] or 1.0
    spend = float(budget) if budget is not None else (norm["m"] or 0.0) * z
    weights = sources.select("_src", (q / z).alias("_weight"), (F.lit(spend) * q / F.lit(z) / F.col("n_tokens")).alias("_passes"), "n_tokens")
    # Tokens before each block, in the order of the last pass; a source has n_blocks rows at most.
    w = Window.partitionBy("_src").orderBy("_turn", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("_before", F.coalesce(F.sum("b").over(w), F.lit(0))).join(weights, "_src")
    before = before.select(F.col("_src").alias("_s"), F.col("_block").alias("_b"), "_before", "_weight", "_passes", "n_tokens")
    before = written(before)  # so that its size is known: it is sent to all tasks if it is small
    # The join and the window share one exchange by (source, block).
    full = F.floor(F.col("_passes") + 1e-9)
    rest = F.greatest(F.lit(0.0), (F.col("_passes") - full) * F.col("n_tokens"))
    d = a.join(before, (F.col("_src") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    inner = Window.partitionBy("_src", "_block").orderBy("_h", "_doc")
    d = d.withColumn("_sofar", F.col("_before") + F.sum("_n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n_tokens"))
    n = (full + F.when((rest > 0.5) & (F.col("_sofar") < rest), 1).otherwise(0)).cast("int")
    d = d.withColumn("_copies", n).where("_copies > 0").withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    order = F.xxhash64(F.lit(seed), F.col("_pass"), F.col("_h"))
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ADDED]
    return d.select(*own, "_n_tokens", "_weight", "_passes", "_pass", "_block", order.alias("_order"))
