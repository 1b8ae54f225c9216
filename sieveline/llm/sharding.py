"""Sharding by a Feistel permutation with cycle walking over global row numbers.

A row's number is its rank by (id, checksum, size), so it depends on the rows and not on how they are stored.
The number is found with a range partitioning of three small columns, which is checkpointed, and the row counts
of its partitions; no task sees more than one partition. The permutation is arithmetic on the row: anyone who
knows the row number, the number of rows and the seed can compute shard and slot, and invert them.

A walk leaves the range only through the numbers beyond it, fewer than the root of the row count; the driver follows all
of those and so knows the longest walk before the job starts.

Defined results: a null text has size 1 and checksum 0, as an empty one; a text is measured whole; rows with equal id
and text are interchangeable and get numbers next to each other; a null id comes first; other columns are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import keep

#: A prime below 2**31: products of two residues fit 63 bits.
PRIME = 2147483647
ROUNDS = 6
_POSITION = (1 << 33) - 1


def _key(seed: int, i: int) -> int:
    return (seed * 7368787 + (i + 1) * 48271 * 65537) % PRIME


def _mix(x: Column, seed: int, i: int) -> Column:
    """Two squarings modulo PRIME with a round key between; below PRIME for every x below 2**62."""
    a = (x + _key(seed, i)) % PRIME
    b = (a * a + _key(seed, i + ROUNDS)) % PRIME
    return (b * b + a) % PRIME


def permuted(row: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``row`` among ``n``, a bijection of 0 .. n - 1."""
    left = max(1, isqrt(max(n - 1, 0)) + 1)
    right = max(1, -(-max(n, 1) // left))

    def step(x: Column) -> Column:
        s = F.struct((x % left).alias("l"), F.floor(x / left).cast("long").alias("r"))
        # aggregate() binds each round's state once, so that the expression doesn't double with each round.
        def half(s, i):
            moved_l = F.lit(0).cast("long")
            moved_r = F.lit(0).cast("long")
            for k in range(ROUNDS):
                if k % 2 == 0:
                    moved_l = F.when(i == k, (s["l"] + _mix(s["r"], seed, k)) % left).otherwise(moved_l)
                else:
                    moved_r = F.when(i == k, (s["r"] + _mix(s["l"], seed, k)) % right).otherwise(moved_r)
            return F.struct(F.when(i % 2 == 0, moved_l).otherwise(s["l"]).alias("l"), F.when(i % 2 == 1, moved_r).otherwise(s["r"]).alias("r"))

        return F.aggregate(F.array(*[F.lit(k) for k in range(ROUNDS)]), s, half, lambda s: s["r"] * left + s["l"])

    more = longest_walk(n, seed)
    start = step(row.cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(more)), start, lambda x, _: F.when(x < n, x).otherwise(step(x))) if more else start


def _step(n: int, seed: int):
    """One step of the walk for plain numbers, and the size of its domain."""
    left = max(1, isqrt(max(n - 1, 0)) + 1)
    right = max(1, -(-max(n, 1) // left))

    def mix(x: int, i: int) -> int:
        a = (x + _key(seed, i)) % PRIME
        b = (a * a + _key(seed, i + ROUNDS)) % PRIME
        return (b * b + a) % PRIME

    def step(row: int) -> int:
        lo, hi = row % left, row // left
        for k in range(ROUNDS):
            if k % 2 == 0:
                lo = (lo + mix(hi, k)) % left
            else:
                hi = (hi + mix(lo, k)) % right
        return hi * left + lo

    return step, left * right


def longest_walk(n: int, seed: int = 0) -> int:
    """The most steps that any walk takes beyond the range."""
    step, size = _step(n, seed)
    beyond: dict[int, int] = {}
    for x in range(n, size):
        way = []
        while x >= n and x not in beyond:
            way.append(x)
            beyond[x] = 0  # stays so in a circle beyond the range, which no row enters
            x = step(x)
        circle = bool(way) and x == way[0]
        for k, y in enumerate(reversed(way)):
            beyond[y] = 0 if circle else beyond.get(x, 0) + k + 1
    return max(beyond.values(), default=0)


def permuted_number(row: int, n: int, seed: int = 0) -> int:
    """The same permutation for one number, outside Spark."""
    step, _ = _step(n, seed)
    row = step(row)
    while row >= n:
        row = step(row)
    return row


def numbered(df: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """The rows with ``row_number`` from 0 by the order of ``by``, and their count. ``df`` should be narrow: it is checkpointed."""
    ranged = keep(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by]))
    placed = ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION)))
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    first, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        first.append(total)
        total += counts.get(p, 0)
    starts = F.array(*[F.lit(x).cast("long") for x in first]) if first else F.array().cast("array<bigint>")
    return placed.withColumn("row_number", F.get(starts, F.col("_part")) + F.col("_at")).drop("_part", "_at"), total


def sharded(docs: DataFrame, shards: int = 8, seed: int = 20, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every document; shards differ by one row at most."""
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    small = docs.select(F.col(doc).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    rows, n = numbered(small, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("_p", permuted(F.col("row_number"), n, seed))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"))
