"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers in ascending id order. A keyed permutation of ``[0, n)`` moves
number ``r`` to ``p``; the row then lies in shard ``p % shards`` at slot ``p // shards``. So shard
sizes differ by one row at most (the law ``rows``), the shuffle is reproducible, and the place of
any row is computable from its number alone, as is the number from its place.

The permutation is a generalised Feistel network on an ``a x b`` grid that is only a little larger
than ``n``; numbers that land outside ``[0, n)`` walk on along their cycle. The longest walk is
found beforehand (only the about ``2 * sqrt(n)`` surplus numbers can prolong one), which turns the
walk into a fixed number of column expressions: no loop over data, no user function.

Scale: one range shuffle of slim rows (id, size, checksum; never the text), one table of row counts
per partition, which is broadcast because it has one row per partition, and a projection. Equal
texts or a hot source have no influence, because nothing is grouped.

Defined results: a null text has no bytes (size 1, checksum 0); rows with a null id come first;
equal ids are ordered by size and checksum; repeated rows get numbers of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, text_of

ROUNDS = 6
#: A prime below 2**31: products of two residues stay within a signed 64-bit integer.
PRIME = 2147483629
SEED = 20240601


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Multiplier and increment of each round, from a linear recurrence over the prime field."""
    keys, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 48271 + 11) % PRIME
        y = (x * 69621 + 7) % PRIME
        keys.append((x or 1, y))
        x = y
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _quotient(x: Column, divisor: int) -> Column:
    """Integer quotient of two non-negative integers."""
    return F.call_function("div", x, F.lit(divisor))


def _mixed(x: Column, multiplier: Column, increment: Column) -> Column:
    """Keyed residue of x; the square makes the round function non-linear."""
    t = (x % PRIME * multiplier + increment) % PRIME
    return (t * t + x) % PRIME


def feistel(x: Column, n: int, seed: int = SEED) -> Column:
    """One pass of the network over the grid of n: a permutation of [0, a * b).

    The rounds are a fold over the array of keys, so that the expression stays small.
    """
    a, b = grid(n)
    keys = F.array(
        *[
            F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"), F.lit(i % 2 == 0).alias("on_left"))
            for i, (m, c) in enumerate(round_keys(seed))
        ]
    )

    def one_round(state: Column, key: Column) -> Column:
        left, right = state["left"], state["right"]
        moved = F.struct(((left + _mixed(right, key["m"], key["c"])) % a).alias("left"), right.alias("right"))
        other = F.struct(left.alias("left"), ((right + _mixed(left, key["m"], key["c"])) % b).alias("right"))
        return F.when(key["on_left"], moved).otherwise(other)

    start = F.struct((x % a).cast("long").alias("left"), _quotient(x, a).alias("right"))
    return F.aggregate(keys, start, one_round, lambda s: s["right"] * a + s["left"])


def longest_walk(spark, n: int, seed: int = SEED) -> int:
    """How many further steps any number needs at most until it lies inside [0, n)."""
    a, b = grid(n)
    outside, left, steps = spark.range(n, a * b).select(F.col("id").alias("x")), a * b - n, 0
    while left:
        outside = outside.select(feistel(F.col("x"), n, seed).alias("x")).filter(F.col("x") >= n)
        after = outside.count()
        if after == left:  # whole cycles outside: no inner number leads there
            break
        left, steps = after, steps + 1
    return steps


def permute(df: DataFrame, number: str, n: int, out: str, seed: int = SEED) -> DataFrame:
    """Add the permuted number: within [0, n), each exactly once."""
    if n == 0:
        return df.withColumn(out, F.lit(0).cast("long"))
    place, walk = feistel(F.col(number), n, seed), longest_walk(df.sparkSession, n, seed)
    if walk:
        again = lambda x, _: F.when(x >= n, feistel(x, n, seed)).otherwise(x)
        place = F.aggregate(F.sequence(F.lit(1), F.lit(walk)), place, again)
    return df.withColumn(out, place)


def number_rows(df: DataFrame, order: list[str], out: str = "row_number", scratch: Scratch | None = None) -> tuple[DataFrame, int]:
    """Gapless global row numbers in the given order, and the number of rows.

    The rows are range-partitioned and sorted, so that a partition's rows follow those of the one
    before; a row's number is its position in its partition plus the rows of all earlier ones.
    The sorted table is written down first: both counts and positions come from the same files.
    """
    sorted_rows = (
        df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
        .sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
        .withColumn("_part", F.spark_partition_id())
        # The id counts a partition's rows in its lower 33 bits.
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    rows = (scratch or Scratch(df.sparkSession)).table(sorted_rows, "numbered")
    sizes = rows.groupBy("_part").count().collect()  # one row per partition
    start, base = 0, {}
    for part, count in sorted((r[0], r[1]) for r in sizes):
        base[part] = start
        start += count
    bases = df.sparkSession.createDataFrame(list(base.items()) or [(0, 0)], "_part int, _base long")
    numbered = rows.join(F.broadcast(bases), "_part").withColumn(out, F.col("_base") + F.col("_at"))
    return numbered.drop("_part", "_at", "_base"), start


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED) -> DataFrame:
    """Assign every row a shard and a slot: doc id, size, text_crc32, row_number, place, shard, slot."""
    text = text_of(text_column)
    slim = docs.select(
        F.col(id_column).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    numbered, n = number_rows(slim, ["doc_id", "size", "text_crc32"])
    placed = permute(numbered, "row_number", n, "place", seed)
    return placed.withColumns(
        {
            "shard": (F.col("place") % shards).cast("int"),
            "slot": _quotient(F.col("place"), shards),
        }
    )
