"""Mixing sources to target weights by blocks of packed words.

Every source's documents are laid end to end and cut into blocks of a fixed number of words. A plan
gives each output shard a number of slots per source, drawn as multinomial counts from the slots that
are still to be given out, so that over all shards every source gets exactly its quota. The k-th slot
of a source stands for block ``perm(k)`` of the source, ``perm`` being a keyed permutation that starts
anew for each pass over the source; blocks are then joined by (source, index).

Targets: the total size is shared by weight; no target exceeds ``MAX_PASSES`` times its source's
size, and what is cut off is shared again by weight among the others. Quotas consist of whole passes
and a rest of less than a pass, so that no block, and hence no document, is taken more than
``MAX_PASSES`` times. Quotas are whole blocks: the rest is rounded by the source's mean block, and a
source with any words gets one slot at least. Blocks longer than ``LEAST_WORDS`` are for large sources
only: none is longer than a ``BLOCK_SHARE``-th of its source's target, if that is over ``LEAST_WORDS``.

Scale: only (source, id, size) rows are shuffled. Positions inside a source come from two levels of
running sums: documents fall into hash buckets of about ``BUCKET_ROWS`` rows, whose totals are summed
per source; thus a source with a third of all rows is spread over as many tasks as any other rows, and
repeated rows are one row with a count until the end. Sources are a table like any other, of any
number: they are ordered, weighted and given targets in Spark (each round of sharing returns two sums),
and slot counts are drawn in two levels, over chunks of ``CHUNK`` sources on the driver and over the
sources of a chunk in its task. Slots are generated in ranges; blocks are joined on an index within the
source, by sort and merge: both sides grow with the input, however small they look compressed.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; repeated rows count each; rows of null ids are placed by their text like others;
an empty table gives an empty result; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import WORD, Scratch, quoted, text_of, unused
from tabwright.llm.sharding import PRIME, number_rows, round_keys

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
BLOCK_WORDS = 512
LEAST_WORDS = 32
BLOCK_SHARE = 64
SHARDS = 8
BUCKET_ROWS = 4096
#: Sources in one draw of slot counts.
CHUNK = 4096
#: Sources (under 100 bytes a row) that may be broadcast.
BROADCAST_ROWS = 500_000
SEED = 7919


def _floor_div(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def plan_sources(stats: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Number, target, block length, blocks and slots of each source, from (source, rows, source_size)."""
    ordered, n = number_rows(stats.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "_s", scratch)
    weights = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("_s") % len(WEIGHTS) + 1).cast("int"))
    table = scratch.table(ordered.drop("_last").withColumn("_weight", weights), "sources")
    cap = (F.col("source_size") * MAX_PASSES).cast("double")
    total, weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0.0))).first()
    left, closed = float(total), -1
    while weight:
        full = F.lit(left) * F.col("_weight") / weight >= cap
        found = table.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_weight")))).first()
        if found[0] == closed:
            break
        closed, left, weight = found[0], float(total) - (found[1] or 0.0), found[2]
    share = F.lit(left) * F.col("_weight") / weight if weight else cap
    size, target = F.col("source_size"), F.col("target")
    planned = table.withColumn("target", F.least(cap, share))
    planned = planned.withColumn("_words", F.least(F.lit(block_words), F.greatest(F.lit(LEAST_WORDS), F.floor(target / BLOCK_SHARE))).cast("long"))
    planned = planned.withColumn("_blocks", F.ceil(size / F.col("_words")).cast("long"))
    passes = F.when(size > 0, F.floor(target / size)).otherwise(0)
    rest = F.least(F.col("_blocks"), F.round((target - passes * size) * F.col("_blocks") / size).cast("long"))
    slots = passes * F.col("_blocks") + F.when((size > 0) & (passes < MAX_PASSES), rest).otherwise(0)
    slots = F.when(target > 0, F.greatest(slots, F.lit(1))).otherwise(slots).cast("long")
    return scratch.table(planned.withColumn("_slots", slots).drop("_weight"), "plan")


def draw_counts(quotas: np.ndarray, totals: list[int], seed: list[int]) -> np.ndarray:
    """Slots of each shard (row) and source (column): multinomial draws that add up to quotas and totals."""
    rng, left = np.random.default_rng(seed), np.array(quotas, np.int64)
    out = np.zeros((len(totals), len(left)), np.int64)
    for j, want in enumerate(totals):
        while (missing := want - int(out[j].sum())) > 0:
            room = left - out[j]
            out[j] += np.minimum(rng.multinomial(missing, room / room.sum()), room)
        left -= out[j]
    return out


def even_totals(n: int, shards: int) -> list[int]:
    """Sizes of the shards, at most one apart."""
    return [(n * (j + 1)) // shards - (n * j) // shards for j in range(shards)]


# ------------------------------------------------------- a permutation for each source and pass


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _walks(n: int, seed: int) -> int:
    """Longest walk outside [0, n), from the surplus numbers of the grid alone."""
    a, b = _grid(n)
    x, steps = np.arange(n, a * b, dtype=np.int64), 0
    while len(x):
        left, right = x % a, x // a
        for i, (m, c) in enumerate(round_keys(seed)):
            if i % 2 == 0:
                left = (left + _residue(right, m, c)) % a
            else:
                right = (right + _residue(left, m, c)) % b
        after = right * a + left
        after = after[after >= n]
        if len(after) == len(x):  # whole cycles outside: no inner number leads there
            break
        x, steps = after, steps + 1
    return steps


def _residue(x: np.ndarray, m: int, c: int) -> np.ndarray:
    t = (x % PRIME * m + c) % PRIME
    return (t * t + x) % PRIME


def _place(x: Column, a: Column, b: Column, seed: int) -> Column:
    keys = F.array(
        *[
            F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"), F.lit(i % 2 == 0).alias("left"))
            for i, (m, c) in enumerate(round_keys(seed))
        ]
    )

    def residue(v: Column, k: Column) -> Column:
        t = (v % PRIME * k["m"] + k["c"]) % PRIME
        return (t * t + v) % PRIME

    def one_round(s: Column, k: Column) -> Column:
        first = F.struct(((s["l"] + residue(s["r"], k)) % a).alias("l"), s["r"].alias("r"))
        second = F.struct(s["l"].alias("l"), ((s["r"] + residue(s["l"], k)) % b).alias("r"))
        return F.when(k["left"], first).otherwise(second)

    start = F.struct((x % a).alias("l"), F.call_function("div", x, a).alias("r"))
    return F.aggregate(keys, start, one_round, lambda s: s["r"] * a + s["l"])


def _permuted(x: Column, n: Column, a: Column, b: Column, walks: int, seed: int) -> Column:
    place = _place(x, a, b, seed)
    if walks:
        again = lambda v, _: F.when(v >= n, _place(v, a, b, seed)).otherwise(v)
        place = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), place, again)
    return place


# ----------------------------------------------------------------------------------- the mix


def measure(docs: DataFrame, scratch: Scratch, row: str | None = None) -> DataFrame:
    """doc_id, source, text_hash, size (words) and copies (``_n``) of rows; with ``row``, that id of each row.

    Written down, as it is read thrice. Without row ids, repeated rows are one row with their number.
    """
    sizes = docs.select(
        "doc_id",
        F.col("source").alias("source"),
        F.xxhash64(text_of()).alias("_hash"),
        F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"),
        *([quoted(row).alias("_row")] if row else []),
    )
    if row:
        sizes = sizes.withColumn("_n", F.lit(1).cast("long"))
    else:
        sizes = sizes.groupBy("doc_id", "source", "_hash", "size").agg(F.count(F.lit(1)).alias("_n"))
    return scratch.table(sizes, "sizes")


def source_stats(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum("_n").alias("rows"), F.sum(F.col("size") * F.col("_n")).alias("source_size"))


def positions(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Add the plan of each row's source and ``_from``, the words before the row in its source."""
    plan = plan.withColumnRenamed("source", "_name")
    small = plan.count() <= BROADCAST_ROWS
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    rows = sizes.join(F.broadcast(plan) if small else plan, sizes["source"].eqNullSafe(plan["_name"])).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "_hash"), buckets)
    )
    ties = [F.col("_row")] if "_row" in sizes.columns else []
    words = F.col("size") * F.col("_n")
    inside = Window.partitionBy("_s", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "_hash", *ties)
    rows = rows.withColumn("_inside", F.sum(words).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy("_s").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_s", "_bucket").agg(F.sum(words).alias("_total"))
    totals = totals.select("_s", "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(totals.hint("merge"), ["_s", "_bucket"])
    rows = rows.withColumn("_first", F.col("_before") + F.coalesce("_inside", F.lit(0)))
    # Copies follow each other; ranges of them first, so that no array grows with their number.
    ranged = rows.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(BUCKET_ROWS).cast("long"))))
    each = ranged.withColumn("_copy", F.explode(F.sequence("_lo", F.least(F.col("_lo") + (BUCKET_ROWS - 1), F.col("_n") - 1))))
    return each.withColumn("_from", F.col("_first") + F.col("_copy") * F.col("size"))


def slots(plan: DataFrame, scratch: Scratch, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: shard, slot within the shard, source number, pass over the source, block index."""
    spark = plan.sparkSession
    chunked = plan.filter("_slots > 0").select("_s", "_blocks", "_slots", _floor_div(F.col("_s"), F.lit(CHUNK)).alias("_chunk"))
    quotas = sorted(tuple(r) for r in chunked.groupBy("_chunk").agg(F.sum("_slots")).collect())  # a row for CHUNK sources
    total = sum(q for _, q in quotas)
    totals = even_totals(total, shards)
    counts = draw_counts(np.array([q for _, q in quotas], np.int64), totals, [seed, 1])
    base = np.cumsum(counts, 1) - counts
    rows = [(c, counts[:, i].tolist(), base[:, i].tolist()) for i, (c, _) in enumerate(quotas)]
    dealt = chunked.join(spark.createDataFrame(rows, "_chunk long, _totals array<long>, _bases array<long>"), "_chunk")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        found = draw_counts(pdf["_slots"].to_numpy(np.int64), list(pdf["_totals"].iloc[0]), [seed, 2, int(pdf["_chunk"].iloc[0])])
        at = np.cumsum(found, 1) - found + np.array(list(pdf["_bases"].iloc[0]))[:, None]
        first = np.cumsum(found, 0) - found
        j, i = np.nonzero(found)
        grids = [_grid(int(n)) for n in pdf["_blocks"]]
        walks = [max(_walks(int(n), seed + e) for e in range(MAX_PASSES)) for n in pdf["_blocks"]]
        return pd.DataFrame({
            "shard": j.astype(np.int32), "_s": pdf["_s"].to_numpy()[i], "_at": at[j, i], "_n": found[j, i], "_first": first[j, i],
            "_blocks": pdf["_blocks"].to_numpy()[i], "_a": np.array([g[0] for g in grids])[i], "_b": np.array([g[1] for g in grids])[i], "_walks": np.array(walks)[i],
        })

    schema = "shard int, _s long, _at long, _n long, _first long, _blocks long, _a long, _b long, _walks long"
    drawn = scratch.table(dealt.groupBy("_chunk").applyInPandas(draw, schema), "drawn")
    walks = drawn.agg(F.coalesce(F.max("_walks"), F.lit(0))).first()[0]
    shard_walks = max(_walks(n, seed + 101) for n in totals)
    of_shard = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("shard") + 1)
    chunk = 1 << 14
    ranges = drawn.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk).cast("long"))).alias("_lo"))
    ranges = ranges.repartition(max(1, min(10_000, -(-total // (8 * chunk)))))
    each = ranges.select("*", F.explode(F.sequence(F.col("_lo"), F.least(F.col("_lo") + (chunk - 1), F.col("_n") - 1))).alias("_k"))
    each = each.withColumn("_nth", F.col("_first") + F.col("_k")).withColumn("pass", _floor_div(F.col("_nth"), F.col("_blocks")).cast("int"))
    within = F.col("_nth") % F.col("_blocks")
    block = F.lit(None).cast("long")
    for e in range(MAX_PASSES):
        block = F.when(F.col("pass") == e, _permuted(within, F.col("_blocks"), F.col("_a"), F.col("_b"), walks, seed + e)).otherwise(block)
    sides = [_grid(n) for n in totals]
    slot = _permuted(F.col("_at") + F.col("_k"), of_shard(totals), of_shard([a for a, _ in sides]), of_shard([b for _, b in sides]), shard_walks, seed + 101)
    return each.select("shard", slot.alias("slot"), "_s", "pass", block.alias("block"))


def pieces(placed: DataFrame) -> DataFrame:
    """A row for each block that a document touches: block, and the document's words in it, from and to."""
    first, last = _floor_div(F.col("_from"), F.col("_words")), _floor_div(F.col("_from") + F.col("size") - 1, F.col("_words"))
    spread = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("block") * F.col("_words") - F.col("_from"), F.lit(0).cast("long"))
    high = F.least((F.col("block") + 1) * F.col("_words") - F.col("_from"), F.col("size"))
    return spread.withColumns({"low": low, "high": high})


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """For each row: doc_id, source, size, source_size, target of its source, and taken words."""
    scratch = scratch or Scratch(docs.sparkSession)
    sizes = measure(docs, scratch)
    plan = plan_sources(source_stats(sizes), scratch, block_words)
    own = ["doc_id", "source", "size", "source_size", "target", "_s", "_from"]
    placed = positions(sizes, plan).select(*own, "_words")
    times = slots(plan, scratch, shards, seed).groupBy("_s", "block").agg(F.count(F.lit(1)).alias("_times"))
    parts = pieces(placed).join(times.hint("merge"), ["_s", "block"], "left")
    some = parts.groupBy(*own).agg(F.sum((F.col("high") - F.col("low")) * F.coalesce("_times", F.lit(0))).alias("taken"))
    none = placed.filter("size = 0").select(*own, F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).drop("_s", "_from")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, scratch: Scratch | None = None) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: text and n_chars are those of what is taken.

    A pass over a source takes some of its blocks. Neighbouring taken blocks join again, so that in a
    whole pass a document comes out as it was; else its runs of taken words come out as rows.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    row, found, run = unused(docs, "_row", "_runs", "_run")
    keyed = scratch.table(docs.withColumn(row, F.monotonically_increasing_id()), "input")
    sizes = measure(keyed, scratch, row)
    plan = plan_sources(source_stats(sizes), scratch, block_words)
    placed = positions(sizes, plan).select("_row", "size", "_s", "_from", "_words")
    drawn = slots(plan, scratch, shards, seed).select("_s", "block", "pass")
    got = pieces(placed).join(drawn.hint("merge"), ["_s", "block"])
    ranges = got.groupBy("_row", "size", "pass").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("_r"))
    empty = F.array().cast("array<struct<low:bigint,high:bigint>>")

    def join(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        meets = (F.size(runs) > 0) & (F.get(runs, F.size(runs) - 1)["high"] == x["low"])
        longer = F.concat(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.struct(last["low"].alias("low"), x["high"].alias("high"))))
        return F.when(meets, longer).otherwise(F.concat(runs, F.array(F.struct(x["low"].alias("low"), x["high"].alias("high")))))

    runs = ranges.select("_row", "size", F.explode(F.aggregate("_r", empty, join)).alias("_one"))
    runs = runs.select("_row", F.struct("_one.low", "_one.high", ((F.col("_one.low") == 0) & (F.col("_one.high") == F.col("size"))).alias("whole")).alias("_one"))
    per_row = runs.groupBy(F.col("_row").alias(row)).agg(F.collect_list("_one").alias(found))
    rows = keyed.join(per_row.hint("merge"), row).withColumn(run, F.explode(quoted(found)))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    low, high = quoted(run)["low"], quoted(run)["high"]
    part = F.array_join(F.slice(words, (low + 1).cast("int"), (high - low).cast("int")), "")
    out = rows.withColumn("text", F.when(quoted(run)["whole"], F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[quoted(c) for c in docs.columns])
