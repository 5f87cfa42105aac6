"""Closed frequent itemsets of baskets, and the rules that leave one item out.

Method: items of enough baskets are put in one order, most frequent first, and each basket becomes the list of its
frequent items in that order. Items belong to groups by a hash. For every group a basket holds an item of, the group's
shard gets the basket up to its last such item: enough to count all itemsets whose last item is in the group. Equal
projections are merged before and after the shuffle. Each shard builds a frequent-pattern tree and mines it from the
rarest item upwards; a tree of the closed sets found so far, one for each last item, tells whether a set is subsumed by a
larger one of equal support. What a shard cannot see is a larger set that ends in a rarer item. A set that is closed among those with
its own last item and yet not closed is a proper prefix of its closure, in the order of items: so the prefixes of every
set, with its support, are the keys that drop non-closed ones across shards, by one equal join.

Rules need supports of sets with one item left out. These are closed among sets with their own last item, or else have
the support of the whole set, so they are looked up in what the shards found, again by an equal join.

Scale: shards have a bound, ``limit`` list elements. One beyond it is not mined: each of its items becomes a suffix of its
own, counted by a distributed sum, whose shorter projections are dealt into groups again, and so on; results of deeper
levels meet those above them by the same prefix rule. A basket's list is at most as long as there are frequent items, of
which there are at most ``per`` times the mean size of baskets. Supports reach baskets by a salted join; nothing but the
number of baskets goes to the driver and nothing is broadcast.

Defined results: rows without a basket or an item are no part of any basket; repeated rows count once; extra columns are ignored;
an empty table, or one without frequent items, gives no rows. Ties of supports are ordered by item.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Scratch, quoted

GROUPS = 128
SHARD_ELEMENTS = 2_000_000
SALTS = 32
#: An item with its support, negative so that arrays sort by falling support.
ELEMENT = "struct<down:bigint,item:bigint>"
FOUND = f"suffix array<{ELEMENT}>, items array<{ELEMENT}>, support bigint"


# ---------------------------------------------------------------- inside one shard


def group_of(item: int, depth: int, groups: int) -> int:
    return zlib.crc32(f"{depth}:{item}".encode()) % groups


class PatternTree:
    """A frequent-pattern tree: weighted lists of item codes, ascending, with shared prefixes."""

    def __init__(self, lists: Iterable[tuple[Iterable[int], int]]):
        self.item, self.count, self.parent = [-1], [0], [0]
        self.nodes: dict[int, list[int]] = defaultdict(list)
        below: list[dict[int, int]] = [{}]
        for codes, weight in lists:
            at = 0
            for code in codes:
                to = below[at].get(code)
                if to is None:
                    to = below[at][code] = len(self.item)
                    self.item.append(code)
                    self.count.append(0)
                    self.parent.append(at)
                    below.append({})
                    self.nodes[code].append(to)
                self.count[to] += weight
                at = to

    def base(self, code: int) -> list[tuple[list[int], int]]:
        """What stands above an item's nodes: its conditional pattern base."""
        out = []
        for node in self.nodes[code]:
            path, at = [], self.parent[node]
            while at:
                path.append(self.item[at])
                at = self.parent[at]
            out.append((path[::-1], self.count[node]))
        return out


class ClosedTree:
    """Closed sets found so far, rarest item first; each node keeps the largest support of a set through it."""

    def __init__(self):
        self.item, self.support, self.parent = [-1], [0], [0]
        self.below: list[dict[int, int]] = [{}]
        self.known: dict[tuple[int, int], list[int]] = defaultdict(list)

    def add(self, codes: list[int], support: int) -> None:
        at = 0
        for code in reversed(codes):
            to = self.below[at].get(code)
            if to is None:
                to = self.below[at][code] = len(self.item)
                self.item.append(code)
                self.support.append(0)
                self.parent.append(at)
                self.below.append({})
            if self.support[to] < support:
                self.support[to] = support
                self.known[code, support].append(to)
            at = to

    def subsumes(self, codes: list[int], support: int) -> bool:
        """Whether a set with all of these codes and this support is in the tree."""
        for node in self.known.get((codes[0], support), ()):
            if self.support[node] != support:
                continue
            k, at = 1, self.parent[node]
            while k < len(codes) and at and self.item[at] <= codes[k]:
                k += self.item[at] == codes[k]
                at = self.parent[at]
            if k == len(codes):
                return True
        return False


def closed_by_last(lists: list[tuple[list[int], int]], least: int, heads: Iterable[int]) -> Iterator[tuple[list[int], int]]:
    """For each head: the sets ending in it that no larger one ending in it equals in support."""
    tree = PatternTree(lists)
    for head in heads:
        done = ClosedTree()
        todo = [([], [(tree, [head])])]
        while todo:  # depth first, without recursion: lists can be long
            suffix, rest = todo.pop()
            if not rest:
                continue
            (here, codes) = rest[-1]
            if not codes:
                rest.pop()
                continue
            todo.append((suffix, rest))
            code = codes.pop()
            base = here.base(code)
            support, counts = 0, defaultdict(int)
            for path, weight in base:
                support += weight
                for c in path:
                    counts[c] += weight
            if support < least:
                continue
            found = sorted([code, *suffix, *(c for c, n in counts.items() if n == support)])
            if done.subsumes(found, support):
                continue
            done.add(found, support)
            yield found, support
            more = {c for c, n in counts.items() if least <= n < support}
            if more:
                inner = PatternTree(([c for c in path if c in more], weight) for path, weight in base)
                todo.append((found, [(inner, sorted(more))]))


def mine(shard: pa.Table, least: int, depth: int, groups: int) -> pa.Table:
    """All rows of a shard: (suffix, shard, items, weight)."""
    lists = shard.column("items").combine_chunks()
    flat, at = lists.flatten(), 0
    pairs = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True))
    order = sorted(set(pairs))
    code = {x: i for i, x in enumerate(order)}
    coded = [code[x] for x in pairs]
    rows = []
    for n, weight in zip(lists.value_lengths().to_pylist(), shard.column("weight").to_pylist(), strict=True):
        rows.append((coded[at : at + n], weight))
        at += n
    own = shard.column("shard")[0].as_py()
    heads = [i for i, (_, item) in enumerate(order) if group_of(item, depth, groups) == own]
    found = [([{"down": order[c][0], "item": order[c][1]} for c in codes], n) for codes, n in closed_by_last(rows, least, heads)]
    suffix = shard.column("suffix")[0].as_py()
    kind = pa.list_(pa.struct([("down", pa.int64()), ("item", pa.int64())]))
    return pa.table(
        {
            "suffix": pa.array([suffix] * len(found), kind),
            "items": pa.array([x for x, _ in found], kind),
            "support": pa.array([n for _, n in found], pa.int64()),
        }
    )


def miner(least: int, depth: int, groups: int) -> Callable[[pa.Table], pa.Table]:
    return lambda shard: mine(shard, least, depth, groups)


# ---------------------------------------------------------------- across shards


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Equal join in which a hot key of ``many`` is dealt to ``SALTS`` partitions; ``few`` has each key once."""
    left = many.withColumn("salt_", F.pmod(F.hash(spread), F.lit(SALTS)))
    right = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("shuffle_hash"), [*keys, "salt_"], how).drop("salt_")


def group_column(item: Column, depth: int, groups: int) -> Column:
    return F.pmod(F.crc32(F.concat(F.lit(f"{depth}:"), item.cast("string"))), F.lit(groups)).cast("int")


def deal(lists: DataFrame, depth: int, groups: int) -> DataFrame:
    """Projections of (suffix, items, weight) for every group of which the list has an item."""
    own = lists.withColumn("own_", F.transform("items", lambda x: group_column(x["item"], depth, groups)))
    own = own.withColumn("back_", F.reverse("own_")).withColumn("shard", F.explode(F.array_distinct("own_")))
    last = (F.size("own_") - F.array_position("back_", F.col("shard")) + 1).cast("int")
    cut = own.select("suffix", "shard", F.slice("items", F.lit(1), last).alias("items"), "weight")
    return cut.groupBy("suffix", "shard", "items").agg(F.sum("weight").alias("weight"))


def drop_prefixes(found: DataFrame, least_length: int) -> DataFrame:
    """Sets that are no proper prefix of another one with the same suffix and support."""
    lengths = F.sequence(F.lit(least_length), F.size("items") - 1)
    shorter = found.where(F.size("items") > least_length).select(
        "suffix", F.explode(F.transform(lengths, lambda n: F.slice("items", F.lit(1), n))).alias("items"), "support", F.lit(0).alias("own_")
    )
    both = found.select("suffix", "items", "support", F.lit(1).alias("own_")).unionByName(shorter)
    seen = both.groupBy("suffix", "items", "support").agg(F.min("own_").alias("least_"), F.max("own_").alias("most_"))
    return seen.where("least_ = 1 AND most_ = 1").select("suffix", "items", "support")


def candidates(lists: DataFrame, least: int, scratch: Scratch, groups: int = GROUPS, limit: int = SHARD_ELEMENTS) -> DataFrame:
    """(items, support) of the sets that are closed among those with their last item. lists: (items, weight)."""
    found: list[DataFrame] = []
    rows = deal(lists.withColumn("suffix", F.array().cast(f"array<{ELEMENT}>")), 0, groups)
    while True:
        depth = len(found)
        rows = scratch.table(rows, f"projections-{depth}")
        loads = rows.groupBy("suffix", "shard").agg(F.sum(F.size("items")).alias("load_"))
        large = scratch.table(loads.where(F.col("load_") > limit).select("suffix", "shard"), f"large-{depth}")
        more = not large.isEmpty()
        small = salted_join(rows, large, ["suffix", "shard"], F.col("items"), "left_anti") if more else rows

        here = small.select("suffix", "shard", "items", "weight").groupBy("suffix", "shard").applyInArrow(miner(least, depth, groups), FOUND)
        if depth:
            here = here.unionByName(suffixes.select("suffix", F.array().cast(f"array<{ELEMENT}>").alias("items"), "support"))  # noqa: F821
        found.append(scratch.table(here, f"found-{depth}"))
        if not more:
            break
        wide = salted_join(rows, large, ["suffix", "shard"], F.col("items"), "left_semi")
        wide = wide.select("suffix", "shard", "items", "weight", F.posexplode("items").alias("at_", "head_"))
        wide = wide.where(group_column(F.col("head_.item"), depth, groups) == F.col("shard"))
        wide = wide.select(F.concat(F.array("head_"), "suffix").alias("suffix"), F.slice("items", F.lit(1), F.col("at_")).alias("items"), "weight")
        wide = scratch.table(wide.groupBy("suffix", "items").agg(F.sum("weight").alias("weight")), f"wide-{depth}")
        suffixes = wide.groupBy("suffix").agg(F.sum("weight").alias("support")).where(F.col("support") >= least)
        suffixes = scratch.table(suffixes, f"suffixes-{depth + 1}")
        rows = deal(salted_join(wide, suffixes.select("suffix"), ["suffix"], F.col("items"), "left_semi"), depth + 1, groups)
    while len(found) > 1:  # the deepest level first; its sets end in one item more than those above
        deepest = drop_prefixes(found.pop(), 0)
        lifted = deepest.select(
            F.slice("suffix", F.lit(2), F.size("suffix")).alias("suffix"),
            F.concat("items", F.slice("suffix", 1, 1)).alias("items"),
            "support",
        )
        found[-1] = scratch.table(found[-1].unionByName(lifted), f"lifted-{len(found)}")
    return found[0]


def closed_itemsets(
    lines: DataFrame,
    basket: str = "sale_id",
    item: str = "item_id",
    least: int = 8,
    per: int = 5000,
    confidence: int = 10,
    groups: int = GROUPS,
    limit: int = SHARD_ELEMENTS,
    scratch: Scratch | None = None,
) -> DataFrame:
    """Closed itemsets of at least ``least`` baskets and one basket in ``per``: items (ascending), support, and rules.

    A rule takes one item c from a set: struct (c, a, s), a the support of the rest, s that of c, where the set is in
    ``confidence`` percent of the rest's baskets at least and in more than independence would give.
    """
    scratch = scratch or Scratch(lines.sparkSession)
    pairs = lines.select(quoted(basket).cast("long").alias("basket"), quoted(item).cast("long").alias("item"))
    pairs = scratch.table(pairs.where("basket IS NOT NULL AND item IS NOT NULL").distinct(), "pairs")
    total = pairs.select("basket").distinct().count()
    least = max(least, -(-total // per))
    often = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    often = scratch.table(often.select("item", (-F.col("n")).alias("down")), "often")
    sized = salted_join(pairs, often, ["item"], F.col("basket"))
    lists = sized.groupBy("basket").agg(F.sort_array(F.collect_list(F.struct("down", "item"))).alias("items"))
    lists = lists.groupBy("items").agg(F.count(F.lit(1)).alias("weight"))
    local = candidates(lists, least, scratch, groups, limit)
    closed = scratch.table(drop_prefixes(local, 1).select("items", "support"), "closed")
    rest = F.filter("items", lambda x: x != F.col("out_"))
    parts = closed.select("items", "support", F.explode("items").alias("out_")).withColumn("rest_", rest)
    known = local.select(F.col("items").alias("rest_"), F.col("support").alias("a_"))
    parts = parts.join(known.hint("merge"), "rest_", "left").withColumn("a_", F.coalesce("a_", "support")).withColumn("s_", -F.col("out_.down"))
    holds = (F.size("items") > 1) & (100 * F.col("support") >= confidence * F.col("a_")) & (F.col("support") * F.lit(total) > F.col("a_") * F.col("s_"))
    rule = F.when(holds, F.struct(F.col("out_.item").alias("c"), F.col("a_").alias("a"), F.col("s_").alias("s")))
    out = parts.groupBy("items", "support").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    return out.select(F.sort_array(F.transform("items", lambda x: x["item"])).alias("items"), "support", "rules")
