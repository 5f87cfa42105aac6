"""Closed itemsets and their rules against brute force; deep shards, nulls, repeats, clashing names, empty tables."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabwright.llm import baskets, queries

SCHEMA = "sale_id long, item_id long, `items` string, `basket` int"


def brute(rows, least, per, confidence):
    sets = defaultdict(set)
    for sale, item, *_ in rows:
        if sale is not None and item is not None:
            sets[sale].add(item)
    total, counts = len(sets), Counter()
    for s in sets.values():
        for k in range(1, len(s) + 1):
            counts.update(itertools.combinations(sorted(s), k))
    often = {x: n for x, n in counts.items() if n >= least and n * per >= total}
    items = {i for x in often for i in x}
    out = {}
    for x, n in often.items():
        if any(often.get(tuple(sorted({*x, i}))) == n for i in items - set(x)):
            continue
        rules = []
        for c in x if len(x) > 1 else ():
            a, s = counts[tuple(i for i in x if i != c)], counts[(c,)]
            if 100 * n >= confidence * a and n * total > a * s:
                rules.append((c, a, s))
        out[x] = (n, rules)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = []
    for sale in range(300):
        picked = [int(i) for i in rng.zipf(1.5, rng.integers(1, 8)) % 12]
        picked += [20, 21, 22, 23] if sale % 9 == 0 else []
        picked += [30, 1] if sale % 7 == 0 else []
        out += [(sale, i, "x", 1) for i in picked]
    return [*out, *out[:40], (None, 1, "y", 2), (5, None, None, None), (None, None, None, None)]


@pytest.mark.parametrize(("limit", "groups"), [(10**6, 8), (10**6, 1), (60, 2), (1, 3)])
def test_closed_itemsets_at_any_shard_size(spark, rows, limit, groups):
    df = spark.createDataFrame(rows, SCHEMA)
    found = baskets.closed_itemsets(df, least=5, limit=limit, groups=groups).collect()
    got = {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in found}
    assert len(got) == len(found)
    assert got == brute(rows, 5, 5000, 10)


def test_relative_support_and_confidence(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = baskets.closed_itemsets(df, least=1, per=20, confidence=60).collect()
    assert {tuple(r["items"]): (r["support"], [tuple(x) for x in r["rules"]]) for r in found} == brute(rows, 1, 20, 60)


def test_empty_tables(spark):
    for rows in ([], [(1, 2, "x", 1)], [(None, None, None, None)]):
        assert baskets.closed_itemsets(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_trees():
    tree = baskets.ClosedTree()
    tree.add([1, 4, 7], 3)
    tree.add([2, 7], 5)
    assert tree.subsumes([1, 7], 3) and tree.subsumes([4, 7], 3) and tree.subsumes([2, 7], 5)
    assert not tree.subsumes([1, 7], 2) and not tree.subsumes([2, 4, 7], 3) and not tree.subsumes([1, 2, 7], 3)
    lists = [([0, 1], 2), ([0, 1, 2], 3), ([2], 1)]
    assert sorted(baskets.closed_by_last(lists, 1, [1, 2])) == [([0, 1], 5), ([0, 1, 2], 3), ([2], 4)]


def test_registered():
    assert "op13_basket_itemsets" in queries.QUERIES
