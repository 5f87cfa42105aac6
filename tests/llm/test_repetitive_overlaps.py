"""Overlaps of repetitive texts with repetitive items, through the join, against all diagonals."""

import random

import numpy as np

from tabwright.llm import decontaminate as D


def words_of(text):
    return np.array([hash(w) & (2**63 - 1) for w in text.split()], np.uint64)


def brute(text, item):
    h, i = words_of(text), words_of(item)
    return max((D.agreement(h, i, s) for s in range(-len(i) + 1, len(h))), default=0) if len(i) else 0


def texts(rnd):
    unit = [rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 5]))]
    out = (unit * 60)[: rnd.choice([13, 25, 60])]
    for _ in range(rnd.choice([0, 0, 2, 6])):
        out[rnd.randrange(len(out))] = rnd.choice("xyz")
    return " ".join(out)


def test_against_all_diagonals(spark):
    rnd = random.Random(11)
    docs = [(i, texts(rnd)) for i in range(60)] + [(60, None), (61, ""), (62, "a")]
    items = [(i, texts(rnd)) for i in range(15)] + [(15, "c b a"), (16, "")]
    found = D.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["doc_id"]: (r["item_ids"], r["n_same"]) for r in found.collect()}
    for key, text in docs:
        same = {i: brute(text or "", t) for i, t in items}
        assert got[key] == (sorted(i for i, n in same.items() if n), max(same.values())), text


def test_progressions_keep_every_place():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(0, 80))
        owner, h, place = rng.integers(0, 2, n), rng.integers(0, 3, n).astype(np.uint64), rng.permutation(200)[:n]
        first, step, count = D.progressions(owner, h, place)
        back = sorted((int(owner[f]), int(h[f]), int(place[f] + k * s)) for f, s, c in zip(first, step, count, strict=True) for k in range(c))
        assert back == sorted(zip(owner.tolist(), h.tolist(), place.tolist(), strict=True))


def test_long_repetitions(spark):
    docs = spark.createDataFrame([(1, "w " * 20000), (2, "a b c " * 5000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "w " * 5000), (8, "a b " * 2000), (9, "b c a " * 1000)], "item_id long, text string")
    assert {r["doc_id"]: (r["item_ids"], r["n_same"]) for r in D.judge(docs, items).collect()} == {1: ([7], 5000), 2: ([9], 3000)}
