"""Runs of repeated words against brute force, on random, periodic and awkward texts."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from tabwright.llm import queries, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIR = "/root/testdata/sf0.001"


def brute(x, least=12):
    """Every maximal stretch of each period, shortest periods first; a stretch within one of a divisor of its period is none."""
    found = []
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            n = j - i + p
            if j > i and n >= 2 * p and not any(p % q == 0 and a <= i and i + n <= a + m for a, m, q in found):
                found.append((i, n, p))
            i = j + 1
    return sorted((x for x in found if x[1] >= max(least, 2 * x[2])), key=lambda r: (r[0], r[2]))


def expected(key, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    lost = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in lost)),
    )


def sample(rnd):
    n, k = rnd.choice([2, 5, 13, 40, 80]), rnd.choice([1, 2, 3, 6])
    x = [rnd.randrange(k) for _ in range(n)]
    if rnd.random() < 0.5:
        x = x[: n // 4] + (x[: max(1, n // rnd.choice([2, 3, 5]))] * 10)[:n]
        if rnd.random() < 0.3:
            x[rnd.randrange(len(x))] = 9
    return x


def test_runs_of_an_array():
    rnd = random.Random(3)
    for _ in range(800):
        x = sample(rnd)
        found = sorted(zip(*(a.tolist() for a in repeats.runs_of(np.array(x))), strict=True), key=lambda r: (r[0], r[2]))
        assert found == brute(x, 0), x


def test_runs_of_several_texts():
    rnd = random.Random(4)
    for _ in range(200):
        texts = [[b"%d" % w for w in sample(rnd)] for _ in range(3)]
        hashes = np.array([hash(w) & (2**63 - 1) for t in texts for w in t], np.uint64)
        r = repeats.find_runs(texts, hashes)
        assert list(zip(*(a.tolist() for a in r), strict=True)) == [(i, *run) for i, t in enumerate(texts) for run in brute(t)]


def test_long_repetitive_arrays_are_quick():
    for x, many in ((np.zeros(300_000, int), 1), (np.tile(np.arange(50_000), 6), 1)):
        start, length, _ = repeats.runs_of(x)
        assert len(start) == many and length[0] == len(x)


SCHEMA = "doc_id long, text string, n_runs int, `text_` string, start string"


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE_BYTES", 2000)
    rnd = random.Random(5)
    texts = [None, "", " \n", "one", "a " * 40, "  x y " * 20, "x\x85y \x1c z " * 12, *(" ".join(f"w{v}" for v in sample(rnd)) for _ in range(150))]
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)]
    rows += [(None, "b c " * 9, None, None, None), (None, None, None, None, None), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, repeats.digests(docs).collect()), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)
    whole = {r["doc_id"]: r for r in repeats.find(docs).collect()}
    assert [tuple(r) for r in whole[4]["runs"]] == [(0, 40, 1)] and whole[4]["collapsed"] == "a"
    assert repeats.digests(docs.limit(0)).count() == repeats.find(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    small = {r["doc_id"]: r["text"] for r in docs if len(r["text"] or "") < 6000}
    found = queries.QUERIES["op12_repeat_runs"](spark, DIR).collect()
    assert len(found) == len(docs)
    for r in found:
        if r["doc_id"] in small:
            assert tuple(r) == expected(r["doc_id"], small[r["doc_id"]])
