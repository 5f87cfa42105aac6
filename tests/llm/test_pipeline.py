"""The pipeline's stages by brute force on the smallest tables."""

import os

import pytest

import corpus_pipeline as CP
from tabwright.llm import mixing, quality_rules, queries
from tabwright.llm.common import Scratch

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in CP.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != CP.STAGES[-1][0]:
            assert docs.columns == columns
    good, single, clean, mixed, final = kept.values()
    raw = spark.read.parquet(f"{DIR}/documents.parquet")
    assert {r.doc_id for r in good} == {r.doc_id for r in quality_rules.judge(raw).filter("_q_kept").collect()}

    def words(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, label = {r.doc_id: words(r.text) for r in good}, {r.doc_id: r.doc_id for r in good}
    for _ in range(4):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id for r in single} == {d for d, c in label.items() if d == c}
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in single if any(f" {b} " in f" {' '.join(r.text.lower().split())} " for b in bench)}
    assert leaks.isdisjoint({r.doc_id for r in clean})
    assert len(single) - len(clean) <= len(leaks) + 3
    sizes = {r.doc_id: len(r.text.split()) for r in clean}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= mixing.MAX_PASSES * sizes[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 20 * mixing.BLOCK_WORDS
    assert len(final) == len(mixed)
    assert sum(r.n_tokens for r in final) == max(r.start + r.n_tokens for r in final)


def test_run_repeats_and_leaves_other_results_alone(spark):
    key = lambda df: sorted(map(tuple, df.collect()))
    lazy, other = queries.op4_lsh_forest(spark, DIR), Scratch(spark).table(spark.range(3), "other")
    first = CP.run(spark, DIR)
    second = CP.run(spark, DIR)
    assert key(first) == key(second)
    assert lazy.count() == spark.read.parquet(f"{DIR}/documents.parquet").count() and other.count() == 3


def test_stages_on_awkward_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, `_row` string, `_id` string"
    long = " ".join(f"word{i} the of and to" for i in range(300))
    spark.createDataFrame([(1, " ".join(f"word{i} the of and to" for i in range(8))), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, long, "en", "a", 1, "p", "q"), (2, long, None, None, None, None, None), (None, long, "en", "a", 1, "r", "s"), (3, None, "en", "a", 0, "t", "u"), (4, "", None, "b", 0, "v", "w"), (1, long, "en", "a", 1, "p", "q")]
    for data in ([], rows):
        df = spark.createDataFrame(data, schema)
        for name, stage in CP.STAGES:
            out = stage(spark, df, str(tmp_path)).collect()
            assert data or out == [], name
            if data:
                want = {"quality rules": 4, "near-duplicates": 3, "decontamination": 2, "token binary": 6}.get(name)
                assert want is None or len(out) == want, name
                assert name != "source mix" or {r.text for r in out} and all(r.text in long for r in out)
