"""A corpus pipeline: each stage is one operator over all that the stage before it has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet into the shared folder and reads it again,
so a lost executor costs the tasks of one stage only.

A stage's result has to be written before the next stage is called on the same folder in the same thread: that call drops
the intermediate tables of the stages before it, and no others.

Defined results, of every stage: null and empty texts fail the quality rules (too few words), so later
stages meet them only when called by themselves: they have no near-duplicates, share no passage, are not
taken into the mix, and are a lone end id in the token data. Rows of null or equal ids are told apart by
their texts; of rows equal in both, near-duplicates keeps one, and the other stages treat each. Ties go
to the least id. Extra columns stay, whatever their names, up to the last stage. Empty tables give empty
results.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import decontaminate, mixing, neardup, quality_rules, token_binary
from tabwright.llm.common import Scratch

_open: dict[tuple[str, str, int], list[tuple[int, Scratch]]] = {}


def _scope(spark: SparkSession, sf_dir: str, stage: int) -> Scratch:
    """A scope for a stage; those of earlier stages on the folder end: their results have been written."""
    key = (spark.sparkContext.applicationId, sf_dir, threading.get_ident())
    for n, scratch in (held := _open.get(key, [])):
        if n < stage:
            scratch.drop()
    fresh = Scratch(spark)
    _open[key] = [x for x in held if x[0] >= stage] + [(stage, fresh)]
    return fresh


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more)."""
    return neardup.keep_one(docs, k=5, percent=80, scratch=_scope(spark, sf_dir, 1))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    scratch = _scope(spark, sf_dir, 2)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), scratch=scratch)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a source below its target repeats documents, one above it loses blocks."""
    return mixing.mixed_documents(docs, scratch=_scope(spark, sf_dir, 3))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token data set, as read back: a row for each document of the mix."""
    return token_binary.encode_and_read(docs, scratch=_scope(spark, sf_dir, 4))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminated),
    ("source mix", mix),
    ("token binary", tokens),
]

#: MinHash candidates, keyed permutations and byte-pair encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what they write between each other goes once the last one has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as between:
        for name, stage in STAGES[:-1]:
            docs = between.table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        return STAGES[-1][1](spark, docs, sf_dir)
