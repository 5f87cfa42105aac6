"""Query templates from a few primitives: lookups, bridges, arithmetic, ranking and quantifiers.

A *measure* is a DataFrame (k, v): an entity and its value; a *map* is (k, to): an entity and the key of
another table that an attribute of it names. A template yields either (subject, value) or (subject, holds);
a null means that the tables do not tell, whatever was missing. All are set-wise over many subjects: a
lookup is a left join, a bridge is another one, and Catalyst picks how each is run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that are ranked on their own.
RANK_PARTS = 64


def value_of(pairs: DataFrame, measure: DataFrame, by: str, out: str) -> DataFrame:
    """Add the value of the entity in column ``by``: null where the measure lacks it or has it twice."""
    single = measure.groupBy("k").agg(F.first("v").alias(out), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    return pairs.join(single.select(F.col("k").alias("_k"), out), F.col(by) == F.col("_k"), "left").drop("_k")


def bridge(pairs: DataFrame, links: DataFrame, by: str, out: str) -> DataFrame:
    """Follow an attribute: the key in another table that the entity in column ``by`` names."""
    return pairs.join(links.select(F.col("k").alias("_k"), F.col("to").alias(out)), F.col(by) == F.col("_k"), "left").drop("_k")


def combine(pairs: DataFrame, how: str, *values: str, places: int | None = None) -> DataFrame:
    """subject and value: diff, sum, mean, ratio or pct of value columns, rounded half up."""
    v = [F.col(x).cast("double") for x in values]
    if how == "diff":
        out = v[0] - v[1]
    elif how == "sum":
        out = sum(v[1:], v[0])
    elif how == "mean":
        out = sum(v[1:], v[0]) / len(v)
    elif how == "ratio":
        out = F.try_divide(v[0], v[1])
    elif how == "pct":
        out = F.try_divide(100 * (v[0] - v[1]), v[1])
    else:
        raise ValueError(how)
    return pairs.select("subject", (F.round(out, places) if places is not None else out).alias("value"))


def compare(pairs: DataFrame, left: str, right: str) -> DataFrame:
    return pairs.select("subject", (F.col(left) > F.col(right)).alias("holds"))


AGGREGATES = {
    "sum": lambda v: F.sum(v).cast("double"),
    "avg": lambda v: F.round(F.sum(v) / F.count(v), 2),
    "max": lambda v: F.max(v).cast("double"),
    "min": lambda v: F.min(v).cast("double"),
    "count": lambda v: F.count(F.lit(1)).cast("double"),
}


def grouped(rows: DataFrame, by: str, how: str) -> DataFrame:
    """subject and value of an aggregate of ``v`` in each group."""
    return rows.groupBy(F.col(by).cast("string").alias("subject")).agg(AGGREGATES[how](F.col("v")).alias("value"))


def count_above(rows: DataFrame, by: str, limit: float) -> DataFrame:
    return rows.groupBy(F.col(by).cast("string").alias("subject")).agg(F.count_if(F.col("v") > limit).cast("double").alias("value"))


def arg_extreme(rows: DataFrame, by: str, what: str = "k", least: bool = False) -> DataFrame:
    """subject and value: the entity (or an attribute of it) with the extreme ``v``; ties to the least key."""
    order = F.struct(F.col("v") if least else -F.col("v"), F.col("k"))
    return rows.groupBy(F.col(by).cast("string").alias("subject")).agg(F.min_by(what, order).alias("value"))


def superlative(rows: DataFrame, by: str) -> DataFrame:
    """holds: the entity of the least key alone has the group's greatest value."""
    top = F.max("v")
    agg = rows.groupBy(F.col(by).cast("string").alias("subject")).agg(F.min_by("v", "k").alias("own"), top.alias("top"), F.max_by("v", F.struct("v", "k")).alias("_t"))
    tied = rows.join(agg.select(F.col("subject").alias("_s"), "top"), F.col(by).cast("string") == F.col("_s")).filter("v = top").groupBy("_s").count()
    return agg.join(tied, agg["subject"] == tied["_s"]).select("subject", ((F.col("own") == F.col("top")) & (F.col("count") == 1)).alias("holds"))


def ranked(measure: DataFrame) -> DataFrame:
    """Add ``rank``, by falling value and then by key.

    A rank over all rows must not gather them in one task: they are cut at quantiles of the value (a list of
    fixed length, found beforehand), numbered within each part, and moved on by the rows of the parts before.
    """
    shares = [i / RANK_PARTS for i in range(1, RANK_PARTS)]
    edges = sorted(set(measure.agg(F.percentile_approx("v", shares, 10 * RANK_PARTS)).first()[0] or []))
    part = F.lit(0)
    if edges:
        part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: F.coalesce(F.col("v") < e, F.lit(True))))
    rows = measure.withColumn("_part", part)
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # RANK_PARTS rows at most
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_part").orderBy(F.col("v").desc(), F.col("k").asc())
    return rows.join(F.broadcast(counts), "_part").withColumn("rank", F.col("_before") + F.row_number().over(own)).drop("_part", "_before")


def nth(measure: DataFrame, within: str | None = None) -> DataFrame:
    """subject (rank, or group and rank) and value: the entity at each rank by falling value."""
    if within:
        rank = F.row_number().over(Window.partitionBy(within).orderBy(F.col("v").desc(), F.col("k").asc())).cast("string")
        return measure.select(F.concat_ws("/", F.col(within).cast("string"), rank).alias("subject"), F.col("k").cast("double").alias("value"))
    return ranked(measure).select(F.col("rank").cast("string").alias("subject"), F.col("k").cast("double").alias("value"))


def only_one(rows: DataFrame, by: str, limit: float) -> DataFrame:
    return rows.groupBy(F.col(by).cast("string").alias("subject")).agg((F.count_if(F.col("v") > limit) == 1).alias("holds"))


def only_first(rows: DataFrame, by: str, limit: float) -> DataFrame:
    """holds: the entity of the least key exceeds the limit and no other does."""
    one = F.count_if(F.col("v") > limit) == 1
    return rows.groupBy(F.col(by).cast("string").alias("subject")).agg((one & (F.min_by("v", "k") > limit)).alias("holds"))


def all_hold(rows: DataFrame, by: str, holds: Column) -> DataFrame:
    """holds: no row breaks the condition; unknown if some row does not tell."""
    agg = F.when(F.count_if(~holds) > 0, False).when(F.count_if(holds.isNull()) > 0, F.lit(None)).otherwise(True)
    return rows.groupBy(F.col(by).cast("string").alias("subject")).agg(agg.alias("holds"))
