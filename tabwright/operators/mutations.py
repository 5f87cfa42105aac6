"""Mutations of statements: each axis changes one part of a true statement, so that it no longer holds or
can no longer be decided.

A statement is a row (subject, entity, stated, ...); a *table* is (k, v). ``judged`` looks the entity up and
compares what is stated with what the table holds: null where the table does not tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.operators import templates as T


def judged(statements: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Add whether the stated value is the entity's, as column ``name``."""
    found = T.value_of(statements, table, "entity", "_v")
    return found.withColumn(name, F.col("_v") == F.col("stated")).drop("_v")


def number(statements: DataFrame, by: int = 1) -> DataFrame:
    """REFUTES by number: another value is stated."""
    return statements.withColumn("stated", F.col("stated") + by)


def rank(statements: DataFrame) -> DataFrame:
    """REFUTES by rank: the next rank is stated."""
    return number(statements, 1)


def direction(holds: Column) -> Column:
    """REFUTES by direction: a rise is stated as a fall, and the other way round."""
    return ~holds


def entity(statements: DataFrame, others: DataFrame) -> DataFrame:
    """REFUTES by entity: the statement is made about another one; others: (k, other)."""
    swapped = statements.join(others.select(F.col("k").alias("_k"), "other"), F.col("entity") == F.col("_k"), "left")
    return swapped.withColumn("entity", F.col("other")).drop("_k", "other")


def entity_or_value(statements: DataFrame, others: DataFrame, odd: Column) -> DataFrame:
    """REFUTES by entity or value: half of the statements get another entity, the rest another value."""
    return entity(statements.filter(odd), others).unionByName(number(statements.filter(~odd)))


def bridge_entity(statements: DataFrame, links: DataFrame, others: DataFrame) -> DataFrame:
    """REFUTES by bridge: the attribute that leads to the other table is another entity's."""
    return T.bridge(entity(statements, others), links, "entity", "to").drop("entity").withColumnRenamed("to", "entity")


def not_established(rows: DataFrame, by: str, limit: float) -> DataFrame:
    """REFUTES as not established: some entity does exceed the limit, but the statement says that one alone does."""
    over = F.count_if(F.col("v") > limit)
    return rows.groupBy(F.col(by).cast("string").alias("subject")).agg((over >= 1).alias("holds"), (over == 1).alias("mutated"))


def absent_metric(statements: DataFrame) -> DataFrame:
    """NEI by metric: what is stated is of a column that no table has."""
    return statements.withColumn("stated", F.lit(None).cast(dict(statements.dtypes)["stated"]))


def absent_entity(statements: DataFrame, mark: Column) -> DataFrame:
    """NEI by entity: the statement is about one that no table has."""
    return statements.withColumn("entity", mark)
