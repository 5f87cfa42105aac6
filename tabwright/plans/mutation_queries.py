"""Verdicts before and after a mutation of each axis, over the relational test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.verdict import verdict
from tabwright.operators import mutations as U
from tabwright.operators import templates as T
from tabwright.plans.template_queries import Tables


def _counts(t: Tables) -> DataFrame:
    """(k, v): number of customers of each nation."""
    return t.customer().groupBy(F.col("n").alias("k")).agg(F.count(F.lit(1)).alias("v"))


def _statements(table: DataFrame) -> DataFrame:
    return table.select(F.col("k").cast("string").alias("subject"), F.col("k").alias("entity"), F.col("v").alias("stated"))


def _claimed(table: DataFrame) -> DataFrame:
    """Statements that give each nation the value of another one: true only where the two happen to agree."""
    other = table.select(F.col("k").alias("_k"), F.col("v").alias("stated"))
    named = table.select(F.col("k").cast("string").alias("subject"), F.col("k").alias("entity"))
    return named.join(other, F.col("_k") == (F.col("entity") * 7 + 3) % 25, "left").drop("_k")


def _next(t: Tables) -> DataFrame:
    """The entity that stands for another one: the nation of the next key, the first after the last."""
    return t.nation().select("k", F.pmod(F.col("k") + 1, F.lit(25)).alias("other"))


def _both(before: DataFrame, after: DataFrame, table: DataFrame) -> DataFrame:
    a, b = U.judged(before, table, "holds"), U.judged(after, table, "changed")
    joined = a.select("subject", "holds").join(b.select("subject", "changed"), "subject")
    return joined.select("subject", verdict(F.col("holds")).alias("verdict"), verdict(F.col("changed")).alias("mutated"))


def mut_number(spark, sf_dir):
    table = _counts(Tables(spark, sf_dir))
    return _both(_claimed(table), U.number(_claimed(table)), table)


def mut_rank(spark, sf_dir):
    ranks = T.ranked(_counts(Tables(spark, sf_dir))).select("k", F.col("rank").alias("v"))
    return _both(_claimed(ranks), U.rank(_claimed(ranks)), ranks)


def mut_entity(spark, sf_dir):
    t = Tables(spark, sf_dir)
    table = _counts(t)
    return _both(_statements(table), U.entity(_statements(table), _next(t)), table)


def mut_entity_or_value(spark, sf_dir):
    t = Tables(spark, sf_dir)
    table = _counts(t)
    return _both(_statements(table), U.entity_or_value(_statements(table), _next(t), F.col("entity") % 2 == 1), table)


def mut_bridge_entity(spark, sf_dir):
    """The balance of the region that a nation lies in; the mutated statement follows another nation's bridge."""
    t = Tables(spark, sf_dir)
    links, table = t.nation().select("k", F.col("r").alias("to")), t.region_balance()
    bridged = T.bridge(t.nation().select(F.col("k").cast("string").alias("subject"), F.col("k").alias("entity")), links, "entity", "to")
    true = T.value_of(bridged, table, "to", "stated")
    before = true.select("subject", F.col("to").alias("entity"), "stated")
    return _both(before, U.bridge_entity(true.select("subject", "entity", "stated"), links, _next(t)), table)


def mut_direction(spark, sf_dir):
    t = Tables(spark, sf_dir)
    now = t.nation_year().join(t.nation_year().select(F.col("k").alias("_k"), (F.col("y") + 1).alias("_y"), F.col("v").alias("x")), (F.col("k") == F.col("_k")) & (F.col("y") == F.col("_y")))
    holds = F.col("v") > F.col("x")
    return now.select(F.concat_ws("/", "k", "y").alias("subject"), verdict(holds).alias("verdict"), verdict(U.direction(holds)).alias("mutated"))


def mut_not_established(spark, sf_dir):
    changed = U.not_established(Tables(spark, sf_dir).supplier(), "n", 500000)
    return changed.select("subject", verdict(F.col("holds")).alias("verdict"), verdict(F.col("mutated")).alias("mutated"))


def mut_absent_metric(spark, sf_dir):
    table = _counts(Tables(spark, sf_dir))
    return _both(_claimed(table), U.absent_metric(_claimed(table)), table)


def mut_absent_entity(spark, sf_dir):
    table = _counts(Tables(spark, sf_dir))
    return _both(_claimed(table), U.absent_entity(_claimed(table), F.col("entity") + 20), table)


QUERIES = {f.__name__: f for f in (
    mut_number, mut_rank, mut_entity, mut_entity_or_value, mut_bridge_entity, mut_direction, mut_not_established, mut_absent_metric, mut_absent_entity,
)}

_COUNTS = "WITH c AS (SELECT c_nationkey AS k, count(*) AS v FROM customer GROUP BY 1)"
_VERDICT = "CASE WHEN {0} IS NULL THEN 'NEI' WHEN {0} THEN 'SUPPORTS' ELSE 'REFUTES' END AS {1}"
_CLAIMED = "c LEFT JOIN c o ON o.k = (c.k * 7 + 3) % 25"
_OTHER = "c LEFT JOIN c o ON o.k = (c.k + 1) % 25"
ORACLES = {
    "mut_number": f"{_COUNTS} SELECT CAST(c.k AS VARCHAR) AS subject, {_VERDICT.format('(c.v = o.v)', 'verdict')}, {_VERDICT.format('(c.v = o.v + 1)', 'mutated')} FROM {_CLAIMED}",
    "mut_rank": f"{_COUNTS}, r AS (SELECT k, row_number() OVER (ORDER BY v DESC, k) AS v FROM c) SELECT CAST(c.k AS VARCHAR) AS subject, {_VERDICT.format('(c.v = o.v)', 'verdict')}, {_VERDICT.format('(c.v = o.v + 1)', 'mutated')} FROM r c LEFT JOIN r o ON o.k = (c.k * 7 + 3) % 25",
    "mut_entity": f"{_COUNTS} SELECT CAST(c.k AS VARCHAR) AS subject, 'SUPPORTS' AS verdict, {_VERDICT.format('(o.v = c.v)', 'mutated')} FROM {_OTHER}",
    "mut_entity_or_value": f"{_COUNTS} SELECT CAST(c.k AS VARCHAR) AS subject, 'SUPPORTS' AS verdict, CASE WHEN c.k % 2 = 0 THEN 'REFUTES' WHEN o.v IS NULL THEN 'NEI' WHEN o.v = c.v THEN 'SUPPORTS' ELSE 'REFUTES' END AS mutated FROM {_OTHER}",
    "mut_bridge_entity": f"""WITH b AS (SELECT n_regionkey AS r, sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT CAST(x.n_nationkey AS VARCHAR) AS subject, {_VERDICT.format('(bx.v = bx.v)', 'verdict')}, {_VERDICT.format('(bx.v = bo.v)', 'mutated')}
FROM nation x JOIN nation o ON o.n_nationkey = (x.n_nationkey + 1) % 25 LEFT JOIN b bx ON bx.r = x.n_regionkey LEFT JOIN b bo ON bo.r = o.n_regionkey""",
    "mut_direction": f"""WITH y AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT a.k || '/' || a.y AS subject, {_VERDICT.format('(a.v > b.v)', 'verdict')}, {_VERDICT.format('(NOT a.v > b.v)', 'mutated')} FROM y a JOIN y b ON a.k = b.k AND a.y = b.y + 1""",
    "mut_not_established": f"""WITH s AS (SELECT s_nationkey AS k, count(*) FILTER (CAST(round(s_acctbal * 100) AS BIGINT) > 500000) AS n FROM supplier GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS subject, {_VERDICT.format('(n >= 1)', 'verdict')}, {_VERDICT.format('(n = 1)', 'mutated')} FROM s""",
    "mut_absent_metric": f"{_COUNTS} SELECT CAST(c.k AS VARCHAR) AS subject, {_VERDICT.format('(c.v = o.v)', 'verdict')}, {_VERDICT.format('(c.v = CAST(NULL AS BIGINT))', 'mutated')} FROM {_CLAIMED}",
    "mut_absent_entity": f"{_COUNTS} SELECT CAST(c.k AS VARCHAR) AS subject, {_VERDICT.format('(c.v = o.v)', 'verdict')}, {_VERDICT.format('(n.v = o.v)', 'mutated')} FROM {_CLAIMED} LEFT JOIN c n ON n.k = c.k + 20",
}
