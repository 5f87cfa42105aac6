"""Action chains of many statements at once over the given tables, each with its SQL.

A statement per customer: ``t0`` holds its orders, ``t1`` the priorities of its orders with the weight that is used for them. The recorded actions
are JSON, as an agent would have left them; some of them cannot be run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.operators import setwise
from tabwright.sources.scratch import steps_of

#: By customer key modulo their number: what is done, and what is answered in the end.
RECORDED = (
    ('{"op":"sort","table":"t0","column":1,"descending":true}', '{"op":"select_rows","table":"s1","rows":[0]}', '{"op":"select_columns","table":"s2","columns":[1,0]}', '{"label":"supports"}'),
    ('{"op":"group_count","table":"t0","column":2}', '{"op":"sort","table":"s1","column":0,"numeric":false,"descending":true}', '{"label":"Refuted"}'),
    ('{"op":"aggregate","table":"t0","column":1,"method":"sum"}', '{"label":"NEI"}'),
    ('{"op":"derive","table":"t0","left":1,"right":0,"method":"ratio"}', '{"op":"aggregate","table":"s1","column":4,"method":"max"}', '{"label":"not enough info"}'),
    ('{"op":"join","table":"t0","other":"t1","left":3,"right":0}', '{"op":"derive","table":"s1","left":1,"right":5,"method":"subtract"}', '{"op":"aggregate","table":"s2","column":6,"method":"min"}', '{"label":"SUPPORTED"}'),
    ('{"op":"aggregate","table":"t0","column":2,"method":"mean"}', '{"label":"SUPPORTS"}'),
    ('{"op":"select_columns","table":"t0","columns":[0]}', '{"op":"group_count","table":"s1","column":0}', '{"op":"aggregate","table":"s2","column":1,"method":"count"}', '{"op":"sort","table":"s3","column":0}', '{"label":"NEI"}'),
    ('{"op":"select_rows","table":"t0","rows":[3,1]}', '{"label":"maybe"}'),
)


def packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, headers and actions of a statement for each customer."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customers = read("customer").select(F.col("c_custkey").alias("claim_id"))
    orders = read("orders").select(F.col("o_custkey").alias("claim_id"), "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderstatus", "o_orderpriority")
    orders = orders.join(customers, "claim_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("claim_id").orderBy("o_orderkey")) - 1
    cells = F.array(*[F.col(c).cast("string") for c in ("o_orderkey", "cents", "o_orderstatus", "o_orderpriority")])
    rows = orders.select("claim_id", F.lit("t0").alias("name"), place.cast("long").alias("row"), cells.alias("cells"))
    weights = orders.select("claim_id", "o_orderpriority").distinct()
    place = F.conv(F.substring("o_orderpriority", 1, 1), 10, 10).cast("long")
    weights = weights.select("claim_id", F.lit("t1").alias("name"), place.alias("row"), F.array(F.concat(F.lit(" "), "o_orderpriority"), (place * 1000).cast("string")).alias("cells"))
    headers = customers.select("claim_id", F.lit("t0").alias("name"), F.array(*map(F.lit, ("order", "cents", "status", "priority"))).alias("headers"))
    headers = headers.unionByName(customers.select("claim_id", F.lit("t1").alias("name"), F.array(F.lit("priority"), F.lit("weight")).alias("headers")))
    recorded = F.array(*[F.array(*map(F.lit, x)) for x in RECORDED])
    actions = customers.select("claim_id", F.get(recorded, F.pmod("claim_id", F.lit(len(RECORDED))).cast("int")).alias("actions"))
    return rows.unionByName(weights), headers, actions


def shown(chains: setwise.Chains) -> DataFrame:
    """Verdicts with the cells of the last table: computed numbers in millionths, rows one after the other."""
    text = F.transform("cells", lambda c: F.when(c["d"].isNull(), c["t"]).otherwise(F.round(c["d"] * 1e6).cast("long").cast("string")))
    last = chains.rows.where("name LIKE 's%'").groupBy("claim_id", "name").agg(F.array_sort(F.collect_list(F.struct("row", F.array_join(text, ",").alias("x")))).alias("rows"))
    last = last.groupBy("claim_id").agg(F.max_by("rows", "name").alias("rows"))
    answered = chains.verdicts.join(last, "claim_id", "left")
    result = F.when(F.col("status") == setwise.FAILED, F.lit(None)).otherwise(F.array_join(F.transform("rows", lambda r: r["x"]), ";"))
    return answered.select("claim_id", "label", "status", "reason", result.alias("result"))


def alg_chains_setwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, headers, actions = packages(spark, sf_dir)
    return shown(setwise.run_chains(rows, headers, actions, steps_of(spark, "alg_chains_setwise")))


SETWISE_SQL = """
WITH o AS (
  SELECT o_custkey AS c, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderstatus AS s, o_orderpriority AS p,
    CAST(substr(o_orderpriority, 1, 1) AS BIGINT) * 1000 AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders
), g AS (
  SELECT c, s, count(*) AS n FROM o GROUP BY c, s
), a AS (
  SELECT c, count(*) AS n, arg_max(v || ',' || k, struct_pack(v := v, i := -i)) AS top, sum(v) AS total, min(v - w) AS least, max(CAST(v AS DOUBLE) / nullif(k, 0)) AS ratio,
    count(*) FILTER (k = 0) AS zero, max(CASE WHEN i = 3 THEN k || ',' || v || ',' || s || ',' || p END) AS third, max(CASE WHEN i = 1 THEN k || ',' || v || ',' || s || ',' || p END) AS first
  FROM o GROUP BY c
), b AS (
  SELECT c, string_agg(s || ',' || n * 1000000, ';' ORDER BY s DESC) AS groups FROM g GROUP BY c
), x AS (
  SELECT c_custkey AS claim_id, c_custkey % 8 AS kind, coalesce(n, 0) AS n, top, total, least, ratio, zero, third, first, groups
  FROM customer LEFT JOIN a ON a.c = c_custkey LEFT JOIN b ON b.c = c_custkey
), y AS (
  SELECT *, CASE
    WHEN kind = 0 AND n = 0 THEN 'invalid_row_selection' WHEN kind IN (2, 3, 4, 6) AND n = 0 THEN 'empty_aggregate' WHEN kind = 5 AND n = 0 THEN 'empty_aggregate'
    WHEN kind = 3 AND zero > 0 THEN 'division_by_zero' WHEN kind = 5 THEN 'not_a_scalar_number' WHEN kind = 7 AND n < 4 THEN 'invalid_row_selection' END AS reason FROM x
)
SELECT claim_id, CASE WHEN reason IS NOT NULL OR kind IN (6, 7) THEN 'INVALID' WHEN kind IN (0, 4) THEN 'SUPPORTS' WHEN kind = 1 THEN 'REFUTES' ELSE 'NEI' END AS label,
  CASE WHEN reason IS NOT NULL THEN 'invalid_table_operation' WHEN kind = 6 THEN 'no_final_label' WHEN kind = 7 THEN 'invalid_label' ELSE 'answered' END AS status, reason,
  CASE WHEN reason IS NULL THEN CASE kind WHEN 0 THEN top WHEN 1 THEN groups WHEN 2 THEN CAST(total * 1000000 AS VARCHAR) WHEN 3 THEN CAST(CAST(round(ratio * 1000000) AS BIGINT) AS VARCHAR)
    WHEN 4 THEN CAST(least * 1000000 AS VARCHAR) WHEN 6 THEN CAST(n * 1000000 AS VARCHAR) WHEN 7 THEN third || ';' || first END END AS result
FROM y
"""

QUERIES = {"alg_chains_setwise": alg_chains_setwise}
ORACLES = {"alg_chains_setwise": SETWISE_SQL}
