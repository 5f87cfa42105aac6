"""Table algebra, scoring and SQL-surface queries over the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import algebra as A
from tabwright.operators import metrics as M
from tabwright.operators import sqlsurface as S


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark, sf_dir) -> DataFrame:
    """A positional table; part keys are dense, so a position needs no global ordering."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("_row"), "p_name", "p_brand", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"), F.col("p_size").cast("long").alias("size"))


def alg_select_rows(spark, sf_dir):
    return A.select_rows(parts(spark, sf_dir), [7, 3, 5])


def alg_select_columns(spark, sf_dir):
    return A.select_columns(parts(spark, sf_dir), [3, 0])


def alg_sort_numeric_desc_stable(spark, sf_dir):
    return A.sort(A.select_columns(parts(spark, sf_dir), [3, 0]), 0, numeric=True, descending=True)


def alg_sort_text(spark, sf_dir):
    return A.sort(A.select_columns(parts(spark, sf_dir), [1]), 0, numeric=False)


def alg_group_count(spark, sf_dir):
    return A.group_count(parts(spark, sf_dir), 1)


def _aggregate(method):
    def run(spark, sf_dir):
        return A.aggregate(parts(spark, sf_dir), 2, method).withColumnRenamed(f"{method}(cents)", "value")

    return run


def _derive(method):
    def run(spark, sf_dir):
        return A.derive(A.select_columns(parts(spark, sf_dir), [2, 3]), 0, 1, method).withColumnRenamed(f"{method}(cents,size)", "value")

    return run


def _suppliers(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("_row"), "s_name", F.concat(F.lit(" "), F.col("s_nationkey").cast("string")).alias("nation"))


def _nations(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("_row"), F.concat(F.col("n_nationkey").cast("string"), F.lit("  ")).alias("key"), "n_name")


def alg_join(spark, sf_dir):
    joined = A.join(_suppliers(spark, sf_dir), _nations(spark, sf_dir), 1, 0, limit=None)
    return joined.select("_l", "_r", F.col("`left.s_name`").alias("s_name"), F.col("`right.n_name`").alias("n_name"))


def alg_chain_3step(spark, sf_dir):
    tables = {"t0": parts(spark, sf_dir)}
    actions = [
        {"op": "derive", "table": "t0", "left": 2, "right": 3, "method": "ratio"},
        {"op": "select_columns", "table": "s1", "columns": [1, 4]},
        {"op": "aggregate", "table": "s2", "column": 1, "method": "max"},
    ]
    label, status, known = A.run_chain(tables, [*actions, {"label": "supports"}])
    return known["s3"].select(F.round("max(ratio(cents,size))", 6).alias("value"), F.lit(label).alias("label"), F.lit(status).alias("status"))


_PARTS = "WITH p AS (SELECT p_partkey AS _row, p_name, p_brand, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, CAST(p_size AS BIGINT) AS size FROM part)"

# ------------------------------------------------------------------------------- scoring


def pairs(spark, sf_dir) -> DataFrame:
    """Gold and predicted labels made from the two labels of documents, with group columns."""
    gold = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "SUPPORTS").when(F.col("doc_id") % 3 == 0, "NEI").otherwise("REFUTES").alias("label"))
    said = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 7 == 0, "NEI").when(F.col("toxic") == 1, "REFUTES").otherwise("SUPPORTS")
    pred = read(spark, sf_dir, "labels").filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), said.alias("label"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return M.pair(gold.join(docs, "id"), pred)


_PAIRS = """
WITH pairs AS (SELECT l.doc_id AS id, lang, source, CASE WHEN quality = 1 THEN 'SUPPORTS' WHEN l.doc_id % 3 = 0 THEN 'NEI' ELSE 'REFUTES' END AS gold,
  CASE WHEN l.doc_id % 13 = 0 OR l.doc_id % 11 = 0 THEN 'INVALID' WHEN l.doc_id % 7 = 0 THEN 'NEI' WHEN toxic = 1 THEN 'REFUTES' ELSE 'SUPPORTS' END AS pred
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def _f1(label: str) -> str:
    c = f"count(*) FILTER (gold = '{label}' AND pred = '{label}')"
    both = f"(count(*) FILTER (gold = '{label}') + count(*) FILTER (pred = '{label}'))"
    return f"(CASE WHEN {c} > 0 THEN 2.0::DOUBLE * {c} / {both} ELSE 0 END)"


_F1 = {x: _f1(x) for x in ("SUPPORTS", "REFUTES", "NEI")}
_PRESENT = "(" + " + ".join(f"CASE WHEN count(*) FILTER (gold = '{x}') > 0 THEN {f} ELSE 0 END" for x, f in _F1.items()) + ") / count(DISTINCT gold)"


def m_confusion(spark, sf_dir):
    return M.confusion(pairs(spark, sf_dir))


def m_accuracy_f1(spark, sf_dir):
    s = M.scores(pairs(spark, sf_dir))
    return s.select("n", "invalid", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "f1_supports", "f1_refutes", "f1_nei")])


def m_present_macro_f1(spark, sf_dir):
    return M.scores(pairs(spark, sf_dir).filter("gold <> 'NEI'")).select(F.round("present_macro_f1", 9).alias("present_macro_f1"))


def m_by_group(spark, sf_dir):
    g = M.grouped_scores(pairs(spark, sf_dir), ["lang", "source"])
    return g.select("field", "value", "n", F.round("accuracy", 9).alias("accuracy"), F.round("present_macro_f1", 9).alias("present_macro_f1"))


def m_status_counts(spark, sf_dir):
    return M.status_counts(read(spark, sf_dir, "conversations").withColumnRenamed("role", "status"))


def m_last_prediction_wins(spark, sf_dir):
    lines = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("label"), F.col("turn").alias("line_no"))
    return M.last_prediction(lines)


def m_bootstrap_ci(spark, sf_dir):
    return M.bootstrap_intervals(pairs(spark, sf_dir), n=REPLICATES)


def m_bootstrap_by_group(spark, sf_dir):
    return M.bootstrap_intervals(pairs(spark, sf_dir), "lang", n=REPLICATES)


REPLICATES = 200


def _bootstrap_sql(group: str) -> str:
    drawn = " + ".join(f"CAST(u >= {x!r} AS INT)" for x in M.DRAWN)
    f1 = " + ".join(f"coalesce(2.0::DOUBLE * sum(w) FILTER (gold = '{x}' AND pred = '{x}') / nullif(coalesce(sum(w) FILTER (gold = '{x}'), 0) + coalesce(sum(w) FILTER (pred = '{x}'), 0), 0), 0)" for x in ("SUPPORTS", "REFUTES", "NEI"))
    ends = ", ".join(f"round(100 * list_sort(list({x}))[1 + greatest(0, CAST(floor({share} * count(*)) AS INT) - {less})], 1) AS {x}_{end}" for x in ("accuracy", "macro_f1") for end, share, less in (("low", 0.025, 0), ("high", 0.975, 1)))
    return f"""{_PAIRS.rstrip()},
x AS (SELECT {group} AS grp, gold, pred, b * 4 + j AS rep, CAST(CAST('0x' || substr(md5(b || ':' || id), CAST(j * 8 + 1 AS BIGINT), 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM pairs, range({(REPLICATES - 1) // 4 + 1}) AS r(b), range(4) AS s(j)),
y AS (SELECT grp, rep, gold, pred, {drawn} AS w FROM x WHERE rep < {REPLICATES}),
z AS (SELECT grp, rep, CAST(coalesce(sum(w) FILTER (gold = pred), 0) AS DOUBLE) / sum(w) AS accuracy, ({f1}) / 3 AS macro_f1 FROM y WHERE w > 0 GROUP BY 1, 2)
SELECT grp AS "group", {ends} FROM z GROUP BY 1"""


# ------------------------------------------------------------------------------- SQL surface


def _guarded(sql: str):
    def run(spark, sf_dir):
        for name in ("region", "nation", "supplier", "customer", "orders", "part"):
            read(spark, sf_dir, name).createOrReplaceTempView(name)
        if why := S.guard(spark, sql):
            raise ValueError(why)
        return spark.sql(sql)

    return run


_RECURSIVE = "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t"
_RANK = "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS before FROM supplier"
_SETS = "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1"
_SEMI = "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990)"
_CORRELATED = "SELECT s_suppkey FROM supplier s WHERE s_acctbal > (SELECT avg(x.s_acctbal) FROM supplier x WHERE x.s_nationkey = s.s_nationkey)"
_BARE = "SELECT s_nationkey, max_by(s_name, s_acctbal) AS s_name, max(s_acctbal) AS top FROM supplier GROUP BY s_nationkey"
_HAVING = "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS kinds FROM part GROUP BY p_brand HAVING count(*) > 1"
_LIMIT = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5"
_CASE = "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 100 THEN 'low' WHEN c_mktsegment LIKE 'B%' THEN 'b' ELSE upper(substr(c_name, 1, 3)) END AS tag FROM customer WHERE c_nationkey IN (1, 2, 3) OR c_mktsegment ILIKE 'mach%'"
_THETA = "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"


def sql_read_only_guard(spark, sf_dir):
    tried = ["SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "DROP TABLE x", "select replace('a','b','c')", "INSERT INTO t SELECT 1", "", "EXPLAIN SELECT 1", "SELECT (1"]
    return spark.createDataFrame([(q, (S.guard(spark, q) or "ok").split(":")[0]) for q in tried], "q string, result string")


GUARD_SQL = """SELECT * FROM (VALUES ('SELECT 1', 'ok'), ('WITH a AS (SELECT 1) SELECT * FROM a', 'ok'), ('DROP TABLE x', 'not_read_only_select'),
 ('select replace(''a'',''b'',''c'')', 'not_read_only_select'), ('INSERT INTO t SELECT 1', 'not_read_only_select'), ('', 'empty_sql'),
 ('EXPLAIN SELECT 1', 'not_read_only_select'), ('SELECT (1', 'sql_error')) AS t(q, result)"""

QUERIES = {
    **{f.__name__: f for f in (alg_select_rows, alg_select_columns, alg_sort_numeric_desc_stable, alg_sort_text, alg_group_count, alg_join, alg_chain_3step)},
    **{f"alg_agg_{m}": _aggregate(m) for m in A.AGGREGATES},
    **{f"alg_derive_{m}": _derive(m) for m in A.DERIVATIONS},
    **{f.__name__: f for f in (m_confusion, m_accuracy_f1, m_present_macro_f1, m_by_group, m_status_counts, m_last_prediction_wins, m_bootstrap_ci, m_bootstrap_by_group)},
    "sql_recursive_cte": _guarded(_RECURSIVE),
    "sql_window_rank": _guarded(_RANK),
    "sql_set_ops": _guarded(_SETS),
    "sql_semi_anti": _guarded(_SEMI),
    "sql_correlated": _guarded(_CORRELATED),
    "sql_bare_column_max_by": _guarded(_BARE),
    "sql_having_distinct": _guarded(_HAVING),
    "sql_top_k_offset": _guarded(_LIMIT),
    "sql_case_predicates": _guarded(_CASE),
    "sql_theta_self_join": _guarded(_THETA),
    "sql_read_only_guard": sql_read_only_guard,
}

ORACLES = {
    "m_bootstrap_ci": _bootstrap_sql("'all'"),
    "m_bootstrap_by_group": _bootstrap_sql("lang"),
    "alg_select_rows": _PARTS + " SELECT CASE _row WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END::BIGINT AS _row, p_name, p_brand, cents, size FROM p WHERE _row IN (7, 3, 5)",
    "alg_select_columns": _PARTS + " SELECT _row, size, p_name FROM p",
    "alg_sort_numeric_desc_stable": _PARTS + " SELECT row_number() OVER (ORDER BY size DESC, _row) - 1 AS _row, size, p_name FROM p",
    "alg_sort_text": _PARTS + " SELECT row_number() OVER (ORDER BY p_brand, _row) - 1 AS _row, p_brand FROM p",
    "alg_group_count": _PARTS + " SELECT min(_row) AS _row, p_brand, count(*) AS count FROM p GROUP BY p_brand",
    "alg_join": "SELECT s_suppkey AS _l, CAST(n_nationkey AS BIGINT) AS _r, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "alg_chain_3step": _PARTS + " SELECT round(max(cents / CAST(size AS DOUBLE)), 6) AS value, 'SUPPORTS' AS label, 'answered' AS status FROM p",
    **{f"alg_agg_{m}": _PARTS + f" SELECT CAST(0 AS BIGINT) AS _row, CAST({f}(cents) AS DOUBLE) AS value FROM p" for m, f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("count", "count"))},
    "alg_derive_subtract": _PARTS + " SELECT _row, cents, size, CAST(cents - size AS DOUBLE) AS value FROM p",
    "alg_derive_add": _PARTS + " SELECT _row, cents, size, CAST(cents + size AS DOUBLE) AS value FROM p",
    "alg_derive_ratio": _PARTS + " SELECT _row, cents, size, CAST(cents AS DOUBLE) / size AS value FROM p",
    "m_confusion": _PAIRS + " SELECT g AS gold, q AS pred, count(id) AS n FROM (VALUES ('SUPPORTS'), ('REFUTES'), ('NEI')) a(g) CROSS JOIN (VALUES ('SUPPORTS'), ('REFUTES'), ('NEI'), ('INVALID')) b(q) LEFT JOIN pairs ON gold = g AND pred = q GROUP BY 1, 2",
    "m_accuracy_f1": _PAIRS + f" SELECT count(*) AS n, count(*) FILTER (pred = 'INVALID') AS invalid, round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, round(({' + '.join(_F1.values())}) / 3, 9) AS macro_f1, "
    + ", ".join(f"round({f}, 9) AS f1_{x.lower()}" for x, f in _F1.items()) + " FROM pairs",
    "m_present_macro_f1": _PAIRS + f" SELECT round({_PRESENT}, 9) AS present_macro_f1 FROM pairs WHERE gold <> 'NEI'",
    "m_by_group": _PAIRS + " " + " UNION ALL ".join(f"SELECT '{g}' AS field, {g} AS value, count(*) AS n, round(avg(CASE WHEN gold = pred THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, round({_PRESENT}, 9) AS present_macro_f1 FROM pairs GROUP BY {g}" for g in ("lang", "source")),
    "m_status_counts": "SELECT role AS status, count(*) AS n FROM conversations GROUP BY role",
    "m_last_prediction_wins": "SELECT conv_id AS id, coalesce(arg_max(CASE WHEN turn % 3 <> 2 THEN role ELSE 'INVALID' END, turn), 'INVALID') AS label FROM conversations GROUP BY conv_id",
    "sql_recursive_cte": _RECURSIVE,
    "sql_window_rank": _RANK,
    "sql_set_ops": _SETS,
    "sql_semi_anti": _SEMI,
    "sql_correlated": _CORRELATED,
    "sql_bare_column_max_by": _BARE,
    "sql_having_distinct": _HAVING,
    "sql_top_k_offset": _LIMIT,
    "sql_case_predicates": _CASE,
    "sql_theta_self_join": _THETA,
    "sql_read_only_guard": GUARD_SQL,
}
