"""Cell, profile, total-row and verdict queries on literal tables, with independent expected answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions import cells as C
from tabwright.functions import verdict as V
from tabwright.operators import profile as P

#: Raw cell -> number it holds, worked out by hand.
NUMBERS = [
    ("12", 12.0), ("1,234", 1234.0), ("1,234,567", 1234567.0), ("1，234", 1234.0), ("1,234人", None), ("12人", 12.0), ("12万", 12.0),
    ("12%", 12.0), ("8.53", 8.53), ("+3", 3.0), ("-3", -3.0), ("−3", -3.0), ("–3", -3.0), ("1：3", None), ("15-11", None), ("12:30", None),
    ("2014年", None), ("2014-05", None), ("3月", None), ("2014", 2014.0), ("1 234", None), ("5.4公里（3.3英里）", None), ("约12", None),
    ("12†", 12.0), ("*12", 12.0), ("１２", 12.0), ("", None), ("—", None), ("N/A", None), ("12 km²", 12.0), ("1e+16", None), (".5", None),
    ("5.", None), ("12平方公里", None), ("12平方米", 12.0), ("　7　", 7.0), ("1,23", None), ("100‰", 100.0), ("1:3", None),
    ("2014/5", None), (None, None), ("3.0", 3.0),
]
#: Raw cell -> entity key, join key.
KEYS = [
    ("北京（首都）", "北京", "北京"), ("甲（乙(丙)丁）戊", "甲戊", "甲戊"), ("武汉三镇足球俱乐部", "武汉三镇足球俱乐部", "武汉三镇"), ("北京队", "北京队", "北京"),
    ("甲队", "甲队", "甲队"), ("挪威*", "挪威", "挪威"), (" 中 国 ", "中国", "中国"), ("，山东；", "山东", "山东"), ("广州(H)", "广州", "广州"),
    ("中国代表团", "中国代表团", "中国"), ("未闭（合", "未闭（合", "未闭（合"), (None, "", ""), ("甲足球队", "甲足球队", "甲足球"),
]
UNITS = [("12%", "%"), ("12 km²", "km²"), ("5", ""), ("12平方米", "平方米"), ("1,000人", None), ("x", None)]
PERIODS = [("2022年GDP", 2022, "GDP"), ("2019", 2019, ""), ("1899年", None, ""), ("2021年（亿元）", 2021, "亿元"), ("人口", None, "")]
FORMATS = [(8.5, "8.50", "8.50"), (1234.0, "1,234", "1234"), (0.125, "1", "0.12"), (2.5, "x", "2.5"), (-3.0, "-3", "-3")]
TOTALS = [("合计", True), ("全国", True), ("北京", False), ("TOTAL", True), ("各地总计", True), ("全省平均", True), ("小计", True), ("其他国家", False)]
CJK = [("abc", False), ("中a", True), ("", False), (None, False), ("１２", False)]

MEDALS = ("t1", ["国家", "金牌", "银牌"], [["挪威", "16", "8"], ["德国", "12", "10"], ["中国", "9", "4"], ["美国", "9", "10"], ["合计", "46", "32"]])
RANKED = ("t2", ["名次", "球队名称", "赛区", "积分", "年份", "胜率"], [
    ["1", "武汉三镇", "北区", "78", "2020", "70%"], ["2", "山东泰山", "北区", "78", "2020", "65%"], ["3", "浙江队", "南区", "65", "2021", "60%"],
    ["4", "上海海港", "南区", "65", "2021", "50%"], ["—", "平均", "全部", "71", "2021", "61%"],
])
SPARSE = ("t3", ["甲", "乙", "code"], [["一", "", "7"], ["二", "3", "8"], ["三", "", "9"], ["四", "", "11"]])
TABLES = [MEDALS, RANKED, SPARSE]
#: table, column, kind and reason, worked out by hand on the surviving rows.
KINDS = [
    ("t1", 0, "key", ""), ("t1", 1, "metric", ""), ("t1", 2, "metric", ""), ("t2", 0, "rank", ""), ("t2", 1, "key", ""), ("t2", 2, "category", ""),
    ("t2", 3, "metric", ""), ("t2", 4, "other", "forbidden_header"), ("t2", 5, "metric", ""), ("t3", 0, "text", ""), ("t3", 1, "other", "sparse"),
    ("t3", 2, "other", "non_chinese_header"),
]
ANSWERS = [
    ('{"label":"SUPPORTS"}', "SUPPORTS", None), ('```json\n{"label":"refuted"}\n```', "REFUTES", None), ("so {\"label\":\"not enough info\"} end", "NEI", None),
    ('{"label":"NEI"} xx', "NEI", None), ("{'label':'NEI'}", "INVALID", "invalid_json"), ("", "INVALID", "empty_output"), (None, "INVALID", "empty_output"),
    ('{"label":"maybe"}', "INVALID", "invalid_label"), ("[1]", "INVALID", "invalid_json"),
]


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def values_sql(rows: list[tuple], names: list[str], types: list[str]) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types))
    return f"SELECT {casts} FROM (VALUES {body}) AS x({', '.join(names)})"


def _raws(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(r[0],) for r in rows], "raw string")


def tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TABLES, "table_id string, headers array<string>, rows array<array<string>>")


def cell_parse_number(spark, sf_dir):
    return _raws(spark, NUMBERS).select("raw", C.parse_number(F.col("raw")).alias("num"))


def cell_entity_key(spark, sf_dir):
    return _raws(spark, KEYS).select("raw", C.entity_key(F.col("raw")).alias("ekey"))


def cell_join_key(spark, sf_dir):
    return _raws(spark, KEYS).select("raw", C.join_key(F.col("raw")).alias("jkey"))


def cell_unit(spark, sf_dir):
    return _raws(spark, UNITS).select("raw", C.unit(F.col("raw")).alias("unit"))


def cell_period(spark, sf_dir):
    rest = F.when(C.period(F.col("raw")).isNotNull(), C.period_rest(F.col("raw"))).otherwise("")
    return _raws(spark, PERIODS).select("raw", C.period(F.col("raw")).alias("period"), rest.alias("rest"))


def cell_format_number(spark, sf_dir):
    df = spark.createDataFrame([(r[0], r[1]) for r in FORMATS], "value double, raw string")
    return df.select("value", "raw", C.format_number(F.col("value"), F.col("raw")).alias("shown"))


def cell_total_row(spark, sf_dir):
    return _raws(spark, TOTALS).select("raw", C.is_total_row(F.col("raw")).alias("total"))


def cell_has_cjk(spark, sf_dir):
    return _raws(spark, CJK).select("raw", C.has_cjk(F.col("raw")).alias("cjk"))


def cell_part_names(spark, sf_dir):
    """Number, unit and keys of cells built from a large table: the cell functions at scale."""
    raw = F.concat(F.format_string("%,d", (F.col("p_partkey") * 37).cast("long")), F.when(F.col("p_size") % 3 == 0, "人").when(F.col("p_size") % 3 == 1, " km²").otherwise("%"))
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", raw.alias("raw"))
    return df.select("p_partkey", C.parse_number(F.col("raw")).alias("num"), C.unit(F.col("raw")).alias("unit"))


PART_NAMES_SQL = """
WITH x AS (SELECT p_partkey, CAST(p_partkey * 37 AS BIGINT) AS n, CAST(p_size AS INT) % 3 AS u FROM part)
SELECT p_partkey, CASE WHEN u = 0 AND n >= 1000 THEN NULL ELSE CAST(n AS DOUBLE) END AS num,
  CASE WHEN u = 0 AND n >= 1000 THEN NULL WHEN u = 0 THEN '人' WHEN u = 1 THEN 'km²' ELSE '%' END AS unit FROM x
"""


def prof_kind(spark, sf_dir):
    return P.profile_tables(tables(spark))[1].select("table_id", "col_idx", "kind", "reason")


def prof_ratios(spark, sf_dir):
    return P.profile_tables(tables(spark))[1].select("table_id", "col_idx", "numeric_ratio", "unique_ratio", "unit", "is_rate")


RATIOS = [
    ("t1", 0, 0.0, 1.0, "", False), ("t1", 1, 1.0, 0.75, "", False), ("t1", 2, 1.0, 0.75, "", False), ("t2", 0, 1.0, 1.0, "", False),
    ("t2", 1, 0.0, 1.0, "", False), ("t2", 2, 0.0, 0.5, "", False), ("t2", 3, 1.0, 0.5, "", False), ("t2", 4, 1.0, 0.5, "", False),
    ("t2", 5, 1.0, 1.0, "%", True), ("t3", 0, 0.0, 1.0, "", False), ("t3", 1, 1.0, 1.0, "", False), ("t3", 2, 1.0, 1.0, "", False),
]


def prof_key(spark, sf_dir):
    return P.key_columns(P.profile_tables(tables(spark))[1])


def prof_total_row_removal(spark, sf_dir):
    kept = P.profile_tables(tables(spark))[0]
    return kept.select("table_id", "row_idx").distinct()


def prof_lookup_unique(spark, sf_dir):
    kept, profiled = P.profile_tables(tables(spark))
    wanted = spark.createDataFrame([("t1", "中国"), ("t1", "合计"), ("t2", "浙江"), ("t2", "武汉三镇足球俱乐部")], "table_id string, name string")
    return P.lookup(kept, profiled, wanted, loose=True, unique=True)


def prof_usable(spark, sf_dir):
    kept, profiled = P.profile_tables(tables(spark))
    return P.usable(kept, profiled)


def verdict_parse_label(spark, sf_dir):
    df = spark.createDataFrame([(r[0],) for r in ANSWERS], "raw string").withColumn("p", V.parse_label("raw"))
    return df.select("raw", "p.label", "p.error")


def verdict_round_half_up(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") / 8).alias("x"))
    return df.select("p_partkey", F.round("x", 2).alias("shown"), V.verdict(V.same_at(F.col("x"), F.col("x") + 0.001, 2)).alias("verdict"))


ROUND_SQL = """
WITH p AS (SELECT p_partkey, p_partkey / 8.0::DOUBLE AS x FROM part)
SELECT p_partkey, round(x, 2) AS shown, CASE WHEN round(x, 2) = round(x + 0.001, 2) THEN 'SUPPORTS' ELSE 'REFUTES' END AS verdict FROM p
"""


def verdict_three_valued(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    a = F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal") > 0)
    b = F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey") < 12)
    return c.select("c_custkey", V.verdict(a & b).alias("verdict"))


THREE_SQL = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal > 0 END AS a, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey < 12 END AS b FROM customer)
SELECT c_custkey, CASE WHEN a IS FALSE OR b IS FALSE THEN 'REFUTES' WHEN a IS NULL OR b IS NULL THEN 'NEI' ELSE 'SUPPORTS' END AS verdict FROM c
"""


def verdict_sql_boolean(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    value = F.when(F.col("n_nationkey") % 4 != 0, (F.col("n_nationkey") % 4 - 1).cast("string"))
    return n.select("n_nationkey", V.sql_verdict(F.lit(1), F.lit(1), value).alias("label"))


BOOLEAN_SQL = "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'REFUTES' WHEN 2 THEN 'SUPPORTS' ELSE 'INVALID' END AS label FROM nation"

# ---------------------------------------------------------------- mutations of a statement


def _brands(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), F.round(F.col("p_retailprice") * 100).cast("long").alias("v"))
    return p.groupBy("brand").agg(F.sum("v").alias("v"))


def mut_total_row(spark, sf_dir):
    """A total that swallows the table's own total row is twice the true one: refuted."""
    clean = _brands(spark, sf_dir)
    dirty = clean.unionByName(clean.agg(F.lit("合计").alias("brand"), F.sum("v").alias("v")))
    kept = dirty.filter(~C.is_total_row(F.col("brand"))).agg(F.sum("v").alias("true_total"))
    return dirty.agg(F.sum("v").alias("stated")).crossJoin(kept).select("stated", "true_total", V.verdict(F.col("stated") == F.col("true_total")).alias("verdict"))


TOTAL_SQL = """
WITH b AS (SELECT p_brand, sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS v FROM part GROUP BY 1)
SELECT CAST(2 * sum(v) AS BIGINT) AS stated, CAST(sum(v) AS BIGINT) AS true_total, 'REFUTES' AS verdict FROM b
"""


def mut_missing_table(spark, sf_dir):
    """The table that a bridge leads to lacks half of its rows: what is missing is not known."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    r = spark.read.parquet(f"{sf_dir}/region.parquet").filter("r_regionkey % 2 = 0")
    joined = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return joined.select("n_name", V.verdict(F.col("r_name") == "ASIA").alias("verdict"))


MISSING_SQL = """
SELECT n_name, CASE WHEN r_name IS NULL THEN 'NEI' WHEN r_name = 'ASIA' THEN 'SUPPORTS' ELSE 'REFUTES' END AS verdict
FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey % 2 = 0) ON n_regionkey = r_regionkey
"""


def mut_wrong_edition(spark, sf_dir):
    """A statement about a year for which no table is given is not decidable."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    asked = spark.createDataFrame([(y,) for y in range(1990, 2000)], "asked int")
    return asked.join(o, F.col("asked") == F.col("y"), "left").select("asked", V.verdict(F.col("n") > 0).alias("verdict"))


EDITION_SQL = """
SELECT CAST(a AS INT) AS asked, CASE WHEN n IS NULL THEN 'NEI' ELSE 'SUPPORTS' END AS verdict FROM range(1990, 2000) t(a)
LEFT JOIN (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) ON y = a
"""


def mut_entity_order(spark, sf_dir):
    """Swapping the two entities of a comparison turns its verdict round, ties aside."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    o = s.select((F.col("k") - 1).alias("k"), F.col("v").alias("w"))
    return s.join(o, "k").select("k", V.verdict(F.col("v") > F.col("w")).alias("verdict"), V.verdict(F.col("w") > F.col("v")).alias("swapped"))


ORDER_SQL = """
SELECT a.s_suppkey AS k, CASE WHEN a.s_acctbal > b.s_acctbal THEN 'SUPPORTS' ELSE 'REFUTES' END AS verdict,
  CASE WHEN b.s_acctbal > a.s_acctbal THEN 'SUPPORTS' ELSE 'REFUTES' END AS swapped
FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
"""

_ROWS = [("t1", r) for r in range(4)] + [("t2", r) for r in range(4)] + [("t3", r) for r in range(4)]

QUERIES = {f.__name__: f for f in (
    cell_parse_number, cell_entity_key, cell_join_key, cell_unit, cell_period, cell_format_number, cell_total_row, cell_has_cjk, cell_part_names,
    prof_kind, prof_ratios, prof_key, prof_total_row_removal, prof_lookup_unique, prof_usable,
    verdict_parse_label, verdict_round_half_up, verdict_three_valued, verdict_sql_boolean,
    mut_total_row, mut_missing_table, mut_wrong_edition, mut_entity_order,
)}

ORACLES = {
    "cell_parse_number": values_sql(NUMBERS, ["raw", "num"], ["VARCHAR", "DOUBLE"]),
    "cell_entity_key": values_sql([r[:2] for r in KEYS], ["raw", "ekey"], ["VARCHAR", "VARCHAR"]),
    "cell_join_key": values_sql([(r[0], r[2]) for r in KEYS], ["raw", "jkey"], ["VARCHAR", "VARCHAR"]),
    "cell_unit": values_sql(UNITS, ["raw", "unit"], ["VARCHAR", "VARCHAR"]),
    "cell_period": values_sql(PERIODS, ["raw", "period", "rest"], ["VARCHAR", "INT", "VARCHAR"]),
    "cell_format_number": values_sql(FORMATS, ["value", "raw", "shown"], ["DOUBLE", "VARCHAR", "VARCHAR"]),
    "cell_total_row": values_sql(TOTALS, ["raw", "total"], ["VARCHAR", "BOOLEAN"]),
    "cell_has_cjk": values_sql(CJK, ["raw", "cjk"], ["VARCHAR", "BOOLEAN"]),
    "cell_part_names": PART_NAMES_SQL,
    "prof_kind": values_sql(KINDS, ["table_id", "col_idx", "kind", "reason"], ["VARCHAR", "INT", "VARCHAR", "VARCHAR"]),
    "prof_ratios": values_sql(RATIOS, ["table_id", "col_idx", "numeric_ratio", "unique_ratio", "unit", "is_rate"], ["VARCHAR", "INT", "DOUBLE", "DOUBLE", "VARCHAR", "BOOLEAN"]),
    "prof_key": values_sql([("t1", 0), ("t2", 1)], ["table_id", "key"], ["VARCHAR", "INT"]),
    "prof_total_row_removal": values_sql(_ROWS, ["table_id", "row_idx"], ["VARCHAR", "INT"]),
    "prof_lookup_unique": values_sql([("t1", "中国", 2), ("t2", "浙江", 2), ("t2", "武汉三镇足球俱乐部", 0)], ["table_id", "name", "row_idx"], ["VARCHAR", "VARCHAR", "INT"]),
    "prof_usable": values_sql([("t1", True), ("t2", True), ("t3", False)], ["table_id", "usable"], ["VARCHAR", "BOOLEAN"]),
    "verdict_parse_label": values_sql(ANSWERS, ["raw", "label", "error"], ["VARCHAR", "VARCHAR", "VARCHAR"]),
    "verdict_round_half_up": ROUND_SQL,
    "verdict_three_valued": THREE_SQL,
    "verdict_sql_boolean": BOOLEAN_SQL,
    "mut_total_row": TOTAL_SQL,
    "mut_missing_table": MISSING_SQL,
    "mut_wrong_edition": EDITION_SQL,
    "mut_entity_order": ORDER_SQL,
}
