"""Statements that are records, over evidence tables cut from the given ones: all 47 skeletons in one plan, each with its SQL.

A statement per customer and skeleton in turn. Its entities, groups, limits and stated values come from the customer's own key, never from
what the evidence tables give; some of the entities exist in no table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import profile as P
from tabwright.operators import programs
from tabwright.sources.scratch import steps_of

_C = {"table": "customers", "column": "订单数"}
_CN = {**_C, "by": "国家", "table2": "nations", "column2": "客户数"}
_CAT = {**_C, "where": "类别", "equals": "@s"}
_JOIN = {**_C, "by": "国家", "table2": "nations", "where": "地区", "equals": "@r"}
_RANK = {**_C, "by": "国家", "table2": "nations", "where": "位次", "equals": "@n"}
_YEARS = {"table": "year1995", "column": "订单", "table2": "year1996", "column2": "订单", "a": "@x"}
_NATION = {"table": "nations", "column": "客户数"}
_B = {**_CN, "a": "@a", "b": "@b", "c": "@c", "value": "@v"}
#: Skeleton -> slots; what begins with @ is the customer's.
SLOTS = {
    "ST_COMPARE": {**_C, "a": "@a", "b": "@b"}, "ST_DIFF": {**_C, "a": "@a", "b": "@b", "value": "@d"}, "ST_COUNT_GT": {**_NATION, "over": "@o", "value": "@v"},
    "ST_SUPERLATIVE": {**_NATION, "a": "@x"}, "ST_AVG": {**_NATION, "value": "6.0"}, "ST_SUM": {**_NATION, "value": "150"},
    "XT_COMPARE": {**_C, "a": "@a", "b": "@x", "table2": "nations", "column2": "客户数"}, "XT_DIFF": {**_C, "a": "@a", "b": "@x", "table2": "nations", "column2": "客户数", "value": "@d"},
    "CP_DIFF": {**_YEARS, "value": "@d"}, "CP_DIRECTION": _YEARS, "CP_PCT": {**_YEARS, "value": "0.0"},
    "CG_PCT2": {"table": "year1995", "column": "订单", "table3": "year1996", "column2": "订单", "by": "国家", "table2": "nations", "where": "地区", "equals": "@r", "value": "0.5"},
    "CAT_ARGEXT": {**_CAT, "value": "@a"}, "CAT_ARGEXT_ATTR": {**_CAT, "attribute": "国家", "value": "@x"}, "CAT_AVG": {**_CAT, "value": "10"}, "CAT_COUNT": {**_CAT, "value": "30"},
    "CAT_COUNT_GT": {**_CAT, "over": "@o", "value": "@v"}, "CAT_EXTVAL": {**_CAT, "least": "true", "value": "@l"}, "CAT_SUM": {**_CAT, "value": "300"},
    "JF_ARGEXT": {**_JOIN, "value": "@a"}, "JF_AVG": {**_JOIN, "value": "10"}, "JF_COUNT_GT": {**_JOIN, "over": "@o", "value": "@v"}, "JF_EXTVAL": {**_JOIN, "value": "@v"}, "JF_SUM": {**_JOIN, "value": "300"},
    "JG_COUNT2": {**_JOIN, "equals2": "@s2"}, "NB_LOOKUP2": _B, "NB_LOOKUP3": {**_B, "by2": "地区", "table3": "regions", "column3": "国家数"},
    "NT_NTH": {**_NATION, "n": "@n", "value": "@x"}, "NT_NTH_IN": {**_NATION, "where": "地区", "equals": "@r", "n": "@p", "value": "@x"},
    "RJ_MEMBER_RANK": {**_B, "column2": "位次", "value": "@n"}, "RJ_RANK_TOP": {**_RANK, "value": "@a"}, "RJ_RANK_TOPVAL": {**_RANK, "value": "@v"},
    **{x: _B for x in ("RS_AVG", "RS_AVG3", "RS_DIFF", "RS_DIFF2", "RS_SUM", "RS_SUM2", "RS_SUM3")},
    **{x: {**_B, "value": "@q"} for x in ("RS_PCT", "RS_PCT2")}, **{x: {**_B, "value": "@t"} for x in ("RS_RATIO", "RS_RATIO2")},
    "UQ_ONE": {**_JOIN, "over": "@h"}, "UQ_ONLY_GT": {**_JOIN, "over": "@h", "a": "@a"},
    "UV_ALL_EQ": {**_JOIN, "attribute": "类别", "is": "@s"}, "UV_ALL_GT": {**_JOIN, "over": "@l"},
}
NAMES = sorted(SLOTS)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHERS")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "NOWHERE")


def evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells and key columns of the evidence tables."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    customer, orders, region = read("customer"), read("orders"), read("region")
    nation = read("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    many = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    per = customer.join(many, "c_custkey", "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    size = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    nations = nation.join(size, "n_nationkey", "left").select(F.col("n_nationkey").alias("k"), "n_name", "r_name", F.col("n").alias("n"), (F.col("n_nationkey") + 1).alias("place"))
    years = orders.where(F.year("o_orderdate").isin(1995, 1996)).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    years = years.groupBy("c_nationkey", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def cells(rows: DataFrame, table: str | F.Column, key: str, **values: F.Column) -> DataFrame:
        every = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), v.cast("string").alias("raw")) for i, (h, v) in enumerate(values.items())])
        name = F.lit(table) if isinstance(table, str) else table
        return rows.select(name.alias("table_id"), F.col(key).cast("long").alias("row_idx"), F.explode(every).alias("c")).select("table_id", "row_idx", "c.*")

    c = F.col
    out = cells(per, "customers", "c_custkey", 名称=F.concat(F.lit("客户"), c("c_custkey")), 国家=c("n_name"), 类别=c("c_mktsegment"), 订单数=c("n"))
    out = out.unionByName(cells(nations, "nations", "k", 国家=c("n_name"), 地区=c("r_name"), 客户数=c("n"), 位次=c("place")))
    counted = nation.groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).alias("n"))
    out = out.unionByName(cells(counted, "regions", "r_regionkey", 地区=c("r_name"), 国家数=c("n")))
    out = out.unionByName(cells(years, F.concat(F.lit("year"), c("y")), "c_nationkey", 国家=c("n_name"), 订单=c("n")))
    keys = spark.createDataFrame([(t, 0) for t in ("customers", "nations", "regions", "year1995", "year1996")], "table_id string, key int")
    return P.with_values(out), keys


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, skeleton_id, slots) of a statement for each customer. Ids are dealt out first: a file of them is small, and one task would make all statements."""
    k = F.col("c_custkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") - 0).alias("_n"), "n_name")
    claims = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    claims = claims.join(nation, (k * 3) % 26 == F.col("_n"), "left")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    text = lambda x: x.cast("string")
    own = {
        "@a": F.concat(F.lit("客户"), text(k)), "@b": F.concat(F.lit("客户"), text((k * 7 + 3) % 151)), "@c": F.concat(F.lit("客户"), text(k + 2)), "@x": F.coalesce("n_name", F.lit("NOWHERE")),
        "@s": pick(SEGMENTS, k % 6), "@s2": pick(REGIONS, (k + 1) % 6), "@r": pick(REGIONS, k % 6), "@n": text(k % 27), "@p": text(k % 5 + 1), "@v": text(k % 73), "@d": text(k % 5 - 2),
        "@o": text(k % 19 + 4), "@h": text(k % 9 + 18), "@l": text(k % 3), "@q": F.format_string("%.1f", (k % 900).cast("double")), "@t": F.format_string("%.2f", (k % 400) / 100.0),
    }
    names = F.array(*map(F.lit, NAMES))
    at = (k % len(NAMES)).cast("int")
    made = [F.create_map(*[x for role, v in SLOTS[n].items() for x in (F.lit(role), own.get(v, F.lit(v)))]) for n in NAMES]
    slots = F.coalesce(*[F.when(at == i, m) for i, m in enumerate(made)])
    return claims.select(k.alias("claim_id"), F.get(names, at).alias("skeleton_id"), slots.alias("slots"))


def prog_all_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, keys = evidence(spark, sf_dir)
    out = programs.run_programs(records(spark, sf_dir), cells, keys, steps_of(spark, "prog_all_skeletons"))
    return out.select("claim_id", "skeleton_id", F.round("value", 6).alias("value"), "entity", "verdict")


_NUMBER = "CASE WHEN floor(abs(round({v} * 10^{d}, 6)) + 0.5) * sign({v}) = round(CAST({s} AS DOUBLE) * 10^{d}) THEN true WHEN {v} IS NOT NULL THEN false END"


def _number(value: str, stated: str, places: int = 0) -> tuple[str, str, str]:
    return value, "NULL", _NUMBER.format(v=f"({value})", d=places, s=stated)


def _named(entity: str, stated: str) -> tuple[str, str, str]:
    return "NULL", entity, f"{entity} = {stated}"


_XB, _XC = "(SELECT pop FROM cu WHERE name = b)", "(SELECT n FROM cu WHERE name = c)"
_XA = "(SELECT pop FROM cu WHERE name = a)"
_NA, _NB = "(SELECT n FROM cu WHERE name = a)", "(SELECT n FROM cu WHERE name = b)"
_IN = "(SELECT {0} FROM cu WHERE {1})"
_S, _R = "seg = s", "reg = r"
_Y5, _Y6 = "(SELECT n FROM ye WHERE y = 1995 AND nat = x)", "(SELECT n FROM ye WHERE y = 1996 AND nat = x)"
_R5, _R6 = "(SELECT CAST(sum(n) AS DOUBLE) FROM ye WHERE y = 1995 AND reg = r)", "(SELECT CAST(sum(n) AS DOUBLE) FROM ye WHERE y = 1996 AND reg = r)"
_RJ = "CAST(pos AS VARCHAR) = n_"


def _over(where: str, limit: str) -> str:
    return f"(SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (n > {limit}) END FROM cu WHERE {where})"


#: Skeleton -> value, entity and whether it holds, in SQL over a statement's own values.
SQL = {
    "ST_COMPARE": ("NULL", "NULL", f"{_NA} > {_NB}"), "ST_DIFF": _number(f"{_NA} - {_NB}", "d"), "ST_COUNT_GT": _number("(SELECT count(*) FILTER (pop > o) FROM na)", "v"),
    "ST_SUPERLATIVE": ("NULL", "(SELECT name FROM na WHERE pop IS NOT NULL ORDER BY pop DESC, name LIMIT 1)",
      "(SELECT name FROM na WHERE pop IS NOT NULL ORDER BY pop DESC, name LIMIT 1) = x AND (SELECT count(*) = 1 FROM na WHERE pop = (SELECT max(pop) FROM na))"),
    "ST_AVG": _number("(SELECT avg(pop) FROM na)", "6.0", 1), "ST_SUM": _number("(SELECT CAST(sum(pop) AS DOUBLE) FROM na)", "150"),
    "XT_COMPARE": ("NULL", "NULL", f"{_NA} > (SELECT pop FROM na WHERE name = x)"), "XT_DIFF": _number(f"{_NA} - (SELECT pop FROM na WHERE name = x)", "d"),
    "CP_DIFF": _number(f"{_Y6} - {_Y5}", "d"), "CP_DIRECTION": ("NULL", "NULL", f"{_Y6} > {_Y5}"), "CP_PCT": _number(f"100.0::DOUBLE * ({_Y6} - {_Y5}) / {_Y5}", "0.0", 1),
    "CG_PCT2": _number(f"100 * ({_R6} - {_R5}) / {_R5}", "0.5", 1),
    "CAT_ARGEXT": _named("(SELECT name FROM cu WHERE seg = s AND n IS NOT NULL ORDER BY n DESC, name LIMIT 1)", "a"),
    "CAT_ARGEXT_ATTR": _named("(SELECT nat FROM cu WHERE seg = s AND n IS NOT NULL ORDER BY n DESC, name LIMIT 1)", "x"),
    "CAT_AVG": _number(_IN.format("avg(n)", _S), "10"), "CAT_COUNT": _number(_IN.format("nullif(count(*), 0)", _S), "30"), "CAT_COUNT_GT": _number(_over(_S, "o"), "v"),
    "CAT_EXTVAL": _number(_IN.format("min(n)", _S), "l"), "CAT_SUM": _number(_IN.format("CAST(sum(n) AS DOUBLE)", _S), "300"),
    "JF_ARGEXT": _named("(SELECT name FROM cu WHERE reg = r AND n IS NOT NULL ORDER BY n DESC, name LIMIT 1)", "a"),
    "JF_AVG": _number(_IN.format("avg(n)", _R), "10"), "JF_COUNT_GT": _number(_over(_R, "o"), "v"), "JF_EXTVAL": _number(_IN.format("max(n)", _R), "v"), "JF_SUM": _number(_IN.format("CAST(sum(n) AS DOUBLE)", _R), "300"),
    "JG_COUNT2": ("NULL", "NULL", "(SELECT nullif(count(*), 0) FROM cu WHERE reg = r) > (SELECT nullif(count(*), 0) FROM cu WHERE reg = s2)"),
    "NB_LOOKUP2": _number(_XA, "v"), "NB_LOOKUP3": _number("(SELECT many FROM cu WHERE name = a)", "v"),
    "NT_NTH": _named("(SELECT name FROM rk WHERE CAST(i AS VARCHAR) = n_)", "x"), "NT_NTH_IN": _named("(SELECT name FROM rk WHERE reg = r AND j = p)", "x"),
    "RJ_MEMBER_RANK": _number("(SELECT pos FROM cu WHERE name = a)", "n_"), "RJ_RANK_TOP": _named(f"(SELECT name FROM cu WHERE {_RJ} AND n IS NOT NULL ORDER BY n DESC, name LIMIT 1)", "a"),
    "RJ_RANK_TOPVAL": _number(_IN.format("max(n)", _RJ), "v"),
    "RS_AVG": _number(f"({_XA} + {_NB}) / 2.0::DOUBLE", "v"), "RS_AVG3": _number(f"({_XA} + {_XB} + {_XC}) / 3.0::DOUBLE", "v"), "RS_DIFF": _number(f"{_XA} - {_NB}", "v"), "RS_DIFF2": _number(f"{_XA} - {_XB}", "v"),
    "RS_PCT": _number(f"100.0::DOUBLE * ({_XA} - {_NB}) / {_NB}", "q", 1), "RS_PCT2": _number(f"100.0::DOUBLE * ({_XA} - {_XB}) / {_XB}", "q", 1),
    "RS_RATIO": _number(f"CAST({_XA} AS DOUBLE) / {_NB}", "t", 2), "RS_RATIO2": _number(f"CAST({_XA} AS DOUBLE) / {_XB}", "t", 2),
    "RS_SUM": _number(f"{_XA} + {_NB}", "v"), "RS_SUM2": _number(f"{_XA} + {_XB}", "v"), "RS_SUM3": _number(f"{_XA} + {_XB} + {_XC}", "v"),
    "UQ_ONE": ("NULL", "NULL", f"{_over(_R, 'h')} = 1"),
    "UQ_ONLY_GT": ("NULL", "NULL", f"{_over(_R, 'h')} = 1 AND (SELECT name FROM cu WHERE reg = r AND n IS NOT NULL ORDER BY n DESC, name LIMIT 1) = a"),
    "UV_ALL_EQ": ("NULL", "NULL", "(SELECT bool_and(seg = s) FROM cu WHERE reg = r)"),
    "UV_ALL_GT": ("NULL", "NULL", "(SELECT CASE WHEN count(*) FILTER (n <= l) > 0 THEN false WHEN count(*) FILTER (n IS NULL) > 0 THEN NULL WHEN count(*) > 0 THEN true END FROM cu WHERE reg = r)"),
}


def _sql() -> str:
    parts = [
        f"SELECT k AS claim_id, '{n}' AS skeleton_id, round(CAST({v} AS DOUBLE), 6) AS value, CAST({e} AS VARCHAR) AS entity, {h} AS holds FROM cl WHERE k % {len(NAMES)} = {i}"
        for i, n in enumerate(NAMES)
        for v, e, h in [SQL[n]]
    ]
    pick = lambda names, i: f"list_extract([{', '.join(repr(x) for x in names)}], 1 + ({i}))"
    return f"""
WITH na AS (SELECT n_nationkey AS k, n_name AS name, r_name AS reg, n_nationkey + 1 AS pos, pop FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT c_nationkey, count(*) AS pop FROM customer GROUP BY 1) ON c_nationkey = n_nationkey
), cu AS (SELECT '客户' || c_custkey AS name, na.name AS nat, c_mktsegment AS seg, n, reg, pos, pop, (SELECT count(*) FROM na z WHERE z.reg = na.reg) AS many FROM customer JOIN na ON na.k = c_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
), ye AS (SELECT year(o_orderdate) AS y, na.name AS nat, reg, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN na ON na.k = c_nationkey GROUP BY 1, 2, 3
), rk AS (SELECT name, reg, row_number() OVER (ORDER BY pop DESC, name) AS i, row_number() OVER (PARTITION BY reg ORDER BY pop DESC, name) AS j FROM na WHERE pop IS NOT NULL
), cl AS (SELECT c_custkey AS k, '客户' || c_custkey AS a, '客户' || ((c_custkey * 7 + 3) % 151) AS b, '客户' || (c_custkey + 2) AS c, coalesce(name, 'NOWHERE') AS x,
    {pick(SEGMENTS, 'c_custkey % 6')} AS s, replace({pick(REGIONS, '(c_custkey + 1) % 6')}, '', '') AS s2, {pick(REGIONS, 'c_custkey % 6')} AS r, CAST(c_custkey % 27 AS VARCHAR) AS n_, c_custkey % 5 + 1 AS p,
    c_custkey % 73 AS v, c_custkey % 5 - 2 AS d, c_custkey % 19 + 4 AS o, c_custkey % 9 + 18 AS h, c_custkey % 3 AS l, c_custkey % 900 AS q, (c_custkey % 400) / 100.0 AS t
  FROM customer LEFT JOIN na ON na.k = (c_custkey * 3) % 26
)
SELECT claim_id, skeleton_id, value, replace(entity, ' ', '') AS entity, CASE WHEN holds IS NULL THEN 'NEI' WHEN holds THEN 'SUPPORTS' ELSE 'REFUTES' END AS verdict FROM ({' UNION ALL '.join(parts)})
"""


QUERIES = {"prog_all_skeletons": prog_all_skeletons}
ORACLES = {"prog_all_skeletons": _sql()}
