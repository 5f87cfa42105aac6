"""The 47 query templates over the relational test tables, each with its SQL.

Stated values follow one rule on both sides: a computed value whose whole part leaves 1 on division by 3
is stated one too high, so that verdicts of all three kinds occur.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.functions.verdict import verdict
from tabwright.operators import templates as T


class Tables:
    """Measures, maps and rows over the tables of a folder; amounts are whole cents."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def part(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), F.col("p_type").alias("a"), _cents("p_retailprice").alias("v"))

    def customer(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("g"), F.col("c_nationkey").alias("n"), _cents("c_acctbal").alias("v"))

    def supplier(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"), _cents("s_acctbal").alias("v"))

    def nation(self) -> DataFrame:
        return self.read("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))

    def nation_year(self) -> DataFrame:
        # Orders are summed per customer and year first: the join then moves sums, not orders.
        per = self.read("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(_cents("o_totalprice")).alias("v"))
        joined = per.join(self.read("customer").select("c_custkey", F.col("c_nationkey").alias("k")), F.col("o_custkey") == F.col("c_custkey"))
        return joined.groupBy("k", "y").agg(F.sum("v").alias("v"))

    def nation_total(self) -> DataFrame:
        return self.nation_year().groupBy("k").agg(F.sum("v").alias("v"))

    def nation_supply(self) -> DataFrame:
        return self.supplier().groupBy(F.col("n").alias("k")).agg(F.sum("v").alias("v"))

    def region_balance(self) -> DataFrame:
        joined = self.customer().groupBy(F.col("n").alias("k")).agg(F.sum("v").alias("v")).join(self.nation(), "k")
        return joined.groupBy(F.col("r").alias("k")).agg(F.sum("v").alias("v"))

    def joined_suppliers(self) -> DataFrame:
        """Suppliers of nations in two regions."""
        region = self.read("region").filter(F.col("r_name").isin("ASIA", "EUROPE")).select(F.col("r_regionkey").alias("r"))
        nation = self.nation().join(region, "r").select(F.col("k").alias("n"), F.col("name").alias("g"))
        return self.supplier().join(nation, "n")

    def customer_pairs(self) -> DataFrame:
        """Customers with their neighbour by key, and for both the nation that a bridge leads to."""
        c = self.customer()
        links = c.select("k", F.col("n").alias("to"))
        pairs = c.select(F.col("k").cast("string").alias("subject"), "k", (F.col("k") + 1).alias("other"), F.col("v").alias("x"))
        pairs = T.bridge(T.bridge(pairs, links, "k", "n"), links, "other", "m")
        pairs = T.value_of(T.value_of(pairs, self.nation_supply(), "n", "b"), self.nation_supply(), "m", "c")
        return T.value_of(pairs, self.nation_total(), "n", "d")


def _cents(name: str):
    return F.round(F.col(name) * 100).cast("long")


def _part_pairs(t: Tables) -> DataFrame:
    p = t.part().select("k", "v")
    pairs = p.select(F.col("k").cast("string").alias("subject"), F.col("v").alias("x"), (F.col("k") + 1).alias("other"))
    return T.value_of(pairs, p, "other", "y")


def _cross_pairs(t: Tables) -> DataFrame:
    pairs = t.customer().select(F.col("k").cast("string").alias("subject"), "k", F.col("v").alias("x"))
    return T.value_of(pairs, t.supplier().select("k", "v"), "k", "y")


def _year_pairs(t: Tables) -> DataFrame:
    now = t.nation_year()
    before = now.select(F.col("k").alias("_k"), (F.col("y") + 1).alias("_y"), F.col("v").alias("x"))
    joined = now.join(before, (F.col("k") == F.col("_k")) & (F.col("y") == F.col("_y")), "left")
    return joined.select(F.concat_ws("/", "k", "y").alias("subject"), "x", F.col("v").alias("z"))


def _region_years(t: Tables) -> DataFrame:
    now = t.nation_year().join(t.nation(), "k").groupBy("r", "y").agg(F.sum("v").alias("v"))
    before = now.select(F.col("r").alias("_r"), (F.col("y") + 1).alias("_y"), F.col("v").alias("x"))
    joined = now.join(before, (F.col("r") == F.col("_r")) & (F.col("y") == F.col("_y")), "left")
    return joined.select(F.concat_ws("/", "r", "y").alias("subject"), "x", F.col("v").alias("z"))


def _two_counts(t: Tables) -> DataFrame:
    joined = t.customer().join(t.nation().select(F.col("k").alias("n"), "name"), "n")
    return joined.groupBy(F.col("name").alias("subject")).agg((F.count_if(F.col("g") == "BUILDING") > F.count_if(F.col("g") == "MACHINERY")).alias("holds"))


def _lookup2(t: Tables) -> DataFrame:
    return t.customer_pairs().select("subject", F.col("d").cast("double").alias("value"))


def _lookup3(t: Tables) -> DataFrame:
    s = t.supplier().select(F.col("k").cast("string").alias("subject"), "n")
    pairs = T.bridge(s, t.nation().select("k", F.col("r").alias("to")), "n", "r")
    return T.value_of(pairs, t.region_balance(), "r", "v").select("subject", F.col("v").cast("double").alias("value"))


def _ranks(t: Tables) -> DataFrame:
    """Nations with their rank by total: (k, v = rank)."""
    return T.ranked(t.nation_total()).select("k", F.col("rank").cast("long").alias("v"))


def _member_rank(t: Tables) -> DataFrame:
    s = t.supplier().select(F.col("k").cast("string").alias("subject"), "n")
    return T.value_of(s, _ranks(t), "n", "v").select("subject", F.col("v").cast("double").alias("value"))


def _members(t: Tables) -> DataFrame:
    ranks = _ranks(t)
    return t.supplier().join(ranks.select(F.col("k").alias("n"), F.col("v").alias("g")), "n")


def _in_regions(t: Tables) -> DataFrame:
    return t.nation_total().join(t.nation().select("k", F.col("r").alias("g")), "k")


#: Template -> builder of (subject, value) or (subject, holds).
BUILDERS = {
    "st_compare": lambda t: T.compare(_part_pairs(t), "x", "y"),
    "st_count_gt": lambda t: T.count_above(t.part(), "g", 120000),
    "st_diff": lambda t: T.combine(_part_pairs(t), "diff", "x", "y"),
    "st_superlative": lambda t: T.superlative(t.part(), "g"),
    "st_avg": lambda t: T.grouped(t.part(), "g", "avg"),
    "st_sum": lambda t: T.grouped(t.part(), "g", "sum"),
    "xt_compare": lambda t: T.compare(_cross_pairs(t), "x", "y"),
    "xt_diff": lambda t: T.combine(_cross_pairs(t), "diff", "x", "y"),
    "cp_diff": lambda t: T.combine(_year_pairs(t), "diff", "z", "x"),
    "cp_direction": lambda t: T.compare(_year_pairs(t), "z", "x"),
    "cp_pct": lambda t: T.combine(_year_pairs(t), "pct", "z", "x", places=1),
    "cg_pct2": lambda t: T.combine(_region_years(t), "pct", "z", "x", places=1),
    "cat_argext": lambda t: T.arg_extreme(t.part(), "a").withColumn("value", F.col("value").cast("double")),
    "cat_argext_attr": lambda t: T.arg_extreme(t.part(), "a", "g").select("subject", (F.col("value") == "Brand#11").alias("holds")),
    "cat_avg": lambda t: T.grouped(t.part(), "a", "avg"),
    "cat_count": lambda t: T.grouped(t.part(), "a", "count"),
    "cat_count_gt": lambda t: T.count_above(t.part(), "a", 130000),
    "cat_extval": lambda t: T.grouped(t.part(), "a", "min"),
    "cat_sum": lambda t: T.grouped(t.part(), "a", "sum"),
    "jf_argext": lambda t: T.arg_extreme(t.joined_suppliers(), "g").withColumn("value", F.col("value").cast("double")),
    "jf_avg": lambda t: T.grouped(t.joined_suppliers(), "g", "avg"),
    "jf_count_gt": lambda t: T.count_above(t.joined_suppliers(), "g", 400000),
    "jf_extval": lambda t: T.grouped(t.joined_suppliers(), "g", "max"),
    "jf_sum": lambda t: T.grouped(t.joined_suppliers(), "g", "sum"),
    "jg_count2": _two_counts,
    "nb_lookup2": _lookup2,
    "nb_lookup3": _lookup3,
    "nt_nth": lambda t: T.nth(t.nation_total()),
    "nt_nth_in": lambda t: T.nth(_in_regions(t), "g"),
    "rj_member_rank": _member_rank,
    "rj_rank_top": lambda t: T.arg_extreme(_members(t), "g").withColumn("value", F.col("value").cast("double")),
    "rj_rank_topval": lambda t: T.grouped(_members(t), "g", "max"),
    "rs_avg": lambda t: T.combine(t.customer_pairs(), "mean", "b", "x"),
    "rs_avg3": lambda t: T.combine(t.customer_pairs(), "mean", "b", "c", "x", places=2),
    "rs_diff": lambda t: T.combine(t.customer_pairs(), "diff", "b", "x"),
    "rs_diff2": lambda t: T.combine(t.customer_pairs(), "diff", "b", "c"),
    "rs_pct": lambda t: T.combine(t.customer_pairs(), "pct", "b", "x", places=1),
    "rs_pct2": lambda t: T.combine(t.customer_pairs(), "pct", "b", "c", places=1),
    "rs_ratio": lambda t: T.combine(t.customer_pairs(), "ratio", "b", "x", places=2),
    "rs_ratio2": lambda t: T.combine(t.customer_pairs(), "ratio", "b", "c", places=2),
    "rs_sum": lambda t: T.combine(t.customer_pairs(), "sum", "b", "x"),
    "rs_sum2": lambda t: T.combine(t.customer_pairs(), "sum", "b", "c"),
    "rs_sum3": lambda t: T.combine(t.customer_pairs(), "sum", "b", "c", "x"),
    "uq_one": lambda t: T.only_one(t.supplier(), "n", 900000),
    "uq_only_gt": lambda t: T.only_first(t.supplier(), "n", 500000),
    "uv_all_eq": lambda t: T.all_hold(t.joined_suppliers().withColumn("_c", F.col("k") % 2), "g", F.col("_c") == 0),
    "uv_all_gt": lambda t: T.all_hold(t.supplier(), "n", F.when(F.col("k") % 17 != 0, F.col("v") > -50000)),
}

_PRELUDE = """
WITH part_ AS (SELECT p_partkey AS k, p_brand AS g, p_type AS a, CAST(round(p_retailprice * 100) AS BIGINT) AS v FROM part),
cust AS (SELECT c_custkey AS k, c_mktsegment AS g, c_nationkey AS n, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer),
supp AS (SELECT s_suppkey AS k, s_nationkey AS n, CAST(round(s_acctbal * 100) AS BIGINT) AS v FROM supplier),
nat AS (SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation),
ny AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
nt AS (SELECT k, CAST(sum(v) AS BIGINT) AS v FROM ny GROUP BY k),
ns AS (SELECT n AS k, CAST(sum(v) AS BIGINT) AS v FROM supp GROUP BY n),
rb AS (SELECT r AS k, CAST(sum(v) AS BIGINT) AS v FROM cust JOIN nat ON cust.n = nat.k GROUP BY r),
js AS (SELECT supp.*, nat.name AS g FROM supp JOIN nat ON supp.n = nat.k JOIN region ON r = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')),
pp AS (SELECT CAST(a.k AS VARCHAR) AS subject, a.v AS x, b.v AS y FROM part_ a LEFT JOIN part_ b ON b.k = a.k + 1),
xp AS (SELECT CAST(a.k AS VARCHAR) AS subject, a.v AS x, b.v AS y FROM cust a LEFT JOIN supp b ON a.k = b.k),
yp AS (SELECT a.k || '/' || a.y AS subject, b.v AS x, a.v AS z FROM ny a LEFT JOIN ny b ON a.k = b.k AND b.y = a.y - 1),
ry AS (SELECT r, y, CAST(sum(v) AS BIGINT) AS v FROM ny JOIN nat USING (k) GROUP BY 1, 2),
rp AS (SELECT a.r || '/' || a.y AS subject, b.v AS x, a.v AS z FROM ry a LEFT JOIN ry b ON a.r = b.r AND b.y = a.y - 1),
cp AS (SELECT CAST(a.k AS VARCHAR) AS subject, a.v AS x, nb.v AS b, nc.v AS c, nd.v AS d FROM cust a
  LEFT JOIN cust o ON o.k = a.k + 1 LEFT JOIN ns nb ON nb.k = a.n LEFT JOIN ns nc ON nc.k = o.n LEFT JOIN nt nd ON nd.k = a.n),
rk AS (SELECT k, row_number() OVER (ORDER BY v DESC, k) AS v FROM nt),
mem AS (SELECT supp.*, rk.v AS g FROM supp JOIN rk ON supp.n = rk.k),
"""


def _group(rows: str, by: str, expression: str, kind: str = "value") -> str:
    cast = f"CAST({expression} AS DOUBLE)" if kind == "value" else expression
    return f"SELECT CAST({by} AS VARCHAR) AS subject, {cast} AS {kind} FROM {rows} GROUP BY {by}"


def _pair(rows: str, expression: str) -> str:
    return f"SELECT subject, CAST({expression} AS DOUBLE) AS value FROM {rows}"


def _pct(a: str, b: str) -> str:
    return f"round(100 * (CAST({a} AS DOUBLE) - {b}) / nullif(CAST({b} AS DOUBLE), 0), 1) + 0.0"


def _top(rows: str, by: str, what: str = "k") -> str:
    return f"SELECT CAST({by} AS VARCHAR) AS subject, {what} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY v DESC, k) AS i FROM {rows}) WHERE i = 1"


_AVG = "round(CAST(sum(v) AS DOUBLE) / count(v), 2)"
SQL = {
    "st_compare": "SELECT subject, x > y AS holds FROM pp",
    "st_count_gt": _group("part_", "g", "count(*) FILTER (v > 120000)"),
    "st_diff": _pair("pp", "x - y"),
    "st_superlative": "SELECT g AS subject, arg_min(v, k) = max(v) AND count(*) FILTER (v = m) = 1 AS holds FROM (SELECT *, max(v) OVER (PARTITION BY g) AS m FROM part_) GROUP BY g",
    "st_avg": _group("part_", "g", _AVG),
    "st_sum": _group("part_", "g", "sum(v)"),
    "xt_compare": "SELECT subject, x > y AS holds FROM xp",
    "xt_diff": _pair("xp", "x - y"),
    "cp_diff": _pair("yp", "z - x"),
    "cp_direction": "SELECT subject, z > x AS holds FROM yp",
    "cp_pct": _pair("yp", _pct("z", "x")),
    "cg_pct2": _pair("rp", _pct("z", "x")),
    "cat_argext": f"SELECT subject, CAST(k AS DOUBLE) AS value FROM ({_top('part_', 'a')})",
    "cat_argext_attr": f"SELECT subject, g = 'Brand#11' AS holds FROM ({_top('part_', 'a', 'g')})",
    "cat_avg": _group("part_", "a", _AVG),
    "cat_count": _group("part_", "a", "count(*)"),
    "cat_count_gt": _group("part_", "a", "count(*) FILTER (v > 130000)"),
    "cat_extval": _group("part_", "a", "min(v)"),
    "cat_sum": _group("part_", "a", "sum(v)"),
    "jf_argext": f"SELECT subject, CAST(k AS DOUBLE) AS value FROM ({_top('js', 'g')})",
    "jf_avg": _group("js", "g", _AVG),
    "jf_count_gt": _group("js", "g", "count(*) FILTER (v > 400000)"),
    "jf_extval": _group("js", "g", "max(v)"),
    "jf_sum": _group("js", "g", "sum(v)"),
    "jg_count2": "SELECT name AS subject, count(*) FILTER (g = 'BUILDING') > count(*) FILTER (g = 'MACHINERY') AS holds FROM cust JOIN nat ON cust.n = nat.k GROUP BY name",
    "nb_lookup2": _pair("cp", "d"),
    "nb_lookup3": "SELECT CAST(s.k AS VARCHAR) AS subject, CAST(rb.v AS DOUBLE) AS value FROM supp s LEFT JOIN nat ON s.n = nat.k LEFT JOIN rb ON nat.r = rb.k",
    "nt_nth": "SELECT CAST(v AS VARCHAR) AS subject, CAST(k AS DOUBLE) AS value FROM rk",
    "nt_nth_in": "SELECT r || '/' || row_number() OVER (PARTITION BY r ORDER BY v DESC, nt.k) AS subject, CAST(nt.k AS DOUBLE) AS value FROM nt JOIN nat ON nt.k = nat.k",
    "rj_member_rank": "SELECT CAST(s.k AS VARCHAR) AS subject, CAST(rk.v AS DOUBLE) AS value FROM supp s LEFT JOIN rk ON s.n = rk.k",
    "rj_rank_top": f"SELECT subject, CAST(k AS DOUBLE) AS value FROM ({_top('mem', 'g')})",
    "rj_rank_topval": _group("mem", "g", "max(v)"),
    "rs_avg": _pair("cp", "(CAST(b AS DOUBLE) + x) / 2"),
    "rs_avg3": _pair("cp", "round((CAST(b AS DOUBLE) + c + x) / 3, 2)"),
    "rs_diff": _pair("cp", "b - x"),
    "rs_diff2": _pair("cp", "b - c"),
    "rs_pct": _pair("cp", _pct("b", "x")),
    "rs_pct2": _pair("cp", _pct("b", "c")),
    "rs_ratio": _pair("cp", "round(CAST(b AS DOUBLE) / nullif(x, 0), 2)"),
    "rs_ratio2": _pair("cp", "round(CAST(b AS DOUBLE) / nullif(c, 0), 2)"),
    "rs_sum": _pair("cp", "b + x"),
    "rs_sum2": _pair("cp", "b + c"),
    "rs_sum3": _pair("cp", "b + c + x"),
    "uq_one": _group("supp", "n", "count(*) FILTER (v > 900000) = 1", "holds"),
    "uq_only_gt": _group("supp", "n", "count(*) FILTER (v > 500000) = 1 AND arg_min(v, k) > 500000", "holds"),
    "uv_all_eq": _group("js", "g", "count(*) FILTER (k % 2 <> 0) = 0", "holds"),
    "uv_all_gt": _group("supp", "n", "CASE WHEN count(*) FILTER (k % 17 <> 0 AND v <= -50000) > 0 THEN false WHEN count(*) FILTER (k % 17 = 0) > 0 THEN NULL ELSE true END", "holds"),
}


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = BUILDERS[name](Tables(spark, sf_dir))
        if "holds" in df.columns:
            return df.select("subject", verdict(F.col("holds")).alias("verdict"))
        stated = F.col("value") + F.when(F.pmod(F.floor("value"), F.lit(3)) == 1, 1.0).otherwise(0.0)
        return df.select("subject", "value", verdict(F.col("value") == stated).alias("verdict"))

    return run


def _oracle(name: str) -> str:
    body = SQL[name]
    case = "CASE WHEN {0} IS NULL THEN 'NEI' WHEN {0} THEN 'SUPPORTS' ELSE 'REFUTES' END AS verdict"
    if " AS holds" in body:
        return f"{_PRELUDE} q AS ({body}) SELECT subject, {case.format('holds')} FROM q"
    test = "(((CAST(floor(value) AS BIGINT) % 3) + 3) % 3 <> 1)"
    return f"{_PRELUDE} q AS ({body}) SELECT subject, value, {case.format(test)} FROM q"


@cache
def registered() -> tuple[dict, dict]:
    return {f"sk_{n}": _query(n) for n in BUILDERS}, {f"sk_{n}": _oracle(n) for n in SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios between regions' order totals over three bridges, compared with stated values."""
    t = Tables(spark, sf_dir)
    per = t.nation_total().join(t.nation(), "k").join(t.read("region"), F.col("r") == F.col("r_regionkey"))
    total = per.groupBy("r_name").agg(F.sum("v").alias("v"))
    a, b = total.select(F.col("r_name").alias("region_a"), F.col("v").alias("a")), total.select(F.col("r_name").alias("region_b"), F.col("v").alias("b"))
    pairs = a.join(b, F.col("region_a") < F.col("region_b"))
    ratio = F.round(F.try_divide(F.col("a"), F.col("b")), 2)
    stated = F.when(F.col("region_a") == "AMERICA", F.lit(None).cast("double")).when(F.col("region_b") == "ASIA", F.lit(1.0)).otherwise(ratio)
    return pairs.select("region_a", "region_b", ratio.alias("ratio"), verdict(ratio == stated).alias("verdict"))


FLAGSHIP_SQL = _PRELUDE + """
t AS (SELECT r_name, CAST(sum(v) AS BIGINT) AS v FROM nt JOIN nat USING (k) JOIN region ON r = r_regionkey GROUP BY r_name),
p AS (SELECT a.r_name AS region_a, b.r_name AS region_b, round(CAST(a.v AS DOUBLE) / b.v, 2) AS ratio FROM t a JOIN t b ON a.r_name < b.r_name)
SELECT region_a, region_b, ratio, CASE WHEN region_a = 'AMERICA' THEN 'NEI' WHEN region_b = 'ASIA' AND ratio <> 1 THEN 'REFUTES' ELSE 'SUPPORTS' END AS verdict FROM p
"""
