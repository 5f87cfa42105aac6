"""Kinds of table sets cut from the given tables, with their SQL.

Per region and shape a package. Whether its columns lie within each other hangs on the data: rankings lack the last nations, years may lack some, and
a category needs repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import packages
from tabwright.sources.scratch import Steps, steps_of

SHAPES = ("single", "divided", "years", "halves", "ranking", "classes", "segments", "chain", "hub")


def cut(spark: SparkSession, sf_dir: str, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Cells of all packages' tables, and (package_id, table_id, period). Orders are joined and counted once for the four tables of years."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = F.col
    nation = read("nation").select("n_nationkey", F.concat(F.lit("国"), "n_name").alias("nat"), c("n_regionkey").alias("r"))
    region = read("region").select(c("r_regionkey").alias("r"), F.concat(F.lit("区"), "r_name").alias("reg"))
    customer = read("customer").join(nation, c("c_nationkey") == c("n_nationkey")).select("r", c("c_custkey").alias("k"), F.concat(F.lit("客"), "c_custkey").alias("name"), "nat", c("c_nationkey").alias("n"), F.concat(F.lit("类"), "c_mktsegment").alias("seg"), F.round(c("c_acctbal")).cast("long").alias("v"))
    size = customer.groupBy("r", c("n").alias("k"), "nat").agg(F.count(F.lit(1)).alias("v"))
    years = read("orders").join(customer, c("o_custkey") == c("k")).groupBy("r", c("n").alias("k"), "nat", F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("v"))
    years = steps.table(years, "years")
    listed = nation.join(region, "r").select("r", c("n_nationkey").alias("k"), "nat", "reg", F.when(c("n_nationkey") % 2 == 0, "甲类").otherwise("乙类").alias("cls"))
    around = listed.withColumn("r", F.explode(F.array(c("r"), (c("r") + 4) % 5))).where((c("r") % 3 != 1) | (c("k") % 4 != 0))
    ranked = size.groupBy("r").agg(F.array_sort(F.collect_list(F.struct((-c("v")).alias("v"), "k", "nat"))).alias("s")).select("r", F.posexplode("s").alias("i", "x"))
    ranked = ranked.where(c("i") < 5 - c("r") % 2).select("r", c("i").alias("k"), (c("i") + 1).alias("place"), c("x.nat").alias("nat"))
    by_segment = customer.groupBy("r", "seg").agg(F.count(F.lit(1)).alias("v"), F.min("k").alias("k"))
    every = F.explode(F.array(*map(F.lit, range(5))))
    regions = region.select(c("r").alias("k"), "reg", (c("r") + 3).alias("v"), every.alias("r"))

    def cells(shape: str, table: str, rows: DataFrame, **values: Column) -> DataFrame:
        own = F.array(*[F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), v.cast("string").alias("raw")) for i, (h, v) in enumerate(values.items())])
        name = F.concat_ws("/", F.lit(shape), c("r").cast("string"), F.lit(table))
        return rows.select(name.alias("table_id"), c("k").cast("long").alias("row_idx"), F.explode(own).alias("x")).select("table_id", "row_idx", "x.*")

    per = lambda y: years.where(c("y") == y)
    detail = {"名称": c("name"), "国家": c("nat"), "余额": c("v")}
    made = [
        cells("single", "a", customer, 名称=c("name"), 余额=c("v")), cells("divided", "a", customer, 名称=c("name"), 类别=c("seg"), 余额=c("v")),
        *[cells("years", str(y), per(y), 国家=c("nat"), 订单=c("v")) for y in (1995, 1996)],
        *[cells("halves", str(h), customer.where(c("k") % 2 == h), 名称=c("name"), 余额=c("v")) for h in (0, 1)],
        cells("ranking", "a", customer, **detail), cells("ranking", "b", ranked, 名次=c("place"), 国家=c("nat")),
        cells("classes", "a", customer, **detail), cells("classes", "b", listed, 国家=c("nat"), 组别=c("cls")),
        cells("segments", "a", customer, 名称=c("name"), 类别=c("seg"), 余额=c("v")), cells("segments", "b", by_segment.where(c("v") > c("r")), 类别=c("seg"), 客户数=c("v")),
        cells("chain", "a", customer, **detail), cells("chain", "b", around, 国家=c("nat"), 地区=F.concat("reg", F.when(c("k") % 2 == 0, "").otherwise("队"))), cells("chain", "c", regions, 地区=c("reg"), 数量=c("v")),
        cells("hub", "a", listed, 国家=c("nat"), 组号=c("k")), *[cells("hub", str(y), per(y), 国家=c("nat"), 订单=c("v")) for y in (1995, 1996)],
    ]
    out = made[0]
    for x in made[1:]:
        out = out.unionByName(x)
    tables = [(f"{s}/{r}", f"{s}/{r}/{t}", int(t) if len(t) == 4 else None) for r in range(5) for s, ts in zip(SHAPES, ("a", "a", ("1995", "1996"), "01", "ab", "ab", "ab", "abc", ("a", "1995", "1996")), strict=True) for t in ts]
    return out, spark.createDataFrame(tables, "package_id string, table_id string, period int")


def pkg_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = steps_of(spark, "pkg_kinds")
    return packages.package_kinds(*cut(spark, sf_dir, steps), steps)


KINDS_SQL = """
WITH cu AS (SELECT n_regionkey AS r, c_custkey AS k, n_nationkey AS n, c_mktsegment AS seg, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey),
yr AS (SELECT r, n, year(o_orderdate) AS y FROM orders JOIN cu ON o_custkey = k GROUP BY 1, 2, 3),
sz AS (SELECT r, n, row_number() OVER (PARTITION BY r ORDER BY count(*) DESC, n) - 1 AS i FROM cu GROUP BY 1, 2),
sg AS (SELECT r, seg, count(*) AS v FROM cu GROUP BY 1, 2),
u AS (SELECT r, count(*) AS n, count(DISTINCT n) AS used, count(DISTINCT n) FILTER (r % 3 <> 1 OR n % 4 <> 0) AS in_listed FROM cu GROUP BY r),
rk AS (SELECT cu.r, count(DISTINCT cu.n) AS in_rank FROM cu JOIN sz ON sz.r = cu.r AND sz.n = cu.n WHERE i < 5 - cu.r % 2 GROUP BY 1),
ss AS (SELECT r, count(*) AS segs, count(*) FILTER (v > r) AS in_segs, count(*) FILTER (v >= 2) AS twice FROM sg GROUP BY r),
ys AS (SELECT r, count(*) FILTER (y = 1995) AS y5, count(*) FILTER (y = 1996) AS y6 FROM yr GROUP BY r),
yb AS (SELECT a.r, count(*) AS y56 FROM yr a JOIN yr b ON a.r = b.r AND a.n = b.n AND a.y = 1995 AND b.y = 1996 GROUP BY 1),
mi AS (SELECT n_regionkey AS r, least(count(*) FILTER (n_nationkey % 2 = 0), count(*) FILTER (n_nationkey % 2 = 1)) AS minor FROM nation GROUP BY 1),
m AS (SELECT r, used, in_listed, coalesce(in_rank, 0) AS in_rank, segs, in_segs, segs BETWEEN 2 AND greatest(2, n // 2) AND twice >= 2 AS seg_category, coalesce(y5, 0) AS y5, coalesce(y6, 0) AS y6, coalesce(y56, 0) AS y56, minor
  FROM u JOIN ss USING (r) JOIN mi USING (r) LEFT JOIN rk USING (r) LEFT JOIN ys USING (r) LEFT JOIN yb USING (r))
SELECT 'single/' || r AS package_id, 'single' AS kind, 1 AS n_tables FROM m
UNION ALL SELECT 'divided/' || r, CASE WHEN seg_category THEN 'category_decomp' ELSE 'single' END, 1 FROM m
UNION ALL SELECT 'years/' || r, CASE WHEN y5 >= 3 AND y6 >= 3 AND 2 * y56 >= least(y5, y6) THEN 'period_pair' WHEN y56 = 0 OR y5 < 3 OR y6 < 3 THEN 'split_pair' ELSE 'unrelated' END, 2 FROM m
UNION ALL SELECT 'halves/' || r, 'split_pair', 2 FROM m
UNION ALL SELECT 'ranking/' || r, CASE WHEN in_rank = used AND used >= 3 THEN 'rank_detail' ELSE 'unrelated' END, 2 FROM m
UNION ALL SELECT 'classes/' || r, CASE WHEN minor >= 2 THEN 'join_filter' ELSE 'bridge_chain' END, 2 FROM m
UNION ALL SELECT 'segments/' || r, CASE WHEN in_segs < segs OR in_segs < 3 THEN 'unrelated' WHEN seg_category THEN 'category_partner' ELSE 'bridge_chain' END, 2 FROM m
UNION ALL SELECT 'chain/' || r, CASE WHEN in_listed = used THEN 'bridge_chain' ELSE 'unrelated' END, 3 FROM m
UNION ALL SELECT 'hub/' || r, CASE WHEN y5 >= 2 AND y6 >= 2 THEN 'hub_profile' ELSE 'unrelated' END, 3 FROM m
"""

QUERIES = {"pkg_kinds": pkg_kinds}
ORACLES = {"pkg_kinds": KINDS_SQL}
