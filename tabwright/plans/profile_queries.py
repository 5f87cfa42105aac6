"""Profiles of the given tables, and total rows found by both rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import profile as P
from tabwright.sources.scratch import steps_of

#: Given table -> Chinese header, column and what is put before its values.
TABLES = {
    "part": [("编号", "p_partkey", ""), ("零件名称", "p_partkey", "零件"), ("名", "p_name", ""), ("品牌", "p_brand", ""), ("类别", "p_type", ""), ("尺寸", "p_size", ""), ("价格", "p_retailprice", ""), ("price", "p_retailprice", "")],
    "supplier": [("供应商", "s_suppkey", "供应商"), ("位次", "s_suppkey + 1", ""), ("供应商代码", "s_name", ""), ("国家", "s_nationkey", "国"), ("余额", "s_acctbal", ""), ("余额变化", "s_acctbal", "")],
    "clients": [("客户姓名", "client_id", "客户"), ("城市", "city", ""), ("来源", "source", ""), ("客群", "segment", ""), ("余额", "balance", ""), ("国家_2", "nation_id", ""), ("主数", "master_id", "")],
    "items": [("商品名称", "name", ""), ("商品", "item_id", "商品"), ("品牌", "brand", ""), ("种类", "kind", ""), ("大小", "size", ""), ("单价", "price", ""), ("2023年单价", "price", ""), ("折扣率", "size", "")],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table under Chinese headers, as a web table would show it."""
    raw = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    value = lambda column, mark: F.concat(F.lit(mark), F.expr(column).cast("string")) if mark else F.expr(column)
    return raw.select(*[value(c, m).alias(h) for h, c, m in TABLES[name]])


def _profile(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = P.profile_wide_table(table(spark, sf_dir, name), name, steps_of(spark, f"prof_wide_{name}"))[1]
        key = F.struct(~F.col("header").rlike(P.KEY_HINT), F.col("col_idx"))
        roles = found.agg(F.min_by("col_idx", F.when(F.col("kind") == "key", key)).alias("key"), F.min(F.when(F.col("kind") == "rank", F.col("col_idx"))).alias("rank"))
        out = found.crossJoin(roles)  # one row of roles beside a row for each column
        return out.select("table_id", "col_idx", "header", "kind", "reason", "numeric_ratio", "unique_ratio", "period", "unit", "is_rate", "key", "rank")

    return run


def _profile_sql(name: str) -> str:
    cells = " UNION ALL ".join(
        f"SELECT {i} AS col_idx, '{h}' AS header, coalesce('{m}' || CAST({c} AS VARCHAR), '') AS raw FROM {name}" for i, (h, c, m) in enumerate(TABLES[name])
    )
    return rf"""
WITH c AS ({cells}
), v AS (SELECT *, raw NOT IN ('', '—', '-', '–', 'N/A', 'n/a') AS filled, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+(\.[0-9]+)?') AND NOT regexp_matches(raw, '[0-9]{{4}}\.[0-9]') THEN CAST(raw AS DOUBLE) END AS num,
  regexp_replace(regexp_replace(raw, '[#*\s]', '', 'g'), '^[，,、；;:：]+|[，,、；;:：]+$', '', 'g') AS ekey FROM c
), k AS (SELECT col_idx, count(*) FILTER (n >= 2) AS repeated FROM (SELECT col_idx, ekey, count(*) AS n FROM v WHERE filled GROUP BY 1, 2) GROUP BY 1
), m AS (SELECT col_idx, header, count(*) AS n, count(*) FILTER (filled) AS filled, count(num) AS nums, count(DISTINCT ekey) FILTER (filled) AS keys, count(DISTINCT num) AS nvals, min(num) AS least, max(num) AS most,
  count(*) FILTER (num <> floor(num)) AS fractions, count(*) FILTER (num = floor(num) AND num BETWEEN 1800 AND 2100) AS years, count(*) FILTER (raw[1] IN ('+', '-') AND num <> 0) AS signs,
  coalesce(avg(length(ekey)) FILTER (filled), 0) AS mean_length, count(*) FILTER (filled AND regexp_matches(ekey, '[一-鿿]')) AS cjk_keys, count(*) FILTER (filled AND regexp_matches(ekey, '[0-9]')) AS digit_keys
  FROM v GROUP BY 1, 2
), s AS (SELECT m.*, coalesce(repeated, 0) AS repeated, coalesce(nums / nullif(filled, 0), 0) AS numeric, coalesce(keys / nullif(filled, 0), 0) AS uniq, regexp_matches(header, '[一-鿿]') AS cjk,
  fractions = 0 AND nvals = nums AND least = 1 AND most = nums AS ordinal, TRY_CAST(nullif(regexp_extract(header, '^((19|20)\d\d)年?', 1), '') AS INT) AS period,
  regexp_matches(header, '编号|^名$|代码|位次') AS forbidden, header IN ('位次', '名') AS rank_header FROM m LEFT JOIN k USING (col_idx)
), t AS (SELECT *, CASE
  WHEN n = 0 OR filled < greatest(3, floor(0.8 * n)) THEN 'other/sparse'
  WHEN numeric >= 0.95 THEN CASE WHEN rank_header OR (ordinal AND NOT regexp_matches(replace(header, '数', ''), '[一-鿿]')) THEN 'rank/' WHEN forbidden AND period IS NULL THEN 'other/forbidden_header'
    WHEN years >= 0.8 * nums THEN 'other/year_values' WHEN NOT cjk AND period IS NULL THEN 'other/non_chinese_header' WHEN ordinal AND nums >= 5 THEN 'rank/ordinal_sequence'
    WHEN signs > 0.3 * filled AND NOT regexp_matches(header, '净|差|变化|增|涨|跌|盈亏') THEN 'other/signed_change_values'
    WHEN nvals <= 1 THEN 'other/constant' WHEN regexp_matches(header, '_\d+$') THEN 'other/duplicate_header' ELSE 'metric/' END
  WHEN numeric <= 0.2 THEN CASE WHEN uniq >= 0.95 AND mean_length BETWEEN 2 AND 24 AND cjk_keys >= 0.8 * filled THEN 'key/'
    WHEN keys BETWEEN 2 AND greatest(2, floor(n / 2)) AND repeated >= 2 AND mean_length <= 12 AND cjk AND digit_keys <= 0.2 * filled THEN 'category/' ELSE 'text/' END
  ELSE 'other/' END AS kr FROM s
), u AS (SELECT *, string_split(kr, '/')[1] AS kind, string_split(kr, '/')[2] AS reason FROM t)
SELECT '{name}' AS table_id, col_idx, header, kind, reason, round(numeric, 3) AS numeric_ratio, round(uniq, 3) AS unique_ratio, period, '' AS unit, header LIKE '%率%' AND kind = 'metric' AS is_rate,
  (SELECT arg_min(col_idx, 100 * CAST(NOT regexp_matches(header, '姓名|名称|国家|城市') AS INT) + col_idx) FROM u WHERE kind = 'key') AS key, (SELECT min(col_idx) FROM u WHERE kind = 'rank') AS rank FROM u
"""


# ---------------------------------------------------------------- total rows


def with_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of cities by nation, as a roll-up gives them: some call their total row a total, others leave it unranked under another name."""
    clients = spark.read.parquet(f"{sf_dir}/clients.parquet").where("nation_id IS NOT NULL AND city IS NOT NULL")
    cents = F.round(F.col("balance") * 100).cast("long")
    rows = clients.rollup("nation_id", "city").agg(F.sum(cents).alias("v"), F.min("client_id").alias("k"), F.grouping("city").alias("_total")).where("nation_id IS NOT NULL")
    label = F.when(F.col("_total") == 0, F.col("city")).when(F.col("nation_id") % 3 == 0, "合计").when(F.col("nation_id") % 3 == 1, "（全国）各城市小计").otherwise("各城市")
    return rows.select(F.col("nation_id").alias("g"), label.alias("城市"), F.when(F.col("_total") == 0, F.col("k") + 1).alias("名次"), F.col("v").alias("余额"))


def prof_totals_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, mean and number of what is left of each nation's table; totals that stayed would double them."""
    kept = P.without_total_rows(with_totals(spark, sf_dir), "城市", "名次", by="g")
    return kept.groupBy("g").agg(F.sum("余额").alias("sum"), F.round(F.sum("余额") / F.count("余额"), 4).alias("mean"), F.count(F.lit(1)).alias("n"))


TOTALS_SQL = """
WITH c AS (SELECT nation_id AS g, city, sum(CAST(round(balance * 100) AS BIGINT)) AS v, count(*) AS k FROM clients WHERE nation_id IS NOT NULL AND city IS NOT NULL GROUP BY 1, 2),
t AS (SELECT g, count(*) AS n, CAST(sum(v) AS BIGINT) AS s, count(v) AS m FROM c GROUP BY g)
SELECT g, CASE WHEN g % 3 = 2 AND n < 4 THEN 2 * s ELSE s END AS sum, round(CAST(s AS DOUBLE) * CASE WHEN g % 3 = 2 AND n < 4 THEN 2 ELSE 1 END / (m + CASE WHEN g % 3 = 2 AND n < 4 THEN 1 ELSE 0 END), 4) AS mean,
  n + CASE WHEN g % 3 = 2 AND n < 4 THEN 1 ELSE 0 END AS n FROM t
"""

QUERIES = {f"prof_wide_{n}": _profile(n) for n in TABLES} | {"prof_totals_found": prof_totals_found}
ORACLES = {f"prof_wide_{n}": _profile_sql(n) for n in TABLES} | {"prof_totals_found": TOTALS_SQL}
