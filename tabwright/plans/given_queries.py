"""Cell functions, answers and profiles over cells composed from the given tables, each with its SQL.

A template makes a raw cell from a row's values; its SQL says what the cell holds without looking at the cell. Profiles are of tables by region that have
a column for each rule and end with a total row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions import cells as C
from tabwright.functions import verdict as V
from tabwright.operators import profile as P
from tabwright.sources.scratch import steps_of

_BARE = "replace(p_name, ' ', '')"
#: Query -> raw cell in Spark SQL and what it holds in DuckDB SQL, for rows of ``part``.
NUMBERS = [
    ("format_string('%,d', p_partkey * 1000 + p_size)", "p_partkey * 1000 + p_size"), ("concat(p_size, '%')", "p_size"), ("concat('−', p_size, '.5')", "-(p_size + 0.5)"),
    ("concat(p_size, ' km²')", "p_size"), ("concat(p_size, '人')", "p_size"), ("concat(1990 + p_size % 30, '年')", "NULL"), ("concat(p_size, ':', p_partkey)", "NULL"),
    ("concat('约', p_size)", "NULL"), ("concat('*', p_size, '†')", "p_size"), ("translate(p_size, '0123456789', '０１２３４５６７８９')", "p_size"), ("''", "NULL"),
    ("CAST(NULL AS STRING)", "NULL"), ("concat(p_size, ' ', p_partkey)", "NULL"), ("concat('　', p_size, '　')", "p_size"), ("concat(p_size, '平方公里')", "NULL"),
    ("concat(p_size, '‰')", "p_size"), ("concat('+', p_size)", "p_size"), ("concat(p_size, 'e+1')", "NULL"), ("concat('-', p_size, '.25')", "-(p_size + 0.25)"),
]
KEYS = [
    ("concat(p_name, '（', p_size, '）')", _BARE), ("concat('，', p_name, '；')", _BARE), ("concat(p_name, '*')", _BARE), ("concat('甲（乙(', p_name, ')丁）戊')", "'甲戊'"),
    ("concat(p_name, '（未闭')", f"{_BARE} || '（未闭'"), ("concat('第', p_size, '组 v t e')", "'第' || p_size || '组'"), ("CAST(NULL AS STRING)", "''"), ("concat(' ', p_name, ' 队')", f"{_BARE} || '队'"),
]
JOIN_KEYS = [
    ("concat(p_name, '队')", _BARE), ("concat(p_name, '足球俱乐部')", _BARE), ("concat(p_name, ' 代表团')", _BARE), ("'甲队'", "'甲队'"), ("concat('甲', p_size % 10, '队')", "'甲' || p_size % 10"),
    ("concat(p_name, '足球队（', p_size, '）')", _BARE), ("p_name", _BARE), ("CAST(NULL AS STRING)", "''"),
]
UNITS = [("concat(p_size, '%')", "'%'"), ("concat(p_size, ' km²')", "'km²'"), ("CAST(p_size AS STRING)", "''"), ("concat(p_size, '平方米')", "'平方米'"), ("p_name", "NULL"), ("concat('1,000', p_type)", "NULL")]
PERIODS = [
    ("concat(1950 + p_size, '年', p_type)", "1950 + p_size, p_type"), ("concat(1850 + p_size % 49, '年')", "NULL, ''"), ("concat(1950 + p_size, '年（', p_type, '）')", "1950 + p_size, p_type"),
    ("p_type", "NULL, ''"), ("concat(1950 + p_size, ' ')", "1950 + p_size, ''"),
]
_VALUE = "(p_size + 0.125::DOUBLE * (p_partkey % 8))"
_OWN = f"CASE p_partkey % 8 WHEN 0 THEN printf('%d', p_size) WHEN 4 THEN printf('%.1f', {_VALUE}) ELSE printf('%.2f', {_VALUE}) END"
FORMATS = [("'8.50'", f"printf('%.2f', {_VALUE})"), ("'1,234'", _OWN), ("concat(p_size, '.5')", f"printf('%.1f', {_VALUE})"), ("p_name", _OWN)]
TOTALS = [("'合计'", "true"), ("concat(p_type, '小计')", "true"), ("concat('全省', p_type)", "true"), ("p_name", "false"), ("'TOTAL'", "true"), ("concat('其他', p_type)", "false"), ("concat(p_type, '其他')", "true"), ("''", "false")]
CJK = [("p_name", "false"), ("concat(p_name, '中')", "true"), ("''", "false"), ("CAST(NULL AS STRING)", "false"), ("'１２，'", "false")]
DECIMALS = [("concat('从', p_size, '.25升')", "2"), ("CAST(p_size AS STRING)", "0"), ("concat('增', p_size, '.5%')", "1"), ("CAST(NULL AS STRING)", "0"), ("concat(p_size, '.')", "0"), ("concat('a', p_size, '.125b', '.1')", "3")]
_FLOAT = "CAST(CAST({} AS DOUBLE) AS VARCHAR)"
FLOATS = [("CAST(p_size AS DOUBLE)", _FLOAT.format("p_size")), ("p_size / 8D", _FLOAT.format("p_size / 8.0::DOUBLE")), ("p_size * 1e15D", _FLOAT.format("p_size * 1e15")), ("p_size * 1e16D", _FLOAT.format("p_size * 1e16")), ("p_size / 1e6D", _FLOAT.format("p_size / 1e6")), ("CAST(NULL AS DOUBLE)", "NULL")]
ANSWERS = [
    ("""concat('{"label":"SUPPORTS","n":', p_size, '}')""", "'SUPPORTS', NULL"), ("""concat('```json\\n{"label":"refuted","n":', p_size, '}\\n```')""", "'REFUTES', NULL"), ("""concat(p_name, ' {"label":"not enough info"} ', p_type)""", "'NEI', NULL"),
    ("""concat('{"label":"NEI"} ', p_size)""", "'NEI', NULL"), ("""concat("{'label':'NEI','n':", p_size, '}')""", "'INVALID', 'invalid_json'"), ("''", "'INVALID', 'empty_output'"), ("CAST(NULL AS STRING)", "'INVALID', 'empty_output'"),
    ("""concat('{"label":"', p_type, '"}')""", "'INVALID', 'invalid_label'"), ("concat('[', p_size, ']')", "'INVALID', 'invalid_json'"),
]
OBJECTS = [("""concat('{"a": ', p_size, '}')""", "'{\"a\": ' || p_size || '}'"), ("""concat('x {"a": "', p_type, '", "b": ', p_size, '} y')""", "'{\"a\": \"' || p_type || '\", \"b\": ' || p_size || '}'"), ("concat('[', p_size, ']')", "'{}'"), ("concat('{', p_name)", "'{}'"), ("CAST(NULL AS STRING)", "'{}'")]


def _template(templates: list[tuple[str, str]], shown: Callable[[Column], dict[str, Column]]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        case = " ".join(f"WHEN {i} THEN {raw}" for i, (raw, _) in enumerate(templates))
        rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "p_size", f"CASE p_partkey % {len(templates)} {case} END AS raw")
        return rows.select("p_partkey", *[v.alias(n) for n, v in shown(F.col("raw")).items()])

    return run


def _template_sql(templates: list[tuple[str, str]], names: str) -> str:
    parts = [f"SELECT p_partkey, {value} FROM part WHERE p_partkey % {len(templates)} = {i}" for i, (_, value) in enumerate(templates)]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS x(p_partkey, {names})"


def _value() -> Column:
    return F.col("p_size") + F.lit(0.125) * (F.col("p_partkey") % 8)


CELLS = {
    "cell_parse_number": ([(raw, f"CAST({x} AS DOUBLE)") for raw, x in NUMBERS], lambda raw: {"num": C.parse_number(raw)}, "num"),
    "cell_entity_key": (KEYS, lambda raw: {"ekey": C.entity_key(raw)}, "ekey"),
    "cell_join_key": (JOIN_KEYS, lambda raw: {"jkey": C.join_key(raw)}, "jkey"),
    "cell_unit": (UNITS, lambda raw: {"unit": C.unit(raw)}, "unit"),
    "cell_period": (PERIODS, lambda raw: {"period": C.period(raw), "rest": F.when(C.period(raw).isNotNull(), C.period_rest(raw)).otherwise("")}, "period, rest"),
    "cell_format_number": (FORMATS, lambda raw: {"shown": C.format_number(_value(), raw)}, "shown"),
    "cell_total_row": (TOTALS, lambda raw: {"total": C.is_total_row(raw)}, "total"),
    "cell_has_cjk": (CJK, lambda raw: {"cjk": C.has_cjk(raw)}, "cjk"),
    "cell_decimals_stated": (DECIMALS, lambda raw: {"places": C.decimals_stated(raw)}, "places"),
    "verdict_float_text": (FLOATS, lambda raw: {"shown": V.python_float_text(raw)}, "shown"),
    "verdict_parse_label": (ANSWERS, lambda raw: {"label": V.parse_label(raw)["label"], "error": V.parse_label(raw)["error"]}, "label, error"),
    "verdict_json_object": (OBJECTS, lambda raw: {"object": V.parse_object(raw)}, "object"),
}

# ---------------------------------------------------------------- profiles of tables by region

#: Header and cell of a table's columns, over a customer with key k, place i, segment seg and balance v; then the total row's cell.
COLUMNS = [
    ("名次", "i", "''"), ("名称", "'客' || k", "'合计'"), ("类别", "'类' || seg", "''"), ("余额", "v", "sum(v)"), ("年份", "1990 + k % 20", "''"), ("基准", "1850 + k % 100", "''"),
    ("涨跌数", "CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END || (k % 7 + 1)", "''"), ("变动", "CASE WHEN k % 2 = 0 THEN '+' ELSE '-' END || (k % 7 + 1)", "''"),
    ("混合", "(k % 50) || CASE WHEN k % 2 = 0 THEN '人' ELSE '元' END", "''"), ("比率", "(k % 90) || '%'", "''"), ("固定", "'7'", "''"), ("金牌_2", "k % 11", "''"),
    ("一半", "CASE WHEN i % 2 = 0 THEN '' || (k % 9) ELSE '无' END", "''"), ("code", "k % 31", "''"), ("次数", "i", "''"), ("空", "CASE WHEN i % 3 = 0 THEN 'x' ELSE '' END", "''"),
]


#: Stretches of customers' keys that are numbered on their own.
STRETCHES = 64


def by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table for each region: its customers in the order of their keys, and a total row. No table is gathered in a row or a task.

    Rows are numbered within stretches of keys that are cut at quantiles, and moved on by the rows of the stretches before.
    """
    customer, nation = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("customer", "nation"))
    given = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("r"), "n_regionkey").alias("t"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.round("c_acctbal").cast("long").alias("v")
    )
    edges = sorted(set(given.agg(F.percentile_approx("k", [i / STRETCHES for i in range(1, STRETCHES)], 10 * STRETCHES)).first()[0] or []))  # fixed in number
    given = given.withColumn("part", F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("k"))) if edges else F.lit(0))
    earlier = Window.partitionBy("t").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = given.groupBy("t", "part").agg(F.count(F.lit(1)).alias("n")).select("t", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rows = given.withColumn("i", F.row_number().over(Window.partitionBy("t", "part").orderBy("k"))).join(F.broadcast(starts), ["t", "part"])
    rows = rows.withColumn("i", (F.col("i") + F.col("start")).cast("int"))
    array = lambda cells: F.array(*[F.expr(f"CAST({x} AS STRING)") for x in cells])
    body = rows.select("t", (F.col("i") - 1).alias("row_idx"), array(x for _, x, _ in COLUMNS).alias("x"))
    totals = given.groupBy("t").agg(F.count(F.lit(1)).cast("int").alias("row_idx"), array(x for _, _, x in COLUMNS).alias("x"))
    out = body.unionByName(totals).select(F.col("t").alias("table_id"), "row_idx", F.posexplode("x").alias("col_idx", "raw"))
    return out.select("table_id", "row_idx", "col_idx", F.get(F.array(*[F.lit(h) for h, _, _ in COLUMNS]), F.col("col_idx")).alias("header"), "raw")


def _prelude() -> str:
    cells = " UNION ALL ".join(f"SELECT t, i, {j} AS col_idx, '{h}' AS header, CAST({x} AS VARCHAR) AS raw FROM c" for j, (h, x, _) in enumerate(COLUMNS))
    return rf"""
WITH c AS (SELECT 'r' || n_regionkey AS t, c_custkey AS k, c_mktsegment AS seg, CAST(round(c_acctbal) AS BIGINT) AS v, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS i
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), x AS ({cells}
), v AS (SELECT *, raw <> '' AS filled, CASE WHEN regexp_full_match(raw, '[+-]?[0-9]+(人|元|%)?') THEN CAST(regexp_replace(raw, '[人元%]', '') AS DOUBLE) END AS num, regexp_extract(raw, '[人元%]$') AS unit FROM x
), d AS (SELECT t, col_idx, count(*) FILTER (n >= 2) AS repeated FROM (SELECT t, col_idx, raw, count(*) AS n FROM v WHERE filled GROUP BY 1, 2, 3) GROUP BY 1, 2
), m AS (SELECT t, col_idx, header, count(*) AS n, count(*) FILTER (filled) AS filled, count(num) AS nums, count(DISTINCT raw) FILTER (filled) AS keys, count(DISTINCT num) AS nvals, min(num) AS least, max(num) AS most,
  count(*) FILTER (num BETWEEN 1800 AND 2100) AS years, count(*) FILTER (raw[1] IN ('+', '-') AND num <> 0) AS signs, count(DISTINCT unit) FILTER (num IS NOT NULL) AS units, max(unit) FILTER (num IS NOT NULL) AS unit,
  coalesce(avg(length(raw)) FILTER (filled), 0) AS mean_length, count(*) FILTER (regexp_matches(raw, '[一-鿿]')) AS cjk_keys, count(*) FILTER (regexp_matches(raw, '[0-9]')) AS digit_keys FROM v GROUP BY 1, 2, 3
), s AS (SELECT m.*, coalesce(repeated, 0) AS repeated, coalesce(nums / nullif(filled, 0), 0) AS numeric, coalesce(keys / nullif(filled, 0), 0) AS uniq, nvals = nums AND least = 1 AND most = nums AS ordinal FROM m LEFT JOIN d USING (t, col_idx)
), kinds AS (SELECT *, CASE WHEN filled < greatest(3, floor(0.8 * n)) THEN 'other/sparse'
  WHEN numeric >= 0.95 THEN CASE WHEN header = '名次' THEN 'rank/' WHEN header = '年份' THEN 'other/forbidden_header' WHEN years >= 0.8 * nums THEN 'other/year_values' WHEN header = 'code' THEN 'other/non_chinese_header'
    WHEN ordinal AND nums >= 5 THEN 'rank/ordinal_sequence' WHEN signs > 0.3 * filled AND NOT regexp_matches(header, '净|差|变化|增|涨|跌|盈亏') THEN 'other/signed_change_values'
    WHEN nvals <= 1 THEN 'other/constant' WHEN units > 1 THEN 'other/mixed_units' WHEN header LIKE '%\_2' ESCAPE '\' THEN 'other/duplicate_header' ELSE 'metric/' END
  WHEN numeric <= 0.2 THEN CASE WHEN uniq >= 0.95 AND mean_length BETWEEN 2 AND 24 AND cjk_keys >= 0.8 * filled THEN 'key/'
    WHEN keys BETWEEN 2 AND greatest(2, floor(n / 2)) AND repeated >= 2 AND mean_length <= 12 AND digit_keys <= 0.2 * filled THEN 'category/' ELSE 'text/' END
  ELSE 'other/' END AS kr FROM s
), p AS (SELECT *, t AS table_id, string_split(kr, '/')[1] AS kind, string_split(kr, '/')[2] AS reason FROM kinds)
"""


def _tables(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    return P.profile_cells(by_region(spark, sf_dir), steps_of(spark, name))


def _profiled(name: str, shown: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shown(*_tables(spark, sf_dir, name))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to look up in the tables: customers' own, marked or with a suffix, in their region's table or another's."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    name = F.concat(F.lit("客"), k.cast("string"), F.when(k % 3 == 0, "队").when(k % 3 == 1, "*").otherwise("（甲）"))
    return c.select(F.concat(F.lit("r"), (F.col("n_regionkey") + (k % 4 == 0).cast("int")) % 5).alias("table_id"), name.alias("name"))


def _lookup(loose: bool, unique: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: P.lookup(*_tables(spark, sf_dir, f"lookup {loose} {unique}"), _asked(spark, sf_dir), loose=loose, unique=unique)


_LOOKUP = """, a AS (SELECT 'r' || ((n_regionkey + CAST(c_custkey % 4 = 0 AS INT)) % 5) AS t, c_custkey AS k, '客' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '队' WHEN 1 THEN '*' ELSE '（甲）' END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c.t AS table_id, name, i - 1 AS row_idx FROM a JOIN c ON a.t = c.t AND a.k = c.k"""


def _wanted_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("r"), k % 7).alias("table_id"), k.cast("int").alias("row_idx"), (k % 18).cast("int").alias("col_idx"))


PROFILES = {
    "prof_kind": (lambda kept, p: p.select("table_id", "col_idx", "kind", "reason"), "SELECT table_id, col_idx, kind, reason FROM p"),
    "prof_ratios": (
        lambda kept, p: p.select("table_id", "col_idx", "numeric_ratio", "unique_ratio", "unit", "is_rate"),
        """SELECT table_id, col_idx, round(numeric, 3) AS numeric_ratio, round(uniq, 3) AS unique_ratio, CASE WHEN units = 1 AND (kind = 'metric' OR reason IN ('constant', 'duplicate_header')) THEN unit ELSE '' END AS unit,
        header = '比率' AND kind = 'metric' AS is_rate FROM p""",
    ),
    "prof_key": (lambda kept, p: P.key_columns(p), "SELECT table_id, min(col_idx) AS key FROM p WHERE kind = 'key' GROUP BY 1"),
    "prof_rank": (lambda kept, p: P.rank_columns(p), "SELECT table_id, min(col_idx) AS rank FROM p WHERE kind = 'rank' GROUP BY 1"),
    "prof_total_row_removal": (lambda kept, p: kept.select("table_id", "row_idx").distinct(), "SELECT t AS table_id, i - 1 AS row_idx FROM c"),
    "prof_usable": (lambda kept, p: P.usable(kept, p), "SELECT table_id, bool_or(kind = 'key') AND bool_or(kind = 'metric') AND max(n) >= 4 AS usable FROM p GROUP BY 1"),
    "prof_metric_columns": (lambda kept, p: P.metric_columns(p).select("table_id", "col_idx", "header", "unit"), "SELECT table_id, col_idx, header, unit FROM p WHERE kind = 'metric'"),
    "prof_category_columns": (lambda kept, p: P.category_columns(p), "SELECT table_id, col_idx, header FROM p WHERE kind = 'category'"),
    "prof_rare_kinds": (lambda kept, p: p.where("reason <> ''").groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "SELECT reason, count(*) AS n FROM p WHERE reason <> '' GROUP BY 1"),
    "prof_key_values": (lambda kept, p: P.key_values(kept, p), "SELECT t AS table_id, i - 1 AS row_idx, '客' || k AS ekey FROM c WHERE t IN (SELECT t FROM p WHERE kind = 'key')"),
    "prof_column_by_header": (
        lambda kept, p: P.column_by_header(p, p.where("col_idx % 2 = 0").select("table_id", F.col("header"))),
        "SELECT table_id, header, col_idx FROM p WHERE col_idx % 2 = 0",
    ),
}


def prof_cell_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cell_at(_tables(spark, sf_dir, "prof_cell_at")[0], _wanted_cells(spark, sf_dir))


_CELL_AT = "SELECT v.t AS table_id, i - 1 AS row_idx, col_idx, raw FROM v JOIN customer ON v.t = 'r' || c_custkey % 7 AND i - 1 = c_custkey AND col_idx = c_custkey % 18"

def prof_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the tables of all regions after those of three had been profiled: the store is read for these."""
    steps = steps_of(spark, "prof_store")
    cells = steps.table(by_region(spark, sf_dir), "given")
    store = f"{steps.root}/store"
    P.stored_profile(cells.where("table_id < 'r3'"), store, steps)
    return P.stored_profile(cells, store, steps).select("table_id", "col_idx", "kind", "known")


QUERIES = {n: _template(t, shown) for n, (t, shown, _) in CELLS.items()} | {n: _profiled(n, f) for n, (f, _) in PROFILES.items()}
QUERIES |= {"prof_store": prof_store, "prof_cell_at": prof_cell_at, "prof_lookup_loose": _lookup(True, False), "prof_lookup_unique": _lookup(False, True)}
ORACLES = {n: _template_sql(t, names) for n, (t, _, names) in CELLS.items()} | {n: _prelude() + sql for n, (_, sql) in PROFILES.items()}
ORACLES["prof_store"] = _prelude() + "SELECT table_id, col_idx, kind, table_id < 'r3' AS known FROM p"
ORACLES |= {"prof_cell_at": _prelude() + _CELL_AT, "prof_lookup_loose": _prelude() + _LOOKUP, "prof_lookup_unique": _prelude() + _LOOKUP + " WHERE a.k % 3 <> 0"}
