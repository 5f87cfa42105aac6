"""Queries of table profiles' rarer branches, accessors, prompts, errors of the algebra, files and scalar SQL."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators import algebra as A
from tabwright.operators import metrics as M
from tabwright.operators import profile as P
from tabwright.operators import prompts
from tabwright.operators import sqlsurface as S
from tabwright.plans.cell_queries import tables, values_sql
from tabwright.plans.relational_queries import _guarded, parts, read
from tabwright.sources import files
from tabwright.sources.scratch import shared_dir

#: Tables whose columns reach the branches of the numeric and the middle rules that ordinary ones do not.
RARE = [
    ("r1", ["国家", "面积", "次数", "涨跌值", "变动值", "单位混合", "固定值", "金牌_2", "一半数"], [
        ["甲国", "1901", "1", "+3", "+3", "5人", "7", "4", "1"], ["乙国", "1950", "2", "-4", "-4", "6人", "7", "5", "2"],
        ["丙国", "1999", "3", "+5", "+5", "7元", "7", "6", "x"], ["丁国", "2003", "4", "-6", "-6", "8元", "7", "8", "y"],
        ["戊国", "2010", "5", "+7", "+7", "9元", "7", "9", "z"],
    ]),
    ("r2", ["国家", "金牌"], []),
]
#: table, column, kind and reason, worked out by hand: year values, an ordinal sequence, signed change with and without a
#: change word in the header, mixed units, a constant, a repeated header, and a column between numbers and text.
RARE_KINDS = [
    ("r1", 0, "key", ""), ("r1", 1, "other", "year_values"), ("r1", 2, "rank", "ordinal_sequence"), ("r1", 3, "metric", ""), ("r1", 4, "other", "signed_change_values"),
    ("r1", 5, "other", "mixed_units"), ("r1", 6, "other", "constant"), ("r1", 7, "other", "duplicate_header"), ("r1", 8, "other", ""),
    ("r2", 0, "other", "sparse"), ("r2", 1, "other", "sparse"),
]


def rare_tables(spark) -> DataFrame:
    return spark.createDataFrame(RARE, "table_id string, headers array<string>, rows array<array<string>>")


def prof_rare_kinds(spark, sf_dir):
    return P.profile_tables(rare_tables(spark))[1].select("table_id", "col_idx", "kind", "reason")


def prof_metric_columns(spark, sf_dir):
    return P.metric_columns(P.profile_tables(tables(spark))[1]).select("table_id", "col_idx", "header", "unit")


def prof_category_columns(spark, sf_dir):
    return P.category_columns(P.profile_tables(tables(spark))[1])


def prof_column_by_header(spark, sf_dir):
    wanted = spark.createDataFrame([("t1", "银牌"), ("t2", "积分"), ("t2", "没有"), ("t3", "甲")], "table_id string, header string")
    return P.column_by_header(P.profile_tables(tables(spark))[1], wanted)


def prof_key_values(spark, sf_dir):
    return P.key_values(*P.profile_tables(tables(spark)))


def prof_cell_at(spark, sf_dir):
    wanted = spark.createDataFrame([("t1", 0, 1), ("t1", 4, 1), ("t2", 3, 2), ("t3", 0, 1), ("t3", 0, 9)], "table_id string, row_idx int, col_idx int")
    return P.cell_at(P.profile_tables(tables(spark))[0], wanted)


#: Chains of actions over a table of parts, and what they end with.
CHAINS = [
    ("holds", [{"op": "aggregate", "table": "t0", "column": 2, "method": "max"}, {"label": "supports"}], "SUPPORTS", "answered"),
    ("text_cell", [{"op": "aggregate", "table": "t0", "column": 1, "method": "sum"}, {"label": "supports"}], "INVALID", "invalid_table_operation"),
    ("bad_row", [{"op": "select_rows", "table": "t0", "rows": [0, 99999999]}, {"label": "supports"}], "INVALID", "invalid_table_operation"),
    ("negative_row", [{"op": "select_rows", "table": "t0", "rows": [-1]}, {"label": "supports"}], "INVALID", "invalid_table_operation"),
    ("empty_mean", [{"op": "select_rows", "table": "t0", "rows": []}, {"op": "aggregate", "table": "s1", "column": 2, "method": "mean"}, {"label": "refutes"}], "INVALID", "invalid_table_operation"),
    ("failure_in_the_middle", [{"op": "sort", "table": "t0", "column": 1, "numeric": True}, {"op": "select_columns", "table": "t0", "columns": [0]}, {"label": "nei"}], "INVALID", "invalid_table_operation"),
    ("failure_without_label", [{"op": "aggregate", "table": "t0", "column": 1, "method": "min"}] * 3, "INVALID", "invalid_table_operation"),
    ("no_label", [{"op": "select_columns", "table": "t0", "columns": [0]}] * 4, "INVALID", "no_final_label"),
    ("unknown_label", [{"label": "perhaps"}], "INVALID", "invalid_label"),
]


def alg_chain_ends(spark, sf_dir):
    few = {"t0": parts(spark, sf_dir).filter("_row < 20")}
    return spark.createDataFrame([(name, *A.run_chain(few, actions)[:2]) for name, actions, *_ in CHAINS], "name string, label string, status string")


def alg_package_tables(spark, sf_dir):
    """The tables of a package by the algebra's names; a short row is filled with empty cells."""
    package = {"tables": [{"headers": ["国", "金", "金"], "rows": [["挪威", "16", "8"], ["德国", "12"]]}, {"headers": ["a"], "rows": [["x"]]}]}
    named = A.tables_of(spark, package)
    long = [df.select(F.lit(n).alias("name"), "_row", F.concat_ws("|", *[A.cell(df, c) for c in A.columns(df)]).alias("cells")) for n, df in named.items()]
    return long[0].unionByName(long[1])


_RECORD = {"id": "7", "claim": "挪威有16枚金牌", "tables": [{"table_id": "t", "title": None, "headers": ["国", "金"], "rows": [["挪威", "16"]], "extra": 1}],
           "program": {"skeleton_id": "ST_SUM", "operators": ["sum"], "slots": {}}, "context_cells": [{"table_id": "t", "row": 0, "col": 1, "raw_value": "16"}]}
_HEAD = "\n\n".join([prompts.LABEL_DEFINITIONS, prompts.ROUNDING, prompts.ANSWER_FORMAT, "Claim: 挪威有16枚金牌"])
_TABLES = '\n\nTables:\nTable t: \nHeaders: ["国", "金"]\nRows: [["挪威", "16"]]'
PROMPTS = [
    ("claim-only", _HEAD + "\n\nNo tables are provided in this setting."),
    ("full-table", _HEAD + _TABLES),
    ("oracle-evidence", _HEAD + _TABLES + '\n\nRelevant cells (gold): [["t", 0, 1, "16"]]'),
    ("oracle-program", _HEAD + _TABLES + '\n\nVerification program (operators to apply over the tables): {"skeleton": "ST_SUM", "operators": ["sum"]}'),
]


def llm_prompts(spark, sf_dir):
    path = Folder(spark, "prompts").write("c.jsonl", [_RECORD])
    out = None
    for setting, _ in PROMPTS:
        df = prompts.read_prompts(spark, path, setting).select(F.lit(setting).alias("setting"), "prompt")
        out = df if out is None else out.unionByName(df)
    return out


class Folder:
    """Files of a few lines for queries about readers: in the folder that driver and executors share, where one is named."""

    def __init__(self, spark, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"

    def write(self, name: str, lines: list[dict | str]) -> str:
        path = f"{self.root}/{name}"
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        out = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray("".join((x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) + "\n" for x in lines).encode()))
        out.close()
        return path


_LINES = [{"id": "1", "label": "NEI", "status": "x"}, {"id": "2", "status": "x"}, {"id": "1", "label": "SUPPORTS", "status": "y"}]
LAST = [("1", "SUPPORTS", "y"), ("2", "INVALID", "x")]


def src_last_line_wins(spark, sf_dir):
    return files.read_predictions(spark, Folder(spark, "predictions").write("p.jsonl", _LINES))


def src_run_folder(spark, sf_dir):
    folder = Folder(spark, "runs")
    for name in ("system_a", "system_b"):
        folder.write(f"{name}/predictions.jsonl", _LINES if name == "system_a" else _LINES[:2])
    return files.read_run_folder(spark, folder.root)


def src_named_inputs(spark, sf_dir):
    path = Folder(spark, "named").write("p.jsonl", _LINES)
    return files.read_named(spark, files.parse_named([f"one={path}", f"two={path}"]))


def src_claims(spark, sf_dir):
    """Statements by id with a limit; the reader's schema keeps tables and evidence."""
    lines = [{**_RECORD, "id": str(i)} for i in (3, 1, 2)]
    claims = files.read_claims(spark, Folder(spark, "claims").write("c.jsonl", lines), limit=2)
    return claims.select("id", F.col("tables")[0]["rows"][0][1].alias("cell"), F.col("context_cells")[0]["raw_value"].alias("evidence"))


def src_prediction_sink(spark, sf_dir):
    """Predictions written twice: the sink appends, the reader takes the last line."""
    folder = Folder(spark, "sink")
    for label in ("NEI", "REFUTES"):
        files.write_predictions(spark.createDataFrame([("1", label, "x")], "id string, label string, status string").coalesce(1), f"{folder.root}/{label}")
    return files.read_named(spark, {label: f"{folder.root}/{label}" for label in ("NEI", "REFUTES")})


def src_report_sink(spark, sf_dir):
    """A report replaces the one before it."""
    path = f"{Folder(spark, 'report').root}/report"
    for n in (1, 2):
        files.write_report(spark.createDataFrame([("accuracy", n)], "name string, value long"), path)
    return spark.read.schema("name string, value long").json(path)


def src_raw_input_hash(spark, sf_dir):
    """Hashes of raw records: absent fields are null, unknown keys of tables count."""
    records = [_RECORD, {"id": "8", "claim": "甲"}]
    return files.read_input_hashes(spark, Folder(spark, "raw").write("c.jsonl", records))


_NULLS = '"evidence_cells": null, '
HASHED_TEXTS = [
    ("7", '{"claim": "挪威有16枚金牌", "context_cells": [{"col": 1, "raw_value": "16", "row": 0, "table_id": "t"}], ' + _NULLS
     + '"program": {"operators": ["sum"], "skeleton_id": "ST_SUM", "slots": {}}, "tables": [{"extra": 1, "headers": ["国", "金"], "rows": [["挪威", "16"]], "table_id": "t", "title": null}]}'),
    ("8", '{"claim": "甲", "context_cells": null, ' + _NULLS + '"program": null, "tables": null}'),
]


def src_pending_calls(spark, sf_dir):
    """Of records with a status, those with a failed call are run again."""
    done = spark.createDataFrame(
        [("1", "answered", [(None,)]), ("2", "answered", [(("timeout",),)]), ("3", None, []), ("4", "answered", None), ("5", "answered", [((None,),), (("",),)])],
        "id string, status string, api_calls array<struct<api: struct<error: string>>>",
    )
    claims = spark.createDataFrame([(str(i),) for i in range(1, 7)], "id string")
    return files.pending(claims, done, "calls")


def src_run_identity(spark, sf_dir):
    """Whether a run folder accepts settings: other data or settings are refused, other workers are not."""
    folder = Folder(spark, "identity")
    a, b = folder.write("a.jsonl", [{"x": 1}]), folder.write("b.jsonl", [{"x": 2}])
    out = []
    for name, settings, data in (("first", {"model": "m", "workers": 1}, a), ("again", {"model": "m", "workers": 9}, a), ("data", {"model": "m"}, b), ("model", {"model": "n"}, a)):
        try:
            files.prepare_run(spark, f"{folder.root}/run", {**settings, "name": "fixed"}, data=(data,))
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, accepted boolean")


def m_call_counts(spark, sf_dir):
    rows = [("1", [((None,),), (("timeout",),)], [("s1",), (None,)]), ("2", [], None), ("3", None, [("s1",), ("s2",)]), ("4", [(("",),), None], [])]
    return M.call_counts(spark.createDataFrame(rows, "id string, api_calls array<struct<api: struct<error: string>>>, operations array<struct<result: string>>"))


def m_report_lines(spark, sf_dir):
    rows = [("b", 0.5, 0.25, 3), ("a", 1.0, 0.875, 0)]
    return spark.createDataFrame([(x,) for x in M.report_lines(spark.createDataFrame(rows, "system string, accuracy double, macro_f1 double, invalid long"))], "line string")


SQL_GUARD = [
    ("SELECT java_method('java.lang.System', 'getProperty', 'user.name')", "not_read_only_select"), ("SELECT reflect('a', 'b')", "not_read_only_select"),
    ("SELECT try_reflect('a', 'b')", "not_read_only_select"), ("SELECT * FROM text.`/etc/hostname`", "not_read_only_select"),
    ("SELECT 1 WHERE EXISTS (SELECT * FROM parquet.`/x`)", "not_read_only_select"), ("SELECT (SELECT max(x) FROM csv.`/x`)", "not_read_only_select"),
    ("WITH t AS (SELECT 1 AS a) INSERT INTO x SELECT * FROM t", "not_read_only_select"), ("WITH t AS (SELECT * FROM json.`/x`) SELECT 1", "not_read_only_select"),
    ("SELECT a FROM (SELECT reflect('a', 'b') AS a) AS t", "not_read_only_select"), ("SELECT count(*) FROM a JOIN b ON a.x = b.x GROUP BY a.y HAVING count(*) > 1", "ok"),
    ("SELECT x IN (SELECT y FROM b) FROM a ORDER BY 1 LIMIT 2 OFFSET 1", "ok"), ("SELECT * FROM (VALUES (1), (2)) AS t(x) WHERE x > (SELECT avg(x) FROM a)", "ok"),
]


def sql_guard_whole_plan(spark, sf_dir):
    rows = [(q, (S.guard(spark, q, strict) or "ok").split(":")[0]) for q, _ in SQL_GUARD for strict in (False,)]
    return spark.createDataFrame(rows, "q string, result string")


#: SQLite statements and their value as text.
SQLITE = [
    ('SELECT "c_name" FROM customer WHERE c_custkey = 1', "Customer#000000001"), ("SELECT 7 / 2", "3"), ("SELECT 7.0 / 2", "3.5"), ("SELECT '7 / 2 \"x\"'", '7 / 2 "x"'),
    ("SELECT count(*) FROM region WHERE r_name LIKE 'as%'", "1"), ("SELECT (SELECT count(*) FROM nation) / 2", None), ("SELECT count(*) / 2 FROM nation", "12"),
]


def sql_from_sqlite(spark, sf_dir):
    for name in ("customer", "region", "nation"):
        read(spark, sf_dir, name).createOrReplaceTempView(name)
    rows = []
    for q, want in SQLITE:
        if want is not None:
            seen = S.run_sql(spark, S.from_sqlite(q))
            value = seen.rows[0][0] if seen.rows else None
            rows.append((q, f"{float(value):g}" if not isinstance(value, (str, int)) else str(value)))
    return spark.createDataFrame(rows, "q string, value string")


def sql_no_views_left(spark, sf_dir):
    """A conversation's steps end with it: the next one does not see them."""
    first = S.converse(spark, [{"sql": "SELECT 3 AS n"}, {"final_label": "NEI"}])
    later = S.converse(spark, [{"sql": "SELECT n FROM step1"}, {"final_label": "NEI"}])
    return spark.createDataFrame([(first[2][0].error is None, later[2][0].error is None)], "first_ran boolean, later_saw_it boolean")


def sql_cost_bound(spark, sf_dir):
    """A statement over its time limit is cancelled and reported as an error."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    slow = "SELECT count(*) FROM orders a JOIN orders b ON a.o_orderkey <> b.o_orderkey JOIN orders c ON a.o_totalprice + c.o_totalprice <> b.o_totalprice"
    seen = S.run_sql(spark, slow, seconds=0.3)
    return spark.createDataFrame([(bool(seen.error), len(seen.rows))], "cancelled boolean, shown int")


_STRINGS = (
    "SELECT c_custkey, upper(substr(c_name, 1, 3)) AS head, length(trim('  ' || c_mktsegment || ' ')) AS n, replace(c_name, '#', '-') AS dashed, "
    "coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, instr(c_name, '#') AS at, lpad(cast(c_nationkey AS STRING), 3, '0') AS code FROM customer"
)
_DATES = (
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_format(o_orderdate, 'yyyy-MM') AS ym, "
    "datediff(o_orderdate, DATE'1992-01-01') AS days FROM orders"
)
_NUMBERS = "SELECT s_suppkey, round(s_acctbal, 1) AS r, abs(s_acctbal) AS a, sign(s_acctbal) AS s, CAST(floor(s_acctbal) AS BIGINT) AS f, s_suppkey % 7 AS m, greatest(s_suppkey, 10) AS g FROM supplier"
_JSON = "SELECT n_nationkey, get_json_object('{\"k\": ' || n_nationkey || ', \"l\": [1, ' || n_regionkey || ']}', '$.l[1]') AS second FROM nation"

QUERIES = {
    "sql_scalar_strings": lambda spark, sf_dir: _unguarded(spark, sf_dir, _STRINGS),
    "sql_scalar_dates": _guarded(_DATES),
    "sql_scalar_numbers": _guarded(_NUMBERS),
    "sql_scalar_json": _guarded(_JSON),
    **{f.__name__: f for f in (
        prof_rare_kinds, prof_metric_columns, prof_category_columns, prof_column_by_header, prof_key_values, prof_cell_at, alg_chain_ends, alg_package_tables,
        llm_prompts, src_last_line_wins, src_run_folder, src_named_inputs, src_claims, src_prediction_sink, src_report_sink, src_raw_input_hash,
        src_pending_calls, src_run_identity, m_call_counts, m_report_lines, sql_guard_whole_plan, sql_from_sqlite, sql_no_views_left, sql_cost_bound,
    )},
}


def _unguarded(spark, sf_dir, sql: str) -> DataFrame:
    """``replace`` is a function here, while the strict guard refuses the word: the plan guard alone decides."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    if why := S.guard(spark, sql, strict=False):
        raise ValueError(why)
    return spark.sql(sql)


ORACLES = {
    "sql_scalar_strings": _STRINGS.replace("STRING", "VARCHAR"),
    "sql_scalar_dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, strftime(o_orderdate, '%Y-%m') AS ym, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders",
    "sql_scalar_numbers": _NUMBERS,
    "sql_scalar_json": "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS second FROM nation",
    "prof_rare_kinds": values_sql(RARE_KINDS, ["table_id", "col_idx", "kind", "reason"], ["VARCHAR", "INT", "VARCHAR", "VARCHAR"]),
    "prof_metric_columns": values_sql([("t1", 1, "金牌", ""), ("t1", 2, "银牌", ""), ("t2", 3, "积分", ""), ("t2", 5, "胜率", "%")], ["table_id", "col_idx", "header", "unit"], ["VARCHAR", "INT", "VARCHAR", "VARCHAR"]),
    "prof_category_columns": values_sql([("t2", 2, "赛区")], ["table_id", "col_idx", "header"], ["VARCHAR", "INT", "VARCHAR"]),
    "prof_column_by_header": values_sql([("t1", "银牌", 2), ("t2", "积分", 3), ("t3", "甲", 0)], ["table_id", "header", "col_idx"], ["VARCHAR", "VARCHAR", "INT"]),
    "prof_key_values": values_sql(
        [("t1", 0, "挪威"), ("t1", 1, "德国"), ("t1", 2, "中国"), ("t1", 3, "美国"), ("t2", 0, "武汉三镇"), ("t2", 1, "山东泰山"), ("t2", 2, "浙江队"), ("t2", 3, "上海海港")],
        ["table_id", "row_idx", "ekey"], ["VARCHAR", "INT", "VARCHAR"],
    ),
    "prof_cell_at": values_sql([("t1", 0, 1, "16"), ("t2", 3, 2, "南区"), ("t3", 0, 1, "")], ["table_id", "row_idx", "col_idx", "raw"], ["VARCHAR", "INT", "INT", "VARCHAR"]),
    "alg_chain_ends": values_sql([(n, x, s) for n, _, x, s in CHAINS], ["name", "label", "status"], ["VARCHAR"] * 3),
    "alg_package_tables": values_sql([("t0", 0, "挪威|16|8"), ("t0", 1, "德国|12|"), ("t1", 0, "x")], ["name", "_row", "cells"], ["VARCHAR", "BIGINT", "VARCHAR"]),
    "llm_prompts": values_sql(PROMPTS, ["setting", "prompt"], ["VARCHAR", "VARCHAR"]),
    "src_last_line_wins": values_sql(LAST, ["id", "label", "status"], ["VARCHAR"] * 3),
    "src_run_folder": values_sql([("system_a", "1", "SUPPORTS"), ("system_a", "2", "INVALID"), ("system_b", "1", "NEI"), ("system_b", "2", "INVALID")], ["system", "id", "label"], ["VARCHAR"] * 3),
    "src_named_inputs": values_sql([(s, i, x) for s in ("one", "two") for i, x, _ in LAST], ["system", "id", "label"], ["VARCHAR"] * 3),
    "src_claims": values_sql([("1", "16", "16"), ("2", "16", "16")], ["id", "cell", "evidence"], ["VARCHAR"] * 3),
    "src_prediction_sink": values_sql([("NEI", "1", "NEI"), ("REFUTES", "1", "REFUTES")], ["system", "id", "label"], ["VARCHAR"] * 3),
    "src_report_sink": "SELECT 'accuracy' AS name, CAST(2 AS BIGINT) AS value",
    "src_raw_input_hash": "SELECT id, sha256(text) AS input_sha256 FROM (" + values_sql(HASHED_TEXTS, ["id", "text"], ["VARCHAR", "VARCHAR"]) + ")",
    "src_pending_calls": values_sql([("2",), ("3",), ("6",)], ["id"], ["VARCHAR"]),
    "src_run_identity": values_sql([("first", True), ("again", True), ("data", False), ("model", False)], ["name", "accepted"], ["VARCHAR", "BOOLEAN"]),
    "m_call_counts": "SELECT CAST(1 AS BIGINT) AS api_failures, CAST(3 AS BIGINT) AS operations_executed",
    "m_report_lines": values_sql([("a" + " " * 39 + "  100.0     87.5       0",), ("b" + " " * 39 + "   50.0     25.0       3",)], ["line"], ["VARCHAR"]),
    "sql_guard_whole_plan": values_sql(SQL_GUARD, ["q", "result"], ["VARCHAR", "VARCHAR"]),
    "sql_from_sqlite": values_sql([x for x in SQLITE if x[1] is not None], ["q", "value"], ["VARCHAR", "VARCHAR"]),
    "sql_no_views_left": "SELECT true AS first_ran, false AS later_saw_it",
    "sql_cost_bound": "SELECT true AS cancelled, CAST(0 AS INT) AS shown",
}
