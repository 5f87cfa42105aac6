"""Chains of all statements at once give what each gives by itself."""

import json

import pytest

from tabwright.operators import algebra, setwise
from tabwright.sources.scratch import Steps

TABLES = [
    {"headers": ["国家", "金牌", "银牌"], "rows": [["挪威", "16", "8"], ["德国", "12", "10"], ["中国", "9", "4"], ["美国", "9", "10"], ["x", "y"]]},
    {"headers": ["a", "b"], "rows": [[" 挪威 ", "1,200"], ["", "3"], ["美国", "−4"], ["美国", "5"]]},
    {"headers": ["e"], "rows": []},
]
NEI = {"label": "NEI"}
CHAINS = [
    [{"op": "sort", "table": "t0", "column": 0, "numeric": False, "descending": True}, {"op": "select_rows", "table": "s1", "rows": [2, 0]}, {"label": "supports"}],
    [{"op": "sort", "table": "t0", "column": 1}, NEI],
    [{"op": "select_rows", "table": "t0", "rows": [0, 1, 2, 3]}, {"op": "sort", "table": "s1", "column": 1, "descending": True}, {"op": "derive", "table": "s2", "left": 1, "right": 2, "method": "ratio"}, {"label": "refute"}],
    [{"op": "join", "table": "t0", "other": "t1", "left": 0, "right": 0}, {"op": "aggregate", "table": "s1", "column": 4, "method": "sum"}, {"label": "Supported"}],
    [{"op": "select_columns", "table": "t0", "columns": [2, 0]}, {"op": "aggregate", "table": "s1", "column": 0, "method": "mean"}, NEI],
    [{"op": "select_rows", "table": "t0", "rows": []}, {"label": "maybe"}],
    [{"op": "select_rows", "table": "t0", "rows": [1.0]}, NEI],
    [{"op": "sort", "table": "t0", "column": True}, NEI],
    [],
]
FAIL = [
    [{"op": "aggregate", "table": "t2", "column": 0, "method": "count"}, NEI], [{"op": "select_rows", "table": "t0", "rows": [5]}, NEI],
    [{"op": "select_rows", "table": "t0", "rows": [1, 1]}, NEI], [{"op": "select_rows", "table": "t0", "rows": [True]}, NEI],
    [{"op": "sort", "table": "t0", "column": 0, "numeric": 1}, NEI], [{"op": "sort", "table": "t0", "column": 0, "numeric": None}, NEI],
    [{"op": "x", "table": "t0"}, NEI], [{"op": "sort", "table": "t9"}, NEI], [{"op": "select_columns", "table": "t0", "columns": []}, NEI],
    [{"op": "derive", "table": "t0", "left": 1, "right": 1, "method": "power"}, NEI], [{"op": "join", "table": "t0", "left": 0, "right": 0}, NEI],
    [{"op": "join", "table": "t0", "other": "t1", "left": 0, "right": 2}, NEI], [{"op": "aggregate", "table": "t1", "column": 0, "method": "sum"}, NEI],
]
OTHERS = [
    ([NEI], "NEI", "answered"), ([{"label": None}], "INVALID", "invalid_label"), ([{"label": 7}], "INVALID", "invalid_label"),
    ([{"op": "group_count", "table": "t0", "column": 0}], "INVALID", "no_final_label"),
    ([*[{"op": "sort", "table": "t0", "column": 0, "numeric": False}] * 3, NEI], "NEI", "answered"),
    ([*[{"op": "sort", "table": "t0", "column": 0, "numeric": False}] * 4, NEI], "INVALID", "no_final_label"),
    ([{"op": "join", "table": "t0", "other": "t2", "left": 0, "right": 0}, {"op": "group_count", "table": "s1", "column": 0}, NEI], "NEI", "answered"),
]


@pytest.fixture(scope="module")
def run(spark):
    chains = [*CHAINS, *FAIL, *[c for c, _, _ in OTHERS]]
    big = [{"headers": ["k"], "rows": [["a"]] * 50}, {"headers": ["k"], "rows": [["a"]] * 41}]
    long = [{"headers": ["k"], "rows": [["a", "b"]]}]
    rows = [(str(i), TABLES, [json.dumps(x) for x in c]) for i, c in enumerate(chains)]
    rows.append(("big", big, ['{"op":"join","table":"t0","other":"t1","left":0,"right":0}', '{"label":"NEI"}']))
    rows.append(("long", long, ['{"op":"sort","table":"t0","column":0,"numeric":false}', '{"label":"NEI"}']))
    rows.append(("text", TABLES, ["no json", '{"label":"NEI"}']))
    claims = spark.createDataFrame(rows, "claim_id string, tables array<struct<headers:array<string>,rows:array<array<string>>>>, actions array<string>")
    with Steps(spark) as steps:
        out = setwise.run_chains(*setwise.from_packages(claims), claims.select("claim_id", "actions"), steps)
        verdicts = {r["claim_id"]: r for r in out.verdicts.collect()}
        tables: dict = {}
        for r in out.rows.where("name LIKE 's%'").collect():
            tables.setdefault((r["claim_id"], r["name"]), {})[r["row"]] = [c["t"] for c in r["cells"]]
        headers = {(r["claim_id"], r["name"]): r["headers"] for r in out.headers.collect()}
    return verdicts, tables, headers


def test_as_one_by_one(spark, run):
    verdicts, tables, headers = run
    for i, chain in enumerate(CHAINS):
        label, status, known = algebra.run_chain(algebra.tables_of(spark, {"tables": TABLES}), chain)
        assert (verdicts[str(i)]["label"], verdicts[str(i)]["status"]) == (label, status), chain
        for name in known if status != algebra.FAILED else ():
            if name.startswith("s"):
                names = [c for c in known[name].columns if c != "_row"]
                want = [[str(r[c]) for c in names] for r in known[name].orderBy("_row").collect()]
                found = tables.get((str(i), name), {})
                assert sorted(found) == list(range(len(want))) and [found[k] for k in sorted(found)] == want
                assert headers[str(i), name] == names


def test_what_fails(run):
    verdicts = run[0]
    for i in range(len(CHAINS), len(CHAINS) + len(FAIL)):
        assert (verdicts[str(i)]["label"], verdicts[str(i)]["status"]) == ("INVALID", algebra.FAILED), FAIL[i - len(CHAINS)]
    assert [verdicts[x]["reason"] for x in ("big", "long", "text")] == ["join_row_limit", "non_rectangular_table", "unknown_table"]


def test_how_chains_end(run):
    for i, (chain, label, status) in enumerate(OTHERS, len(CHAINS) + len(FAIL)):
        assert (run[0][str(i)]["label"], run[0][str(i)]["status"]) == (label, status), chain


def test_given_rows_are_made_once(spark):
    """Rows and headers that come from a plan are written before the first step: each step reads them several times."""
    rows, headers = setwise.from_packages(spark.createDataFrame([("1", TABLES[:1])], "claim_id string, tables array<struct<headers:array<string>,rows:array<array<string>>>>"))
    with Steps(spark) as steps:
        out = setwise.run_chains(rows, headers, spark.createDataFrame([("1", ['{"op":"sort","table":"t0","column":1,"descending":true}', '{"label":"NEI"}'])], "claim_id string, actions array<string>"), steps)
        plan = out.rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "LogicalRDD" not in plan and out.rows.where("name = 't0'").count() == 5
