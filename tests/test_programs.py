"""Programs from records on small tables: what is stated decides, what is missing leaves a statement undecided."""

import pytest

from tabwright.operators import profile, programs
from tabwright.sources.scratch import Steps

TEAMS = ("teams", ["球队", "联赛", "积分", "名次"], [["甲队", "北", "30", "1"], ["乙队", "北", "30", "2"], ["丙队", "南", "12.5", "3"], ["丁队", "南", "", "4"], ["重复", "南", "5", "5"], ["重复", "南", "6", "6"]])
MEN = ("men", ["球员", "球队", "进球"], [["一", "甲队", "9"], ["二", "甲队", "4"], ["三", "丙队", "7"], ["四", "无此队", "1"]])
B = {"table": "men", "column": "进球", "by": "球队", "table2": "teams", "column2": "积分"}
T = {"table": "teams", "column": "积分"}
CASES = [
    ("ST_DIFF", {**T, "a": "甲队", "b": "丙队", "value": "17.5"}, "SUPPORTS"), ("ST_DIFF", {**T, "a": "甲队", "b": "丙队", "value": "18"}, "SUPPORTS"),
    ("ST_DIFF", {**T, "a": "甲队", "b": "丙队", "value": "17.4"}, "REFUTES"), ("ST_DIFF", {**T, "a": "甲队", "b": "丁队", "value": "1"}, "NEI"),
    ("ST_DIFF", {**T, "a": "甲队", "b": "重复", "value": "1"}, "NEI"), ("ST_DIFF", {**T, "a": "甲队", "b": "丙队"}, "NEI"),
    ("ST_DIFF", {"table": "none", "column": "积分", "a": "甲队", "b": "丙队", "value": "1"}, "NEI"), ("ST_DIFF", {**T, "column": "亚军", "a": "甲队", "b": "丙队", "value": "1"}, "NEI"),
    ("ST_SUPERLATIVE", {**T, "a": "甲队"}, "REFUTES"), ("ST_SUPERLATIVE", {**T, "a": "重复", "least": "true"}, "SUPPORTS"),
    ("ST_COUNT_GT", {**T, "over": "12.5", "value": "2"}, "SUPPORTS"), ("ST_COUNT_GT", {**T, "over": "12.4", "value": "2"}, "REFUTES"), ("ST_COUNT_GT", {**T, "over": "x", "value": "2"}, "NEI"),
    ("CAT_SUM", {**T, "where": "联赛", "equals": "北", "value": "60"}, "SUPPORTS"), ("CAT_SUM", {**T, "where": "联赛", "equals": "西", "value": "60"}, "NEI"),
    ("NB_LOOKUP2", {**B, "a": "一", "value": "30"}, "SUPPORTS"), ("NB_LOOKUP2", {**B, "a": "四", "value": "30"}, "NEI"),
    ("RS_RATIO", {**B, "a": "三", "b": "二", "value": "3.13"}, "SUPPORTS"), ("RS_RATIO", {**B, "a": "三", "b": "二", "value": "3.12"}, "REFUTES"),
    ("RJ_RANK_TOP", {**B, "where": "名次", "equals": "1", "value": "一"}, "SUPPORTS"), ("UQ_ONE", {**B, "where": "联赛", "equals": "北", "over": "5"}, "SUPPORTS"),
    ("UQ_ONLY_GT", {**B, "where": "联赛", "equals": "北", "over": "5", "a": "二"}, "REFUTES"), ("UV_ALL_GT", {**T, "where": "联赛", "equals": "南", "over": "1"}, "NEI"),
    ("UV_ALL_GT", {**T, "where": "联赛", "equals": "南", "over": "5"}, "REFUTES"), ("UV_ALL_GT", {**T, "where": "联赛", "equals": "北", "over": "5"}, "SUPPORTS"),
    ("UV_ALL_EQ", {**B, "where": "名次", "equals": "1", "attribute": "球队", "is": "甲队"}, "SUPPORTS"), ("NO_SUCH", {}, "NEI"), ("ST_SUM", {**T, "value": "83.5"}, "SUPPORTS"),
]


@pytest.fixture(scope="module")
def evidence(spark):
    tables = spark.createDataFrame([TEAMS, MEN], "table_id string, headers array<string>, rows array<array<string>>")
    return profile.with_values(profile.explode_tables(tables)), spark.createDataFrame([("teams", 0), ("men", 0)], "table_id string, key int")


def test_verdicts(spark, evidence):
    records = spark.createDataFrame([(i, s, x) for i, (s, x, _) in enumerate(CASES)], "claim_id int, skeleton_id string, slots map<string,string>")
    with Steps(spark) as steps:
        found = {r["claim_id"]: r["verdict"] for r in programs.run_programs(records, *evidence, steps).collect()}
    assert {i: (CASES[i][:2], v) for i, v in found.items() if v != CASES[i][2]} == {}
    assert len(found) == len(CASES)


def test_no_records(spark, evidence):
    with Steps(spark) as steps:
        none = spark.createDataFrame([], "claim_id int, skeleton_id string, slots map<string,string>")
        assert programs.run_programs(none, *evidence, steps).count() == 0
    assert len(programs.SKELETONS) == 47


def test_rows_answer_questions_without_being_gathered(spark):
    """A table of 300 rows: what is written for its questions is counts of metrics by group, and only rows that reach an asked place are put in order."""
    rows = [[f"队{i:03d}", "北" if i % 3 else "南", str(i % 5)] for i in range(300)]
    tables = spark.createDataFrame([("long", ["球队", "联赛", "积分"], rows)], "table_id string, headers array<string>, rows array<array<string>>")
    cells, keys = profile.with_values(profile.explode_tables(tables)), spark.createDataFrame([("long", 0)], "table_id string, key int")
    slots = {"table": "long", "column": "积分", "where": "联赛", "equals": "北"}
    tops = [r[0] for r in sorted(rows, key=lambda r: (-int(r[2]), r[0])) if r[1] == "北"]
    cases = [("CAT_SUM", {"value": "400"}), ("CAT_AVG", {"value": "2.0"}), ("CAT_COUNT_GT", {"over": "2", "value": "80"}), ("CAT_COUNT_GT", {"over": "1.5", "value": "120"}), ("UV_ALL_GT", {"over": "-1"}),
             ("NT_NTH_IN", {"n": "3", "value": tops[2]}), ("NT_NTH_IN", {"n": "41", "value": tops[40]}), ("NT_NTH_IN", {"n": "2", "least": "true", "value": tops[161]})]
    records = spark.createDataFrame([(i, s, {**slots, **x}) for i, (s, x) in enumerate(cases)], "claim_id int, skeleton_id string, slots map<string,string>")
    with Steps(spark) as steps:
        found = {r["claim_id"]: r["verdict"] for r in programs.run_programs(records, cells, keys, steps).collect()}
        written = lambda name: spark.read.parquet(f"{steps.root}/*-{name}").count()
        assert (written("facts"), written("spread"), written("ranked")) == (300, 20, 43)
    assert found == dict.fromkeys(range(len(cases)), "SUPPORTS")
