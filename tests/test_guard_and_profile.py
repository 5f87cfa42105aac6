"""The guard over every field of a plan, and profiles of wide tables against those of cells."""

import pytest
from pyspark.sql import functions as F

from tabwright.operators import profile, sqlsurface
from tabwright.plans import given_queries
from tabwright.plans.cell_queries import TABLES
from tabwright.sources.scratch import Steps

CODE = "reflect('java.lang.System', 'getProperty', 'user.home')"
REFUSED = [
    f"SELECT {CODE}", f"SELECT max(1) OVER w AS x FROM v WINDOW w AS (ORDER BY {CODE})", f"SELECT max(1) OVER w FROM v WINDOW w AS (PARTITION BY a), u AS (ORDER BY {CODE})",
    f"SELECT * FROM v LATERAL VIEW explode(array({CODE})) t AS y", f"SELECT (SELECT max(b) FROM v WHERE a = {CODE})", f"WITH c AS (SELECT {CODE} AS x) SELECT * FROM c",
    f"SELECT a FROM v GROUP BY a HAVING max(b) = {CODE}", f"SELECT a FROM v ORDER BY {CODE}", f"SELECT transform(array(1), x -> {CODE})", f"SELECT * FROM v WHERE a IN (SELECT {CODE})",
    f"SELECT CASE WHEN a = 1 THEN {CODE} END FROM v", "SELECT java_method('java.lang.Math', 'random')", "SELECT * FROM text.`/etc/passwd`", "SELECT * FROM IDENTIFIER('v')",
    "SELECT IDENTIFIER('reflect')('java.lang.Math', 'random')", "SELECT input_file_name() FROM v", "SELECT system.builtin.reflect('java.lang.Math', 'random')", f"SELECT * FROM range({CODE})",
    f"SELECT * FROM v, LATERAL (SELECT {CODE})", f"SELECT count(*) FILTER (WHERE a = {CODE}) FROM v", f"SELECT * FROM (SELECT a FROM v UNION ALL SELECT {CODE})", "SELECT no_such_function(1)",
    "SELECT raise_error('x')", f"SELECT * FROM VALUES ({CODE}) AS t(x)",
]
ALLOWED = [
    "SELECT max(1) OVER w AS x FROM v WINDOW w AS (PARTITION BY a ORDER BY b)", "SELECT * FROM v LATERAL VIEW explode(array(1, 2)) t AS y", "SELECT * FROM range(3)",
    "WITH c AS (SELECT a, sum(b) AS s FROM v GROUP BY a) SELECT * FROM c WHERE s > (SELECT avg(b) FROM v)", "SELECT count(DISTINCT a), round(avg(b), 2), upper(trim(a)) FROM v",
    "SELECT a, row_number() OVER (ORDER BY b) FROM v", "SELECT * FROM v WHERE a LIKE 'x%' OR EXISTS (SELECT 1 FROM v w WHERE w.a = v.a)", "SELECT CAST(a AS INT), coalesce(b, 0) FROM v ORDER BY 1 LIMIT 3",
    "SELECT * FROM VALUES (1, 'a') AS t(x, y)", "SELECT * FROM v, LATERAL (SELECT b + 1 AS c)", "SELECT substr(a, 1, 2), extract(YEAR FROM DATE'2020-01-01'), CASE WHEN b > 1 THEN 1 ELSE 0 END FROM v",
]


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sql):
    assert sqlsurface.guard(spark, sql), sql


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, sql):
    assert sqlsurface.guard(spark, sql) is None, sql


def test_wide_profiles_are_those_of_cells(spark):
    fields = ["header", "kind", "reason", "numeric_ratio", "unique_ratio", "period", "period_rest", "unit", "is_rate", "n"]
    raw = spark.createDataFrame(TABLES, "table_id string, headers array<string>, rows array<array<string>>")
    by_cells = {(r["table_id"], r["col_idx"]): [r[f] for f in fields] for r in profile.profile_tables(raw)[1].collect()}
    with Steps(spark) as steps:
        for name, headers, rows in TABLES:
            wide = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in headers))
            kept, found = profile.profile_wide_table(wide, name, steps)
            for r in found.collect():
                assert [r[f] for f in fields] == by_cells[name, r["col_idx"]]
            assert kept.count() == 4


def test_empty_wide_table(spark):
    with Steps(spark) as steps:
        found = profile.profile_wide_table(spark.createDataFrame([], "`甲` string, b int"), "t", steps)[1].collect()
    assert [(r["kind"], r["reason"]) for r in found] == [("other", "sparse")] * 2


def test_total_rows_by_both_rules(spark):
    rows = [("a", "甲", "1"), ("a", "乙", "2"), ("a", "丙", "3"), ("a", "丁", "4"), ("a", "各地", None), ("b", "甲", "1"), ("b", "合计", "2"), ("b", "乙", None), (None, "甲", None)]
    df = spark.createDataFrame(rows, "g string, name string, place string")
    left = {tuple(r) for r in profile.without_total_rows(df, "name", "place", by="g").collect()}
    assert left == {rows[0], rows[1], rows[2], rows[3], rows[5], rows[7], rows[8]}
    assert profile.without_total_rows(df.where(F.col("g") == "a"), "name").count() == 5


def test_profiles_are_kept_by_content(spark):
    rows = [["甲国", "1"], ["乙国", "2"], ["丙国", "5"]]
    table = lambda name, body: (name, ["国家", "金牌"], body)
    cells = lambda *t: profile.explode_tables(spark.createDataFrame(list(t), "table_id string, headers array<string>, rows array<array<string>>"))
    with Steps(spark) as steps:
        store = f"{steps.root}/store"
        first = profile.stored_profile(cells(table("a", rows), table("b", rows)), store, steps).collect()
        assert {(r["table_id"], r["known"]) for r in first} == {("a", False), ("b", False)} and len(first) == 4
        assert spark.read.parquet(store).count() == 2
        again = profile.stored_profile(cells(table("c", rows), table("d", rows[::-1])), store, steps).collect()
        assert {(r["table_id"], r["known"]) for r in again} == {("c", True), ("d", False)}
        assert {r["kind"] for r in again if r["col_idx"] == 0} == {"key"}


def test_profiles_and_total_rows_hash_and_do_not_sort(spark):
    """Cells meet in groupings that keep numbers only, and values are worked out for distinct texts: no grouping of all cells sorts them or holds their texts."""
    cells = profile.explode_tables(spark.createDataFrame(TABLES, "table_id string, headers array<string>, rows array<array<string>>"))
    with Steps(spark) as steps:
        first = steps.table(profile.profile(cells), "first")
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan(profile.row_marks(cells, first)).splitlines() if "SortAggregate" in x and "row_idx" in x]
        assert "SortAggregate" not in plan(profile.profile(cells)) and "Expand" not in plan(profile.profile(cells))


def test_repeated_and_missing_values_count_as_often_as_they_stand(spark):
    rows = [["甲国", "5"], ["甲国", "5"], ["乙国", "5.0"], ["丙国", "—"], ["乙国（注）", None], ["丁国", "7 km²"]]
    found = profile.profile(profile.explode_tables(spark.createDataFrame([("t", ["国家", "数量"], rows)], "table_id string, headers array<string>, rows array<array<string>>")))
    got = {r["col_idx"]: r for r in found.collect()}
    assert (got[0]["n"], got[0]["unique_ratio"], got[0]["numeric_ratio"]) == (6, round(4 / 6, 3), 0.0)
    assert (got[1]["n"], got[1]["unique_ratio"], got[1]["numeric_ratio"], got[1]["reason"]) == (6, 0.75, 1.0, "mixed_units")


def test_rows_of_regions_are_numbered_in_stretches(spark):
    found = given_queries.by_region(spark, "/root/testdata/sf0.001")
    per = found.groupBy("table_id").agg(F.count_distinct("row_idx").alias("n"), F.max("row_idx").alias("last"), F.min("row_idx").alias("first"))
    assert all(r["n"] == r["last"] + 1 and r["first"] == 0 for r in per.collect())
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in x]
    assert windows and all("part#" in x.split("windowspecdefinition(")[1].split(" ASC")[0] for x in windows)


def test_wide_profiles_work_values_out_for_distinct_texts(spark):
    """What a wide profile works out and writes is a row for each distinct text; its total rows go by label and by rank, as those of cells do."""
    rows = [[f"甲{i % 7}国", str(i % 5), str(i + 1), "同"] for i in range(400)] + [["合计", "9 km²", "401", "同"], ["各地", "12.5", "", ""]]
    headers = ["国家", "数量", "名次", "类别"]
    rest = [["丙国", "3", "x", ""], ["合计", "4", "", ""], ["合计", "5", "7", ""]]
    with Steps(spark) as steps:
        for name, body in (("long", rows), ("rest", rest), ("none", rest[1:])):
            kept, found = profile.profile_wide_table(spark.createDataFrame(body, ", ".join(f"`{h}` string" for h in headers)), name, steps)
            cells = profile.profile_tables(spark.createDataFrame([(name, headers, body)], "table_id string, headers array<string>, rows array<array<string>>"))
            fields = ["col_idx", "header", "kind", "reason", "numeric_ratio", "unique_ratio", "unit", "is_rate", "n"]
            by_cells = {tuple(r[f] for f in fields) for r in cells[1].collect()}
            wide = {tuple(r[f] for f in fields) for r in found.collect()}
            assert wide == by_cells or (name == "none" and {r[2:4] + r[-1:] for r in wide} == {("other", "sparse", 0)})
            assert kept.count() == {"long": 400, "rest": 1, "none": 0}[name]
            if name == "long":
                sizes = [spark.read.parquet(f"{steps.root}/{i}-{x}").count() for i, x in ((1, "texts"), (3, "gone"))]
                assert sizes == [422, 8]  # 420 distinct texts, an empty one for each of two columns without any; the cells number 1,608
