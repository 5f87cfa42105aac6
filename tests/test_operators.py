"""Errors and edge cases of the table algebra, scoring, guarded SQL and file sources."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabwright.functions.verdict import json_object, label_of
from tabwright.operators import algebra as A
from tabwright.operators import metrics as M
from tabwright.operators import sqlsurface as S
from tabwright.sources import files
from tabwright.streaming import predictions as streamed

MEDALS = [(0, "挪威", "16", "8"), (1, "德国", "12", "10"), (2, "中国", "9", "4"), (3, "美国", "9", "10"), (4, "合计", "46", "32")]


@pytest.fixture()
def medals(spark):
    return spark.createDataFrame(MEDALS, "_row long, `国家` string, `金牌` string, `银牌` string")


def cells(df):
    return [tuple(r)[1:] for r in df.select("_row", *[A.cell(df, c) for c in A.columns(df)]).orderBy("_row").collect()]


def test_sort_is_stable_descending(medals):
    assert [r[0] for r in cells(A.sort(medals, 1, descending=True))] == ["合计", "挪威", "德国", "中国", "美国"]


def test_select_rows_keeps_requested_order(medals):
    assert [r[0] for r in cells(A.select_rows(medals, [2, 0]))] == ["中国", "挪威"]
    assert cells(A.select_rows(medals, [])) == []


def test_group_count_by_first_appearance(medals):
    assert cells(A.group_count(medals, 1)) == [("16", 1), ("12", 1), ("9", 2), ("46", 1)]


def test_aggregate_and_derive(medals):
    assert cells(A.aggregate(medals, 1, "sum")) == [(92.0,)]
    assert cells(A.derive(medals, 1, 2, "ratio"))[0][-1] == 2.0


@pytest.mark.parametrize(
    "action",
    [
        {"op": "select_rows", "table": "t0", "rows": [0, 0]},
        {"op": "select_columns", "table": "t0", "columns": []},
        {"op": "select_columns", "table": "t0", "columns": [True]},
        {"op": "sort", "table": "t0", "column": 9},
        {"op": "sort", "table": "t0", "column": 1, "numeric": 1},
        {"op": "aggregate", "table": "t0", "column": 1, "method": "median"},
        {"op": "derive", "table": "t0", "left": 1, "right": 2, "method": "times"},
        {"op": "join", "table": "t0", "other": "t9", "left": 0, "right": 0},
        {"op": "sort", "table": "t7", "column": 0},
        {"op": "pivot", "table": "t0"},
    ],
)
def test_malformed_actions(medals, action):
    with pytest.raises(A.TableError):
        A.execute({"t0": medals}, action)


def test_cells_that_are_no_numbers_raise(medals):
    with pytest.raises(PySparkException, match="not_a_scalar_number"):
        A.aggregate(medals, 0, "sum").collect()
    with pytest.raises(PySparkException, match="empty_aggregate"):
        A.aggregate(medals.limit(0), 1, "count").collect()
    with pytest.raises(PySparkException, match="division_by_zero"):
        A.derive(medals.withColumn("零", F.lit("0")), 1, 3, "ratio").collect()


def test_join_trims_and_skips_blanks(spark, medals):
    other = spark.createDataFrame([(0, " 挪威 ", "a"), (1, " ", "b"), (2, "挪威", "c")], "_row long, k string, x string")
    assert [r[-1] for r in cells(A.join(medals, other, 0, 0))] == ["a", "c"]
    with pytest.raises(A.TableError, match="join_row_limit"):
        A.join(medals, other, 0, 0, limit=1)


def test_chain_ends(medals):
    t = {"t0": medals}
    step = {"op": "select_rows", "table": "t0", "rows": [0]}
    assert A.run_chain(t, [step, {"label": "refuted"}])[:2] == ("REFUTES", "answered")
    assert A.run_chain(t, [step] * 4)[:2] == ("INVALID", "no_final_label")
    assert A.run_chain(t, [{"op": "sort"}])[:2] == ("INVALID", "invalid_table_operation")


def test_labels():
    assert label_of('{"label": "not enough info"}') == ("NEI", None)
    assert label_of('x {"label": "SUPPORTS"} y') == ("SUPPORTS", None)
    assert json_object("[1] {\"a\": 1}") == {"a": 1}
    assert json_object("none") == {}


def test_scores_from_a_confusion_matrix(spark):
    counts = {("SUPPORTS", "SUPPORTS"): 40, ("SUPPORTS", "INVALID"): 10, ("REFUTES", "SUPPORTS"): 20, ("REFUTES", "REFUTES"): 30}
    rows = [x for (g, p), n in counts.items() for x in [(g, p)] * n]
    pairs = spark.createDataFrame(rows, "gold string, pred string")
    s = M.scores(pairs).first()
    assert (s.n, s.invalid, s.accuracy) == (100, 10, 0.7)
    f_s, f_r = 80 / 110, 60 / 80
    assert s.macro_f1 == pytest.approx((f_s + f_r) / 3)
    assert s.present_macro_f1 == pytest.approx((f_s + f_r) / 2)
    low, high = M.bootstrap(pairs, "accuracy")
    assert 55 < low < 70 < high < 85
    assert M.scores(pairs.limit(0)).first().accuracy == 0.0


def test_guarded_sql(spark):
    df = S.load_table(spark, "t0", ["国", "金", "金", ""], [["挪威", "16", "1,000", "x"], ["德国", "12", "9"]])
    assert df.columns == ["_row", "国", "金", "金_2", "col", "金__num", "金_2__num"]
    assert "数值列" in S.schema_text(df, "t0", "奖牌")
    assert S.answer(spark, [{"sql": "select sum(`金__num`) = 28 from t0"}]) == ("SUPPORTS", "executed")
    assert S.answer(spark, [{"sql": "select 2"}]) == ("INVALID", "non_boolean_or_empty_result")
    assert S.answer(spark, [{"sql": "select nothing from nowhere"}, {"sql": "select 0"}]) == ("REFUTES", "executed")
    assert S.answer(spark, [{"abstain": True}]) == ("NEI", "abstain")
    label, status, seen = S.converse(spark, [{"sql": "select * from t0"}, {"sql": "select count(*) from step1"}, {"final_label": "supports"}])
    assert (label, status, seen[1].rows) == ("SUPPORTS", "answered", [(2,)])
    assert S.guard(spark, "CREATE TABLE x AS SELECT 1", strict=False) == "not_read_only_select"


def test_files(spark, tmp_path):
    run = tmp_path / "system_a"
    run.mkdir()
    lines = [{"id": "1", "label": "NEI", "status": "x"}, {"id": "2", "status": "x"}, {"id": "1", "label": "SUPPORTS", "status": "x"}]
    (run / "predictions.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    got = {r.id: r.label for r in files.read_predictions(spark, str(run / "predictions.jsonl")).collect()}
    assert got == {"1": "SUPPORTS", "2": "INVALID"}
    assert {r.system for r in files.read_run_folder(spark, str(tmp_path)).collect()} == {"system_a"}
    named = files.read_named(spark, files.parse_named([f"b={run}/predictions.jsonl"]))
    assert {(r.system, r.id) for r in named.collect()} == {("b", "1"), ("b", "2")}
    claims = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = spark.read.json(str(run / "predictions.jsonl"))
    assert [r.id for r in files.pending(claims, done).collect()] == ["3"]
    meta = files.prepare_run(spark, str(tmp_path / "new"), {"model": "m", "workers": 3})
    assert files.prepare_run(spark, str(tmp_path / "new"), {"model": "m", "workers": 8}) == meta
    with pytest.raises(ValueError):
        files.prepare_run(spark, str(tmp_path / "new"), {"model": "n"})


def test_claims_and_hash(spark, tmp_path):
    claim = {"id": "1", "claim": "甲", "label": "NEI", "tables": [{"table_id": "a", "title": "t", "headers": ["h"], "rows": [["1"]]}]}
    (tmp_path / "c.jsonl").write_text(json.dumps(claim, ensure_ascii=False) + "\n")
    df = files.read_claims(spark, str(tmp_path / "c.jsonl"), limit=5)
    assert files.serialize_tables(df).first().text == 'Table a: t\nHeaders: ["h"]\nRows: [["1"]]'
    assert len(files.with_input_hash(df).first().input_sha256) == 64


def test_streamed_confusion(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": "1", "label": "NEI"}\n{"id": "2"}\n')
    gold = spark.createDataFrame([("1", "NEI"), ("2", "REFUTES")], "id string, label string")
    out = streamed.running_confusion(streamed.read_predictions(spark, str(tmp_path)), gold)
    query = out.writeStream.format("memory").queryName("conf").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("conf").collect()} == {("NEI", "NEI", 1), ("REFUTES", "INVALID", 1)}


def test_rows_beyond_the_table_raise_whatever_columns_are_read(medals):
    for rows in ([0, 99], [99]):
        with pytest.raises(PySparkException, match="index_out_of_range"):
            A.select_rows(medals, rows).select("_row").collect()
    for rows in ([-1], [True], [1.0], "0"):
        with pytest.raises(A.TableError):
            A.select_rows(medals, rows)


def test_a_failed_step_ends_a_chain(medals):
    sums_text = {"op": "aggregate", "table": "t0", "column": 0, "method": "sum"}
    assert A.run_chain({"t0": medals}, [sums_text, {"label": "supports"}])[:2] == ("INVALID", "invalid_table_operation")
    assert A.run_chain({"t0": medals}, [{"op": "select_rows", "table": "t0", "rows": [0, 9]}, {"label": "nei"}])[:2] == ("INVALID", "invalid_table_operation")


def test_integers_are_real_and_bounded():
    assert A.integer(2, 3) == 2
    for value in (3, -1, True, 1.0, "1", None):
        with pytest.raises(A.TableError):
            A.integer(value, 3)


def test_guard_looks_at_the_whole_plan(spark):
    for sql in ("SELECT java_method('java.lang.System', 'getProperty', 'x')", "SELECT * FROM text.`/etc/hostname`", "SELECT (SELECT reflect('a', 'b'))"):
        assert S.guard(spark, sql) == "not_read_only_select"
        assert S.run_sql(spark, sql).error
    assert S.guard(spark, "WITH t AS (SELECT 1 AS a) INSERT INTO x SELECT * FROM t", strict=False) == "not_read_only_select"
    assert S.guard(spark, "SELECT a FROM t WHERE a IN (SELECT b FROM text.`/x`)") == "not_read_only_select"
    assert S.guard(spark, "SELECT * FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.x = a.x)") is None


def test_views_of_a_conversation_end_with_it(spark):
    assert S.converse(spark, [{"sql": "SELECT 1 AS n"}, {"sql": "SELECT n FROM step1"}, {"final_label": "nei"}])[2][1].rows == [(1,)]
    assert S.converse(spark, [{"sql": "SELECT n FROM step1"}, {"final_label": "nei"}])[2][0].error


def test_dialect():
    assert S.from_sqlite("""select "a ""b" from t where x like 'y"%' and n / 2 > 7 / 2""") == """select `a "b` from t where x ILIKE 'y"%' and n / 2 > (7 div 2)"""


def test_a_profile_is_released(spark):
    from tabwright.operators import profile as P

    tables = spark.createDataFrame([("t", ["国家", "金牌"], [["挪威", "1"], ["德国", "2"]]), ("e", ["国家"], [])], "table_id string, headers array<string>, rows array<array<string>>")
    with P.cached_profile(tables) as (kept, profiled):
        assert {(r.table_id, r.kind) for r in profiled.collect()} >= {("e", "other")}
        assert kept.is_cached and profiled.is_cached
    assert not kept.is_cached and not profiled.is_cached


def test_rank_over_all_rows_is_that_of_one_window(spark):
    from pyspark.sql import Window

    from tabwright.operators import templates as T

    rows = spark.range(500).select(F.col("id").alias("k"), F.when(F.col("id") % 50 != 0, F.pmod(F.xxhash64("id"), F.lit(40))).alias("v"))
    want = rows.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("v").desc(), "k"))).collect()
    assert sorted((r.k, r["rank"]) for r in T.ranked(rows).collect()) == sorted((r.k, r["rank"]) for r in want)
    assert T.ranked(rows.limit(0)).collect() == []


def test_identity_of_a_run(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("1\n")
    data = (str(tmp_path / "a.jsonl"),)
    files.prepare_run(spark, str(tmp_path / "run"), {"model": "m"}, data=data)
    files.prepare_run(spark, str(tmp_path / "run"), {"model": "m"}, data=data)
    (tmp_path / "a.jsonl").write_text("2\n")
    with pytest.raises(ValueError):
        files.prepare_run(spark, str(tmp_path / "run"), {"model": "m"}, data=data)


def test_unknown_prompt_setting():
    from tabwright.operators import prompts

    with pytest.raises(ValueError):
        prompts.build_prompt({"claim": "x"}, "other")
