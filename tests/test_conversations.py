"""Recorded conversations: steps run once, side by side, within a budget of work that no clock decides."""

import threading

import pytest

from tabwright.operators import sqlsurface as S
from tabwright.sources.scratch import Steps


@pytest.fixture
def numbers(spark):
    spark.range(1000).selectExpr("id AS n", "id % 7 AS k").createOrReplaceTempView("numbers")


def test_steps_keep_their_order_and_are_tables(spark, numbers):
    turns = [{"sql": "SELECT n, k FROM numbers ORDER BY k DESC, n LIMIT 40"}, {"sql": "SELECT max(n) AS m, 'step1' AS s FROM Step1"}, {"final_label": "supports"}]
    label, status, seen = S.converse(spark, turns)
    assert (label, status) == ("SUPPORTS", "answered")
    assert [r[0] for r in seen[0].rows] == [6 + 7 * i for i in range(30)] and seen[0].total == 40
    assert seen[1].rows == [(6 + 7 * 39, "step1")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("step")]


def test_a_statement_is_run_once(spark):
    spark.sql("SELECT 1")
    _, _, seen = S.converse(spark, [{"sql": "SELECT rand() AS r"}, {"sql": "SELECT r FROM step1"}, {"final_label": "NEI"}])
    assert seen[0].rows == seen[1].rows


def test_side_by_side(spark, numbers):
    found = {}

    def talk(k):
        found[k] = S.converse(spark, [{"sql": f"SELECT n FROM numbers WHERE k = {k}"}, {"sql": "SELECT count(*) AS c, min(n) AS m FROM step1"}, {"final_label": "NEI"}])[2][1].rows

    threads = [threading.Thread(target=talk, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == {k: [((1000 - k + 6) // 7, k)] for k in range(3)}


def test_work_is_counted_in_rows(spark, numbers):
    with Steps(spark) as steps:
        one = S.run_step(spark, "SELECT n FROM numbers WHERE k < 3", steps, "a")
        two = S.run_step(spark, "SELECT n FROM numbers WHERE k < 3", steps, "b")
        assert one.used == two.used > 400 and one.saved
        assert S.run_step(spark, "SELECT n FROM numbers WHERE k < 3", steps, "c", budget=one.used - 1).error == "cost_bound"
        half = S.run_step(spark, "SELECT n FROM numbers WHERE k < 3", steps, "d", budget=2 * one.used - 1)
        assert not half.error and not half.saved and half.total == one.total


def test_a_product_is_refused(spark):
    spark.range(4000).createOrReplaceTempView("many")
    with Steps(spark) as steps:
        seen = S.run_step(spark, "SELECT count(*) AS c FROM many a JOIN many b ON a.id <> b.id", steps, "e", budget=5_000_000)
    assert seen.error == "cost_bound" and seen.used > 5_000_000
