"""Chains of table operations of any number of statements at once.

``algebra.run_chain`` folds the actions of one statement over its tables. Here the k-th action of all statements is one plan: rows of all
tables lie in one table, keyed by statement and table name, an action is a row, and each operation is a case of the same few
joins and groupings. A step is written once and read by those after it: its checked actions, one row a statement, and its rows.
So there are as many writes for any number of statements. Nothing raises: what fails is a reason beside the row or the action it fails on, and
ends its own statement only.

Layout: rows (claim_id, name, row, cells), headers (claim_id, name, headers), actions (claim_id, actions: array of JSON objects). A cell is
(t, d): its text, and its number where it was computed, not read. Tables are as wide as their headers: short rows are filled,
longer ones make operations on their table fail. Positions count from 0 without gaps, in the order of ``row``.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.cells import parse_number, strip
from tabwright.functions.verdict import ALIASES, INVALID, LABELS
from tabwright.operators.algebra import FAILED, JOIN_LIMIT
from tabwright.sources.scratch import Steps

CELL = "struct<t:string,d:double>"
OPERATIONS = ("select_rows", "select_columns", "sort", "group_count", "aggregate", "derive", "join")
METHODS = ("sum", "mean", "min", "max", "count")
DERIVATIONS = ("subtract", "add", "ratio")


class Chains(NamedTuple):
    """verdicts (claim_id, label, status, reason); rows (claim_id, name, row, cells) and headers of all tables, steps being s1, s2, ..."""

    verdicts: DataFrame
    rows: DataFrame
    headers: DataFrame


def cell(t: Column, d: Column | None = None) -> Column:
    return F.struct(t.cast("string").alias("t"), (F.lit(None) if d is None else d).cast("double").alias("d"))


def number_cell(value: Column) -> Column:
    return cell(value.cast("string"), value)


def from_packages(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and headers of statements with (claim_id, tables array<struct<headers, rows>>); tables are named t0, t1, ..."""
    tables = claims.select("claim_id", F.posexplode("tables").alias("_i", "_t"))
    tables = tables.select("claim_id", F.concat(F.lit("t"), F.col("_i")).alias("name"), F.col("_t.headers").alias("headers"), F.col("_t.rows").alias("rows"))
    rows = tables.select("claim_id", "name", F.posexplode("rows").alias("row", "_cells"))
    return rows.select("claim_id", "name", F.col("row").cast("long").alias("row"), F.col("_cells").alias("cells")), tables.select("claim_id", "name", "headers")


# ---------------------------------------------------------------- actions


def typed_actions(actions: DataFrame, max_operations: int) -> DataFrame:
    """One row for each action that counts: those before the first label, and no more than ``max_operations``.

    JSON types stay exact: a column that is 1.0 or true is no position, a flag that is 1 is none.
    """
    one = actions.select("claim_id", F.posexplode("actions").alias("step", "action"))
    one = one.withColumn("_keys", F.json_object_keys("action")).withColumn("_v", F.try_parse_json("action"))
    last = Window.partitionBy("claim_id")
    is_label = F.coalesce(F.array_contains("_keys", "label"), F.lit(False))
    one = one.withColumn("_end", F.min(F.when(is_label, F.col("step"))).over(last))
    one = one.where((F.col("step") <= F.coalesce("_end", F.lit(max_operations))) & (F.col("step") <= max_operations)).where(is_label | (F.col("step") < max_operations))

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant"))

    def get(name: str, wanted: str, spark_type: str) -> Column:
        return F.when(kind(name) == wanted, F.try_variant_get("_v", f"$.{name}", spark_type))

    def flag(name: str, default: bool) -> Column:
        return F.when(~F.array_contains("_keys", name), F.lit(default)).otherwise(get(name, "BOOLEAN", "boolean"))

    def places(name: str) -> Column:
        return F.when(kind(name).isin("ARRAY<BIGINT>", "ARRAY<VOID>"), F.try_variant_get("_v", f"$.{name}", "array<bigint>"))

    said = get("label", "STRING", "string")
    return one.select(
        "claim_id", "step", is_label.alias("ends"),
        F.replace(F.upper(strip(said)), F.lit(" "), F.lit("_")).alias("said"),
        *[get(x, "STRING", "string").alias(x) for x in ("op", "table", "other", "method")],
        places("rows").alias("rows"), places("columns").alias("columns"),
        *[get(x, "BIGINT", "bigint").alias(x) for x in ("column", "left", "right")],
        flag("numeric", True).alias("numeric"), flag("descending", False).alias("descending"),
    )


def label_column(said: Column) -> Column:
    """Label that an answer spells, or null."""
    known = F.create_map(*[F.lit(x) for k, v in {**{x: x for x in LABELS}, **ALIASES}.items() for x in (k, v)])
    return F.try_element_at(known, said)


def _inside(index: Column, bound: Column) -> Column:
    return F.coalesce((index >= 0) & (index < bound), F.lit(False))


def _selection(places: Column, bound: Column) -> Column:
    """A list of different positions below a bound."""
    return F.coalesce(F.forall(places, lambda i: _inside(i, bound)) & (F.size(F.array_distinct(places)) == F.size(places)), F.lit(False))


def checked(actions: DataFrame, meta: DataFrame, k: int) -> DataFrame:
    """The k-th actions with the headers they meet and the reason why one cannot be run, null where it can."""
    here = actions.where((F.col("step") == k) & ~F.col("ends"))
    own = meta.select("claim_id", F.col("name").alias("table"), "headers", "height", "ragged")
    other = meta.select("claim_id", F.col("name").alias("other"), F.col("headers").alias("other_headers"), F.col("ragged").alias("other_ragged"))
    here = here.join(own, ["claim_id", "table"], "left").join(other, ["claim_id", "other"], "left")
    width, op = F.size("headers"), F.col("op")
    column, left, right = (_inside(F.col(x), width) for x in ("column", "left", "right"))
    wrong = [
        (F.col("headers").isNull(), "unknown_table"),
        (F.col("ragged"), "non_rectangular_table"),
        (op.isNull() | ~op.isin(*OPERATIONS), "unknown_operation"),
        ((op == "select_rows") & ~_selection(F.col("rows"), F.col("height")), "invalid_row_selection"),
        ((op == "select_columns") & ~(_selection(F.col("columns"), width) & (F.size("columns") > 0)), "invalid_column_selection"),
        ((op == "sort") & (F.col("numeric").isNull() | F.col("descending").isNull()), "invalid_sort_flags"),
        (op.isin("sort", "group_count", "aggregate") & ~column, "index_out_of_range"),
        ((op == "aggregate") & ~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)), "unknown_aggregate"),
        ((op == "aggregate") & (F.col("height") == 0), "empty_aggregate"),
        (op.isin("derive", "join") & ~left, "index_out_of_range"),
        ((op == "derive") & ~right, "index_out_of_range"),
        ((op == "derive") & ~F.coalesce(F.col("method").isin(*DERIVATIONS), F.lit(False)), "unknown_derivation"),
        ((op == "join") & F.col("other_headers").isNull(), "unknown_join_table"),
        ((op == "join") & F.col("other_ragged"), "non_rectangular_table"),
        ((op == "join") & ~_inside(F.col("right"), F.size("other_headers")), "index_out_of_range"),
    ]
    return here.withColumn("reason", F.coalesce(*[F.when(hit, F.lit(name)) for hit, name in wrong]))


# ---------------------------------------------------------------- one step of all statements


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in their final places: those that have none yet are numbered within their statement's new table.

    The window streams over sorted rows, which spill; it is the one place where a statement's table meets in one task.
    """
    own = Window.partitionBy("claim_id").orderBy(F.col("by_number").asc(), F.col("by_text").asc(), F.col("by_text_down").desc(), "first", "second")
    open_ = rows.where("NOT placed").select("claim_id", (F.row_number().over(own) - 1).cast("long").alias("row"), "cells", "reason")
    return rows.where("placed").select("claim_id", F.col("first").alias("row"), "cells", "reason").unionByName(open_)


def _arranged(cells: Column, first: Column, second: Column | None = None, number: Column | None = None, text: Column | None = None, down: Column | None = None, reason: Column | None = None, placed: Column | bool = False) -> list[Column]:
    none = F.lit(None)
    return [
        (placed if isinstance(placed, Column) else F.lit(placed)).alias("placed"),
        F.col("claim_id"), (none if number is None else number).cast("double").alias("by_number"), (none if text is None else text).cast("string").alias("by_text"),
        (none if down is None else down).cast("string").alias("by_text_down"), first.cast("long").alias("first"), (F.lit(0) if second is None else second).cast("long").alias("second"),
        cells.alias("cells"), (none if reason is None else reason).cast("string").alias("reason"),
    ]


def _key(rows: DataFrame, at: str) -> DataFrame:
    """Rows with the trimmed text of one cell, without those where it is blank."""
    return rows.withColumn("key", strip(F.get("cells", F.col(at).cast("int"))["t"])).where("key <> ''")


def _joined(good: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Joined rows, and the statements whose join has too many: these are told by counts, before any row is joined."""
    asked = good.where("op = 'join'").select("claim_id", "table", "other", "left", "right")
    l = _key(rows.join(asked.select("claim_id", F.col("table").alias("name"), "left"), ["claim_id", "name"]), "left")
    r = _key(rows.join(asked.select("claim_id", F.col("other").alias("name"), "right"), ["claim_id", "name"]), "right")
    pairs = l.groupBy("claim_id", "key").agg(F.count(F.lit(1)).alias("n")).join(r.groupBy("claim_id", "key").agg(F.count(F.lit(1)).alias("m")), ["claim_id", "key"])
    many = pairs.groupBy("claim_id").agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("n")).where(F.col("n") > JOIN_LIMIT).select("claim_id")
    l = l.join(many, "claim_id", "left_anti").select("claim_id", "key", F.col("row").alias("l_row"), F.col("cells").alias("l_cells"))
    r = r.select("claim_id", "key", F.col("row").alias("r_row"), F.col("cells").alias("r_cells"))
    both = l.join(r, ["claim_id", "key"])
    return both.select(*_arranged(F.concat("l_cells", "r_cells"), F.col("l_row"), F.col("r_row"))), many


def _results(good: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows of all operations but joins, with what orders them and why a row fails."""
    kinds = ["op", "method", "rows", "columns", "column", "left", "right", "numeric", "descending"]
    met = rows.join(good.where("op <> 'join'").select("claim_id", F.col("table").alias("name"), *kinds), ["claim_id", "name"])
    op, method = F.col("op"), F.col("method")
    one, two = F.get("cells", F.coalesce("column", "left").cast("int")), F.get("cells", F.col("right").cast("int"))
    needed = ((op == "sort") & F.col("numeric")) | ((op == "aggregate") & (method != "count")) | (op == "derive")
    # A cell is computed or read, so of both numbers one is null. None of this is in a branch or a generator: what parsing repeats is then worked out once.
    read = lambda c, asked: F.greatest(F.when(asked, c["d"]), parse_number(F.when(asked & c["d"].isNull(), c["t"])))
    met = met.select("*", one.alias("one"), read(one, needed).alias("x"), read(two, op == "derive").alias("y"), needed.alias("needed"))
    x, y = F.col("x"), F.col("y")
    fails = F.when(F.col("needed") & (x.isNull() | ((op == "derive") & y.isNull())), "not_a_scalar_number").when((op == "derive") & (method == "ratio") & (y == 0), "division_by_zero")
    derived = F.when(method == "add", x + y).when(method == "subtract", x - y).otherwise(F.try_divide(x, y))
    cells = (
        F.when(op == "select_columns", F.transform("columns", lambda i: F.get("cells", i.cast("int"))))
        .when(op == "derive", F.concat("cells", F.array(number_cell(derived))))
        .otherwise(F.col("cells"))
    )
    place = F.when(op == "select_rows", F.array_position("rows", F.col("row")) - 1).otherwise(F.col("row"))
    text = F.when((op == "sort") & ~F.col("numeric"), F.col("one.t"))
    down = F.col("descending")
    plain = met.where("op IN ('select_rows', 'select_columns', 'sort', 'derive')").where(place >= 0)
    sorted_x = F.when(op == "sort", F.when(down, -x).otherwise(x))
    plain = plain.select(*_arranged(cells, place, number=sorted_x, text=F.when(~down, text), down=F.when(down, text), reason=fails, placed=op != "sort"))
    counted = met.where("op = 'group_count'").groupBy("claim_id", "one").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("place"))
    counted = counted.select(*_arranged(F.array(F.col("one"), number_cell(F.col("n"))), F.col("place")))
    sums = met.where("op = 'aggregate'").groupBy("claim_id", "method")
    sums = sums.agg(F.sum("x").alias("sum"), F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.count(F.lit(1)).cast("double").alias("count"), F.max(fails).alias("why"))
    value = F.coalesce(*[F.when(method == m, F.col(m)) for m in METHODS])
    sums = sums.select(*_arranged(F.array(number_cell(value)), F.lit(0), reason=F.col("why"), placed=True))
    return plain.unionByName(counted).unionByName(sums)


def _new_headers(op: Column) -> Column:
    h = lambda i: F.get("headers", F.col(i).cast("int"))
    named = lambda *x: F.concat(F.col("method"), F.lit("("), F.concat_ws(",", *x), F.lit(")"))
    side = lambda s, x: F.transform(x, lambda c: F.concat(F.lit(s + "."), c))
    return (
        F.when(op == "select_columns", F.transform("columns", lambda i: F.get("headers", i.cast("int"))))
        .when(op == "group_count", F.array(h("column"), F.lit("count")))
        .when(op == "aggregate", F.array(named(h("column"))))
        .when(op == "derive", F.concat("headers", F.array(named(h("left"), h("right")))))
        .when(op == "join", F.concat(side("left", F.col("headers")), side("right", F.col("other_headers"))))
        .otherwise(F.col("headers"))
    )


def _meta(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """(claim_id, name, headers, height, ragged): ragged is a table with a row of more cells than headers."""
    sizes = rows.groupBy("claim_id", "name").agg(F.count(F.lit(1)).alias("height"), F.max(F.size("cells")).alias("_most"))
    found = headers.join(sizes, ["claim_id", "name"], "left")
    return found.select("claim_id", "name", "headers", F.coalesce("height", F.lit(0)).alias("height"), F.coalesce(F.col("_most") > F.size("headers"), F.lit(False)).alias("ragged"))


def run_chains(rows: DataFrame, headers: DataFrame, actions: DataFrame, steps: Steps, max_operations: int = 3) -> Chains:
    """Run the recorded actions of all statements.

    rows (claim_id, name, row, cells array<string>), headers (claim_id, name, headers), actions (claim_id, actions array<string>). Statements are those of
    ``actions``; one without actions ends INVALID, as one without a final label does.
    """
    filled = F.transform("cells", lambda x: cell(F.coalesce(x, F.lit(""))))
    short = F.greatest(F.size("headers") - F.size("cells"), F.lit(0))
    headers = steps.table(headers, "headers")
    rows = rows.join(headers, ["claim_id", "name"]).select("claim_id", "name", "row", F.concat(filled, F.array_repeat(cell(F.lit("")), short)).alias("cells"))
    rows = steps.table(rows, "rows")  # each step reads them several times
    todo = steps.table(typed_actions(actions, max_operations), "actions")
    told = []
    for k in range(max_operations):
        good = steps.table(checked(todo, _meta(rows, headers), k), f"actions-{k + 1}")
        runs = good.where("reason IS NULL")
        joined, many = _joined(runs, rows)
        made = _numbered(_results(runs, rows).unionByName(joined))
        none = F.lit(None)
        marks = good.join(many.withColumn("many", F.lit("join_row_limit")), "claim_id", "left")
        marks = marks.select(
            "claim_id", none.cast("long").alias("row"), none.cast(f"array<{CELL}>").alias("cells"),
            F.coalesce("reason", "many").alias("reason"), _new_headers(F.col("op")).alias("headers"),
        )
        done = steps.table(made.withColumn("headers", none.cast("array<string>")).unionByName(marks), f"step-{k + 1}")
        told.append(done.where("reason IS NOT NULL").select("claim_id", F.lit(k).alias("step"), "reason"))
        name = F.lit(f"s{k + 1}").alias("name")
        rows = rows.unionByName(done.where("row IS NOT NULL").select("claim_id", name, "row", "cells"))
        headers = headers.unionByName(done.where("row IS NULL AND reason IS NULL").select("claim_id", name, "headers"))
    failed = reduce(DataFrame.unionByName, told).groupBy("claim_id").agg(F.min_by("reason", F.struct("step", "reason")).alias("reason"))
    answers = todo.where("ends").select("claim_id", F.lit(True).alias("ends"), label_column(F.col("said")).alias("answer"))
    ended = actions.select("claim_id").distinct().join(failed, "claim_id", "left").join(answers, "claim_id", "left")
    bad = F.col("reason").isNotNull()
    status = F.when(bad, FAILED).when(F.col("ends").isNull(), "no_final_label").when(F.col("answer").isNull(), "invalid_label").otherwise("answered")
    verdicts = ended.select("claim_id", F.when(status == "answered", F.col("answer")).otherwise(INVALID).alias("label"), status.alias("status"), "reason")
    return Chains(verdicts, rows, headers)
