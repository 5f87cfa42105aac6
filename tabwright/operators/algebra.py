"""Positional table algebra on wide DataFrames.

A table is a DataFrame with a ``_row`` column of unique, ordered positions; all others are cells. Every
operator returns such a table. Positions are only renumbered where the algebra says so, and then by an
operator whose output order is already bounded by its input (a selection list, a set of groups).
Wrong arguments raise ``TableError``; cells that are no numbers raise at run time, as nothing may be
skipped silently.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.cells import parse_number, quoted, strip

ROW = "_row"
JOIN_LIMIT = 2000
FAILED = "invalid_table_operation"
#: Errors that only show when cells are read.
RUN_TIME_ERRORS = ("not_a_scalar_number", "empty_aggregate", "division_by_zero", "index_out_of_range")


class TableError(ValueError):
    """A malformed operation: the statement that asked for it ends INVALID, never NEI."""


def columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def integer(value: object, bound: int) -> int:
    """A real integer in [0, bound), no boolean and no float of an integral value."""
    if type(value) is not int or not 0 <= value < bound:
        raise TableError("index_out_of_range")
    return value


def column(df: DataFrame, index: int) -> str:
    names = columns(df)
    return names[integer(index, len(names))]


def cell(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def number(df: DataFrame, name: str) -> Column:
    """Strict number of a cell: numeric columns as they are, text parsed, failures raised."""
    raw = cell(df, name)
    if dict(df.dtypes)[name] not in ("string",):
        return raw.cast("double")
    parsed = parse_number(raw)
    return F.when(parsed.isNull(), F.raise_error(F.lit("not_a_scalar_number")).cast("double")).otherwise(parsed)


def with_rows(df: DataFrame, *order: str) -> DataFrame:
    """Give a small table positions 0 .. n-1 in the given order."""
    return df.withColumn(ROW, F.row_number().over(Window.orderBy(*order)) - 1)


def select_rows(df: DataFrame, rows: list[int]) -> DataFrame:
    """Rows at the given positions, in that order.

    The table's size is not known before it is read: a position beyond it raises when rows are fetched.
    """
    if not isinstance(rows, list) or any(isinstance(r, (list, dict)) for r in rows) or len(rows) != len(set(rows)):
        raise TableError("invalid_row_selection")
    places = [(integer(r, 2**63), i) for i, r in enumerate(rows)]
    wanted = df.sparkSession.createDataFrame(places, "_at long, _new long")
    found = df.join(F.broadcast(wanted), df[ROW] == wanted["_at"]).drop(ROW, "_at").withColumnRenamed("_new", ROW)
    beyond = wanted.join(df.select(F.col(ROW).alias("_own")), F.col("_at") == F.col("_own"), "left_anti")
    # The error stands in a filter, which no pruning of columns removes, on a count, below which no filter is pushed.
    wrong = beyond.agg(F.count(F.lit(1)).alias("_n")).filter(F.when(F.col("_n") > 0, F.raise_error(F.lit("index_out_of_range")).cast("boolean")))
    none = wrong.select(*[F.lit(None).cast(t).alias(c) for c, t in found.dtypes])
    return found.unionByName(none)


def select_columns(df: DataFrame, indices: list[int]) -> DataFrame:
    if not isinstance(indices, list) or not indices or len(indices) != len(set(indices)):
        raise TableError("invalid_column_selection")
    return df.select(ROW, *[cell(df, column(df, i)) for i in indices])


def sort(df: DataFrame, index: int, numeric: bool = True, descending: bool = False) -> DataFrame:
    """Stable sort, also when descending; the new order is in ``_row``.

    Positions of a large table would need one global order, so they come from a window over all rows:
    this operator is for result tables. ``ordered`` gives the distributed order without positions.
    """
    key, ties = _sort_key(df, index, numeric, descending)
    return df.withColumn("_new", (F.row_number().over(Window.orderBy(key, ties)) - 1).cast("long")).drop(ROW).withColumnRenamed("_new", ROW)


def ordered(df: DataFrame, index: int, numeric: bool = True, descending: bool = False) -> DataFrame:
    return df.orderBy(*_sort_key(df, index, numeric, descending))


def _sort_key(df: DataFrame, index: int, numeric: bool, descending: bool) -> tuple[Column, Column]:
    if type(numeric) is not bool or type(descending) is not bool:
        raise TableError("invalid_sort_flags")
    name = column(df, index)
    key = number(df, name) if numeric else cell(df, name).cast("string")
    return (key.desc() if descending else key.asc()), F.col(ROW).asc()


def group_count(df: DataFrame, index: int) -> DataFrame:
    """Counts by exact cell, ordered by first appearance."""
    name = column(df, index)
    counted = df.groupBy(cell(df, name)).agg(F.count(F.lit(1)).alias("count"), F.min(ROW).alias(ROW))
    return counted.select(ROW, cell(df, name), "count")


AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": lambda _: F.count(F.lit(1)).cast("double"),
}


def aggregate(df: DataFrame, index: int, method: str) -> DataFrame:
    """One row with the aggregate of all cells; an empty table is an error, not a zero."""
    name = column(df, index)
    if method not in AGGREGATES:
        raise TableError("unknown_aggregate")
    value = AGGREGATES[method](None if method == "count" else number(df, name))
    checked = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("empty_aggregate")).cast("double")).otherwise(value)
    return df.agg(checked.alias(f"{method}({name})")).withColumn(ROW, F.lit(0).cast("long"))


DERIVATIONS = {"subtract": lambda x, y: x - y, "add": lambda x, y: x + y, "ratio": lambda x, y: F.try_divide(x, y)}


def derive(df: DataFrame, left: int, right: int, method: str) -> DataFrame:
    a, b = column(df, left), column(df, right)
    if method not in DERIVATIONS:
        raise TableError("unknown_derivation")
    value = DERIVATIONS[method](number(df, a), number(df, b))
    if method == "ratio":
        value = F.when(number(df, b) == 0, F.raise_error(F.lit("division_by_zero")).cast("double")).otherwise(value)
    return df.withColumn(f"{method}({a},{b})", value)


def join(df: DataFrame, other: DataFrame, left: int, right: int, limit: int | None = JOIN_LIMIT) -> DataFrame:
    """Inner join on trimmed exact text; blanks never match; left order first, then right order.

    With a limit, a result of more rows is an error. Only its row count up to the limit is computed.
    """
    a, b = column(df, left), column(other, right)
    l = df.select(F.col(ROW).alias("_l"), *[cell(df, c).alias(f"left.{c}") for c in columns(df)], strip(cell(df, a).cast("string")).alias("_key"))
    r = other.select(F.col(ROW).alias("_r"), *[cell(other, c).alias(f"right.{c}") for c in columns(other)], strip(cell(other, b).cast("string")).alias("_key"))
    joined = l.filter("_key <> ''").join(r.filter("_key <> ''"), "_key")
    if limit is not None:
        if joined.limit(limit + 1).count() > limit:
            raise TableError("join_row_limit")
        return with_rows(joined.drop("_key"), "_l", "_r").drop("_l", "_r")
    return joined.drop("_key")


def tables_of(spark: SparkSession, package: dict) -> dict[str, DataFrame]:
    """Tables of a package by the names t0, t1, ..., as given: headers are columns, rows are in order.

    Short rows are filled with empty cells; an equal header gets a number, as columns need names of their own.
    """
    from tabwright.operators.sqlsurface import header_names

    out = {}
    for i, table in enumerate(package.get("tables") or []):
        names = header_names(table["headers"])
        rows = [(n, *[str(x) for x in r], *[""] * (len(names) - len(r))) for n, r in enumerate(table["rows"])]
        if any(len(r) != len(names) + 1 for r in rows):
            raise TableError("non_rectangular_table")
        out[f"t{i}"] = spark.createDataFrame(rows, f"{ROW} long, " + ", ".join(f"{quoted(n)} string" for n in names))
    return out


def raises(df: DataFrame) -> bool:
    """Whether some cell of a table fails: it is worked out to the last one, and nothing is kept."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except PySparkException as e:
        if any(name in str(e) for name in RUN_TIME_ERRORS):
            return True
        raise
    return False


def execute(tables: dict[str, DataFrame], action: dict) -> DataFrame:
    """Run one JSON action over named tables; inputs are never changed."""
    if action.get("table") not in tables:
        raise TableError("unknown_table")
    df, op = tables[action["table"]], action.get("op")
    if op == "select_rows":
        return select_rows(df, action.get("rows"))
    if op == "select_columns":
        return select_columns(df, action.get("columns"))
    if op == "sort":
        return sort(df, action.get("column"), action.get("numeric", True), action.get("descending", False))
    if op == "group_count":
        return group_count(df, action.get("column"))
    if op == "aggregate":
        return aggregate(df, action.get("column"), action.get("method"))
    if op == "derive":
        return derive(df, action.get("left"), action.get("right"), action.get("method"))
    if op == "join":
        if action.get("other") not in tables:
            raise TableError("unknown_join_table")
        return join(df, tables[action["other"]], action.get("left"), action.get("right"))
    raise TableError("unknown_operation")


def run_chain(tables: dict[str, DataFrame], actions: list[dict], max_operations: int = 3) -> tuple[str, str, dict[str, DataFrame]]:
    """Fold recorded actions over tables; label, status and all tables, steps being named s1, s2, ...

    Steps are plans that Catalyst sees as a whole. Before a chain ends, each of them is run once, so that
    a step that fails on a cell ends it as INVALID, whatever label follows.
    """
    from tabwright.functions.verdict import INVALID, label_of

    known = dict(tables)

    def failed() -> bool:
        return any(raises(known[f"s{n}"]) for n in range(1, max_operations + 1) if f"s{n}" in known)

    for step, action in enumerate(actions):
        if "label" in action:
            import json

            label, error = label_of(json.dumps(action, ensure_ascii=False))
            return (INVALID, FAILED, known) if failed() else (label, error or "answered", known)
        if step == max_operations:
            break
        try:
            known[f"s{step + 1}"] = execute(known, action)
        except (TableError, TypeError):
            return INVALID, FAILED, known
    return INVALID, FAILED if failed() else "no_final_label", known
