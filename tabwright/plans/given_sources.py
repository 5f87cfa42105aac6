"""Files, prompts, packages, run records and recorded SQL over statements made of the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.operators import metrics as M
from tabwright.operators import prompts, setwise
from tabwright.operators import sqlsurface as S
from tabwright.plans.relational_queries import read
from tabwright.sources import files
from tabwright.sources.scratch import Steps, steps_of

def _k() -> Column:
    return F.col("c_custkey")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each customer, with its balance in one table and a context cell; every third has an evidence cell too."""
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    rows = F.array(F.array(F.col("c_name"), cents), F.array(F.lit('a "b"'), F.col("c_mktsegment")))
    table = F.struct(text("t", _k()).alias("table_id"), F.when(_k() % 2 == 0, F.lit("表")).alias("title"), F.array(F.lit("名"), F.lit("余额")).alias("headers"), rows.alias("rows"))
    one = F.struct(text("t", _k()).alias("table_id"), F.lit(0).alias("row"), F.lit(1).alias("col"), cents.alias("raw_value"))
    program = F.struct(F.lit("ST_SUM").alias("skeleton_id"), F.array(F.lit("sum"), F.col("c_mktsegment")).alias("operators"))
    return read(spark, sf_dir, "customer").select(
        _k().cast("string").alias("id"), text("客户", _k(), "有", cents).alias("claim"), F.array(table).alias("tables"), program.alias("program"),
        F.when(_k() % 3 == 0, F.array(one)).alias("evidence_cells"), F.array(one).alias("context_cells"),
    )


def _written(df: DataFrame, steps: Steps, name: str) -> str:
    """Path of a table as JSON lines."""
    path = f"{steps.root}/{name}"
    df.write.json(path)
    return path


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction for each order under its customer's id, in the order of orders; some have no label."""
    status = F.col("o_orderstatus")
    label = F.when(status == "F", "SUPPORTS").when(status == "O", "REFUTES")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), label.alias("label"), F.col("o_orderpriority").alias("status"), "o_orderkey")
    return rows.repartition(3, "id").sortWithinPartitions("o_orderkey")


def src_claims(spark, sf_dir):
    """The first fifty statements by id; the reader's schema keeps tables and evidence."""
    found = files.read_claims(spark, _written(claims(spark, sf_dir), steps_of(spark, "src_claims"), "claims"), limit=50)
    return found.select("id", F.col("tables")[0]["rows"][0][1].alias("cell"), F.col("evidence_cells")[0]["raw_value"].alias("evidence"))


def src_last_line_wins(spark, sf_dir):
    return files.read_predictions(spark, _written(_lines(spark, sf_dir), steps_of(spark, "src_last_line_wins"), "lines"))


def src_run_folder(spark, sf_dir):
    steps = steps_of(spark, "src_run_folder")
    _written(_lines(spark, sf_dir), steps, "runs/system_a/predictions.jsonl")
    _written(_lines(spark, sf_dir).where("id % 2 = 0"), steps, "runs/system_b/predictions.jsonl")
    return files.read_run_folder(spark, f"{steps.root}/runs")


def src_named_inputs(spark, sf_dir):
    steps = steps_of(spark, "src_named_inputs")
    one, two = _written(_lines(spark, sf_dir), steps, "one"), _written(_lines(spark, sf_dir).where("id % 2 = 0"), steps, "two")
    return files.read_named(spark, files.parse_named([f"system_a={one}", f"system_b={two}"]))


def src_prediction_sink(spark, sf_dir):
    """Customers written in two goes: the sink appends."""
    path = f"{steps_of(spark, 'src_prediction_sink').root}/predictions"
    for rest in (0, 1):
        rows = read(spark, sf_dir, "customer").where(_k() % 2 == rest).select(_k().cast("string").alias("id"), F.when(_k() % 3 == 0, "NEI").otherwise("REFUTES").alias("label"), F.col("c_mktsegment").alias("status"))
        files.write_predictions(rows, path)
    return files.read_predictions(spark, path)


def src_report_sink(spark, sf_dir):
    """A report replaces the one before it."""
    path = f"{steps_of(spark, 'src_report_sink').root}/report"
    counts = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    for report in (counts.limit(1), counts):
        files.write_report(report, path)
    return spark.read.schema("name string, value long").json(path)


def src_raw_input_hash(spark, sf_dir):
    """Hashes of raw records: absent fields are null, unknown keys of tables count."""
    table = F.struct(_k().alias("extra"), F.array(F.col("c_name")).alias("headers"))
    raw = read(spark, sf_dir, "customer").select(_k().cast("string").alias("id"), F.concat(F.lit("客户"), _k()).alias("claim"), F.when(_k() % 2 == 0, F.array(table)).alias("tables"), F.lit(1).alias("other"))
    return files.read_input_hashes(spark, _written(raw, steps_of(spark, "src_raw_input_hash"), "raw"))


def _calls(spark, sf_dir) -> DataFrame:
    """Records of customers with nested calls: absent, without error, with an empty one, or failed."""
    call = lambda error: F.struct(F.struct(error.cast("string").alias("error")).alias("api"))
    calls = F.when(_k() % 5 == 0, F.array(call(F.lit(None)), call(F.lit("timeout")))).when(_k() % 5 == 1, F.array(call(F.lit("")))).when(_k() % 5 == 2, F.array(call(F.lit(None)), F.lit(None)))
    done = F.when(_k() % 4 != 0, F.array(F.struct(F.when(_k() % 4 == 1, F.col("c_name")).alias("result")), F.struct(F.lit("x").alias("result"))))
    return read(spark, sf_dir, "customer").select(_k().cast("string").alias("id"), F.when(_k() % 7 != 0, "answered").alias("status"), calls.alias("api_calls"), done.alias("operations"))


def src_pending_calls(spark, sf_dir):
    """Of records with a status, those with a failed call are run again; so are those without a record."""
    return files.pending(claims(spark, sf_dir).select("id"), _calls(spark, sf_dir).where("id % 11 <> 0"), "calls")


def m_call_counts(spark, sf_dir):
    return M.call_counts(_calls(spark, sf_dir))


def m_report_lines(spark, sf_dir):
    """A line for each segment, with shares in eighths that print exactly."""
    eighths = lambda x: F.floor(F.avg(x.cast("double")) * 8) / 8
    report = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("system")).agg(eighths(F.col("c_acctbal") > 3000).alias("accuracy"), eighths(F.col("c_nationkey") < 9).alias("macro_f1"), F.count(F.lit(1)).alias("invalid"))
    return spark.createDataFrame([(x,) for x in M.report_lines(report)], "line string")  # a row for each system


def src_run_identity(spark, sf_dir):
    """Whether a run folder accepts settings: other data or settings are refused, other workers are not."""
    folder = f"{steps_of(spark, 'src_run_identity').root}/run"
    a, b = (f"{sf_dir}/{x}.parquet" for x in ("nation", "region"))
    out = []
    for name, settings, data in (("first", {"model": "m", "workers": 1}, a), ("again", {"model": "m", "workers": 9}, a), ("data", {"model": "m"}, b), ("model", {"model": "n"}, a)):
        try:
            files.prepare_run(spark, folder, {**settings, "name": "fixed"}, data=(data,))
            out.append((name, True))
        except ValueError:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, accepted boolean")


def llm_prompts(spark, sf_dir):
    path, out = _written(claims(spark, sf_dir), steps_of(spark, "llm_prompts"), "claims"), None
    for setting in prompts.SETTINGS:
        df = prompts.read_prompts(spark, path, setting).select(F.lit(setting).alias("setting"), "id", "prompt")
        out = df if out is None else out.unionByName(df)
    return out


def alg_package_tables(spark, sf_dir):
    """The tables of packages by the algebra's names, a row for each of theirs."""
    rows, headers = setwise.from_packages(claims(spark, sf_dir).select(F.col("id").alias("claim_id"), "tables"))
    return rows.join(headers, ["claim_id", "name"]).select("claim_id", "name", "row", F.array_join("cells", "|").alias("cells"), F.array_join("headers", "|").alias("headers"))


# ---------------------------------------------------------------- recorded SQL: a statement for each nation or segment

STATEMENTS = [
    ("SELECT n_name FROM nation WHERE n_nationkey = {k}", True, True), ("DELETE FROM nation WHERE n_nationkey = {k}", False, False), ("SELECT reflect('java.lang.Math', 'abs', {k})", False, False),
    ("SELECT max({k}) OVER w FROM nation WINDOW w AS (ORDER BY reflect('a', 'b'))", False, False), ("SELECT * FROM parquet.`/{n}`", False, False), ("SELECT replace(n_name, '{n}', '') FROM nation", False, True),
    ("WITH t AS (SELECT {k} AS a) SELECT * FROM t LATERAL VIEW explode(array(a)) x AS b", True, True), ("SELECT count(*) FROM nation HAVING count(*) > {k}", True, True), ("VALUES ({k})", False, True),
    ("SELECT java_method('java.lang.Math', 'abs', {k}) FROM nation", False, False), ("SELECT * FROM range({k})", True, True), ("SELECT 1 WHERE EXISTS (SELECT * FROM csv.`/{n}`)", False, False),
]


def _guarded_nations(strict: bool):
    def run(spark, sf_dir):
        nations = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # the 25 nations
        rows = []
        for r in nations:
            sql = STATEMENTS[r["n_nationkey"] % len(STATEMENTS)][0].format(k=r["n_nationkey"], n=r["n_name"])
            rows.append((r["n_nationkey"], (S.guard(spark, sql, strict) or "ok").split(":")[0]))
        return spark.createDataFrame(rows, "n_nationkey int, result string")

    return run


def _guard_sql(strict: bool) -> str:
    case = " ".join(f"WHEN {i} THEN '{'ok' if (a if strict else b) else 'not_read_only_select'}'" for i, (_, a, b) in enumerate(STATEMENTS))
    return f"SELECT n_nationkey, CASE n_nationkey % {len(STATEMENTS)} {case} END AS result FROM nation"


def _segments(spark, sf_dir) -> list[str]:
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return [r[0] for r in spark.sql("SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1").collect()]  # the five segments


def sql_answer_rounds(spark, sf_dir):
    """Recorded attempts about each segment: a comparison, a repair after an error, a result that is no verdict."""
    rows = []
    for s in _segments(spark, sf_dir):
        ask = f"SELECT CAST(count(*) > 30 AS INT) AS v FROM customer WHERE c_mktsegment = '{s}'"
        for name, attempts in (("one", [{"sql": ask}]), ("repaired", [{"sql": ask.replace("count", "no_such")}, {"sql": ask}]), ("number", [{"sql": ask.replace("CAST(count(*) > 30 AS INT)", "2 + count(*)")}, {"sql": ask}]), ("abstains", [{"abstain": True, "sql": ask}])):
            rows.append((s, name, *S.answer(spark, attempts)))
    return spark.createDataFrame(rows, "segment string, name string, label string, status string")


def sql_conversation(spark, sf_dir):
    """Turns that build on the step before; what they come to is the last observation."""
    rows = []
    for s in _segments(spark, sf_dir):
        turns = [{"sql": f"SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_mktsegment = '{s}' GROUP BY 1"}, {"sql": "SELECT no_such FROM step1"}, {"sql": "SELECT max(n) AS n, count(*) AS k FROM step1"}, {"final_label": "refutes"}]
        label, status, seen = S.converse(spark, turns)
        rows.append((s, label, status, len(seen), *[int(x) for x in seen[2].rows[0]]))
    return spark.createDataFrame(rows, "segment string, label string, status string, ran int, most int, nations int")


def sql_work_budget(spark, sf_dir):
    """The same statement under a budget of a few rows and under one that leaves room to save its step."""
    rows = []
    with Steps(spark) as steps:
        for s in _segments(spark, sf_dir):
            ask = f"SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = '{s}' GROUP BY 1"
            tight, wide = (S.run_step(spark, ask, steps, f"budget_{i}", budget=b) for i, b in enumerate((20, S.WORK)))
            rows.append((s, tight.error, wide.saved, wide.total))
            spark.catalog.dropTempView("budget_1")
    return spark.createDataFrame(rows, "segment string, tight string, saved boolean, nations int")


def sql_no_views_left(spark, sf_dir):
    """A conversation's steps end with it: the next one does not see them."""
    rows = []
    for s in _segments(spark, sf_dir):
        first = S.converse(spark, [{"sql": f"SELECT count(*) AS n FROM customer WHERE c_mktsegment = '{s}'"}, {"final_label": "NEI"}])
        later = S.converse(spark, [{"sql": "SELECT n FROM step1"}, {"final_label": "NEI"}])
        rows.append((s, int(first[2][0].rows[0][0]), later[2][0].error is None))
    return spark.createDataFrame(rows, "segment string, n int, later_saw_it boolean")


def _nation_rows(spark, sf_dir) -> list[list[str]]:
    joined = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey")
    return [[r["n_name"], r["r_name"], f"{r['n_nationkey']:,}%"] if r["n_nationkey"] % 5 else [r["n_name"], r["r_name"]] for r in joined.collect()]  # the 25 nations


def sql_load_table(spark, sf_dir):
    """An evidence table with a repeated header, short rows and a numeric twin, read through SQL."""
    S.load_table(spark, "loaded", ["名", "名", "值"], _nation_rows(spark, sf_dir))
    return spark.sql("SELECT _row, `名` AS name, `名_2` AS region, `值` AS raw, `值__num` AS num FROM loaded")


def sql_schema_text(spark, sf_dir):
    df = S.load_table(spark, "nations", ["名", "区", "值"], _nation_rows(spark, sf_dir))
    return spark.createDataFrame([(S.schema_text(df, "nations", "国家"),)], "text string")


def sql_header_names(spark, sf_dir):
    """Names of a table that has the regions of all nations as its headers."""
    names = S.header_names([r[1] for r in _nation_rows(spark, sf_dir)])
    return spark.createDataFrame(list(enumerate(names)), "n_nationkey int, name string")


_CENTS = "CAST(round(c_acctbal * 100) AS BIGINT)"
_LAST = "SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN 'REFUTES' ELSE 'INVALID' END, o_orderkey) AS label, arg_max(o_orderpriority, o_orderkey) AS status FROM orders GROUP BY o_custkey"
_HEAD = "\n\n".join([prompts.LABEL_DEFINITIONS, prompts.ROUNDING, prompts.ANSWER_FORMAT]).replace("'", "''")
_PROMPT = f"""'{_HEAD}' || chr(10) || chr(10) || 'Claim: 客户' || k || '有' || v || chr(10) || chr(10)"""
_TABLE = """'Tables:' || chr(10) || 'Table t' || k || ': ' || CASE WHEN k % 2 = 0 THEN '表' ELSE '' END || chr(10) || 'Headers: ["名", "余额"]' || chr(10) || 'Rows: [["' || c_name || '", "' || v || '"], ["a \\"b\\"", "' || c_mktsegment || '"]]'"""
_EXTRA = {
    "claim-only": f"'{prompts.NO_TABLES}'", "full-table": _TABLE,
    "oracle-evidence": _TABLE + """ || chr(10) || chr(10) || 'Relevant cells (gold): [["t' || k || '", 0, 1, "' || v || '"]]'""",
    "oracle-program": _TABLE + """ || chr(10) || chr(10) || 'Verification program (operators to apply over the tables): {"skeleton": "ST_SUM", "operators": ["sum", "' || c_mktsegment || '"]}'""",
}
_OF_SEGMENT = "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"

QUERIES = {f.__name__: f for f in (
    src_claims, src_last_line_wins, src_run_folder, src_named_inputs, src_prediction_sink, src_report_sink, src_raw_input_hash, src_pending_calls, m_call_counts, m_report_lines, src_run_identity,
    llm_prompts, alg_package_tables, sql_answer_rounds, sql_conversation, sql_work_budget, sql_no_views_left, sql_load_table, sql_schema_text, sql_header_names,
)} | {"sql_read_only_guard": _guarded_nations(True), "sql_guard_whole_plan": _guarded_nations(False)}

_TWO = f"WITH l AS ({_LAST}) SELECT 'system_a' AS system, id, label FROM l UNION ALL SELECT 'system_b', id, label FROM l WHERE CAST(id AS BIGINT) % 2 = 0"
ORACLES = {
    "src_claims": f"SELECT CAST(c_custkey AS VARCHAR) AS id, CAST({_CENTS} AS VARCHAR) AS cell, CASE WHEN c_custkey % 3 = 0 THEN CAST({_CENTS} AS VARCHAR) END AS evidence FROM customer ORDER BY 1 LIMIT 50",
    "src_last_line_wins": _LAST,
    "src_run_folder": _TWO,
    "src_named_inputs": _TWO,
    "src_prediction_sink": "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'NEI' ELSE 'REFUTES' END AS label, c_mktsegment AS status FROM customer",
    "src_report_sink": "SELECT c_mktsegment AS name, count(*) AS value FROM customer GROUP BY 1",
    "src_raw_input_hash": """SELECT CAST(c_custkey AS VARCHAR) AS id, sha256('{"claim": "客户' || c_custkey || '", "context_cells": null, "evidence_cells": null, "program": null, "tables": ' ||
      CASE WHEN c_custkey % 2 = 0 THEN '[{"extra": ' || c_custkey || ', "headers": ["' || c_name || '"]}]' ELSE 'null' END || '}') AS input_sha256 FROM customer""",
    "src_pending_calls": "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR c_custkey % 5 = 0",
    "m_call_counts": "SELECT count(*) FILTER (c_custkey % 5 = 0) AS api_failures, count(*) FILTER (c_custkey % 4 <> 0) + count(*) FILTER (c_custkey % 4 = 1) AS operations_executed FROM customer",
    "m_report_lines": """SELECT printf('%-40s %6.1f %8.1f %7d', c_mktsegment, 100 * floor(avg(CAST(c_acctbal > 3000 AS DOUBLE)) * 8) / 8, 100 * floor(avg(CAST(c_nationkey < 9 AS DOUBLE)) * 8) / 8, count(*)) AS line FROM customer GROUP BY c_mktsegment""",
    "src_run_identity": "SELECT unnest(['first', 'again', 'data', 'model']) AS name, unnest([true, true, false, false]) AS accepted",
    "llm_prompts": f"WITH c AS (SELECT *, c_custkey AS k, {_CENTS} AS v FROM customer) " + " UNION ALL ".join(f"SELECT '{s}' AS setting, CAST(k AS VARCHAR) AS id, {_PROMPT} || {x} AS prompt FROM c" for s, x in _EXTRA.items()),
    "alg_package_tables": f"""SELECT CAST(c_custkey AS VARCHAR) AS claim_id, 't0' AS name, i AS row, CASE i WHEN 0 THEN c_name || '|' || {_CENTS} ELSE 'a "b"|' || c_mktsegment END AS cells, '名|余额' AS headers FROM customer, range(2) AS g(i)""",
    "sql_read_only_guard": _guard_sql(True),
    "sql_guard_whole_plan": _guard_sql(False),
    "sql_answer_rounds": f"""WITH s AS ({_OF_SEGMENT}) SELECT segment, name, CASE WHEN name = 'abstains' THEN 'NEI' WHEN name = 'number' THEN 'INVALID' WHEN n > 30 THEN 'SUPPORTS' ELSE 'REFUTES' END AS label,
      CASE name WHEN 'abstains' THEN 'abstain' WHEN 'number' THEN 'non_boolean_or_empty_result' ELSE 'executed' END AS status FROM s, (VALUES ('one'), ('repaired'), ('number'), ('abstains')) AS x(name)""",
    "sql_conversation": """WITH n AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)
      SELECT s AS segment, 'REFUTES' AS label, 'answered' AS status, 3 AS ran, max(n) AS most, count(*) AS nations FROM n GROUP BY s""",
    "sql_work_budget": "SELECT c_mktsegment AS segment, 'cost_bound' AS tight, true AS saved, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1",
    "sql_no_views_left": f"SELECT segment, n, false AS later_saw_it FROM ({_OF_SEGMENT})",
    "sql_load_table": """SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS _row, n_name AS name, r_name AS region, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_nationkey || '%' END AS raw,
      CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS DOUBLE) END AS num FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "sql_schema_text": """WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_name || ' | ' || r_name || ' | ' || CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_nationkey || '%' END AS t FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT 'nations（国家）列："名"，"区"，"值"；数值列："值__num"' || chr(10) || string_agg('  例：' || t, chr(10) ORDER BY i) AS text FROM r WHERE i <= 3""",
    "sql_header_names": """SELECT n_nationkey, CASE WHEN i = 1 THEN r_name ELSE r_name || '_' || i END AS name
      FROM (SELECT n_nationkey, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS i FROM nation JOIN region ON n_regionkey = r_regionkey)""",
}
