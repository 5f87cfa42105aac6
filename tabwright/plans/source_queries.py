"""Queries over sources, table loading, recorded SQL rounds and small cell helpers, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import cells as C
from tabwright.functions import verdict as V
from tabwright.operators import profile as P
from tabwright.operators import sqlsurface as S
from tabwright.plans.cell_queries import MEDALS, tables, values_sql
from tabwright.plans.relational_queries import read
from tabwright.sources import files

_CELLS = "array<struct<table_id string, row int, col int, raw_value string>>"


def _nation_claims(spark, sf_dir) -> DataFrame:
    """A statement for each region, whose only table lists the region's nations in key order."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    nations = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(rows, lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])).alias("rows"))
    table = F.struct(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("table_id"),
        F.col("r_name").alias("title"),
        F.array(F.lit("key"), F.lit("name")).alias("headers"),
        F.col("rows"),
    )
    joined = read(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("claim"), F.array(table).alias("tables"))


def src_serialize_tables(spark, sf_dir):
    return files.serialize_tables(_nation_claims(spark, sf_dir))


SERIALIZE_SQL = """
SELECT CAST(r_regionkey AS VARCHAR) AS id,
  'Table r' || r_regionkey || ': ' || r_name || chr(10) || 'Headers: ["key","name"]' || chr(10) || 'Rows: [' ||
  string_agg('["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY n_nationkey) || ']' AS text
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name
"""


def src_input_hash(spark, sf_dir):
    """Digest of a statement's inputs: keys sorted, nulls kept."""
    claims = _nation_claims(spark, sf_dir).withColumn("tables", F.transform("tables", lambda t: F.struct(t["title"].alias("title"), t["table_id"].alias("table_id"))))
    empty = {c: F.lit(None).cast(_CELLS) for c in ("evidence_cells", "context_cells")}
    claims = claims.withColumns({"program": F.lit(None).cast("struct<skeleton_id string>"), **empty})
    return files.with_input_hash(claims).select("id", "input_sha256")


HASH_SQL = """
SELECT CAST(r_regionkey AS VARCHAR) AS id, sha256('{"claim": "' || r_name || '", "context_cells": null, "evidence_cells": null, "program": null, ' ||
  '"tables": [{"table_id": "r' || r_regionkey || '", "title": "' || r_name || '"}]}') AS input_sha256
FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
"""


def _pending(rule: str):
    def run(spark, sf_dir):
        claims = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
        done = read(spark, sf_dir, "labels").select(
            F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "executed").alias("status"), F.when(F.col("toxic") == 0, "{}").alias("raw_output")
        )
        return files.pending(claims, done, rule)

    return run


def _pending_sql(done: str) -> str:
    return f"SELECT doc_id AS id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels x WHERE x.doc_id = d.doc_id AND {done})"


DECIMALS = [("8.53", 2), ("10.4%", 1), ("12", 0), ("从1.250升至2.5", 3), ("", 0), (None, 0)]
FLOATS = [(1e16, "1e+16"), (1e7, "10000000.0"), (0.1, "0.1"), (-2.0, "-2.0"), (1e-5, "1e-05"), (None, None)]
OBJECTS = [('{"a": 1}', 1), ('x {"a": 2} y', 2), ("[1]", None), ("{'a': 3}", None), ("", None)]
HEADERS = [(["国", "金", "金", "", "", "金"], "国|金|金_2|col|col_2|金_3"), (["a"], "a")]


def _literal(rows: list[tuple], schema: str, shown):
    """Query over the first values of literal rows; ``shown`` gives the column that the second ones hold."""

    def run(spark, sf_dir):
        df = spark.createDataFrame([(r[0],) for r in rows], schema)
        return df.select(*df.columns, shown(df[df.columns[0]]))

    return run


def verdict_json_object(spark, sf_dir):
    """A lenient JSON object's member; recorded answers are few, so they are read here."""
    return spark.createDataFrame([(raw, V.json_object(raw).get("a")) for raw, _ in OBJECTS], "raw string, a int")


def sql_header_names(spark, sf_dir):
    return spark.createDataFrame([("|".join(h), "|".join(S.header_names(h))) for h, _ in HEADERS], "headers string, names string")


def sql_load_table(spark, sf_dir):
    """An evidence table with a repeated header, a short row and numeric twins, read through SQL."""
    S.load_table(spark, "loaded", ["国", "金", "金"], [["挪威", "16", "1,000"], ["德国", "12"], ["合计", "28", "1,000"]])
    return spark.sql("SELECT _row, `国` AS country, `金` AS raw, `金__num` AS num, `金_2__num` AS num2 FROM loaded")


LOADED = [(0, "挪威", "16", 16.0, 1000.0), (1, "德国", "12", 12.0, None), (2, "合计", "28", 28.0, 1000.0)]
SCHEMA_TEXT = 'medals（奖牌）列："国家"，"金牌"，"银牌"；数值列："金牌__num"，"银牌__num"\n  例：挪威 | 16 | 8\n  例：德国 | 12 | 10\n  例：中国 | 9 | 4'


def sql_schema_text(spark, sf_dir):
    df = S.load_table(spark, "medals", MEDALS[1], MEDALS[2])
    return spark.createDataFrame([(S.schema_text(df, "medals", "奖牌"),)], "text string")


#: Recorded attempts, then the label and status that they end with.
ROUNDS = [
    ("holds", [{"sql": "SELECT 1 AS verdict"}], "SUPPORTS", "executed"),
    ("text_zero", [{"sql": "SELECT '0' AS verdict"}], "REFUTES", "executed"),
    ("null", [{"sql": "SELECT NULL AS verdict"}], "INVALID", "non_boolean_or_empty_result"),
    ("two_rows", [{"sql": "SELECT 1 AS v UNION ALL SELECT 1"}], "INVALID", "non_boolean_or_empty_result"),
    ("abstains", [{"abstain": True, "sql": "SELECT 1"}], "NEI", "abstain"),
    ("repaired", [{"sql": "SELECT x FROM nowhere_at_all"}, {"sql": "SELECT 1"}], "SUPPORTS", "executed"),
    ("no_repair_of_a_result", [{"sql": "SELECT 7"}, {"sql": "SELECT 1"}], "INVALID", "non_boolean_or_empty_result"),
    ("no_third_try", [{"sql": "SELEC"}, {"sql": "SELEC"}, {"sql": "SELECT 1"}], "INVALID", "failed_after_repair"),
]
#: Recorded turns, then label, status and the number of statements that ran.
TALKS = [
    ("two_steps", [{"sql": "SELECT 3 AS n"}, {"sql": "SELECT n + 1 AS n FROM step1"}, {"final_label": "supports"}], "SUPPORTS", "answered", 2),
    ("an_error_uses_a_turn", [{"sql": "SELEC"}, {"final_label": "NEI"}], "NEI", "answered", 1),
    ("no_label_in_five", [{"sql": "SELECT 1"}] * 5 + [{"final_label": "NEI"}], "INVALID", "no_final_label", 5),
]


def sql_answer_rounds(spark, sf_dir):
    return spark.createDataFrame([(name, *S.answer(spark, attempts)) for name, attempts, *_ in ROUNDS], "name string, label string, status string")


def sql_conversation(spark, sf_dir):
    rows = []
    for name, turns, *_ in TALKS:
        label, status, seen = S.converse(spark, turns)
        rows.append((name, label, status, len(seen)))
    return spark.createDataFrame(rows, "name string, label string, status string, ran int")


def sql_observation(spark, sf_dir):
    """What a full observation reports: rows shown, and rows fetched up to the limit."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    seen = S.run_sql(spark, "SELECT c_custkey FROM customer", show=S.SHOWN, fetch=S.FETCHED)
    return spark.createDataFrame([(len(seen.rows), seen.total, ",".join(seen.columns))], "shown int, total int, names string")


def prof_rank(spark, sf_dir):
    return P.rank_columns(P.profile_tables(tables(spark))[1])


def prof_lookup_loose(spark, sf_dir):
    kept, profiled = P.profile_tables(tables(spark))
    wanted = spark.createDataFrame([("t1", "挪威*"), ("t2", "浙江"), ("t2", "没有")], "table_id string, name string")
    return P.lookup(kept, profiled, wanted, loose=True)


QUERIES = {
    "src_pending_status": _pending("status"),
    "src_pending_raw_output": _pending("raw_output"),
    "cell_decimals_stated": _literal(DECIMALS, "raw string", lambda c: C.decimals_stated(c).alias("places")),
    "verdict_float_text": _literal(FLOATS, "value double", lambda c: V.python_float_text(c).alias("shown")),
    **{
        f.__name__: f
        for f in (
            src_serialize_tables, src_input_hash, verdict_json_object, sql_header_names, sql_load_table, sql_schema_text, sql_answer_rounds,
            sql_conversation, sql_observation, prof_rank, prof_lookup_loose,
        )
    },
}

ORACLES = {
    "src_serialize_tables": SERIALIZE_SQL,
    "src_input_hash": HASH_SQL,
    "src_pending_status": _pending_sql("quality = 1"),
    "src_pending_raw_output": _pending_sql("toxic = 0"),
    "cell_decimals_stated": values_sql(DECIMALS, ["raw", "places"], ["VARCHAR", "INT"]),
    "verdict_float_text": values_sql(FLOATS, ["value", "shown"], ["DOUBLE", "VARCHAR"]),
    "verdict_json_object": values_sql(OBJECTS, ["raw", "a"], ["VARCHAR", "INT"]),
    "sql_header_names": values_sql([("|".join(h), n) for h, n in HEADERS], ["headers", "names"], ["VARCHAR", "VARCHAR"]),
    "sql_load_table": values_sql(LOADED, ["_row", "country", "raw", "num", "num2"], ["BIGINT", "VARCHAR", "VARCHAR", "DOUBLE", "DOUBLE"]),
    "sql_schema_text": values_sql([(SCHEMA_TEXT,)], ["text"], ["VARCHAR"]),
    "sql_answer_rounds": values_sql([(n, x, s) for n, _, x, s in ROUNDS], ["name", "label", "status"], ["VARCHAR"] * 3),
    "sql_conversation": values_sql([(n, *rest) for n, _, *rest in TALKS], ["name", "label", "status", "ran"], ["VARCHAR"] * 3 + ["INT"]),
    "sql_observation": "SELECT CAST(least(30, count(*)) AS INT) AS shown, CAST(least(5000, count(*)) AS INT) AS total, 'c_custkey' AS names FROM customer",
    "prof_rank": values_sql([("t2", 0)], ["table_id", "rank"], ["VARCHAR", "INT"]),
    "prof_lookup_loose": values_sql([("t1", "挪威*", 0), ("t2", "浙江", 2)], ["table_id", "name", "row_idx"], ["VARCHAR", "VARCHAR", "INT"]),
}
