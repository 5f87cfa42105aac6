"""Readers and writers: statements, predictions, run folders, resumption and run metadata."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructField, StructType

CLAIMS = (
    "id string, claim string, label string, "
    "tables array<struct<table_id string, title string, headers array<string>, rows array<array<string>>, period int>>, "
    "program struct<skeleton_id string, category string, operators array<string>, slots map<string,string>>, "
    "evidence_cells array<struct<table_id string, row int, col int, raw_value string>>, "
    "context_cells array<struct<table_id string, row int, col int, raw_value string>>, "
    "table_topology string, domain string"
)
PREDICTION = "id string, label string, status string, raw_output string, input_sha256 string, run_fingerprint string"
#: Settings that do not change what a run computes.
NOT_SEMANTIC = ("out", "claims", "workers", "api_key_name")


def read_claims(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Statements; a limit takes the first ids, whatever order the files are read in."""
    df = spark.read.schema(CLAIMS).json(path)
    return df.orderBy("id").limit(limit) if limit else df


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row per id: the last line of a file wins, a missing label is INVALID.

    Lines are numbered by byte order: file position comes from the reader, so no sort of the data.
    """
    lines = spark.read.schema(PREDICTION).json(path).withColumns({"_file": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    last = lines.groupBy("id").agg(F.max_by(F.struct(F.coalesce("label", F.lit("INVALID")).alias("label"), "status"), F.struct("_file", "_at")).alias("_l"))
    return last.select("id", "_l.label", "_l.status")


def read_run_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions of every ``<system>/predictions.jsonl`` below a folder, with the system's name."""
    lines = spark.read.schema(PREDICTION).json(f"{folder.rstrip('/')}/*/predictions.jsonl")
    system = F.regexp_extract(F.input_file_name(), r"([^/]+)/predictions\.jsonl(?:/[^/]*)?$", 1)  # a file, or a folder of its parts
    lines = lines.withColumns({"system": F.url_decode(system), "_at": F.monotonically_increasing_id()})
    return lines.groupBy("system", "id").agg(F.max_by(F.coalesce("label", F.lit("INVALID")), "_at").alias("label"))


def read_named(spark: SparkSession, named: dict[str, str]) -> DataFrame:
    """Predictions of NAME=PATH inputs, united."""
    out = None
    for name, path in named.items():
        df = read_predictions(spark, path).select(F.lit(name).alias("system"), "id", "label")
        out = df if out is None else out.unionByName(df)
    if out is None:
        raise ValueError("give at least one NAME=PATH")
    return out


def parse_named(items: list[str]) -> dict[str, str]:
    return {name: path for name, _, path in (x.partition("=") for x in items)}


def pending(claims: DataFrame, done: DataFrame, rule: str = "status") -> DataFrame:
    """Statements still to be run. rule: what makes a record count as finished.

    ``raw_output``: it has an output; ``status``: it has a status; ``identity``: it has one, and the input
    hash and fingerprint (columns of ``claims``) are equal, a repeated id or another input being an error;
    ``calls``: it has a status and none of its recorded calls (``api_calls``) has an error.
    """
    if rule == "identity":
        keys = ["id", "input_sha256", "run_fingerprint"]
        wrong = done.join(claims.select(*keys), keys, "left_anti").limit(1).count() or done.groupBy("id").count().filter("count > 1").limit(1).count()
        if wrong:
            raise ValueError("resume identity mismatch")
        finished = done
    elif rule == "calls":
        failed = F.exists("api_calls", lambda c: F.coalesce(c["api"]["error"].isNotNull() & (c["api"]["error"].cast("string") != ""), F.lit(False)))
        finished = done.filter(F.coalesce(F.col("status") != "", F.lit(False)) & ~F.coalesce(failed, F.lit(False)))
    elif rule in ("status", "raw_output"):
        finished = done.filter(F.col(rule).isNotNull())
    else:
        raise ValueError(rule)
    return claims.join(finished.select("id").distinct(), "id", "left_anti")


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def serialize_tables(claims: DataFrame) -> DataFrame:
    """id and the text form of a statement's tables: id and title, headers and rows as JSON, in order."""
    block = lambda t: F.concat(
        F.lit("Table "), t["table_id"], F.lit(": "), F.coalesce(t["title"], F.lit("")),
        F.lit("\nHeaders: "), F.to_json(t["headers"]), F.lit("\nRows: "), F.to_json(t["rows"]),
    )
    return claims.select("id", F.array_join(F.transform("tables", block), "\n\n").alias("text"))


@pandas_udf(StringType())
def input_hash(payload: pd.Series) -> pd.Series:
    """SHA-256 of a JSON object with sorted keys and Python's separators, non-ASCII kept."""
    return payload.map(lambda x: hashlib.sha256(json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True).encode()).hexdigest())


HASHED = ("claim", "tables", "program", "evidence_cells", "context_cells")


@pandas_udf(StructType([StructField("id", StringType()), StructField("input_sha256", StringType())]))
def _record_hash(lines: pd.Series) -> pd.DataFrame:
    def one(line: str) -> tuple[str | None, str]:
        record = json.loads(line)
        text = json.dumps({k: record.get(k) for k in HASHED}, ensure_ascii=False, sort_keys=True)
        return record.get("id"), hashlib.sha256(text.encode()).hexdigest()

    return pd.DataFrame([one(x) for x in lines], columns=["id", "input_sha256"])


def read_input_hashes(spark: SparkSession, path: str) -> DataFrame:
    """id and SHA-256 of the five input fields of each raw record, whatever else its tables hold."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(_record_hash("value").alias("r")).select("r.*")


def with_input_hash(claims: DataFrame) -> DataFrame:
    """Hash of typed records, whose absent fields are null; ``read_input_hashes`` is the one of raw lines."""
    fields = ["claim", "tables", "program", "evidence_cells", "context_cells"]
    return claims.withColumn("input_sha256", input_hash(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def fingerprint(settings: dict) -> str:
    """SHA-256 over the settings that matter; the caller adds hashes of data and code to them."""
    kept = {k: v for k, v in settings.items() if k not in NOT_SEMANTIC}
    return hashlib.sha256(json.dumps(kept, sort_keys=True).encode()).hexdigest()


def content_hashes(spark: SparkSession, *paths: str) -> dict[str, str]:
    """SHA-256 of files or folders by path, for run metadata: taken by the tasks that read them.

    A folder's hash is that of its files' hashes in the order of their names.
    """
    out = {}
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        parts = files.select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()  # a row for each file
        out[path] = parts[0].h if len(parts) == 1 else hashlib.sha256("".join(p.h for p in parts).encode()).hexdigest()
    return out


def prepare_run(spark: SparkSession, folder: str, settings: dict, data: tuple[str, ...] = (), code: tuple[str, ...] = ()) -> dict:
    """Write or check the run's metadata; another fingerprint, or predictions without one, are refused.

    data and code: files whose contents belong to the run's identity.
    """
    Path = spark._jvm.org.apache.hadoop.fs.Path
    at = Path(f"{folder.rstrip('/')}/run_meta.json")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    known = {"data_sha256": data, "code_sha256": code}
    settings = dict(settings) | {k: content_hashes(spark, *v) for k, v in known.items() if v}
    meta = settings | {"run_fingerprint": fingerprint(settings)}
    if fs.exists(at):
        previous = json.loads(spark.read.text(at.toString(), wholetext=True).first()[0])
        if previous.get("run_fingerprint") != meta["run_fingerprint"]:
            raise ValueError("the folder belongs to other inputs or settings")
        return previous
    if fs.exists(Path(f"{folder.rstrip('/')}/predictions.jsonl")):
        raise ValueError("predictions exist without run metadata")
    out = fs.create(at)
    out.write(bytearray(json.dumps(meta, ensure_ascii=False, indent=2).encode()))
    out.close()
    return meta


def file_order(df: DataFrame) -> DataFrame:
    """Number rows of small inputs by file and place in it."""
    return df.withColumn("line_no", F.row_number().over(Window.orderBy(F.input_file_name(), F.monotonically_increasing_id())) - 1)
