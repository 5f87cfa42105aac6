"""Scoring of predictions as aggregations over (gold, pred) pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.verdict import INVALID, LABELS


def pair(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold rows with their prediction; a missing one is INVALID. Both have id; gold label, pred label."""
    p = pred.select("id", F.coalesce("label", F.lit(INVALID)).alias("pred"))
    return gold.withColumnRenamed("label", "gold").join(p, "id", "left").fillna(INVALID, ["pred"])


def last_prediction(lines: DataFrame) -> DataFrame:
    """One row per id: the label of its last line; a missing label is INVALID."""
    return lines.groupBy("id").agg(F.max_by(F.coalesce("label", F.lit(INVALID)), "line_no").alias("label"))


def confusion(pairs: DataFrame) -> DataFrame:
    """gold, pred, n for every cell, zeros included."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(g, p) for g in LABELS for p in (*LABELS, INVALID)], "gold string, pred string")
    return grid.join(pairs.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")), ["gold", "pred"], "left").fillna(0, ["n"])


def f1_of(label: str) -> Column:
    tp = F.count_if((F.col("gold") == label) & (F.col("pred") == label))
    fp = F.count_if((F.col("gold") != label) & (F.col("pred") == label))
    fn = F.count_if((F.col("gold") == label) & (F.col("pred") != label))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return share(2 * precision * recall, precision + recall)


def _columns() -> list[Column]:
    f1 = {x: f1_of(x) for x in LABELS}
    present = {x: F.count_if(F.col("gold") == x) > 0 for x in LABELS}
    n_present = sum(F.when(p, 1).otherwise(0) for p in present.values())
    return [
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg((F.col("gold") == F.col("pred")).cast("int")), F.lit(0.0)).alias("accuracy"),
        *[f1[x].alias(f"f1_{x.lower()}") for x in LABELS],
        (sum(f1.values()) / 3).alias("macro_f1"),
        (sum(F.when(present[x], f1[x]).otherwise(0.0) for x in LABELS) / F.greatest(n_present, F.lit(1))).alias("present_macro_f1"),
        F.count_if(F.col("pred") == INVALID).alias("invalid"),
    ]


def scores(pairs: DataFrame) -> DataFrame:
    """One row: n, accuracy, F1 by label, macro F1 (always by three), that of present labels, invalid."""
    return pairs.agg(*_columns())


def grouped_scores(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n, accuracy, present_macro_f1: one pass over the pairs for all fields."""
    long = pairs.select("gold", "pred", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("_g"))
    out = long.groupBy(F.col("_g.field").alias("field"), F.col("_g.value").alias("value")).agg(*_columns())
    return out.select("field", "value", "n", "accuracy", "present_macro_f1")


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def call_counts(records: DataFrame) -> DataFrame:
    """api_failures and operations_executed over nested arrays of calls and operations; absent arrays count none."""
    failed = F.size(F.filter("api_calls", lambda c: F.coalesce(c["api"]["error"] != "", F.lit(False))))
    done = F.size(F.filter("operations", lambda o: o["result"].isNotNull()))
    total = lambda n, name: F.coalesce(F.sum(F.when(n > 0, n)), F.lit(0)).cast("long").alias(name)
    return records.agg(total(failed, "api_failures"), total(done, "operations_executed"))


def bootstrap(pairs: DataFrame, metric: str = "macro_f1", n: int = 1000, seed: int = 7) -> list[float]:
    """95 % interval in percent from n resamples of the pairs.

    A resample only matters through its twelve confusion cells, so each is a multinomial draw from
    the observed cells: the cost does not depend on the number of pairs.
    """
    import numpy as np

    cells = [(r.gold, r.pred, r.n) for r in confusion(pairs).collect()]  # twelve rows
    total = sum(c[2] for c in cells)
    if not total:
        return [0.0, 0.0]
    rng = np.random.default_rng(seed)
    draws = rng.multinomial(total, np.array([c[2] for c in cells]) / total, n)
    values = sorted(_metric(dict(zip([(g, p) for g, p, _ in cells], d)), metric) for d in draws)
    return [round(100 * values[int(0.025 * n)], 1), round(100 * values[int(0.975 * n) - 1], 1)]


#: Chances that a row is drawn at most 0, 1, 2, ... times by one resample of many rows.
DRAWN = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(10))


def resampled(pairs: DataFrame, n: int) -> DataFrame:
    """Every pair with the resamples that draw it: (replicate, drawn), drawn being how many times.

    The generator has no state: eight hexadecimal digits of the MD5 of "block:id" are a uniform number for each of the block's four
    replicates, so that any engine, task or rerun draws the same. Counts follow Poisson's law of mean one, as draws with
    replacement from many rows do.
    """
    blocks = pairs.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4))))
    blocks = blocks.withColumn("_h", F.md5(F.concat_ws(":", "_b", "id")))
    parts = blocks.withColumn("_j", F.explode(F.array(*map(F.lit, range(4)))))
    u = F.conv(F.substring("_h", F.col("_j") * 8 + 1, F.lit(8)), 16, 10).cast("double") / 4294967296.0
    drawn = sum(F.when(u >= x, 1).otherwise(0) for x in DRAWN)
    out = parts.withColumns({"replicate": F.col("_b") * 4 + F.col("_j"), "drawn": drawn}).drop("_b", "_h", "_j")
    return out.where((F.col("drawn") > 0) & (F.col("replicate") < n))


def bootstrap_intervals(pairs: DataFrame, by: str | None = None, n: int = 1000) -> DataFrame:
    """95 % intervals in percent of accuracy and macro F1, of all pairs (id, gold, pred) or of each group.

    All replicates are summed in one aggregation, in the tasks that draw them first; of each group and replicate one row moves.
    """
    group = (F.col(by) if by else F.lit("all")).cast("string").alias("group")
    rows = resampled(pairs.select(group, F.col("id").cast("string").alias("id"), "gold", "pred"), n)
    total = lambda hit: F.sum(F.when(hit, F.col("drawn")).otherwise(0))
    gold, pred = F.col("gold"), F.col("pred")
    sums = {"rows": F.sum("drawn"), "right": total(gold == pred)}
    for x in LABELS:
        sums |= {f"tp_{x}": total((gold == x) & (pred == x)), f"of_{x}": total(gold == x) + total(pred == x)}
    per = rows.groupBy("group", "replicate").agg(*[v.alias(k) for k, v in sums.items()])
    f1 = sum(F.coalesce(F.try_divide(2 * F.col(f"tp_{x}"), F.col(f"of_{x}")), F.lit(0.0)) for x in LABELS) / 3
    per = per.select("group", (F.col("right") / F.col("rows")).alias("accuracy"), f1.alias("macro_f1"))
    drawn = per.groupBy("group").agg(*[F.array_sort(F.collect_list(x)).alias(x) for x in ("accuracy", "macro_f1")])  # n numbers a group
    at = lambda x, share, less: F.round(100 * F.get(x, F.greatest(F.lit(0), F.floor(share * F.size(x)) - less).cast("int")), 1)
    return drawn.select("group", *[f(x).alias(f"{x}_{end}") for x in ("accuracy", "macro_f1") for end, f in (("low", lambda x: at(x, 0.025, 0)), ("high", lambda x: at(x, 0.975, 1)))])


def _metric(cells: dict, metric: str) -> float:
    total = sum(cells.values())
    if metric == "accuracy":
        return sum(int(v) for (g, p), v in cells.items() if g == p) / total
    out = []
    for x in LABELS:
        tp = int(cells[x, x])
        said, real = sum(int(v) for (_, p), v in cells.items() if p == x), sum(int(v) for (g, _), v in cells.items() if g == x)
        out.append(2 * tp / (said + real) if tp else 0.0)
    return sum(out) / 3


def report_lines(report: DataFrame) -> list[str]:
    """One text line per system of a report with columns system and those of ``scores``."""
    rows = report.orderBy("system").collect()
    return [f"{r.system:40s} {100 * r.accuracy:6.1f} {100 * r.macro_f1:8.1f} {r.invalid:7d}" for r in rows]
