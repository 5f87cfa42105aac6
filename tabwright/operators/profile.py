"""Column profiling and removal of total rows, set-wise over any number of tables.

Cells are long rows (table_id, row_idx, col_idx, header, raw): one row per cell, so that a profile is
one aggregation by (table_id, col_idx) and a job serves all tables at once. Two passes: the first types
all rows and finds key and rank columns, the second types what is left without total rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions import cells as C
from tabwright.sources.scratch import Steps

# Header patterns that decide what a column may be.
FORBIDDEN_METRIC = (
    r"年份|年度|年代|日期|时间|届|赛季|编号|序号|代码|排名|名次|^名$|^#$|^No\.?$|次序|顺位|位次|邮编|电话|"
    r"比分|比数|成绩|坐标|经度|纬度|海拔高度范围|成立|创建|出生|逝世|生卒|首次|开幕|建成|任期|号码|车号|背号|列\d+$|"
    r"轮次|^轮|周次|期别|场序|赛程|得票|投票|票数|排序|顺序|等级|星级|邮政|区号|面值|汇率|合人民币"
)
RANK_HEADER = "^(排名|名次|名|#|位次|排位|序)$"
KEY_HINT = (
    "球队|队伍|俱乐部|球员|姓名|名称|国家|地区|省|市|城市|车手|车队|学校|大学|机场|公司|企业|电影|影片|作品|"
    "河流|山峰|建筑|代表团|运动员|选手|项目|区|县|州|政区"
)
CHANGE_WORDS = "净|差|变化|增|涨|跌|盈亏"


def explode_tables(tables: DataFrame) -> DataFrame:
    """Cells of tables (table_id, headers array<string>, rows array<array<string>>); short rows are padded."""
    rows = tables.select("table_id", "headers", F.posexplode_outer("rows").alias("row_idx", "_cells"))
    # A table without rows keeps its columns: one cell each without a row number and without a value.
    raw = F.when(F.col("row_idx").isNotNull(), F.coalesce(F.get("_cells", F.col("col_idx")), F.lit("")))
    return rows.select("table_id", "row_idx", "_cells", F.posexplode("headers").alias("col_idx", "header")).select("table_id", "row_idx", "col_idx", "header", raw.alias("raw"))


def with_values(cells: DataFrame) -> DataFrame:
    """Add number, unit, entity key and join key of each cell. A plain projection: what several of them need is worked out once a cell."""
    raw = F.col("raw")
    return cells.select("*", C.parse_number(raw).alias("num"), C.unit(raw).alias("_unit"), C.entity_key(raw).alias("ekey"), C.join_key(raw).alias("jkey"))


def _share(hits: Column, of: Column) -> Column:
    return F.coalesce(F.try_divide(hits, of), F.lit(0.0))


def valued(texts: DataFrame) -> DataFrame:
    """Number, unit and entity key beside each raw text."""
    raw = F.col("raw")
    return texts.select("*", C.parse_number(raw).alias("num"), C.unit(raw).alias("unit"), C.entity_key(raw).alias("ekey"))


def profile(cells: DataFrame) -> DataFrame:
    """One row per column: kind, reason, ratios, period, unit, is_rate, from raw cells.

    Values are worked out once for each distinct raw text of a column; columns of many rows are counted in the tasks that read them.
    """
    own = ["table_id", "col_idx", "header"]
    return typed(_measures(valued(cells.groupBy(*own, "raw").agg(F.count("row_idx").alias("n"), F.count(F.lit(1)).alias("k"))), own))


def _measures(raws: DataFrame, own: list[str]) -> DataFrame:
    """What ``typed`` asks of each column, from its distinct raw texts (raw, n, k, num, unit, ekey): n rows and k cells hold a text.

    All groupings but the last, which sees a row for each unit of a column, keep numbers only, so that they hash and do not sort.
    """
    raw, num, ekey = F.col("raw"), F.col("num"), F.col("ekey")
    full = F.coalesce(~raw.isin(*C.MISSING), F.lit(False))
    whole = num == F.floor("num")
    signed = F.substring(C.strip(raw), 1, 1).isin("+", "−", "–", "-") & (num != 0)
    hits = {
        "filled": F.lit(True), "nums": num.isNotNull(), "fractions": num.isNotNull() & ~whole, "years": whole & num.between(1800, 2100), "signs": signed,
        "percents": raw.contains("%"), "cjk_keys": C.has_cjk(ekey), "digit_keys": ekey.rlike(r"(?U)\d"),
    }
    sums = ["n", *hits, "length"]
    counted = [F.when(full & hit, F.col("k")).otherwise(0).alias(name) for name, hit in hits.items()]
    raws = raws.select(*own, "n", *counted, F.when(full, F.length("ekey") * F.col("k")).otherwise(0).alias("length"), *[F.when(full, F.col(x)).alias(x) for x in ("num", "unit", "ekey")])
    # A row with the measures under its key, one with its number and one with its unit: each is then distinct in one grouping.
    none = F.lit(None)
    row = lambda what, text, number, carries: F.struct(
        F.lit(what).alias("what"), text.cast("string").alias("text"), number.cast("double").alias("num"), *[(F.col(x) if carries else F.lit(0)).cast("long").alias(x) for x in sums]
    )
    rows = raws.select(*own, F.inline(F.array(row("key", ekey, none, True), row("number", none, num, False), row("unit", F.col("unit"), none, False))))
    rows = rows.where("what = 'key' OR text IS NOT NULL OR num IS NOT NULL")
    rows = rows.groupBy(*own, "what", "text", "num").agg(*[F.sum(x).alias(x) for x in sums])
    is_key = (F.col("what") == "key") & F.col("text").isNotNull()
    per = rows.groupBy(*own, F.when(F.col("what") == "unit", F.col("text")).alias("unit")).agg(
        *[F.sum(x).alias(x) for x in sums],
        F.count_if(is_key).alias("keys"), F.count_if(is_key & (F.col("filled") >= 2)).alias("repeated"), F.count("num").alias("values"), F.min("num").alias("least"), F.max("num").alias("most"),
    )
    per = per.groupBy(*own).agg(
        *[F.sum(x).alias(x) for x in (*sums, "keys", "repeated", "values")], F.min("least").alias("least"), F.max("most").alias("most"), F.array_sort(F.collect_set("unit")).alias("units"),
    )
    return per.withColumn("mean_length", _share(F.col("length"), F.col("filled")))


def typed(sums: DataFrame) -> DataFrame:
    """Kind, reason and what else a profile tells, from the measures of each column."""
    h = F.col("header")
    numeric, unique = _share(F.col("nums"), F.col("filled")), _share(F.col("keys"), F.col("filled"))
    period = C.period(h)
    ordinal = (F.col("fractions") == 0) & (F.col("values") == F.col("nums")) & (F.col("least") == 1) & (F.col("most") == F.col("nums"))
    cjk = C.has_cjk(h)
    rank_header = h.rlike(RANK_HEADER)
    forbidden = h.rlike(FORBIDDEN_METRIC) & period.isNull()
    result = lambda kind, reason="": F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    metric = (
        F.when(F.col("values") <= 1, result("other", "constant"))
        .when(F.size("units") > 1, result("other", "mixed_units"))
        .when(h.rlike(r"(?U)_\d+$"), result("other", "duplicate_header"))
        .otherwise(result("metric"))
    )
    of_number = (
        F.when(rank_header | (ordinal & ~C.has_cjk(F.replace(h, F.lit("数"), F.lit("")))), result("rank"))
        .when(forbidden & (rank_header | h.contains("排名") | h.contains("名次")), result("rank", "forbidden_header"))
        .when(forbidden, result("other", "forbidden_header"))
        .when(_share(F.col("years"), F.col("nums")) >= 0.8, result("other", "year_values"))
        .when(~cjk & period.isNull(), result("other", "non_chinese_header"))
        .when(ordinal & (F.col("nums") >= 5), result("rank", "ordinal_sequence"))
        .when((F.col("signs") > 0.3 * F.col("filled")) & ~h.rlike(CHANGE_WORDS), result("other", "signed_change_values"))
        .otherwise(metric)
    )
    half = F.greatest(F.lit(2), F.floor(F.col("n") / 2))
    of_text = (
        F.when((unique >= 0.95) & F.col("mean_length").between(2, 24) & (F.col("cjk_keys") >= 0.8 * F.col("filled")), result("key"))
        .when(
            F.col("keys").between(2, half) & (F.col("repeated") >= 2) & (F.col("mean_length") <= 12) & cjk & ~h.rlike(r"[＼\\]") & (F.col("digit_keys") <= 0.2 * F.col("filled")),
            result("category"),
        )
        .otherwise(result("text"))
    )
    sparse = (F.col("n") == 0) | (F.col("filled") < F.greatest(F.lit(3), F.floor(0.8 * F.col("n"))))
    kind = F.when(sparse, result("other", "sparse")).when(numeric >= 0.95, of_number).when(numeric <= 0.2, of_text).otherwise(result("other"))
    judged = sums.withColumn("_k", kind)
    measured = (F.col("_k.kind") == "metric") | F.col("_k.reason").isin("constant", "mixed_units", "duplicate_header")
    return judged.select(
        "table_id",
        "col_idx",
        "header",
        F.col("_k.kind").alias("kind"),
        F.col("_k.reason").alias("reason"),
        F.round(numeric, 3).alias("numeric_ratio"),
        F.round(unique, 3).alias("unique_ratio"),
        period.alias("period"),
        F.when(period.isNotNull(), C.period_rest(h)).otherwise("").alias("period_rest"),
        F.when(measured & (F.size("units") == 1), F.get("units", F.lit(0))).otherwise("").alias("unit"),
        (measured & (h.contains("率") | (F.col("percents") >= 0.8 * F.col("filled")))).alias("is_rate"),
        "n",
    )


def key_columns(profiled: DataFrame) -> DataFrame:
    """table_id, key: key columns with a hinting header first, then the leftmost."""
    order = F.struct(~F.col("header").rlike(KEY_HINT), F.col("col_idx"))
    return profiled.filter("kind = 'key'").groupBy("table_id").agg(F.min_by("col_idx", order).alias("key"))


def rank_columns(profiled: DataFrame) -> DataFrame:
    return profiled.filter("kind = 'rank'").groupBy("table_id").agg(F.min("col_idx").alias("rank"))


def row_marks(cells: DataFrame, profiled: DataFrame) -> DataFrame:
    """(table_id, row_idx, labelled, ranked, has_rank): whether a row has a total label and a number in its table's rank column."""
    is_key, is_rank = F.col("kind") == "key", F.col("kind") == "rank"
    roles = profiled.groupBy("table_id").agg(
        F.min_by("col_idx", F.when(is_key, F.struct(~F.col("header").rlike(KEY_HINT), F.col("col_idx")))).alias("key"),
        F.min(F.when(is_rank, F.col("col_idx"))).alias("rank"),
    )
    raw, at, total = F.col("raw"), F.col("col_idx"), C.is_total_row(C.entity_key(F.col("raw")))
    # without a key column the first cell with Chinese text labels a row; its place and its verdict are one number, the least of which is the first cell's
    first = F.when(F.col("key").isNull() & F.coalesce(raw != "", F.lit(False)) & C.has_cjk(raw), at.cast("long") * 2 + total.cast("int"))
    rows = cells.join(roles, "table_id").groupBy("table_id", "row_idx").agg(
        F.max(F.when(at == F.col("key"), total)).alias("_own"), F.min(first).alias("_first"),
        F.coalesce(F.max(F.when(at == F.col("rank"), C.parse_number(raw).isNotNull())), F.lit(False)).alias("ranked"), F.max("rank").isNotNull().alias("has_rank"),
    )
    return rows.select("table_id", "row_idx", F.coalesce("_own", F.pmod("_first", F.lit(2)) == 1, F.lit(False)).alias("labelled"), "ranked", "has_rank")


def total_rows(marks: DataFrame) -> DataFrame:
    """(table_id, row_idx) of total rows, from ``row_marks``: those with a total label, or without a rank where four fifths of a table's rows have one."""
    ranks = marks.groupBy("table_id").agg(F.count_if("ranked").alias("_ranked"), F.count(F.lit(1)).alias("_all"))
    total = F.col("labelled") | (F.col("has_rank") & (F.col("_ranked") >= 0.8 * F.col("_all")) & ~F.col("ranked"))
    return marks.join(ranks, "table_id").filter(total).select("table_id", "row_idx")


def drop_total_rows(cells: DataFrame, profiled: DataFrame) -> DataFrame:
    """Cells without total rows, in their original row numbers."""
    return cells.join(total_rows(row_marks(cells, profiled)), ["table_id", "row_idx"], "left_anti")


def profile_cells(cells: DataFrame, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """Surviving cells and the final column profile of raw cells (table_id, row_idx, col_idx, header, raw).

    With ``steps`` cells, the first profile and the total rows are written once for all that reads them; without, all are plans that keep nothing.
    What survives is not written again: it is the cells without the few rows that go.
    """
    keep = steps.table if steps else lambda df, _: df
    cells = keep(cells, "cells")
    marks = keep(row_marks(cells, keep(profile(cells), "first-profile")), "marks")
    kept = cells.join(keep(total_rows(marks), "totals"), ["table_id", "row_idx"], "left_anti")
    return kept, profile(kept)


def profile_tables(tables: DataFrame, steps: Steps | None = None) -> tuple[DataFrame, DataFrame]:
    """``profile_cells`` of whole tables (table_id, headers, rows)."""
    return profile_cells(explode_tables(tables), steps)


@contextmanager
def cached_profile(tables: DataFrame) -> Iterator[tuple[DataFrame, DataFrame]]:
    """As ``profile_tables``, with cells and both profiles persisted while the block lasts and released after it."""
    held: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    try:
        cells = keep(explode_tables(tables))
        kept = keep(drop_total_rows(cells, keep(profile(cells))))
        yield kept, keep(profile(kept))
    finally:
        for df in held:
            df.unpersist()


# ---------------------------------------------------------------- wide tables


def _wide_raw(df: DataFrame) -> list[Column]:
    return [F.coalesce(df["`" + c.replace("`", "``") + "`"].cast("string"), F.lit("")) for c in df.columns]


def wide_values(df: DataFrame) -> DataFrame:
    """A wide table with number, unit and entity key beside the raw text of each cell, column i as struct ``c<i>``. A plain projection."""
    one = lambda r: F.struct(r.alias("raw"), C.parse_number(r).alias("num"), C.unit(r).alias("unit"), C.entity_key(r).alias("ekey"))
    return df.select(*[one(r).alias(f"c{i}") for i, r in enumerate(_wide_raw(df))])


def wide_texts(df: DataFrame) -> DataFrame:
    """(col_idx, raw, k): how many cells of each column of a wide table hold each raw text; an empty table keeps its columns, with 0 empty texts."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("col_idx"), r.alias("raw"), F.lit(1).cast("long").alias("k")) for i, r in enumerate(_wide_raw(df))])))
    columns = df.sparkSession.createDataFrame([(i, "", 0) for i in range(len(df.columns))], "col_idx int, raw string, k long")
    return cells.unionByName(columns).groupBy("col_idx", "raw").agg(F.sum("k").alias("k"))


def profile_wide(texts: DataFrame, names: list[str], table_id: str) -> DataFrame:
    """The profile of one wide table under these headers, as ``profile`` gives it, from its distinct texts with their values (``valued``)."""
    sums = _measures(texts.withColumn("n", F.col("k")), ["col_idx"])
    return typed(sums.select(F.lit(table_id).alias("table_id"), F.get(F.array(*map(F.lit, names)), F.col("col_idx")).alias("header"), "*"))


def key_and_rank(profiled: DataFrame) -> tuple[int | None, int | None]:
    """Places of the key and the rank column of one profiled table: a row for each of its columns is read."""
    rows = profiled.where("kind IN ('key', 'rank')").select("col_idx", "kind", F.col("header").rlike(KEY_HINT).alias("hint")).collect()
    keys = sorted((not r["hint"], r["col_idx"]) for r in rows if r["kind"] == "key")
    return keys[0][1] if keys else None, min((r["col_idx"] for r in rows if r["kind"] == "rank"), default=None)


def _total(label: Column) -> Column:
    return C.is_total_row(C.entity_key(label))


def without_total_rows(df: DataFrame, label: str, rank: str | None = None, by: str | None = None) -> DataFrame:
    """Rows of a wide table, or of the many tables that column ``by`` tells apart, but for total rows.

    A total row has a total label, or no number in the rank column where at least four fifths of its table's rows have one.
    """
    kept = df.where(~_total(F.col(label)))
    if rank is None:
        return kept
    ranked = C.parse_number(F.col(rank).cast("string")).isNotNull()
    shares = df.groupBy((F.col(by) if by else F.lit(0)).alias("_g")).agg((F.count_if(ranked) >= 0.8 * F.count(F.lit(1))).alias("_mostly"))
    found = kept.withColumns({"_ranked": ranked, "_own": F.col(by) if by else F.lit(0)})
    found = found.join(shares, F.col("_own").eqNullSafe(F.col("_g")))
    return found.where("_ranked OR NOT _mostly").drop("_ranked", "_g", "_own", "_mostly")


def _split_rows(df: DataFrame, texts: DataFrame, key: int | None, rank: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of a wide table that stay, and its total rows; none at all if no text of the key and the rank column marks one.

    Marks are told by the distinct texts of these columns; only without a key column is every row looked at.
    """
    at, raws, marks = F.col("col_idx"), _wide_raw(df), []
    kept, gone = df, None
    if key is not None:
        marks.append((key, texts.where((at == key) & C.is_total_row(F.col("ekey")))))
    else:
        first = _total(F.coalesce(*[F.when(C.has_cjk(r), r) for r in raws], F.lit("")))
        kept, gone = df.where(~first), df.where(first)
    if rank is not None:
        ranked = F.sum(F.when(F.col("num").isNotNull(), F.col("k")).otherwise(0)).alias("ranked")
        share = texts.where(at == rank).agg(ranked, F.sum("k").alias("n")).first()
        if share["n"] and share["ranked"] >= 0.8 * share["n"]:
            marks.append((rank, texts.where((at == rank) & F.col("num").isNull())))
    for column, found in marks:
        found = found.where("k > 0").select(F.col("raw").alias("_mark"))
        if not found.isEmpty():
            hit = kept.join(found, raws[column] == F.col("_mark"), "left_semi")
            kept, gone = kept.join(found, raws[column] == F.col("_mark"), "left_anti"), hit if gone is None else gone.union(hit)
    return kept, gone


def profile_wide_table(df: DataFrame, table_id: str, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Values of a wide table without its total rows, and the profile of those: the first pass finds key and rank column.

    Without a key column the first cell with Chinese text labels a row. Values are worked out, and written, once for each distinct text of a column, in the
    tasks to which the texts were dealt and not in the few that read a small file. The second profile takes the texts of total rows off the first's.
    """
    texts = steps.table(valued(wide_texts(df)), "texts")
    profiled = steps.table(profile_wide(texts, df.columns, table_id), "first-profile")
    kept, gone = _split_rows(df, texts, *key_and_rank(profiled))
    gone = gone if gone is None else steps.table(wide_texts(gone).where("k > 0"), "gone")
    if gone is not None and not gone.isEmpty():
        left = texts.join(gone.withColumnRenamed("k", "gone"), ["col_idx", "raw"], "left").withColumn("k", F.col("k") - F.coalesce("gone", F.lit(0)))
        profiled = profile_wide(left.drop("gone").where("k > 0 OR raw = ''"), df.columns, table_id)
    return wide_values(kept), profiled


def metric_columns(profiled: DataFrame) -> DataFrame:
    return profiled.filter("kind = 'metric'").select("table_id", "col_idx", "header", "unit", "period", "is_rate")


def category_columns(profiled: DataFrame) -> DataFrame:
    return profiled.filter("kind = 'category'").select("table_id", "col_idx", "header")


def column_by_header(profiled: DataFrame, wanted: DataFrame) -> DataFrame:
    """table_id, header and col_idx of the first column of each wanted (table_id, header)."""
    return profiled.join(wanted.select("table_id", "header"), ["table_id", "header"]).groupBy("table_id", "header").agg(F.min("col_idx").alias("col_idx"))


def key_values(cells: DataFrame, profiled: DataFrame) -> DataFrame:
    """table_id, row_idx and entity key of the key column's cells; tables without a key have none."""
    return cells.join(key_columns(profiled), "table_id").filter("col_idx = key AND row_idx IS NOT NULL").select("table_id", "row_idx", C.entity_key(F.col("raw")).alias("ekey"))


def cell_at(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Raw cells at (table_id, row_idx, col_idx); places that a table lacks give no row."""
    return wanted.select("table_id", "row_idx", "col_idx").join(cells.select("table_id", "row_idx", "col_idx", "raw"), ["table_id", "row_idx", "col_idx"])


def lookup(cells: DataFrame, profiled: DataFrame, wanted: DataFrame, loose: bool = False, unique: bool = False) -> DataFrame:
    """Rows whose key equals ``wanted`` (table_id, name); unique: only tables and names with a single hit."""
    norm = C.join_key if loose else C.entity_key
    keyed = cells.join(key_columns(profiled), "table_id").filter("col_idx = key").select("table_id", "row_idx", norm(F.col("raw")).alias("_norm"))
    hits = wanted.withColumn("_norm", norm(F.col("name"))).join(keyed, ["table_id", "_norm"])
    if unique:
        single = hits.groupBy("table_id", "name").count().filter("count = 1").drop("count")
        hits = hits.join(single, ["table_id", "name"])
    return hits.select("table_id", "name", "row_idx")


def usable(cells: DataFrame, profiled: DataFrame, min_rows: int = 4) -> DataFrame:
    """table_id, usable: a key, enough rows and a metric."""
    per = profiled.groupBy("table_id").agg(F.count_if(F.col("kind") == "key").alias("k"), F.count_if(F.col("kind") == "metric").alias("m"), F.max("n").alias("n"))
    return per.select("table_id", ((F.col("k") > 0) & (F.col("m") > 0) & (F.col("n") >= min_rows)).alias("usable"))


# ---------------------------------------------------------------- profiles kept by content


def content_keys(cells: DataFrame) -> DataFrame:
    """(table_id, content): what a table holds, whatever it is called: two independent sums of hashes over its cells, in place and header."""
    parts = ["row_idx", "col_idx", "header", "raw"]
    one, two = F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)
    keys = cells.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("a"), F.sum(two.cast("decimal(38,0)")).alias("b"))
    return keys.select("table_id", F.concat_ws(":", "n", "a", "b").alias("content"))


def stored_profile(cells: DataFrame, store: str, steps: Steps) -> DataFrame:
    """The profile of raw cells from a store of profiles by content; tables that it lacks are profiled, and added to it.

    ``known`` tells which tables the store had. Equal tables are profiled once. Runs that add to one store at a time keep it free of repeats.
    """
    spark = cells.sparkSession
    keys = steps.table(content_keys(cells), "content")
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    had = spark.read.parquet(store).select("content").distinct() if exists else keys.select("content").limit(0)
    keys = steps.table(keys.join(had.withColumn("known", F.lit(True)), "content", "left").fillna(False, ["known"]), "known")
    unseen = keys.where("NOT known").groupBy("content").agg(F.min("table_id").alias("table_id"))
    fresh = profile_cells(cells.join(unseen.select("table_id"), "table_id", "left_semi"), steps)[1]
    fresh.join(unseen, "table_id").drop("table_id").write.mode("append").parquet(store)
    return keys.join(spark.read.parquet(store), "content").drop("content")
