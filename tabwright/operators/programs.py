"""Programs as records: verdicts of any number of statements from (claim_id, skeleton_id, slots), all skeletons in one plan.

A skeleton is data: one to three terms and a form that compares them with what the record states. A term is a lookup along
bridges, an aggregate of the rows of a table (of a group of them, if it names one), or the row at a place by a metric. Terms of all statements and
skeletons are resolved by their kind: lookups by one join a hop over facts (table, entity, header), aggregates and places once for each
distinct question, whatever the number of statements that ask it. Null is what the tables do not tell.

Slots: ``table``, ``table2``, ``table3`` (ids); ``a``, ``b``, ``c`` (entities); ``column``, ``column2``, ``column3`` (metric headers); ``by``, ``by2`` (headers whose cells name
entities of the next table); ``where`` and ``equals``, ``equals2`` (a group); ``over``, ``is`` (a condition on the metric or the ``attribute``); ``n`` (a place); ``least`` (true: the smallest first);
``value`` (what is stated: a number, compared at its own decimals, or an entity).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.cells import entity_key, parse_number
from tabwright.functions.verdict import verdict
from tabwright.sources.scratch import Steps


class Term(NamedTuple):
    """kind: look, fold or place; how: the aggregate of a fold; roles: what each role of the term is called among the slots."""

    kind: str
    how: str
    roles: dict[str, str]


def look(entity: str, table: str = "table", column: str = "column", **path: str) -> Term:
    return Term("look", "", {"table": table, "entity": entity, "column": column, **path})


def fold(how: str, equals: str = "equals", table: str = "table", column: str = "column", by: str = "by", table2: str = "table2") -> Term:
    names = {x: x for x in ("where", "over", "is", "attribute")}
    return Term("fold", how, {**names, "table": table, "column": column, "by": by, "table1": table2, "equals": equals})


def place(by: str = "by", table2: str = "table2") -> Term:
    names = {x: x for x in ("table", "column", "where", "equals", "n", "least", "attribute")}
    return Term("place", "", {**names, "by": by, "table1": table2})


def hop(entity: str = "a", column: str = "column2") -> Term:
    return look(entity, column=column, by1="by", table1="table2")


#: Skeleton -> form and terms. Grouped folds and places find the group in the table itself, or where ``by`` leads to.
SKELETONS: dict[str, tuple[str, list[Term]]] = {
    "ST_COMPARE": ("more", [look("a"), look("b")]),
    "ST_DIFF": ("difference", [look("a"), look("b")]),
    "ST_COUNT_GT": ("number", [fold("n_over")]),
    "ST_SUPERLATIVE": ("first", [place(), place()]),
    "ST_AVG": ("number", [fold("avg")]),
    "ST_SUM": ("number", [fold("sum")]),
    "XT_COMPARE": ("more", [look("a"), look("b", "table2", "column2")]),
    "XT_DIFF": ("difference", [look("a"), look("b", "table2", "column2")]),
    "CP_DIFF": ("difference", [look("a", "table2", "column2"), look("a")]),
    "CP_DIRECTION": ("more", [look("a", "table2", "column2"), look("a")]),
    "CP_PCT": ("percent", [look("a", "table2", "column2"), look("a")]),
    "CG_PCT2": ("percent", [fold("sum", table="table3", column="column2"), fold("sum")]),
    "CAT_ARGEXT": ("entity", [place()]),
    "CAT_ARGEXT_ATTR": ("attribute", [place()]),
    "CAT_AVG": ("number", [fold("avg")]),
    "CAT_COUNT": ("number", [fold("n")]),
    "CAT_COUNT_GT": ("number", [fold("n_over")]),
    "CAT_EXTVAL": ("number", [place()]),
    "CAT_SUM": ("number", [fold("sum")]),
    "JF_ARGEXT": ("entity", [place()]),
    "JF_AVG": ("number", [fold("avg")]),
    "JF_COUNT_GT": ("number", [fold("n_over")]),
    "JF_EXTVAL": ("number", [place()]),
    "JF_SUM": ("number", [fold("sum")]),
    "JG_COUNT2": ("more", [fold("n"), fold("n", "equals2")]),
    "NB_LOOKUP2": ("number", [hop()]),
    "NB_LOOKUP3": ("number", [look("a", column="column3", by1="by", table1="table2", by2="by2", table2="table3")]),
    "NT_NTH": ("entity", [place()]),
    "NT_NTH_IN": ("entity", [place()]),
    "RJ_MEMBER_RANK": ("number", [hop()]),
    "RJ_RANK_TOP": ("entity", [place()]),
    "RJ_RANK_TOPVAL": ("number", [place()]),
    "RS_AVG": ("mean", [hop(), look("b")]),
    "RS_AVG3": ("mean", [hop(), hop("b"), look("c")]),
    "RS_DIFF": ("difference", [hop(), look("b")]),
    "RS_DIFF2": ("difference", [hop(), hop("b")]),
    "RS_PCT": ("percent", [hop(), look("b")]),
    "RS_PCT2": ("percent", [hop(), hop("b")]),
    "RS_RATIO": ("ratio", [hop(), look("b")]),
    "RS_RATIO2": ("ratio", [hop(), hop("b")]),
    "RS_SUM": ("sum", [hop(), look("b")]),
    "RS_SUM2": ("sum", [hop(), hop("b")]),
    "RS_SUM3": ("sum", [hop(), hop("b"), look("c")]),
    "UQ_ONE": ("one", [fold("n_over")]),
    "UQ_ONLY_GT": ("only", [fold("n_over"), place()]),
    "UV_ALL_EQ": ("all", [fold("n"), fold("n_is"), fold("n_no_text")]),
    "UV_ALL_GT": ("all", [fold("n"), fold("n_over"), fold("n_no_number")]),
}
#: Terms that ask for a place of their own, whatever the slots say: a superlative's runner-up, and the first of all.
FIXED_PLACE = {("ST_SUPERLATIVE", 0): "1", ("ST_SUPERLATIVE", 1): "2", ("CAT_ARGEXT", 0): "1", ("CAT_ARGEXT_ATTR", 0): "1", ("CAT_EXTVAL", 0): "1", ("JF_ARGEXT", 0): "1",
               ("JF_EXTVAL", 0): "1", ("RJ_RANK_TOP", 0): "1", ("RJ_RANK_TOPVAL", 0): "1", ("UQ_ONLY_GT", 1): "1"}
QUESTION = ["table", "column", "by", "table1", "where", "attribute", "least"]


def _specification(spark: SparkSession) -> DataFrame:
    """The skeletons as a table: about a hundred rows, whatever the data."""
    rows = [(name, form, i, t.kind, t.how, t.roles, FIXED_PLACE.get((name, i))) for name, (form, terms) in SKELETONS.items() for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, "skeleton_id string, form string, term int, kind string, how string, roles map<string,string>, at string")


def facts(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(table_id, row_idx, entity, facts) of each row of tables with a key column: facts are number and text by header; of equal headers the first counts.

    cells as of ``profile.with_values``, keys (table_id, key). Cells are grouped once, into rows.
    """
    named = cells.join(keys, "table_id").where("row_idx IS NOT NULL")
    cell = F.struct("col_idx", "header", "num", F.col("ekey").alias("text"), (F.col("col_idx") == F.col("key")).alias("names"))
    rows = named.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    first = F.filter("c", lambda x, i: x["header"].isNotNull() & (F.array_position("c.header", x["header"]) == i + 1))
    entry = lambda x: F.struct(x["header"].alias("header"), F.struct(x["num"].alias("num"), x["text"].alias("text")).alias("v"))
    entity = F.get(F.filter("c", lambda x: x["names"]), F.lit(0))["text"]
    return rows.select("table_id", "row_idx", entity.alias("entity"), F.map_from_entries(F.transform(first, entry)).alias("facts")).where("entity IS NOT NULL")


def resolved(records: DataFrame) -> DataFrame:
    """One row for each term of each statement: (claim_id, form, term, kind, how, and a column for each role)."""
    spec = F.broadcast(_specification(records.sparkSession))
    terms = records.join(spec, "skeleton_id")
    role = lambda name: F.try_element_at("slots", F.try_element_at("roles", F.lit(name)))
    at = F.coalesce("at", role("n")).try_cast("int").alias("at")
    names = ["table", "column", "by", "table1", "by1", "by2", "table2", "where", "over", "is", "attribute"]
    return terms.select(
        "claim_id", "form", "term", "kind", "how", *[role(x).alias(x) for x in names], at,
        entity_key(role("entity")).alias("entity"), F.coalesce(role("least") == "true", F.lit(False)).cast("string").alias("least"),
        F.when(F.col("roles")["equals"].isNotNull() & role("where").isNotNull(), entity_key(role("equals"))).otherwise("").alias("equals"),
    )


def _facts_once(known: DataFrame, asked: DataFrame) -> DataFrame:
    """Facts of entities that are alone of their name in their table, under the asked (table_id, header)."""
    under = known.select("table_id", "entity", F.explode("facts").alias("header", "v")).join(asked.select("table_id", "header"), ["table_id", "header"], "left_semi")
    per = under.groupBy("table_id", "entity", "header").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    return per.where("n = 1").select(F.col("table_id").alias("_t"), F.col("entity").alias("_e"), F.col("header").alias("_h"), "v")


def _at(rows: DataFrame, once: DataFrame, table: str, entity: str, header: str) -> DataFrame:
    """Add ``v``: the fact at each row's table, entity and header, null where there is none."""
    return rows.join(once, (F.col(table) == F.col("_t")) & (F.col(entity) == F.col("_e")) & (F.col(header) == F.col("_h")), "left").drop("_t", "_e", "_h")


def lookups(terms: DataFrame, known: DataFrame, steps: Steps) -> DataFrame:
    """(claim_id, form, term, num, text) of lookups: up to two bridges, then the cell. Only facts under headers that a hop asks for move."""
    here = terms.where("kind = 'look'").select("claim_id", "form", "term", "table", "entity", "by1", "table1", "by2", "table2", "column")
    second = F.when(F.col("by1").isNull(), F.col("table")).otherwise(F.col("table1"))
    third = F.when(F.col("by2").isNull(), second).otherwise(F.col("table2"))
    hops = [F.struct(F.lit(i).alias("hop"), t.alias("table_id"), F.col(h).alias("header")) for i, (t, h) in enumerate([(F.col("table"), "by1"), (second, "by2"), (third, "column")])]
    asked = steps.table(here.select(F.inline(F.array(*hops))).where("table_id IS NOT NULL AND header IS NOT NULL").distinct(), "asked-facts")
    once = [_facts_once(known, asked.where(F.col("hop") == i)) for i in range(3)]
    for i, (by, to) in enumerate((("by1", "table1"), ("by2", "table2"))):
        here = _at(here, once[i], "table", "entity", by)
        here = here.withColumn("entity", F.when(F.col(by).isNull(), F.col("entity")).otherwise(F.col("v.text"))).withColumn("table", F.when(F.col(by).isNull(), F.col("table")).otherwise(F.col(to))).drop("v")
    return _at(here, once[2], "table", "entity", "column").select("claim_id", "form", "term", F.col("v.num").alias("num"), F.col("v.text").alias("text"))


def questions(terms: DataFrame, known: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """The distinct questions that folds and places ask, numbered by a hash, and the rows of each with metric, attribute and group.

    A row answers a question by itself: it reads its own facts, so rows times questions are made in the tasks that read the rows and are never grouped into rows again.
    """
    key = F.xxhash64(*[F.coalesce(F.col(x), F.lit("\0")) for x in QUESTION])
    asked = terms.where("kind <> 'look'").withColumn("question", key)
    distinct = steps.table(asked.select("question", *QUESTION).distinct(), "questions")
    bridges = distinct.where("`by` IS NOT NULL AND table1 IS NOT NULL AND `where` IS NOT NULL").select(F.col("table1").alias("table_id"), F.col("where").alias("header")).distinct()
    bridge = steps.table(_facts_once(known, bridges), "bridges")
    rows = known.withColumnRenamed("table_id", "table").join(distinct, "table")
    fact = lambda header: F.try_element_at("facts", header)
    has = lambda header: F.coalesce(F.map_contains_key("facts", F.coalesce(header, F.lit(""))) & header.isNotNull(), F.lit(False))
    column, attribute, link = F.col("column"), F.col("attribute"), F.coalesce("by", "where")
    rows = rows.where(column.isNull() | has(column) | has(attribute) | has(link)).select(
        "question", "entity", "by", "table1", "where", "least", fact(column)["num"].alias("num"), fact(attribute)["text"].alias("attribute"), fact(link)["text"].alias("link")
    )
    rows = _at(rows, bridge, "table1", "link", "where")
    group = F.when(F.col("where").isNull(), "").when(F.col("by").isNull(), F.col("link")).otherwise(F.col("v.text"))
    return asked, rows.select("question", "entity", "num", "attribute", "least", group.alias("equals"))


def _above(asked: DataFrame, spread: DataFrame) -> DataFrame:
    """(question, equals, over, n_over): rows above each limit, by one pass over limits and metrics in falling order."""
    limits = asked.where("how = 'n_over'").select("question", "equals", "over").distinct()
    limits = limits.select("question", "equals", "over", parse_number(F.col("over")).alias("num"), F.lit(1).alias("limit"), F.lit(0).cast("long").alias("k"))
    metrics = spread.where("num IS NOT NULL").groupBy("question", "equals", "num").agg(F.sum("k").alias("k"))
    both = limits.unionByName(metrics.select("question", "equals", F.lit(None).cast("string").alias("over"), "num", F.lit(0).alias("limit"), "k"))
    order = Window.partitionBy("question", "equals").orderBy(F.col("num").desc(), F.col("limit").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("n_over", F.sum("k").over(order).cast("double")).where("limit = 1 AND num IS NOT NULL").select("question", "equals", "over", "n_over")


def folds(asked: DataFrame, spread: DataFrame) -> DataFrame:
    """Aggregates of each question's groups, from how many of their rows (k) have a metric and an attribute; of a group without rows nothing is known."""
    k, num = F.col("k"), F.col("num")
    count = lambda hit: F.sum(F.when(hit, k).otherwise(0)).cast("double")
    sums = spread.groupBy("question", "equals").agg(
        F.sum(num * k).alias("sum"), F.try_divide(F.sum(num * k), F.sum(F.when(num.isNotNull(), k))).alias("avg"), F.sum(k).cast("double").alias("n"),
        count(num.isNull()).alias("n_no_number"), count(F.coalesce(F.col("attribute"), F.lit("")) == "").alias("n_no_text"),
    )
    same = spread.groupBy("question", "equals", F.col("attribute").alias("wanted")).agg(F.sum(k).cast("double").alias("n_is"))
    found = asked.where("kind = 'fold'").withColumn("wanted", entity_key(F.col("is"))).join(sums, ["question", "equals"], "left")
    found = found.join(_above(asked, spread), ["question", "equals", "over"], "left").join(same, ["question", "equals", "wanted"], "left")
    found = found.withColumn("n_is", F.when(F.col("n").isNotNull(), F.coalesce("n_is", F.lit(0.0)))).withColumn("n_over", F.when(F.col("n").isNotNull(), F.col("n_over")))
    value = F.coalesce(*[F.when(F.col("how") == x, F.col(x)) for x in ("sum", "avg", "n", "n_over", "n_is", "n_no_number", "n_no_text")])
    return found.select("claim_id", "form", "term", value.alias("num"), F.lit(None).cast("string").alias("text"))


def places(asked: DataFrame, rows: DataFrame, spread: DataFrame, steps: Steps) -> DataFrame:
    """The row at a place of its group by the metric; ties stand in the order of their names.

    Counts of metrics tell which of them reach down to the last place that is asked of a group; only rows with these are put in order.
    """
    asked = asked.where("kind = 'place'")
    wanted = asked.groupBy("question", "equals", "least").agg(F.max("at").alias("last"))
    better = F.when(F.col("least") == "true", F.col("num")).otherwise(-F.col("num"))
    group = Window.partitionBy("question", "equals").orderBy(better)
    counts = spread.where("num IS NOT NULL").groupBy("question", "equals", "num").agg(F.sum("k").alias("k")).join(wanted, ["question", "equals"])
    before = F.coalesce(F.sum("k").over(group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = steps.table(counts.withColumn("before", before).where("before < last").select("question", "equals", "num", "last"), "metrics-near")
    ranked = rows.join(near, ["question", "equals", "num"]).withColumn("at", F.row_number().over(group.orderBy(better, "entity"))).where("at <= last")
    ranked = steps.table(ranked.select("question", "equals", "at", "num", "entity", F.col("attribute").alias("shown")), "ranked")
    found = asked.drop("entity").join(ranked, ["question", "equals", "at"], "left")
    return found.select("claim_id", "form", "term", "num", F.when(F.col("form") == "attribute", F.col("shown")).otherwise(F.col("entity")).alias("text"))


def decimals(stated: Column) -> Column:
    return F.length(F.regexp_extract(stated, r"\d\.(\d+)", 1))


def run_programs(records: DataFrame, cells: DataFrame, keys: DataFrame, steps: Steps) -> DataFrame:
    """(claim_id, skeleton_id, value, entity, verdict) of all records (claim_id, skeleton_id, slots); an unknown skeleton is undecided.

    Facts, terms and the counts of metrics and attributes by question are written once, as each kind of term reads them.
    """
    known, terms = steps.table(facts(cells, keys), "facts"), steps.table(resolved(records), "terms")
    asked, rows = questions(terms, known, steps)
    spread = steps.table(rows.groupBy("question", "equals", "num", "attribute").agg(F.count(F.lit(1)).alias("k")), "spread")
    got = lookups(terms, known, steps).unionByName(folds(asked, spread)).unionByName(places(asked, rows, spread, steps))
    term = lambda i, x: F.max(F.when(F.col("term") == i, F.col(x)))
    per = got.groupBy("claim_id", "form").agg(*[term(i, "num").alias(n) for i, n in enumerate("xyz")], term(0, "text").alias("s"), term(1, "text").alias("s2"))
    out = records.join(per, "claim_id", "left")
    x, y, z, form, stated = F.col("x"), F.col("y"), F.col("z"), F.col("form"), F.try_element_at("slots", F.lit("value"))
    three = F.size(F.filter(F.array(*map(F.lit, [k for k, (_, t) in SKELETONS.items() if len(t) > 2])), lambda k: k == F.col("skeleton_id"))) > 0
    value = (
        F.when(form == "number", x).when(form == "difference", x - y).when(form == "sum", F.when(three, x + y + z).otherwise(x + y))
        .when(form == "mean", F.when(three, (x + y + z) / 3).otherwise((x + y) / 2)).when(form == "ratio", F.try_divide(x, y)).when(form == "percent", F.try_divide(100 * (x - y), y))
    )
    number = parse_number(stated)
    same = F.round(value * F.pow(F.lit(10.0), decimals(stated)), 6)
    same = F.floor(F.abs(same) + 0.5) * F.signum(same) == F.round(number * F.pow(F.lit(10.0), decimals(stated)))
    a = entity_key(F.try_element_at("slots", F.lit("a")))
    holds = (
        F.when(form.isin("number", "difference", "sum", "mean", "ratio", "percent"), same)
        .when(form == "more", x > y)
        .when(form.isin("entity", "attribute"), F.col("s") == entity_key(stated))
        .when(form == "first", (F.col("s") == a) & (y.isNull() | (x != y)))
        .when(form == "one", x == 1)
        .when(form == "only", (x == 1) & (F.col("s2") == a))
        .when(form == "all", F.when(x - y - z > 0, False).when(z > 0, F.lit(None)).otherwise(x == y))
    )
    return out.select("claim_id", "skeleton_id", value.alias("value"), F.when(form.isin("entity", "attribute", "first"), F.col("s")).alias("entity"), verdict(holds).alias("verdict"))
