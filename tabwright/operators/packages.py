"""Kinds of evidence packages: how the tables of a set hang together, found from their cells.

An inverted index of join keys tells which columns lie within which key columns: every distinct value of every column meets the key columns
of the same package that hold it, and a count of the meetings against the count of the values shows exact containment. Containment is a graph of
references between tables, and its shape is the kind:

* ``single``: one table; ``category_decomp``: one table whose rows a category column divides;
* ``period_pair``: two tables of the same headers but for their years, about the same entities; ``split_pair``: the same headers, no entity in both;
* ``rank_detail``: a column of one lies within the key of a ranked one; ``category_partner``: a category column within a key; ``join_filter``: a
  column within the key of a table that categories divide;
* ``bridge_chain``: any other reference of two tables, or references from table to table to table; ``hub_profile``: three tables or more, one of which has
  the entities of all others;
* ``unrelated``: none of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.cells import join_key
from tabwright.operators import profile as P
from tabwright.sources.scratch import Steps

#: Least distinct values of a column that can refer to another table.
LEAST_VALUES = 2


def column_values(cells: DataFrame) -> DataFrame:
    """(table_id, col_idx, jkey): the distinct join keys of each column, worked out once for each distinct text. Blank ones refer to nothing."""
    raws = cells.where("row_idx IS NOT NULL").select("table_id", "col_idx", "raw").distinct()
    return raws.select("table_id", "col_idx", join_key(F.col("raw")).alias("jkey")).distinct().where("jkey <> ''")


def references(values: DataFrame, profiled: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, a, col, b, shared, size, of_key, b_size): columns of table a that share values with the key column of table b.

    values as of ``column_values``, profiled as of ``profile``, packages (package_id, table_id).
    """
    values = values.join(packages, "table_id")
    sizes = values.groupBy("package_id", "table_id", "col_idx").agg(F.count(F.lit(1)).alias("size"))
    keys = P.key_columns(profiled)
    index = values.join(keys, "table_id").where("col_idx = key").select("package_id", "jkey", F.col("table_id").alias("b"))
    met = values.withColumnRenamed("table_id", "a").join(index, ["package_id", "jkey"]).where("a <> b")
    shared = met.groupBy("package_id", "a", "col_idx", "b").agg(F.count(F.lit(1)).alias("shared"))
    of_a = sizes.withColumnRenamed("table_id", "a")
    b_sizes = sizes.join(keys, "table_id").where("col_idx = key").select("package_id", F.col("table_id").alias("b"), F.col("size").alias("b_size"))
    own_key = keys.select(F.col("table_id").alias("a"), F.col("key").alias("_key"))
    out = shared.join(of_a, ["package_id", "a", "col_idx"]).join(b_sizes, ["package_id", "b"]).join(own_key, "a", "left")
    return out.select("package_id", "a", F.col("col_idx").alias("col"), "b", "shared", "size", F.coalesce(F.col("col_idx") == F.col("_key"), F.lit(False)).alias("of_key"), "b_size")


def _traits(profiled: DataFrame, packages: DataFrame) -> DataFrame:
    """(package_id, table_id, ranked, divided, headers, year): what tells tables apart beside their references."""
    per = profiled.groupBy("table_id").agg(
        F.max(F.col("kind") == "rank").alias("ranked"),
        F.max(F.col("kind") == "category").alias("divided"),
        F.array_sort(F.collect_list(F.struct("col_idx", F.when(F.col("period").isNull(), F.col("header")).otherwise(F.col("period_rest")).alias("h")))).alias("h"),
        F.min("period").alias("year"),
    )
    own = packages.join(per, "table_id", "left")
    year = F.coalesce(F.col("period"), F.col("year")) if "period" in packages.columns else F.col("year")
    return own.select("package_id", "table_id", F.coalesce("ranked", F.lit(False)).alias("ranked"), F.coalesce("divided", F.lit(False)).alias("divided"), F.transform("h", lambda x: x["h"]).alias("headers"), year.alias("year"))


def package_kinds(cells: DataFrame, packages: DataFrame, steps: Steps) -> DataFrame:
    """(package_id, kind, n_tables) of packages (package_id, table_id, optionally period); cells (table_id, row_idx, col_idx, header, raw).

    A table may be in several packages.
    """
    cells = steps.table(cells, "cells")
    values = steps.table(column_values(cells), "values")
    profiled = steps.table(P.profile(cells), "profile")
    traits = steps.table(_traits(profiled, packages), "traits")
    kinds = profiled.select(F.col("table_id").alias("a"), F.col("col_idx").alias("col"), F.col("kind").alias("col_kind"))
    found = references(values, profiled, packages.select("package_id", "table_id").distinct()).join(kinds, ["a", "col"])
    b = traits.select("package_id", F.col("table_id").alias("b"), F.col("ranked").alias("b_ranked"), F.col("divided").alias("b_divided"))
    found = steps.table(found.join(b, ["package_id", "b"]), "references")
    whole = (F.col("shared") == F.col("size")) & (F.col("size") >= LEAST_VALUES)
    refers = whole & ~F.col("of_key")
    edges = found.where(refers).select("package_id", "a", "b").distinct()
    chained = edges.alias("x").join(edges.alias("y"), (F.col("x.package_id") == F.col("y.package_id")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.a") != F.col("y.b")))
    chained = chained.select(F.col("x.package_id").alias("package_id"), F.lit(True).alias("chained")).distinct()
    # a hub has the entities of all others: by their keys, or by a column that refers to it
    hubs = found.where(whole).groupBy("package_id", "b").agg(F.count_distinct("a").alias("n")).groupBy("package_id").agg(F.max("n").alias("around"))
    refs = found.groupBy("package_id").agg(
        F.max(refers & F.col("b_ranked")).alias("to_ranked"),
        F.max(refers & (F.col("col_kind") == "category")).alias("by_category"),
        F.max(refers & F.col("b_divided")).alias("to_divided"),
        F.max(refers).alias("refers"),
        F.max(F.when(F.col("of_key"), F.col("shared") >= 0.5 * F.least("size", "b_size"))).alias("same_entities"),
        F.max(F.when(F.col("of_key"), F.col("shared"))).alias("common"),
    )
    sets = traits.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("n_tables"), F.max("divided").alias("divided"), (F.count_distinct("headers") == 1).alias("same_headers"),
        (F.count_distinct("year") == F.count(F.lit(1))).alias("own_years"),
    )
    all_of = sets.join(refs, "package_id", "left").join(chained, "package_id", "left").join(hubs, "package_id", "left")
    n = F.col("n_tables")
    yes = lambda x: F.coalesce(F.col(x), F.lit(False))
    kind = (
        F.when((n == 1) & yes("divided"), "category_decomp").when(n == 1, "single")
        .when((n == 2) & yes("same_headers") & yes("own_years") & yes("same_entities"), "period_pair")
        .when((n == 2) & yes("same_headers") & (F.coalesce("common", F.lit(0)) == 0), "split_pair")
        .when((n == 2) & yes("to_ranked"), "rank_detail").when((n == 2) & yes("by_category"), "category_partner").when((n == 2) & yes("to_divided"), "join_filter")
        .when((n == 2) & yes("refers"), "bridge_chain").when((n > 2) & yes("chained"), "bridge_chain")
        .when((n > 2) & (F.col("around") == n - 1), "hub_profile").otherwise("unrelated")
    )
    return all_of.select("package_id", kind.alias("kind"), "n_tables")
