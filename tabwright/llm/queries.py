"""Registered queries of this subpackage: name -> (session, table folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwright.llm import baskets, cotraining, decontaminate, language_mix, mixing, neardup, pieces, quality_rules, repeats, secrets, sharding, token_binary, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.encode_and_read(table(spark, sf_dir, "documents"))


def op2_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_text", "p_meta", "score", "label", (F.col("label") == 1).alias("kept"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "contaminated", F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), "n_same")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.taken_words(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]

    def of(*kinds: str):
        return F.filter("found", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(F.encode(secrets.as_text(of(*base)), "UTF-8"), 256).alias("base_sha256"),
        secrets.as_text(F.col("found")).alias("spans"),
    )


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mix.identify(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"_q_{n}").alias(n) for n in names], F.array_join("_q_reasons", ",").alias("reasons"))


def op11_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op12_repeat_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op13_basket_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baskets.closed_itemsets(table(spark, sf_dir, "sale_lines"))
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"], r["c"])))["c"]
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    return found.select(
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
        F.size("items").cast("long").alias("n_items"),
        "support",
        F.size("rules").cast("long").alias("n_rules"),
        best.alias("best_item"),
        F.sha2(F.encode(text, "UTF-8"), 256).alias("rules_sha256"),
    )


QUERIES = {
    "op1_token_binary": op1_token_binary,
    "op2_cotraining": op2_cotraining,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_lsh_forest": op4_lsh_forest,
    "op5_trie_token_counts": op5_trie_token_counts,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_source_mix": op7_source_mix,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_mixture": op9_language_mixture,
    "op10_quality_rules": op10_quality_rules,
    "op11_piece_merges": op11_piece_merges,
    "op12_repeat_runs": op12_repeat_runs,
    "op13_basket_itemsets": op13_basket_itemsets,
}
