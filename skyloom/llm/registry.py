"""The operators' queries over the whole tables, with production parameters, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, divergence, fill_in_middle, jaccard, oracles, packing, quality, secrets, substring, suffix_dedup, suffix_tree_lm, token_count, toxicity, url_filter
from .common import documents


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def residue(column: str, n: int) -> Column:
    """Whether crc32 of the id as text leaves 1; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)) == 1, F.lit(False))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_bytes(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), residue("id", 3).alias("held_out"), "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_tree_lm.lm_scores(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), residue("id", 5).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(documents(spark, sf_dir))
    n = lambda k: secrets.count_kind(F.col("base"), k)
    return found.select(
        F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.span_string(F.col("base")), 256).alias("base_sha256"), secrets.span_string(F.col("spans")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_count.count_tokens(documents(spark, sf_dir), tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle.fill_in_middle(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.RULES)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_toxicity, op3_packing, op4_benchmark_decontamination, op5_substring_dedup, op6_lm_scoring, op7_secret_scans, op8_quality_rules, op9_token_counts, op10_ngram_jaccard_join,
        op11_fill_in_middle, op12_url_filters, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
