"""The queries op1 to op10 over the shared tables, and DuckDB SQL for those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxoflux.llm import context_tree, decontaminate, mixing, ngram_join, pii, quality_classifier, quality_rules, site_style_tree, sql, suffix_dedup, toxicity
from taxoflux.llm.runtime import Scratch, table


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = site_style_tree.extract(table(spark, sf_dir, "pages"), Scratch(spark))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))
    return leaks.select("doc_id", "item_id", "n_matched", "n_windows", "doc_pos", "n_slots", "n_changed")


def crc_remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"), crc_remainder(7) == 2, Scratch(spark))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder(4) == 2)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join(table(spark, sf_dir, "documents"), Scratch(spark))
    return joined.select("doc_id", "n_shingles", "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), save=Scratch(spark).save)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), Scratch(spark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_remainder(3) == 1, Scratch(spark))


QUERIES = {"op1_site_style_tree": op1_site_style_tree, "op2_quality_rules": op2_quality_rules, "op3_decontamination": op3_decontamination, "op4_context_tree": op4_context_tree, "op5_pii": op5_pii, "op6_quality_classifier": op6_quality_classifier, "op7_ngram_join": op7_ngram_join, "op8_mixing": op8_mixing, "op9_suffix_dedup": op9_suffix_dedup, "op10_toxicity": op10_toxicity}

ORACLES = {"op2_quality_rules": sql.OP2, "op7_ngram_join": sql.OP7, "op8_mixing": sql.OP8}
