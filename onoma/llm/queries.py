"""The operators over the whole tables, as queries(spark, sf_dir), with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onoma.llm.common import table
from onoma.llm.decontamination import decontaminate
from onoma.llm.html_blocks import main_text
from onoma.llm.license_scan import scan_licenses
from onoma.llm.line_dedup import line_dedup
from onoma.llm.mixing import mix_sources
from onoma.llm.oracles import ORACLES
from onoma.llm.pii import find_pii
from onoma.llm.quality import quality_rules
from onoma.llm.simhash import near_duplicates
from onoma.llm.suffix_dedup import suffix_dedup
from onoma.llm.toxicity import score_toxicity


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# The parts of three operators that SQL can say, over the same whole tables.


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_quality(spark, sf_dir).drop("kept")


QUERIES = {f.__name__: f for f in (op1_pii, op2_html_text, op3_mixing, op4_suffix_dedup, op5_decontamination, op6_simhash, op7_license_scan, op8_toxicity, op9_line_dedup, op10_quality, pii_base, mix_targets, quality_base)}
__all__ = ["ORACLES", "QUERIES"]
