"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volclock.llm import ann, codes, divergence, language_id, license_scan, lines, mixing, ngram_join, oracles, packing, quality_model, quality_rules, quotes, substring
from volclock.llm.text import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality_model.toxic_poor_good(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality_model.graded(docs, quality_model.fitted(docs, ratings))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.formatted(table(spark, sf_dir, "conversations"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), ngram=3, numerator=90, denominator=100)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_rules.quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.public_vocabulary())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.without_common_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_quality_classifier,
        op3_chat_formatting,
        op4_nearest_neighbours,
        op5_ngram_jaccard,
        op6_quality_rules,
        op7_language_id,
        op8_substring_dedup,
        op9_packing,
        op10_license_scan,
        op11_vector_codes,
        op12_source_divergence,
        op13_line_dedup,
    )
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
