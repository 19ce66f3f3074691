"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, jaccard, language, licenses, lines, manifest, mixing, neardup, quality, scoring, substrings, topk
from .common import documents

VOCABULARY = "byte_bpe_50k.json"


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir)).drop("kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", F.array_join("expressions", "; ").alias("expressions"),
    )


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score_documents(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.line_duplicates(documents(spark, sf_dir))
    listed = F.concat_ws(",", F.col("removed_lines").cast("array<string>"))
    return found.select("doc_id", "n_lines", "n_removed", listed.alias("removed_lines"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).drop("_k1", "_k2", "_first")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).drop("_k1", "_k2", "removed_lines")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).drop("_k1", "_k2")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir)).drop("spans")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(documents(spark, sf_dir), manifest.lines_joined()).drop("path")


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_top_k": op3_top_k,
    "op4_lm_score": op4_lm_score,
    "op5_line_dedup": op5_line_dedup,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_mix_sources": op8_mix_sources,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
    "op11_vector_codes": op11_vector_codes,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}
ORACLES = {
    "op3_top_k": topk.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op11_vector_codes": codes.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
}
