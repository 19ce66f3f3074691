"""Corpus preparation in five stages, each one of the library's training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one reads what it wrote. All but
the last return the columns of documents, with the text as the stage left it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, lines, mixing, neardup, quality
from tidemark.llm.common import cut, documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that are too frequent in their source."""
    return quality.apply_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one, exactly or nearly."""
    return lines.apply_line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.apply_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: a part of its words, all, or up to two rounds."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digests of each document's token ids, and of the text they decode to."""
    return bpe.encode_digests(docs, VOCABULARY)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mix", mix), ("bpe", encode)]
ORACLE_SQL = None  # SQL cannot express SimHash components and BPE merges; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for place, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES):
            docs = cut(docs)
    return docs
