"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all rows its predecessor kept. All but the last return the columns of ``documents``; the last
returns the pieces of packed sequences. doc_ids are taken as unique; further columns pass
through (not ``_lines`` and ``_removed``, which the second stage refuses). Null and wordless texts go in the first stage; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common, hilbert_packing, language_id, line_dedup, minmax_dedup, tokens, wu_manber


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is not in ``gone``, which is broadcast only if it is counted as small."""
    (key,) = common.free_names(docs, "gone")
    gone = common.stage(gone.select(F.col("doc_id").cast("long").alias(key)), "gone")
    return docs.join(common.small(gone), F.col("doc_id") == F.col(key), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: without letters, or more likely wrong than right."""
    return language_id.accepted(docs, language_id.fit_on(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that nearly repeat an earlier one; a document that loses all its words goes."""
    out = line_dedup.without_repeated_lines(docs).filter("_removed <= 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group: five-word shingles, Jaccard of 0.8 or more."""
    return _without(docs, minmax_dedup.near_duplicates(docs, shingle_words=5, threshold_pct=80).filter("not kept"))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark passages are at least a twentieth."""
    return _without(docs, wu_manber.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return hilbert_packing.pack_documents(docs, tokens.public("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("lines", remove_repeated_lines),
    ("near_duplicates", remove_near_duplicates),
    ("contamination", remove_contaminated),
    ("packing", pack),
]

#: SQL can't express the classifier, the curve or the tokenizer; tests/llm/test_pipeline.py judges each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = common.stage(function(spark, docs, sf_dir), name)
    return docs
