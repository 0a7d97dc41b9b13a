"""Corpus pipeline: quality rules, near-duplicates, decontamination, PII, byte BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import byte_bpe, cgk_decontam, line_quality, pii_disclosure, simhash_cover
from vigilspark.llm.common import documents, stage
from vigilspark.llm.registry import split_pattern, tokenizer
from vigilspark.sources.tables import read_table

ARROW_BATCH = "8m"  # of a batch that goes to a Python worker


def _bounded(spark: SparkSession) -> None:
    """Batches of texts stay small beside the workers' memory, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their over-frequent lines."""
    _bounded(spark)
    return _sized(line_quality.clean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: its smallest doc_id."""
    _bounded(spark)
    return simhash_cover.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    _bounded(spark)
    return cgk_decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and terms that disclose it replaced."""
    _bounded(spark)
    return _sized(pii_disclosure.sanitise(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and the decoded bytes."""
    _bounded(spark)
    return byte_bpe.round_trip(docs, tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("pii", pii), ("byte_bpe", tokens)]

# Hash walks, connected components and the tokeniser have no SQL form; the
# stages are tested against brute-force versions in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
