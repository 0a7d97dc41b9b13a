"""Registered queries of the subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import (byte_bpe, cgk_decontam, chat_windows, embedding_whitening, line_quality, lm_lattice, minhash_index, ordinal_toxicity, periodic_runs,
               pii_disclosure, simhash_cover, trie_counts, url_rules)
from .common import documents

# The rules of the URL contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# The conversation that the chat contract adds.
EXTRA_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def tokenizer(name: str) -> str:
    """A vocabulary file: in $TOKENIZER_DIR if set, else of the installed package."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_lattice.score_documents(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(documents(spark, sf_dir))


def op3_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgk_decontam.matches(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark")).drop("key")


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ordinal_toxicity.score(docs, ordinal_toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_windows.read_back(chat_windows.format_conversations(c.unionByName(extra)))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), split_pattern())


def op7_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_cover.near_duplicates(documents(spark, sf_dir))


def op8_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.report(documents(spark, sf_dir))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(read_table(spark, sf_dir, "pages"), rules)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    texts = docs.select("doc_id", periodic_runs.planted(F.col("text"), F.col("doc_id")).alias("text"))
    return periodic_runs.report(periodic_runs.periodic_runs(texts))


def op12_minhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_index.near_duplicates(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    ops = [op1_lattice_likelihood, op2_line_frequency, op3_cgk_decontamination, op4_ordinal_toxicity, op5_chat_windows,
           op6_byte_bpe, op7_covering_simhash, op8_trie_token_counts, op9_pii_disclosure, op10_url_rules,
           op11_periodic_runs, op12_minhash_index, op13_embedding_whitening]
    return {f.__name__: f for f in ops}
