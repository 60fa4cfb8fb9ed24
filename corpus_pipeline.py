"""A training-data pipeline over ``documents``: five stages, each over all that the one before it kept.

1. language: rows whose language the byte network cannot name (null, or no letter) go.
2. near_duplicates: of each SimHash component one row stays.
3. decontaminate: rows that hold a benchmark item go.
4. secrets: secrets in the text are replaced by a mark, and n_chars follows.
5. tokens: every text is encoded and decoded; one row of digests each.

Nulls, empty texts, repeated rows, empty tables and extra columns have the results that the operators
state: a stage returns the columns it was given, but for the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdin.llm import bpe_duck, decontaminate, langid, simhash_bk, trigram_secrets
from verdin.llm.common import documents, remainder, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows with a language, named by a network trained on this table's labelled rows."""
    return langid.keep_identified(docs, langid.fit(docs, remainder("i", 4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of fingerprints within 3 bits (3-word shingles)."""
    return simhash_bk.keep_one(docs, width=3, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows in which no benchmark item is found."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets; every row stays."""
    return trigram_secrets.redact(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe_duck.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontamination),
          ("secrets", secrets), ("tokens", tokens)]

#: SQL cannot express the network, the trees and the merges; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result is a table that the next one reads."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
