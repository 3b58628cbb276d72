"""A corpus from raw documents: five stages, each one operator, each stored for the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  What a stage stores on its way, and its input, are deleted as soon as
its output is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplework.llm import bpe, mixing, rules, secrets, simhash
from ripplework.llm.common import kept, release, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a learned rule rejects go."""
    return rules.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.dedup_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; every document stays."""
    return secrets.mask_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.token_digest(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("bpe_tokens", bpe_tokens),
]

#: Learned rules and tokens have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = kept(lambda: stage(spark, before, sf_dir), name)  # noqa: B023
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
