"""The corpus pipeline: five stages over documents, each a step of the operators in cuesmith.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuesmith.llm import bpe, common, mixing, quality, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language and source go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike (0.8 or more on five-word shingles) the one with the smallest doc_id stays."""
    return simhash.drop_like_documents(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target sizes: documents come once, twice, in part or not at all."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, the ids, and digests of the ids and of what they decode to."""
    encoded = bpe.encode_decode(docs, *bpe.vocabulary())
    return bpe.digests(encoded, "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secret_scan),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: Fingerprints, robust estimates and token ids are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
