"""A corpus run: five stages over ``documents``, each written as Parquet and read by the next.

Rejected documents go, of near copies one stays, contaminated documents go, secrets are masked, and
what remains is tokenised. Every stage works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, common, decontaminate, minhash, secrets, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't score as toxic; null and empty texts are scored like any."""
    return toxicity.drop_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without id or words stay."""
    return minhash.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to be contaminated; null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; a null text stays null."""
    return secrets.redact(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document that is left, with their digests; a null text has none."""
    return bpe.round_trip(docs).select("doc_id", "ids", *bpe.digests())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("byte_bpe", tokenise),
]

#: SQL has neither the boosted trees nor the byte-pair merges; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage wrote goes once the next one has."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(docs)
        docs = done
    return docs
