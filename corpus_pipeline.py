"""The corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, token ids.

Each stage reads all that the stage before it kept. A stage takes (spark, docs, sf_dir); all but the
last return the columns of the documents they were given. ``run`` writes each stage's result as
Parquet in the shared folder and reads it again for the next one.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerwise.llm import byte_bpe, decontaminate, quality_rules, secret_scan, simhash
from ledgerwise.llm.common import drop_written, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the bounds of their language and source reject go."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: three-word shingles, links at three bits or fewer."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return secret_scan.redact(docs, public_tokenizers.path(RANKS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the bytes decoded from them."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("byte_bpe", token_ids),
]
#: Fingerprints, the forest and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return result
        docs = written(result, f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return docs
