"""From raw documents to tokens: quality rules, exact and near duplicates, source mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet under the shared
checkpoint folder and read again by the next stage, so lost executors cost one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, exact_dedup, mixing, near_dedup, quality
from tidemark.llm.common import shared_folder

#: Shares of the mixed corpus in characters; "*" is every source not named.
WEIGHTS = {"src0": 2.0, "src1": 1.0, "src2": 1.0, "src3": 0.5, "*": 15.5}
SEED = 17


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.passed(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z folded) the row with the largest id."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8."""
    return near_dedup.survivors(docs, near_dedup.Plan(5, 80, 100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights, in shuffled order; a document may be absent or repeated."""
    return mixing.mixed(docs, WEIGHTS, SEED, added=False)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of decoded bytes."""
    return bpe.digests(bpe.encode(docs, bpe.Bpe(spark)))


STAGES = [("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("source_mixing", mixing_stage),
          ("byte_bpe", tokens_stage)]

#: SQL has no byte-pair merges; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
