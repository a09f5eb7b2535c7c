"""From raw documents to token counts of a mix: quality, near copies, mixture, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
next stage's documents, which are written as Parquet between stages. All but the last
return the columns of documents, further ones included, whatever their names. An empty table
passes through as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from momentlake.llm import bpe, mixing, quality, simhash
from momentlake.plans.lineage import drop_folder, shared_folder

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts. Null and empty texts are scored like others; equal rows share their fate; a label without a document, or null, is ignored."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more.

    Null and empty texts are copies of each other; of equal rows one stays; the smallest id
    stays, null ids last.
    """
    return simhash.near_duplicates(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each time that a document is taken. Null and empty texts have size 0; rows without a source are a source."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of the whole texts, row by row; null texts have no tokens."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("near copies", drop_near_copies), ("mixture", mix_sources), ("tokens", tokenize)]

#: The stages fit trees, compare fingerprints and run BPE, which SQL has no words for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder until the next has read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_folder(spark, f"{folder}/{k - 1}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
