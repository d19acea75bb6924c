"""A corpus, from documents to token ids: five stages, each an operator of ``tidemark.llm``.

Every stage works on all rows that the one before it kept, and its decisions take effect.
Each stage's result is written before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, naming, quality, simhash
from tidemark.llm.common import discard, documents, materialise, scratch
from tidemark.llm.registry import rank_file, split_pattern


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects; what it rejects goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (F.col("quality") == 1).alias("target"))
    return quality.keep_selected(docs, labels)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return naming.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return simhash.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row: ``doc_id``, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit), and digests of the ids and of the decoded bytes."""
    coded = bpe.encode(docs, rank_file(), split_pattern(), decode=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("encode", encode_stage),
]

#: The classifier, the fingerprints and the merges cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents.  A stage's result goes when the next one's is written, the last written one with ``release`` or the driver's process."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
