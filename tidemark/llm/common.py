"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.tables import discard, folder, materialise, numbered, partitions, release, running_sums, scratch, shared_dir

__all__ = ["discard", "documents", "folder", "materialise", "numbered", "partitions", "release", "running_sums", "scratch", "shared_dir"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
