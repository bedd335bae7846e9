"""Exactly-once writes: a chunk owns a partition folder and is written at most once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing_chunks(wanted: DataFrame, fence: DataFrame) -> DataFrame:
    """Chunks that no committed fence row covers."""
    return wanted.join(fence, [c for c in fence.columns if c in wanted.columns], "left_anti")


def write_chunks(df: DataFrame, path: str, chunk: str = "chunk") -> None:
    """Overwrites only the folders of the chunks in ``df``: a repeated write replaces itself."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(path)


def validated(spark: SparkSession, source: DataFrame, path: str, chunk: str = "chunk") -> DataFrame:
    """``source_rows``, ``target_rows``, ``passed`` for a finished copy."""
    written = spark.read.parquet(path).agg(F.count("*").alias("target_rows"))
    counts = source.agg(F.count("*").alias("source_rows")).join(F.broadcast(written))  # two single rows
    return counts.withColumn("passed", F.col("source_rows") == F.col("target_rows"))
