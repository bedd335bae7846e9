"""Sizes and bounds of stored tables from their files alone: footers are read, data pages are not."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_extents(df: DataFrame) -> DataFrame:
    """A row for each file split of a table: ``file``, ``position``, ``bytes``, ``rows``.

    No column of the table is read, so a task counts the rows of its row groups in the
    footer. The splits are what a copy by range of the files cuts.
    """
    m = "_metadata."
    where = df.select(F.col(m + "file_path").alias("file"), F.col(m + "file_block_start").alias("position"), F.col(m + "file_block_length").alias("bytes"))
    return where.groupBy("file", "position", "bytes").agg(F.count("*").alias("rows"))


def footer_bounds(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``rows``, and ``low_x``, ``high_x`` and ``nulls_x`` of each column x, as Spark's own aggregate push-down takes them from the footers.

    Footers hold bounds for numbers, dates and booleans only; other columns are read.
    """
    aside = spark.newSession()  # the two settings are for this scan
    aside.conf.set("spark.sql.sources.useV1SourceList", "")
    aside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    wanted = [e for c in columns for e in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"), F.count(c).alias(f"n_{c}"))]
    found = aside.read.parquet(path).agg(F.count("*").alias("rows"), *wanted)
    return found.select("rows", *[x for c in columns for x in (F.col(f"low_{c}"), F.col(f"high_{c}"), (F.col("rows") - F.col(f"n_{c}")).alias(f"nulls_{c}"))])


def size_of(file_bytes: Column, rows: Column, row_bytes: Column) -> Column:
    """``bytes`` and where they are from: the files, else rows by their average length, else unknown."""
    return (
        F.when(file_bytes.isNotNull(), F.struct(file_bytes.cast("long").alias("bytes"), F.lit("files").alias("known_from")))
        .when(rows.isNotNull() & row_bytes.isNotNull(), F.struct((rows * row_bytes).cast("long").alias("bytes"), F.lit("estimate").alias("known_from")))
        .otherwise(F.struct(F.lit(None).cast("long").alias("bytes"), F.lit("unknown").alias("known_from")))
    )


def synced(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One row: a table's exact ``rows`` and ``bytes`` now; a size that cannot be read is null and no error, a count that cannot is ``error``."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        return spark.createDataFrame([(name, None, None, e.getCondition())], "name string, rows long, bytes long, error string")
    none = F.lit(None).cast("string")
    try:
        sized = file_extents(df).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    except AnalysisException:  # not a file source: no file to measure
        sized = df.agg(F.count("*").alias("rows"), F.lit(None).cast("long").alias("bytes"))
    return sized.select(F.lit(name).alias("name"), "rows", "bytes", none.alias("error"))


def refreshed_sizes(cache: DataFrame, found: DataFrame) -> DataFrame:
    """A cache of sizes (``name``, ``rows``, ``bytes``) after a sync: what was counted replaces the old figures, a size or count that failed keeps them."""
    new = found.select("name", F.col("rows").alias("new_rows"), F.col("bytes").alias("new_bytes"), "error")
    both = cache.join(new, "name", "full")
    return both.select("name", F.coalesce("new_rows", "rows").alias("rows"), F.coalesce("new_bytes", "bytes").alias("bytes"), "error")
