"""Schema comparison, names and DDL over catalog DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.types import with_compatibility


def schema_diff(manifest: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of wanted and live columns by exact name, near misses by case-folded name.

    ``manifest``: keys, ``name``, ``type``, ``nullable``; ``live``: keys,
    ``name``, ``type``, ``not_null``, ``has_default``.
    """
    want = manifest.select(*keys, "name", F.col("type").alias("want_type"), "nullable")
    have = live.select(*keys, "name", F.col("type").alias("live_type"), "not_null", "has_default")
    near = live.groupBy(*keys, F.lower("name").alias("folded")).agg(F.min("name").alias("near_name"))
    joined = want.join(have, [*keys, "name"], "full").withColumn("folded", F.lower("name")).join(near, [*keys, "folded"], "left")
    joined = with_compatibility(joined, "want_type", "live_type", "level")
    level = F.col("level")
    verdict = (
        F.when(F.col("live_type").isNull() & F.col("near_name").isNotNull(), "missing, spelt otherwise").when(F.col("live_type").isNull(), "missing")
        .when(F.col("want_type").isNull() & F.col("not_null") & ~F.col("has_default"), "extra and required").when(F.col("want_type").isNull(), "extra")
        .when(level != "ok", level).when(F.col("nullable") & F.col("not_null"), "nulls into not null").otherwise("ok")
    )
    return joined.select(*keys, "name", verdict.alias("verdict"))


def name_collisions(names: DataFrame, column: str) -> DataFrame:
    """Distinct names that are one when lower-cased."""
    folded = names.select(column).distinct().groupBy(F.lower(column).alias("folded")).agg(F.sort_array(F.collect_list(column)).alias("names"))
    return folded.where(F.size("names") > 1).select("folded", F.array_join("names", ",").alias("names"))


def create_table_text(columns: DataFrame, keys: list[str]) -> DataFrame:
    """CREATE TABLE text for each table, columns in position order."""
    line = F.concat(F.col("name"), F.lit(" "), F.col("type"), F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
    listed = columns.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return listed.select(*keys, F.concat(F.lit("CREATE TABLE t_"), F.concat_ws("_", *keys), F.lit(" ("), F.array_join("lines.line", ", "), F.lit(")")).alias("ddl"))
