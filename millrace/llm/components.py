"""Connected components of an edge table, by alternating large and small stars.

Every round is joins and pre-aggregated minima over edges; nothing is gathered
on the driver but two sums that tell when the edges stop changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``u``, ``root`` for each node of ``edges`` (``u``, ``v``) but the roots, the least nodes of their components."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    for _ in range(most_rounds):
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
        large = sides.where("v > u").join(least, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")
        small = large.join(least, F.col("u") == F.col("of")).where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut(small.unionByName(least.select(F.col("of").alias("u"), F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            return edges.withColumnRenamed("v", "root")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
