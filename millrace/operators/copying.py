"""A copy in chunks: plan, ranged scan under the row filter, target types, fenced write, validation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from millrace.functions.values import checked_filter, normalise_strings
from millrace.operators import monitor, planning
from millrace.sources.writer import write_chunks


#: Ranges that a plan may have; their bounds stand in the query as literals.
MOST_CHUNKS = 10_000


def chunk_of(key: Column, plan: list[Row]) -> Column:
    """The chunk whose range holds a key, by a search in two steps of about the square root of the chunks each; a null key is in the first."""
    chunks, highs = [r.chunk for r in plan], [r.high for r in plan[:-1]]
    if not highs:
        return F.lit(chunks[0])
    step = max(1, math.isqrt(len(highs)))
    groups = [highs[i : i + step] for i in range(0, len(highs), step)]
    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < key))

    def listed(values: list) -> Column:
        return F.array(*map(F.lit, values))

    group = F.greatest(below(listed([g[0] for g in groups])) - 1, F.lit(0))
    place = group * step + below(F.get(F.array(*[listed(g) for g in groups]), group))
    return F.when(key.isNull(), F.lit(chunks[0])).otherwise(F.get(F.array(*map(F.lit, chunks)), place))


def range_filter(key: Column, plan: list[Row], wanted: set[int], most: int = 32) -> Column:
    """A predicate on the key that all rows of the wanted chunks pass, neighbouring ranges as one; the source can prune by it."""
    spans: list[list] = []
    for i, r in enumerate(plan):
        if r.chunk in wanted:
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
    if len(spans) > most:
        spans = [[spans[0][0], spans[-1][1]]]
    out = F.lit(False)
    for start, end in spans:
        low, high = plan[start].low if start else None, plan[end - 1].high if end < len(plan) else None
        inside = F.lit(True)
        if low is not None:
            inside = inside & (key > F.lit(low))
        if high is not None:
            inside = inside & (key <= F.lit(high))
        out = out | (inside if start else inside | key.isNull())
    return out


def chunk_rows(df: DataFrame, plan: DataFrame | list[Row], key: str, row_filter: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """The rows of the plan's chunks with their ``chunk``, without those a fence row covers.

    The plan is read once: a row for each chunk, ``MOST_CHUNKS`` at most. Rows find
    their chunk by search and stay where they are; the wanted ranges go to the scan.
    """
    rows = plan if isinstance(plan, list) else read_plan(plan)
    kept = df if row_filter is None else df.where(checked_filter(row_filter))
    if not rows:
        return kept.where("false").withColumn("chunk", F.lit(0))
    wanted = {r.chunk for r in rows}
    if done is not None:
        wanted -= {r.chunk for r in done.select("chunk").distinct().limit(MOST_CHUNKS + 1).collect()}
    found = kept.where(range_filter(F.col(key), rows, wanted)).withColumn("chunk", chunk_of(F.col(key), rows))
    return found if len(wanted) == len(rows) else found.where(F.col("chunk").isin(*wanted) if wanted else F.lit(False))


def read_plan(plan: DataFrame) -> list[Row]:
    """The chunks of a plan in order of their ranges."""
    rows = plan.select("chunk", "low", "high").limit(MOST_CHUNKS + 1).collect()
    if len(rows) > MOST_CHUNKS:
        raise ValueError(f"a plan has at most {MOST_CHUNKS} chunks")
    return sorted(rows, key=lambda r: r.chunk)


def coerced(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Values in the target's types: text is normalised, the named columns are cast."""
    return normalise_strings(df).withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def copy_table(df: DataFrame, path: str, key: str, chunks: int, types: dict[str, str], row_filter: str | None = None, done: DataFrame | None = None) -> DataFrame:
    """Copies a table in chunks and returns each chunk's ``source_rows``, ``target_rows``, ``passed``.

    Chunks of ``done`` are left as they are; every other chunk replaces its own
    folder, so a copy that failed half-way is simply run again.
    """
    spark: SparkSession = df.sparkSession
    plan = read_plan(planning.key_ranges(planning.ntile_bounds(df, key, chunks)))
    write_chunks(coerced(chunk_rows(df, plan, key, row_filter, done), types), path)
    return monitor.validated_counts(chunk_rows(df, plan, key, row_filter), spark.read.parquet(path), ["chunk"])
