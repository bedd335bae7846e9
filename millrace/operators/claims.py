"""Work that workers claim: the next chunks, trackers held by a run, and a job with all that belongs to it.

Inputs are state tables. Rows whose run or job is not there are not live; a null
status is none of the named ones; ids are taken as unique in their own table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEASE = "interval 10 minutes"
LIVE = ("Queued", "Running")


def claimable(chunks: DataFrame, runs: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Chunks that a worker may take: waiting, not before their retry time, of a run that is loading in a job that runs.

    ``chunks``: ``chunk_id``, ``run_id``, ``status``, ``retry_after``; ``runs``: ``run_id``,
    ``job_id``, ``status``; ``jobs``: ``job_id``, ``status``. Only live runs are joined to the chunks.
    """
    loading = runs.where("status = 'Loading'").select("run_id", "job_id").join(jobs.where("status = 'Running'").select("job_id"), "job_id", "left_semi")
    due = chunks.where((F.col("status") == "Pending") & (F.col("retry_after").isNull() | (F.col("retry_after") <= now)))
    return due.join(loading.select("run_id"), "run_id", "left_semi")


def claimed(free: DataFrame, worker: str, now: Column, most: int) -> DataFrame:
    """The first ``most`` chunks by ``chunk_id`` as they are once ``worker`` has taken them; ``attempts`` counts from null as from 0."""
    first = free.orderBy("chunk_id").limit(most)
    return first.select("chunk_id", "run_id", F.lit("Running").alias("status"), F.lit(worker).alias("worker"), (F.coalesce("attempts", F.lit(0)) + 1).cast("int").alias("attempts"), (now + F.expr(LEASE)).alias("leased_until"))


def released(trackers: DataFrame, jobs: DataFrame, held: str = "active_job_id") -> DataFrame:
    """Trackers with the claim of every job that is neither queued nor running taken away, and whether it was (``released``)."""
    live = jobs.where(F.col("status").isin(*LIVE)).select(F.col("job_id").alias("live_job")).distinct()
    both = trackers.join(live, F.col(held) == F.col("live_job"), "left")
    return both.withColumn("released", F.col(held).isNotNull() & F.col("live_job").isNull()).withColumn(held, F.col("live_job")).drop("live_job")


def job_tree(jobs: DataFrame, runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a run, with its job and its chunks in order of their ids; jobs without runs and runs without chunks stay.

    A run's chunks are as many as a plan makes at most; a job's runs are rows, so
    that a job of any size is never one row. Chunks are gathered before the joins.
    """
    listed = chunks.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", F.col("status").alias("status")))).alias("chunks"))
    whole = runs.select("run_id", "job_id", F.col("status").alias("run_status")).join(listed, "run_id", "left")
    return jobs.select("job_id", F.col("status").alias("job_status")).join(whole, "job_id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<chunk_id:bigint,status:string>>")))


def searched(tables: DataFrame, text: str, name: str = "table_name", owner: str = "owner") -> DataFrame:
    """Tables whose name or owner holds ``text`` in any case, blanks around it ignored; nothing asked for is all tables."""
    asked = text.strip().lower()
    return tables.where(F.lower(name).contains(asked) | F.lower(owner).contains(asked)) if asked else tables


def status_counts(found: DataFrame) -> DataFrame:
    """How many tables of a search there are of each status, and ``All`` of them."""
    return found.rollup("status").agg(F.count("*").alias("tables"), F.grouping("status").alias("every")).select(F.when(F.col("every") == 1, "All").otherwise(F.col("status")).alias("status"), "tables")
