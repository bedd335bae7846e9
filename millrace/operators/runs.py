"""Runs of copies: what must hold before one, how fast its batches were, and what is tracked after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_VERSION = 14


def preflight(runs: DataFrame, schemas: DataFrame, wanted: DataFrame, existing: DataFrame, named: int = 10) -> DataFrame:
    """``run_id``, ``passed``, ``failed``, ``missing`` and, if the right to make tables is lacking but not needed, ``warning``.

    ``runs``: ``run_id``, ``schema``, ``can_read``, ``version``; ``schemas``: ``schema``, ``can_use``, ``can_create``;
    ``wanted``: ``run_id``, ``name``; ``existing``: ``schema``, ``name``. Making tables is only asked for if a
    wanted one is missing; ``failed`` lists what fails, with the first missing tables by name.
    """
    lacking = wanted.join(runs.select("run_id", "schema"), "run_id").join(existing.select("schema", "name").distinct(), ["schema", "name"], "left_anti").select("run_id", "name").distinct()
    gone = lacking.groupBy("run_id").agg(F.count("*").alias("missing"), F.slice(F.sort_array(F.collect_list("name")), 1, named).alias("names"))
    r = runs.join(schemas, "schema", "left").join(gone, "run_id", "left")
    missing = F.coalesce("missing", F.lit(0))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    some = F.concat(F.lit("tables must be made: "), F.array_join("names", ", "), F.when(missing > named, ", ...").otherwise(""))
    failed = F.array_compact(F.array(
        F.when(no("can_read"), "the source cannot be read"), F.when(~F.coalesce(F.col("version") >= LEAST_VERSION, F.lit(False)), f"the destination is older than {LEAST_VERSION}"),
        F.when(no("can_use"), "the schema cannot be used"), F.when(no("can_create") & (missing > 0), some),
    ))
    warning = F.when(no("can_create") & (missing == 0), "no tables can be made here, and none need to be")
    return r.select("run_id", (F.size(failed) == 0).alias("passed"), F.array_join(failed, "; ").alias("failed"), missing.alias("missing"), warning.alias("warning"))


def batch_rates(chunks: DataFrame) -> DataFrame:
    """Adds ``rows_per_s``, ``mb_per_s`` and the shares of time spent waiting for either side, in whole percent.

    ``chunks``: ``rows``, ``bytes``, ``elapsed_ms``, ``source_ms``, ``target_ms``. A batch takes a millisecond at least.
    """
    ms = F.greatest(F.col("elapsed_ms"), F.lit(1))
    share = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)) * 100 / ms + 0.5).cast("int")
    return chunks.withColumns({"rows_per_s": F.col("rows") * 1000 / ms, "mb_per_s": F.col("bytes") * 1000 / 1048576 / ms, "source_share": share("source_ms"), "target_share": share("target_ms")})


def last_run(jobs: DataFrame) -> DataFrame:
    """The job made last, by ``created_at``, then ``job_id``; no rows if there are no jobs."""
    return jobs.orderBy(F.desc_nulls_last("created_at"), F.desc("job_id")).limit(1)


def registered(trackers: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Trackers after bulk copies: ``keys``, ``start_scn``, ``state``, ``action``, each target once.

    ``trackers``: keys, ``start_scn``, ``state``; ``fresh``: keys, ``start_scn``, ``reason`` (why it cannot be
    tracked, null if it can), of several copies of one target that of the greatest start counts. A
    copy that can be tracked starts its tracker anew, also where its row count was wrong; one that cannot
    leaves what is there as it is and is listed as ``refused`` with its reason for a state.
    """
    newest = fresh.groupBy(*keys).agg(F.max_by(F.struct("start_scn", "reason"), F.struct(F.coalesce("start_scn", F.lit(-1)), F.coalesce("reason", F.lit("")))).alias("new"))
    held = trackers.select(*keys, F.struct("start_scn", "state").alias("old"))
    both = held.join(newest, keys, "full")
    can = F.col("new").isNotNull() & F.col("new.reason").isNull()
    action = F.when(can & F.col("old").isNull(), "added").when(can, "restarted").when(F.col("new").isNotNull(), "refused").otherwise("kept")
    start = F.when(can, F.col("new.start_scn")).otherwise(F.col("old.start_scn"))
    state = F.when(can, "needs_first_sync").when(F.col("new").isNotNull(), F.col("new.reason")).otherwise(F.col("old.state"))
    return both.select(*keys, start.alias("start_scn"), state.alias("state"), action.alias("action"))


def sorted_known_first(df: DataFrame, column: str, descending: bool, *ties: str) -> DataFrame:
    """Rows by a figure in either direction, those without it last in both."""
    first: Column = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return df.orderBy(first, *ties)
