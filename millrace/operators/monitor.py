"""Row-count comparison, run states and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import ordered


def pair_names(source: DataFrame, target: DataFrame) -> DataFrame:
    """Pairs tables of two sides: exact names first, then one-to-one by case-folded name in name order; leftovers stay.

    Both sides: ``name``, ``rows``, ``error``. The result has ``source_name``,
    ``target_name`` and both sides' rows and errors.
    """
    s = source.select(F.col("name").alias("source_name"), F.col("rows").alias("source_rows"), F.col("error").alias("source_error"))
    t = target.select(F.col("name").alias("target_name"), F.col("rows").alias("target_rows"), F.col("error").alias("target_error"))
    exact = s.join(t, F.col("source_name") == F.col("target_name"))

    def numbered(df: DataFrame, name: str, other: DataFrame, other_name: str) -> DataFrame:
        rest = df.join(other.select(F.col(other_name).alias("taken")), F.col(name) == F.col("taken"), "left_anti")
        return rest.withColumn("folded", F.lower(name)).withColumn("place", F.row_number().over(Window.partitionBy("folded").orderBy(name)))

    loose = numbered(s, "source_name", t, "target_name").join(numbered(t, "target_name", s, "source_name"), ["folded", "place"], "full").drop("folded", "place")
    return exact.unionByName(loose)


def count_status(pairs: DataFrame) -> DataFrame:
    """Adds ``status`` and ``difference``; an error beats an old number."""
    status = (
        F.when(F.col("source_name").isNull(), "target_only").when(F.col("target_name").isNull(), "source_only")
        .when(F.col("source_error").isNotNull() | F.col("target_error").isNotNull(), "error")
        .when(F.col("source_rows").isNull() | F.col("target_rows").isNull(), "not_counted")
        .when(F.col("source_rows") == F.col("target_rows"), "match").when(F.col("target_rows") < F.col("source_rows"), "missing").otherwise("extra")
    )
    out = pairs.withColumn("status", status)
    return out.withColumn("difference", F.when(F.col("status").isin("match", "missing", "extra"), F.col("target_rows") - F.col("source_rows")))


def job_status(statuses: DataFrame, job: str, status: str) -> DataFrame:
    ended = F.every(F.col(status).isin("Completed", "Failed", "Cancelled"))
    clean = F.every(F.col(status) == "Completed")
    return statuses.groupBy(job).agg(F.when(~ended, "Running").when(clean, "Completed").otherwise("CompletedWithErrors").alias("job_status"))


def change_status(done: Column, total: Column) -> Column:
    return F.when(done == total, "Completed").when(done == 0, "Failed").otherwise("CompletedWithErrors")


def table_status(chunks: DataFrame, table: str, status: str) -> DataFrame:
    waiting = F.bool_or(F.col(status).isin("Pending", "Running"))
    failed = F.bool_or(F.col(status) == "Failed")
    return chunks.groupBy(table).agg(F.when(waiting, "InProgress").when(failed, "Failed").otherwise("Validating").alias("table_status"))


def rates(samples: DataFrame, key: str, at: str, total: str, least_seconds: float = 0.5) -> DataFrame:
    """Adds ``rate``: growth of ``total`` a second since the sample before, floored at 0; a first sample has 0."""
    rows = ordered.previous(samples, [key], [at, total], [at, total])
    seconds, before = (c.cast("timestamp").cast("double") for c in (F.col(at), F.col(f"before.{at}")))
    growth = F.greatest((F.col(total) - F.col(f"before.{total}")) / F.greatest(seconds - before, F.lit(least_seconds)), F.lit(0.0))
    return rows.withColumn("rate", F.coalesce(growth, F.lit(0.0))).drop("before")


def latest(samples: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The last sample of each key, by a pre-aggregated maximum rather than a sort."""
    return samples.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("last")).select(key, "last.*")


def progress(done: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.round(100 * done / total, 0)).cast("int")


def validated_counts(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Row counts of each group of ``keys`` on both sides; a group that one side lacks has 0 there."""
    a = source.groupBy(*keys).agg(F.count("*").alias("source_rows"))
    b = target.groupBy(*keys).agg(F.count("*").alias("target_rows"))
    both = a.join(b, keys, "full")
    none = F.lit(0).cast("long")
    counted = both.select(*keys, F.coalesce("source_rows", none).alias("source_rows"), F.coalesce("target_rows", none).alias("target_rows"))
    return counted.withColumn("passed", F.col("source_rows") == F.col("target_rows"))


def recent_metrics(metrics: DataFrame, running: DataFrame, key: str, at: str, columns: list[str], now: Column, seconds: int = 30) -> DataFrame:
    """The last sample of each running job, if it is at most so many seconds old."""
    fresh = metrics.where(F.col(at) >= now - F.expr(f"INTERVAL {seconds} SECOND"))
    return latest(fresh.join(running.select(key).distinct(), key, "left_semi"), key, at, columns)


def dashboard(chunks: DataFrame, metrics: DataFrame, running: DataFrame, now: Column, sampled_now: Column, hours: int = 24) -> DataFrame:
    """One row: running jobs, rows and bytes of the batches done in the last hours, and the sum of the latest rates.

    ``chunks``: ``status``, ``completed_at``, ``rows``, ``bytes``; ``metrics``:
    ``job_id``, ``sampled_at``, ``rate``; ``running``: ``job_id``.
    """
    done = chunks.where((F.col("status") == "Done") & (F.col("completed_at") >= now - F.expr(f"INTERVAL {hours} HOUR")))
    none = F.lit(0).cast("long")
    copied = done.agg(F.coalesce(F.sum("rows"), none).alias("copied_rows"), F.coalesce(F.sum("bytes"), none).alias("copied_bytes"))
    speed = recent_metrics(metrics, running, "job_id", "sampled_at", ["rate"], sampled_now).agg(F.coalesce(F.sum("rate"), F.lit(0.0)).alias("rows_per_second"))
    jobs = running.select("job_id").distinct().agg(F.count("*").alias("runs_in_progress"))
    return jobs.join(F.broadcast(copied)).join(F.broadcast(speed))  # single rows


def merged_selection(saved: DataFrame, fresh: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """A saved selection over a fresh list: choices are kept, new entries get the defaults, entries that are gone stay."""
    both = fresh.select(key).distinct().join(saved, key, "full")
    return both.select(key, *[F.coalesce(c, d).alias(c) for c, d in defaults.items()])


def refreshed(saved: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """A saved list after a refresh: new entries are added, entries that are gone are dropped, the rest keep what was saved."""
    values = [c for c in saved.columns if c != key]
    return fresh.select(key).distinct().join(saved.select(key, *values), key, "left")


def upserted(state: DataFrame, rows: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """State after rows are put into it: a known key keeps its ``kept`` columns and takes the others from ``rows``."""
    old = state.select(key, *[F.col(c).alias(f"old_{c}") for c in state.columns if c != key], F.lit(True).alias("known"))
    new = rows.select(key, *[F.col(c).alias(f"new_{c}") for c in state.columns if c != key], F.lit(True).alias("put"))
    both = old.join(new, key, "full")

    def value(c: str) -> Column:
        put = F.col("put").isNotNull() & (F.col("known").isNull() if c in kept else F.lit(True))
        return F.when(put, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c)

    return both.select(key, *[value(c) for c in state.columns if c != key])


def without_history(runs: DataFrame, wanted: DataFrame, key: str, active: Column) -> DataFrame:
    """The runs that stay when the wanted ones are deleted: an active run is never deleted."""
    return runs.join(wanted.select(key).distinct().withColumn("wanted", F.lit(True)), key, "left").where(F.col("wanted").isNull() | active).drop("wanted")


def merged_counts(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` and ``error`` after a recount: a failed or missing recount keeps the old number."""
    both = old.select(key, F.col("rows").alias("old")).join(new.select(key, F.col("rows").alias("new"), "error", F.lit(True).alias("fresh")), key, "full")
    return both.select(key, F.when(F.col("error").isNotNull() | F.col("fresh").isNull(), F.col("old")).otherwise(F.col("new")).alias("rows"), "error")
