"""Keyed change sets: mining keys from a change log, re-reading rows, applying and settling them.

The change log supplies keys only; values come from a re-read of a snapshot, so
the order of operations in a window does not matter and a repeated run changes
nothing. All steps are equi-joins on the key; Spark picks broadcast or shuffle
by measured size, and no key list passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import ordered


def resume_point(start: Column, oldest_open: Column) -> Column:
    """Position from which nothing uncommitted is skipped: before the start and before the oldest open transaction."""
    return F.least(start - 1, F.coalesce(oldest_open - 1, start - 1))


def mine_keys(log: DataFrame, tables: DataFrame, upto: Column, keys: list[str] = ("old_key", "new_key")) -> DataFrame:
    """Distinct (``table_id``, ``key``) changed after each table's own point and up to ``upto``; a key change yields both keys."""
    inside = log.join(tables.select("table_id", "from_scn"), "table_id").where((F.col("scn") > F.col("from_scn")) & (F.col("scn") <= upto))
    return inside.select("table_id", F.explode(F.array(*keys)).alias("key")).where("key is not null").distinct()


def reread(snapshot: DataFrame, keys: DataFrame, key: str, row_filter: Column | None = None) -> DataFrame:
    found = snapshot.join(keys.select(key).distinct(), key, "left_semi")
    return found if row_filter is None else found.where(row_filter)


def deleted_keys(target: DataFrame, keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Target rows whose key changed and has no current row."""
    return target.join(keys, key, "left_semi").join(rows, key, "left_anti")


def change_plan(target: DataFrame, keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``action`` (insert, update, delete) for keys whose target row really changes."""
    values = [c for c in rows.columns if c != key]
    old = target.join(keys, key, "left_semi").select(F.col(key), F.struct(*values).alias("old"))
    new = rows.select(F.col(key), F.struct(*values).alias("new"))
    both = old.join(new, key, "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select(key, action.alias("action")).where("action is not null")


def applied(target: DataFrame, keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The target after the change set: untouched rows and the current rows of changed keys."""
    return target.join(keys, key, "left_anti").unionByName(rows.select(*target.columns))


def apply_counts(target: DataFrame, keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    plan = change_plan(target, keys, rows, key)
    return plan.agg(F.count_if(F.col("action") != "delete").alias("written"), F.count_if(F.col("action") == "delete").alias("deleted"))


def settle_counts(target: DataFrame, keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Delete-then-insert: every current row is written; only keys without one count as deleted."""
    gone = deleted_keys(target, keys, rows, key).agg(F.count("*").alias("deleted"))
    return rows.agg(F.count("*").alias("written")).join(F.broadcast(gone))  # two single rows


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def stop_reason(op: Column, status: Column, old_key: Column, new_key: Column, address: Column) -> Column:
    return (
        F.when(op == "DDL", "structure changed").when(op == "UNSUPPORTED", "unsupported operation").when(status != 0, "unreadable record")
        .when(old_key.isNull() & new_key.isNull() & address.isNull(), "no key and no address")
        .when(old_key.isNull() & new_key.isNull(), "look up by address")
    )


def log_gaps(logs: DataFrame) -> DataFrame:
    """Log files whose predecessor in their thread is missing."""
    rows = ordered.previous(logs, ["thread"], ["sequence"], ["sequence"])
    return rows.withColumn("previous", F.col("before.sequence")).drop("before").where("sequence <> previous + 1")


def preferred_logs(logs: DataFrame) -> DataFrame:
    """One file for each thread and sequence, archived before online, then by name."""
    best = F.min(F.struct(F.when(F.col("archived"), 0).otherwise(1).alias("rank"), "name"))
    return logs.groupBy("thread", "sequence").agg(best.alias("best")).select("thread", "sequence", F.col("best.name").alias("name"), (F.col("best.rank") == 0).alias("archived"))


def object_drift(before: DataFrame, now: DataFrame) -> DataFrame:
    """Objects that were dropped, or whose data id changed (truncated or moved)."""
    joined = before.join(now.select("object_id", F.col("data_id").alias("now_id")), "object_id", "left")
    return joined.select("object_id", F.when(F.col("now_id").isNull(), "dropped").when(F.col("now_id") != F.col("data_id"), "truncated or moved").otherwise("same").alias("drift"))


def upserted_rows(target: DataFrame, keys: DataFrame, rows: DataFrame, key: list[str], settable: list[str]) -> DataFrame:
    """The target after an upsert: a row that is there takes the settable columns only, a new row takes all, a changed key without a row goes.

    Key, identity and generated columns are not settable. Without a settable column a row that is there stays as it is.
    """
    columns = [c for c in target.columns if c not in key]
    old = target.select(*key, F.struct(*columns).alias("old"))
    new = rows.select(*key, F.struct(*columns).alias("new"))
    both = old.join(new, key, "full").join(keys.select(*key).distinct().withColumn("changed", F.lit(True)), key, "left")
    left = both.where(F.col("new").isNotNull() | F.col("changed").isNull())

    def value(c: str) -> Column:
        put = F.col("new").isNotNull() & (F.lit(True) if c in settable else F.col("old").isNull())
        return F.when(put, F.col("new")[c]).otherwise(F.col("old")[c]).alias(c)

    return left.select(*[F.col(c) if c in key else value(c) for c in target.columns])


def upsert_counts(target: DataFrame, keys: DataFrame, rows: DataFrame, key: list[str], settable: list[str]) -> DataFrame:
    """``written`` (new rows, and rows whose settable values really change) and ``deleted``."""
    picked = F.struct(*settable) if settable else F.lit(True)
    old = target.select(*key, picked.alias("old"), F.lit(True).alias("was"))
    new = rows.select(*key, picked.alias("new"), F.lit(True).alias("now"))
    both = old.join(new, key, "full").join(keys.select(*key).distinct().withColumn("changed", F.lit(True)), key, "left")
    written = F.col("now").isNotNull() & (F.col("was").isNull() | ~F.col("old").eqNullSafe(F.col("new")))
    deleted = F.col("was").isNotNull() & F.col("now").isNull() & F.col("changed").isNotNull()
    return both.agg(F.count_if(written).alias("written"), F.count_if(deleted).alias("deleted"))


def history_problems(logs: DataFrame, current: Column, from_scn: Column, upto: Column) -> DataFrame:
    """Why the log files cannot tell all that happened after ``from_scn`` and up to ``upto``: ``kind``, ``thread``, ``low``, ``high``; no row if they can.

    ``logs``: ``thread``, ``sequence``, ``name``, ``first_scn``, ``next_scn`` (null: still
    written), ``archived``, ``deleted``, ``incarnation``; ``current`` is the incarnation's
    first position. ``reset``: the start lies before it; ``missing``: nothing is left that
    reaches back to the start; ``hole``: within a thread a file is missing or begins behind
    the end of the one before it (``low`` to ``high`` is not told); ``ends early``: a
    thread's files end before ``upto``; ``deleted``: a file of the window is gone and has no
    other copy. Only files of the current incarnation that are still there count, one for
    each sequence, archived before online.
    """
    inside = logs.where((F.col("next_scn").isNull() | (F.col("next_scn") > from_scn)) & (F.col("first_scn") <= upto) & (F.col("incarnation") == current))
    rank = F.struct(F.when(F.col("archived"), 0).otherwise(1).alias("rank"), "name", "first_scn", "next_scn")
    files = inside.where(~F.col("deleted")).groupBy("thread", "sequence").agg(F.min(rank).alias("f")).select("thread", "sequence", "f.first_scn", "f.next_scn")
    rows = ordered.previous(files, ["thread"], ["sequence"], ["sequence", "next_scn"])
    none = F.lit(None).cast("long")

    def problem(kind: str, thread: Column, low: Column, high: Column) -> list[Column]:
        return [F.lit(kind).alias("kind"), thread.cast("long").alias("thread"), low.cast("long").alias("low"), high.cast("long").alias("high")]

    hole = rows.where(F.col("before").isNotNull() & ((F.col("sequence") != F.col("before.sequence") + 1) | (F.col("first_scn") > F.col("before.next_scn"))))
    whole = files.agg(F.min("first_scn").alias("first"))
    ends = files.groupBy("thread").agg(F.max(F.coalesce("next_scn", F.lit(2**62))).alias("end"))
    gone = inside.where("deleted").groupBy("thread", "sequence").agg(F.min("first_scn").alias("first"), F.max("next_scn").alias("next")).join(files, ["thread", "sequence"], "left_anti")
    parts = [
        whole.where(from_scn < current).select(*problem("reset", none, from_scn, current)),
        whole.where(F.col("first").isNull() | (F.col("first") > from_scn + 1)).select(*problem("missing", none, from_scn + 1, F.coalesce("first", upto + 1))),
        hole.select(*problem("hole", F.col("thread"), F.col("before.next_scn"), F.col("first_scn"))),
        ends.where(F.col("end") <= upto).select(*problem("ends early", F.col("thread"), F.col("end"), upto + 1)),
        gone.select(*problem("deleted", F.col("thread"), F.col("first"), F.col("next"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
