"""What has to be done to a destination before a bulk copy, compiled for all tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import lookups, schema

BLOCKING = ("block", "missing", "missing, spelt otherwise", "extra and required")


def resolved(tables: DataFrame, live: DataFrame) -> DataFrame:
    """Adds ``target_name`` and ``present``: the lower-case name if it is there or nothing is, the source's spelling if only that is.

    ``tables``: ``table_id``, ``name``; ``live``: ``live_name``.
    """
    lower = live.select(F.col("live_name").alias("low_name")).distinct()
    other = live.select(F.col("live_name").alias("same_name")).distinct()
    both = tables.join(lower, F.lower("name") == F.col("low_name"), "left").join(other, F.col("name") == F.col("same_name"), "left")
    own = F.col("low_name").isNull() & F.col("same_name").isNotNull()
    return both.select(*tables.columns, F.when(own, F.col("name")).otherwise(F.lower("name")).alias("target_name"), (F.col("low_name").isNotNull() | F.col("same_name").isNotNull()).alias("present"))


def refusals(tables: DataFrame, names: DataFrame, columns: DataFrame, live_columns: DataFrame) -> DataFrame:
    """``table_id``, ``reason``: the first thing that keeps a table from being prepared.

    Columns (``names``: ``table_id``, ``name`` of the source) that are one when lower-cased
    come before anything in the destination; then the first column, by name, that a table
    already there cannot take. ``columns`` and ``live_columns`` as in ``schema_diff``.
    """
    taken = lookups.duplicate_names(names.select("table_id", "name").distinct(), ["table_id"], "name").groupBy("table_id").agg(F.min("folded").alias("folded"))
    clash = taken.select("table_id", F.lit(1).alias("rank"), F.concat(F.lit("columns differ only in case: "), F.col("folded")).alias("reason"))
    here = tables.where("present").select("table_id")
    found = schema.schema_diff(columns.join(here, "table_id", "left_semi"), live_columns.join(here, "table_id", "left_semi"), ["table_id"]).where(F.col("verdict").isin(*BLOCKING))
    first = found.groupBy("table_id").agg(F.min(F.struct("name", "verdict")).alias("p"))
    unfit = first.select("table_id", F.lit(2).alias("rank"), F.concat(F.lit("column "), F.col("p.name"), F.lit(": "), F.col("p.verdict")).alias("reason"))
    both = clash.unionByName(unfit).join(tables.select("table_id"), "table_id", "left_semi")
    return both.groupBy("table_id").agg(F.min(F.struct("rank", "reason")).alias("r")).select("table_id", "r.reason")


def prepared(tables: DataFrame, refused: DataFrame, constraints: DataFrame) -> DataFrame:
    """The steps of every table in order: ``table_id``, ``step`` (from 1), ``action``, ``detail``.

    A refused table has one step and nothing of it is touched. A new table is created.
    One that is there loses its constraints (those of other tables first, then foreign
    keys, checks, unique keys, the primary key), is emptied, and is left as it is
    otherwise. Then it is planned, loaded, validated, and its constraints come back in
    the opposite order. ``tables``: ``table_id``, ``target_name``, ``present``, ``strategy``;
    ``constraints``: ``table_id``, ``name``, ``kind``, ``inbound``.
    """
    judged = tables.join(refused, "table_id", "left")
    stop = judged.where("reason is not null").select("table_id", F.lit(0).alias("major"), F.lit(0).alias("minor"), F.lit("").alias("by"), F.lit("refuse").alias("action"), F.col("reason").alias("detail"))
    go = judged.where("reason is null")

    def steps(rows: DataFrame, *some: tuple) -> DataFrame:
        each = [F.struct(F.lit(major).alias("major"), F.lit(action).alias("action"), detail.alias("detail")) for major, action, detail in some]
        return rows.select("table_id", F.explode(F.array(*each)).alias("s")).select("table_id", "s.major", F.lit(0).alias("minor"), F.lit("").alias("by"), "s.action", "s.detail")

    name = F.col("target_name")
    out = stop.unionByName(steps(go.where("not present"), (1, "create", name)))
    out = out.unionByName(steps(go.where("present"), (1, "snapshot", name), (3, "truncate", name)))
    out = out.unionByName(steps(go, (4, "plan", F.col("strategy")), (5, "load", name), (6, "validate", name)))
    order = lookups.constraint_step(F.col("kind"), F.col("inbound"))
    held = constraints.join(go.where("present").select("table_id"), "table_id", "left_semi").select("table_id", F.col("name").cast("string").alias("by"), order.alias("minor"))
    for major, sign, action in ((2, -1, "drop constraint"), (7, 1, "restore constraint")):
        out = out.unionByName(held.select("table_id", F.lit(major).alias("major"), (F.col("minor") * sign).alias("minor"), "by", F.lit(action).alias("action"), F.col("by").alias("detail")))
    # a table's own steps: bounded by its constraints
    listed = out.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("major", "minor", "by", "action", "detail"))).alias("all"))
    return listed.select("table_id", F.posexplode("all").alias("place", "s")).select("table_id", (F.col("place") + 1).alias("step"), "s.action", "s.detail")
