"""What a scan of a source finds: tables to offer, enforced keys, online logs, and why a table's history may be incomplete.

Inputs are catalog tables. A flag that is null is not set; a figure that is null is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types whose values the change log gives back exactly.
KEY_TYPES = ("NUMBER", "VARCHAR2", "CHAR", "DATE", "RAW")
NUMERIC = ("NUMBER", "FLOAT", "BINARY_FLOAT", "BINARY_DOUBLE")


def unset(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit(False))


def offered_tables(tables: DataFrame, owner: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Tables that can be copied: not nested, dropped or temporary, and heap or index-only ones but not an overflow segment of these.

    ``tables``: ``owner``, ``name``, ``iot_type``, ``nested``, ``dropped``, ``temporary`` and more; ``wanted``: ``owner``,
    ``name`` of a targeted scan, names in any case. An ``owner`` is taken in upper case.
    """
    kept = tables.where(unset("nested") & unset("dropped") & unset("temporary") & (F.col("iot_type").isNull() | (F.col("iot_type") == "IOT")))
    if owner is not None:
        kept = kept.where(F.col("owner") == owner.upper())
    if wanted is not None:
        asked = wanted.select(F.upper("owner").alias("_o"), F.upper("name").alias("_n")).distinct()
        kept = kept.join(asked, (F.upper("owner") == F.col("_o")) & (F.upper("name") == F.col("_n")), "left_semi")
    return kept


def with_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Each table with its columns in order; a table without visible columns has none. ``columns``: ``owner``, ``name``, ``position``, ``column``, ``source_type``."""
    listed = columns.join(tables.select("owner", "name"), ["owner", "name"], "left_semi").groupBy("owner", "name").agg(F.sort_array(F.collect_list(F.struct("position", "column", "source_type"))).alias("columns"))
    return tables.join(listed, ["owner", "name"], "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<struct<position:bigint,column:string,source_type:string>>")))


def enforced_keys(tables: DataFrame, constraints: DataFrame, key_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """``table_id``, ``key``, ``split_by``, ``problem``: the primary key that the source enforces, or why there is none to rely on.

    ``constraints``: ``table_id``, ``constraint_id``, ``kind``, ``enabled``, ``validated``; ``key_columns``:
    ``constraint_id``, ``position``, ``column``; ``columns``: ``table_id``, ``column``, ``source_type``. ``split_by``
    is the column of a key of one numeric column: only that can be cut into ranges. A key column that
    the scan cannot see is not part of the key, as in the source's own views.
    """
    primary = constraints.where("kind = 'P'").select("table_id", "constraint_id", (F.col("enabled") & F.col("validated")).alias("enforced"))
    parts = primary.join(key_columns, "constraint_id").join(columns.select("table_id", "column", "source_type"), ["table_id", "column"])
    keys = parts.groupBy("table_id").agg(F.sort_array(F.collect_set(F.struct("position", "column", "source_type"))).alias("parts"), F.every("enforced").alias("enforced"))
    both = tables.select("table_id").distinct().join(keys, "table_id", "left")
    readable = F.forall("parts", lambda p: p["source_type"].isin(*KEY_TYPES))
    problem = F.when(F.col("parts").isNull(), "no primary key").when(~F.coalesce("enforced", F.lit(False)), "the key is not enforced").when(~readable, "a key column cannot be read from the history")
    single = F.when((F.size("parts") == 1) & F.col("parts")[0]["source_type"].isin(*NUMERIC), F.col("parts")[0]["column"])
    return both.select("table_id", F.array_join("parts.column", ",").alias("key"), single.alias("split_by"), problem.alias("problem"))


def online_logs(logs: DataFrame, files: DataFrame, low: Column, high: Column) -> DataFrame:
    """Online logs that hold positions from ``low`` to ``high``, each with its first member: ``thread``, ``sequence``, ``member``, ``first_scn``, ``next_scn``.

    ``logs``: ``group_id``, ``thread``, ``sequence``, ``first_scn``, ``next_scn``, ``status``; ``files``: ``group_id``, ``kind``,
    ``member``. The current log has no end yet. Members are reduced to one a group before the join.
    """
    needed = logs.where((F.col("first_scn") <= high) & ((F.col("next_scn") > low) | (F.col("status") == "CURRENT")))
    members = files.where("kind = 'ONLINE'").groupBy("group_id").agg(F.min("member").alias("member"))
    return needed.join(members, "group_id").groupBy("thread", "sequence", "first_scn", "next_scn").agg(F.min("member").alias("member"))


def unlogged_writes(tables: DataFrame, placements: DataFrame, files: DataFrame, forced: bool = False) -> DataFrame:
    """Tables in whose spaces something was written without logging since their last copy: ``table_id``, ``marked_at``.

    ``tables``: ``table_id``, ``from_scn``; ``placements``: ``table_id``, ``space`` of the table and its parts;
    ``files``: ``space``, ``unlogged_scn``. Where logging is forced there are none. Files are reduced to their
    space's last mark first.
    """
    if forced:
        return tables.select("table_id", F.lit(None).cast("long").alias("marked_at")).where("false")
    marks = files.groupBy("space").agg(F.max("unlogged_scn").alias("mark")).where("mark is not null")
    last = placements.select("table_id", "space").distinct().join(marks, "space").groupBy("table_id").agg(F.max("mark").alias("marked_at"))
    return tables.join(last, "table_id").where("marked_at > from_scn").select("table_id", "marked_at")


def stops(tables: DataFrame, drift: DataFrame, unlogged: DataFrame) -> DataFrame:
    """``table_id``, ``stopped``: the first reason to stop a table before its log is read, null if there is none; tables do not stop each other.

    ``drift``: ``table_id``, ``drift`` of its objects ("same", or what became of one); of several the first by name.
    """
    changed = drift.where("drift <> 'same'").groupBy("table_id").agg(F.min("drift").alias("drift"))
    both = tables.select("table_id").join(changed, "table_id", "left").join(unlogged, "table_id", "left")
    return both.select("table_id", F.when(F.col("drift").isNotNull(), F.col("drift")).when(F.col("marked_at").isNotNull(), "written without logging").alias("stopped"))


def present_key(columns: list[str], images: Column) -> Column:
    """The key in a record's JSON image as an array of texts, or null unless every key column is present; a column that is present may be null."""
    names = F.json_object_keys(images)
    here = F.lit(True)
    for c in columns:
        here = here & F.coalesce(F.array_contains(names, c), F.lit(False))
    return F.when(here, F.array(*[F.get_json_object(images, f"$['{c}']") for c in columns]))
