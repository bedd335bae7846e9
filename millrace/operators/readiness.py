"""Whether a source and its tables are ready for change tracking, and the statements that make them so.

One row a check, so that a source of any number of tables is judged by joins and
one pre-aggregated group. A setting that is null could not be read and is not ready.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import values


def yes(c: Column, *others: str) -> Column:
    return F.coalesce(F.upper(c).isin("YES", *others), F.lit(False))


def key_logging(settings: DataFrame) -> Column:
    """Key columns are logged for the whole database, or for the pluggable one."""
    return yes(settings["key_logging"]) | yes(settings["pdb_key_logging"])


def setting_checks(settings: DataFrame) -> DataFrame:
    """``source``, ``item``, ``ok``, ``fix`` of each source's settings; forced logging is advice only, so it never fails.

    ``settings``: ``source``, ``log_mode``, ``minimal``, ``key_logging``, ``pdb_key_logging``, ``forced``.
    A fix is null where there is nothing to do.
    """
    archive = F.coalesce(F.upper("log_mode") == "ARCHIVELOG", F.lit(False))
    checks = (
        ("archived log", archive, archive, "ALTER DATABASE ARCHIVELOG;"),
        ("minimal logging", yes(F.col("minimal"), "IMPLICIT"), yes(F.col("minimal"), "IMPLICIT"), "ALTER DATABASE ADD SUPPLEMENTAL LOG DATA;"),
        ("key logging", key_logging(settings), key_logging(settings), "ALTER DATABASE ADD SUPPLEMENTAL LOG DATA (PRIMARY KEY) COLUMNS;"),
        ("forced logging", F.lit(True), yes(F.col("forced")), "ALTER DATABASE FORCE LOGGING;"),
    )
    items = [F.struct(F.lit(item).alias("item"), ok.alias("ok"), F.when(~done, fix).alias("fix")) for item, ok, done, fix in checks]
    return settings.select("source", F.explode(F.array(*items)).alias("check")).select("source", "check.*")


def table_checks(settings: DataFrame, tables: DataFrame, log_groups: DataFrame, user: str) -> DataFrame:
    """``source``, ``owner``, ``name``, ``ok``, ``problems``, ``fixes`` of each table.

    ``tables``: ``source``, ``owner``, ``name``, ``has_key``, ``unlogged_parts``, ``reads_back``,
    ``support``; ``log_groups``: ``source``, ``owner``, ``name``, ``kind``. A table of key logging of
    its own needs none of its database; one of a source that is not listed has none. A
    name that cannot be quoted is the only problem of its table. No statement makes a key
    or another column type, so these problems have no fix.
    """
    key = ["source", "owner", "name"]
    own = log_groups.where("kind = 'PRIMARY KEY LOGGING'").select(*key).distinct().withColumn("own_logging", F.lit(True))
    whole = settings.select("source", key_logging(settings).alias("logged"))
    t = tables.join(own, key, "left").join(whole, "source", "left")
    logged = F.coalesce("own_logging", F.lit(False)) | F.coalesce("logged", F.lit(False))
    full = F.concat(values.quoted(F.col("owner")), F.lit("."), values.quoted(F.col("name")))
    plain = F.coalesce(values.is_identifier(F.col("owner")) & values.is_identifier(F.col("name")), F.lit(False))
    rules = (
        (~F.coalesce("has_key", F.lit(False)), F.lit("no usable key"), F.lit(None).cast("string")),
        (~logged, F.lit("key columns are not logged"), F.concat(F.lit("ALTER TABLE "), full, F.lit(" ADD SUPPLEMENTAL LOG DATA (PRIMARY KEY) COLUMNS;"))),
        (F.coalesce(F.col("unlogged_parts") > 0, F.lit(False)), F.lit("writes may leave no history"), F.concat(F.lit("ALTER TABLE "), full, F.lit(" LOGGING;"))),
        (~F.coalesce("reads_back", F.lit(False)), F.lit("earlier moments cannot be read"), F.concat(F.lit("GRANT FLASHBACK ON "), full, F.lit(f" TO {user};"))),
        (F.coalesce(F.col("support") == "NONE", F.lit(False)), F.lit("history cannot describe its columns"), F.lit(None).cast("string")),
    )
    problems = F.array_compact(F.array(*[F.when(bad, text) for bad, text, _ in rules]))
    fixes = F.array_compact(F.array(*[F.when(bad, fix) for bad, _, fix in rules]))
    none = F.array().cast("array<string>")
    out = t.select(*key, F.when(plain, problems).otherwise(F.array(F.lit("its name cannot be quoted"))).alias("problems"), F.when(plain, fixes).otherwise(none).alias("fixes"))
    return out.select(*key, (F.size("problems") == 0).alias("ok"), "problems", "fixes")


def ready(settings: DataFrame, tables: DataFrame) -> DataFrame:
    """``source``, ``failed_items``, ``failed_tables``, ``ready``, from the two results above; a source without tables is judged by its settings."""
    a = settings.groupBy("source").agg(F.count_if(~F.col("ok")).alias("failed_items"))
    b = tables.groupBy("source").agg(F.count_if(~F.col("ok")).alias("failed_tables"))
    both = a.join(b, "source", "left").withColumn("failed_tables", F.coalesce("failed_tables", F.lit(0)))
    return both.withColumn("ready", (F.col("failed_items") == 0) & (F.col("failed_tables") == 0))

