"""Lookups between catalog lists, change records and saved keys: all equi-joins on DataFrames of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def live_columns(df: DataFrame) -> DataFrame:
    """A table's columns as rows: ``name``, ``position``, ``type``, and how many of its ``rows`` are ``nulls`` there."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"n{i}") for i, f in enumerate(df.schema.fields)])
    each = [F.struct(F.lit(f.name).alias("name"), F.lit(i + 1).alias("position"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("nulls")) for i, f in enumerate(df.schema.fields)]
    return counts.select("rows", F.explode(F.array(*each)).alias("c")).select("c.name", "c.position", "c.type", "rows", "c.nulls")


def existing(names: DataFrame, live: DataFrame, name: str) -> DataFrame:
    """The asked names and whether each is live; names are compared as they are spelt."""
    return names.select(name).distinct().join(live.select(name).distinct().withColumn("here", F.lit(True)), name, "left").select(name, F.coalesce("here", F.lit(False)).alias("present"))


def restore_order(constraints: DataFrame, present: DataFrame, table: str, name: str) -> DataFrame:
    """Constraints not there yet with their ``step``: primary key, unique, check, foreign key, then those of other tables."""
    step = constraint_step(F.col("kind"), F.col("inbound"))
    return constraints.join(present.select(table, name).distinct(), [table, name], "left_anti").withColumn("step", step)


def constraint_step(kind: Column, inbound: Column) -> Column:
    """The order in which constraints come back."""
    return F.when(inbound, 5).when(kind == "p", 1).when(kind == "u", 2).when(kind == "c", 3).otherwise(4)


def duplicate_names(names: DataFrame, scope: list[str], name: str) -> DataFrame:
    """Names that stand more than once in their scope when case is ignored."""
    return names.groupBy(*scope, F.lower(name).alias("folded")).agg(F.count("*").alias("n")).where("n > 1")


def listed_names(pasted: DataFrame, key: str, text: str) -> DataFrame:
    """A pasted list: parts between commas and line ends, trimmed, blanks dropped."""
    parts = pasted.select(key, F.explode(F.split(text, r"[\n,]")).alias("part"))
    return parts.select(key, F.trim("part").alias("name")).where("name <> ''")


def lob_sizes(lobs: DataFrame, segments: DataFrame, segment: str, table: str) -> DataFrame:
    """Bytes of the segments behind each table's large-object columns."""
    sizes = segments.groupBy(segment).agg(F.sum("bytes").alias("bytes"))
    return lobs.select(table, segment).distinct().join(sizes, segment).groupBy(table).agg(F.sum("bytes").alias("lob_bytes"))


def record_tables(records: DataFrame, tables: DataFrame) -> DataFrame:
    """Adds ``table_id`` to change records: by ``owner`` and ``name``, else by ``object_id``; null if neither is known."""
    by_name = tables.select("owner", "name", F.col("table_id").alias("named"))
    by_id = tables.select("object_id", F.col("table_id").alias("numbered"))
    both = records.join(by_name, ["owner", "name"], "left").join(by_id, "object_id", "left")
    return both.withColumn("table_id", F.coalesce("named", "numbered")).drop("named", "numbered")


def keys_at(addresses: DataFrame, snapshot: DataFrame, address: str, keys: list[str]) -> DataFrame:
    """Keys of the snapshot's rows at the addresses of records without a key; an address without a row has none."""
    return snapshot.join(addresses.select(address).where(F.col(address).isNotNull()).distinct(), address, "left_semi").select(*keys).distinct()


def open_transactions(transactions: DataFrame, sessions: DataFrame | None, on: list[str]) -> DataFrame:
    """Open transactions with the session behind each; without a session list, or a session, its columns are null."""
    if sessions is None:
        return transactions.withColumns({"user_name": F.lit(None).cast("string"), "program": F.lit(None).cast("string")})
    return transactions.join(sessions.select(*on, "user_name", "program"), on, "left")


def full_key(parts: list[Column]) -> Column:
    """The texts of all key parts, or null: a key with a part that is missing names no row."""
    whole = parts[0].isNotNull()
    for p in parts[1:]:
        whole = whole & p.isNotNull()
    return F.when(whole, F.array(*parts))


def mined_value(images: Column, slots: dict[str, list[str]], table: Column, slot: int) -> Column:
    """The value of a key slot in a record's JSON image; which column it is depends on the table."""
    out = F.lit(None).cast("string")
    for name, columns in slots.items():
        if slot < len(columns):
            out = F.when(table == name, F.get_json_object(images, f"$.{columns[slot]}")).otherwise(out)
    return out


def typed_key(text: Column, kind: T.DataType) -> Column:
    """A key part parsed back from its text: numbers exact, dates to the second, binary from hex, other text as it is."""
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast(kind)
    return text.try_cast(kind)


def rows_of_keys(target: DataFrame, key_texts: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows named by composite keys in text form (``part_0``, ``part_1``, ...), matched in the target's own types.

    A key with a null or unreadable part names no row.
    """
    typed = key_texts.select(*[typed_key(F.col(f"part_{i}"), target.schema[k].dataType).alias(k) for i, k in enumerate(keys)]).dropna().distinct()
    return target.join(typed, keys, "left_semi")


def listed_problems(problems: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """One message for each table: the first blocking problems by name, and how many more there are."""
    listed = problems.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("name", "verdict"))).alias("all"))
    lines = F.transform(F.slice("all", 1, most), lambda p: F.concat(F.lit("  - column "), p["name"], F.lit(": "), p["verdict"]))
    more = F.size("all") - most
    tail = F.when(more > 0, F.array(F.concat(F.lit("  ...and "), more.cast("string"), F.lit(" more.")))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.concat(F.size("all").cast("string"), F.when(F.size("all") == 1, " incompatibility:").otherwise(" incompatibilities:")))
    return listed.select(*keys, F.array_join(F.concat(head, lines, tail), "\n").alias("message"))


def mining_mode(multitenant: Column, container: Column, version: Column) -> Column:
    """How the source's change log can be read; an unknown layout or the root container cannot."""
    return (
        F.when(multitenant.isNull(), "unsupported").when(~multitenant, "log files").when(container == "CDB$ROOT", "unsupported")
        .when(version >= 21, "pluggable database").otherwise("unsupported")
    )


def tracker_state(settled: Column, history_lost: Column) -> Column:
    """What a tracked table needs next."""
    return F.when(history_lost, "needs_bulk_copy").when(settled, "ready").otherwise("needs_first_sync")


def allocated_names(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """Names after runs have asked for theirs: ``name``, ``run_id``, ``status``, ``action``, each name once.

    ``wanted``: ``run_id``, ``base_name``; ``held``: ``name``, ``run_id``, ``status``. A name is
    the base name in lower case without blanks around it. A name that is held goes to the
    run that asks (of several, the last by ``run_id``), which gives up any other; names of
    runs that do not ask stay. Asking again changes nothing.
    """
    asked = wanted.select(F.lower(F.trim("base_name")).alias("name"), "run_id").where("name <> ''").groupBy("name").agg(F.max("run_id").alias("run_id"))
    runs = asked.select(F.col("run_id").alias("asking")).distinct()
    by_name = held.select("name", F.col("run_id").alias("holder"), F.col("status").alias("was"))
    by_run = held.groupBy(F.col("run_id").alias("asking")).agg(F.min("name").alias("other"))
    new = asked.join(by_name, "name", "left").join(by_run, F.col("run_id") == F.col("asking"), "left")
    action = F.when(F.col("holder") == F.col("run_id"), "kept").when(F.col("was").isNotNull(), "rebound").when(F.col("other").isNotNull(), "moved").otherwise("new")
    taken = new.select("name", "run_id", F.lit("reserved").alias("status"), action.alias("action"))
    rest = held.join(asked.select("name"), "name", "left_anti").join(runs, F.col("run_id") == F.col("asking"), "left_anti")
    return taken.unionByName(rest.select("name", "run_id", "status", F.lit("untouched").alias("action")))
