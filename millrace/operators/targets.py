"""The destination's side of a copy: what is there, which keys an upsert may rely on, and the statements and messages about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import types, values

SYSTEM = r"^(pg_.*|information_schema)$"


def qualified(schema: Column, name: Column) -> Column:
    return F.concat(values.quoted(schema), F.lit("."), values.quoted(name))


def usable_schemas(schemas: DataFrame, privileges: DataFrame) -> DataFrame:
    """``schema``, ``can_create``: schemas that may be used and are not the system's own.

    ``privileges``: ``schema``, ``privilege`` of the user, repeated rows counting once.
    """
    held = privileges.groupBy("schema").agg(F.bool_or(F.col("privilege") == "USAGE").alias("usable"), F.bool_or(F.col("privilege") == "CREATE").alias("can_create"))
    return schemas.select("schema").distinct().where(~F.col("schema").rlike(SYSTEM)).join(held.where("usable"), "schema").select("schema", "can_create")


def listed_tables(classes: DataFrame, schema: str, fence: str) -> DataFrame:
    """Names of a schema's tables: plain and partitioned ones, but no partition of another and not the table ``fence`` of finished chunks."""
    return classes.where((F.col("schema") == schema) & F.col("kind").isin("r", "p") & ~F.col("is_partition") & (F.col("name") != fence)).select("name")


def arbiters(indexes: DataFrame, index_columns: DataFrame, wanted: DataFrame, table: list[str]) -> DataFrame:
    """The indexes that can arbitrate an upsert on exactly the wanted key, in any order of columns: ``table``, ``index_id``.

    ``indexes``: ``table``, ``index_id``, ``is_unique``, ``valid``, ``immediate``, ``partial``, ``expressions``;
    ``index_columns``: ``table``, ``index_id``, ``name``; ``wanted``: ``table``, ``name``. Names
    are matched one by one and counted, so that no list is compared: an index fits
    if all its names are wanted and it has as many as are.
    """
    key = [*table, "index_id"]
    fit = indexes.where("is_unique and valid and immediate and not partial and not expressions").select(*key).distinct()
    sought = wanted.select(*table, "name").distinct()
    number = sought.groupBy(*table).agg(F.count("*").alias("sought"))
    named = index_columns.select(*key, "name").distinct().join(fit, key, "left_semi").join(sought.withColumn("hit", F.lit(1)), [*table, "name"], "left")
    counted = named.groupBy(*key).agg(F.count("*").alias("names"), F.count("hit").alias("hits"))
    return counted.join(number, table).where("names = hits and hits = sought").select(*key)


def promotions(keys: DataFrame, tables: DataFrame, taken: DataFrame, most: int = 5) -> DataFrame:
    """What follows once a table has been settled: ``schema``, ``name``, ``refused`` or the two statements that make its key.

    ``keys``: ``schema``, ``name``, ``key`` (text), a row for each row of the target;
    ``tables``: ``schema``, ``name``, ``columns`` (quoted, comma-joined); ``taken``: ``schema``,
    ``relation``. Duplicate keys refuse the table, naming the first ``most`` of them. The
    key's name is the table's with ``_pkey``, in lower case and cut to 63 bytes, or
    its variant if that is taken; if both are, the table is refused.
    """
    at = ["schema", "name"]
    twice = keys.groupBy(*at, "key").agg(F.count("*").alias("n")).where("n > 1")
    first = twice.withColumn("place", F.row_number().over(Window.partitionBy(*at).orderBy("key"))).where(F.col("place") <= most)  # cut before the shuffle too
    examples = first.groupBy(*at).agg(F.array_join(F.sort_array(F.collect_list("key")), ", ").alias("examples"))
    candidates = F.array(*[F.struct(F.lit(i).alias("choice"), values.truncated63(F.lower(F.concat("name", F.lit(end)))).alias("relation")) for i, end in enumerate(("_pkey", "_m_pkey"))])
    asked = tables.select(*at, F.explode(candidates).alias("c")).select(*at, "c.choice", "c.relation")
    free = asked.join(taken.select("schema", "relation"), ["schema", "relation"], "left_anti").groupBy(*at).agg(F.min_by("relation", "choice").alias("relation"))
    out = tables.join(examples, at, "left").join(free, at, "left")
    refused = F.when(F.col("examples").isNotNull(), F.concat(F.lit("keys with more than one row: "), F.col("examples"))).when(F.col("relation").isNull(), "no free name for the key")
    whole, index = qualified(F.col("schema"), F.col("name")), values.quoted(F.col("relation"))
    build = F.concat(F.lit("CREATE UNIQUE INDEX CONCURRENTLY "), index, F.lit(" ON "), whole, F.lit(" ("), "columns", F.lit(")"))
    promote = F.concat(F.lit("ALTER TABLE "), whole, F.lit(" ADD CONSTRAINT "), index, F.lit(" PRIMARY KEY USING INDEX "), index)
    return out.select(*at, refused.alias("refused"), F.when(refused.isNull(), build).alias("build"), F.when(refused.isNull(), promote).alias("promote"))


def key_and_index_text(columns: DataFrame, indexes: DataFrame, lower: bool = True) -> DataFrame:
    """``schema``, ``name``, ``statement``: a primary key where a table has key columns left, and every index.

    ``columns``: ``schema``, ``name``, ``position``, ``column``, ``is_key``, ``excluded``; ``indexes``: ``schema``,
    ``name``, ``index``, ``is_unique``, ``columns`` (comma-joined). Names are made lower case if ``lower``.
    """
    style = F.lower if lower else (lambda c: F.col(c) if isinstance(c, str) else c)
    whole = qualified(F.col("schema"), F.col("name"))
    listed = columns.where("is_key and not excluded").groupBy("schema", "name").agg(F.sort_array(F.collect_list(F.struct("position", values.quoted(style("column")).alias("q")))).alias("all"))
    key = F.concat(F.lit("ALTER TABLE "), whole, F.lit(" ADD CONSTRAINT "), values.quoted(style(F.concat(F.lit("pk_"), "name"))), F.lit(" PRIMARY KEY ("), F.array_join("all.q", ", "), F.lit(");"))
    names = F.array_join(F.transform(F.split("columns", ","), lambda x: values.quoted(style(F.trim(x)))), ", ")
    kind = F.when(F.col("is_unique"), "UNIQUE INDEX ").otherwise("INDEX ")
    index = F.concat(F.lit("CREATE "), kind, values.quoted(style(F.concat(F.lit("idx_"), "name", F.lit("_"), "index"))), F.lit(" ON "), whole, F.lit(" ("), names, F.lit(");"))
    return listed.select("schema", "name", key.alias("statement")).unionByName(indexes.select("schema", "name", index.alias("statement")))


def collision_text(names: Column) -> Column:
    """Which names (sorted) become one: both, or all, in their own spelling."""
    return F.concat(F.array_join(F.transform(names, lambda n: F.concat(F.lit('"'), n, F.lit('"'))), " and "), F.lit(' would all be "'), F.lower(F.get(names, F.lit(0))), F.lit('"'))


def collision_message(names: DataFrame, table: list[str], column: str) -> DataFrame:
    """``table``, ``message``: every group of a table's names that differ by case alone."""
    folded = names.select(*table, column).distinct().groupBy(*table, F.lower(column).alias("folded")).agg(F.sort_array(F.collect_list(column)).alias("names")).where(F.size("names") > 1)
    listed = folded.groupBy(*table).agg(F.sort_array(F.collect_list(F.struct("folded", collision_text(F.col("names")).alias("text")))).alias("all"))
    return listed.select(*table, F.array_join("all.text", "; ").alias("message"))


def type_messages(columns: DataFrame, wanted: str = "want_type", live: str = "live_type") -> DataFrame:
    """Adds ``severity`` and ``message`` where a column's type does not fit; columns that fit go, as do those of only one side."""
    judged = types.with_compatibility(columns.where(F.col(wanted).isNotNull() & F.col(live).isNotNull()), wanted, live, "severity").where("severity <> 'ok'")
    return judged.withColumn("message", F.concat(F.lit('column "'), "name", F.lit('" needs '), wanted, F.lit(", the destination has "), live))


def selection(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """A new selection from what a scan found: every table included, with its figures and its columns in order.

    ``tables``: ``table_id``, ``name``, ``rows``, ``bytes``, ``is_estimate``, ``lob_bytes``; ``columns`` as
    for ``types.with_mapped_type``. A table has LOBs if its LOBs have bytes; unknown figures stay null; no
    column is a key or left out before someone says so.
    """
    one = F.struct("position", "name", "source_type", F.col("want_type").alias("target_type"), "nullable", F.lit(False).alias("is_key"), F.lit(False).alias("excluded"))
    listed = types.with_mapped_type(columns).groupBy("table_id").agg(F.sort_array(F.collect_list(one)).alias("columns"))
    lobs = F.coalesce(F.col("lob_bytes") > 0, F.lit(False))
    return tables.select("table_id", "name", F.lit(True).alias("included"), "rows", "bytes", "is_estimate", lobs.alias("has_lobs")).join(listed, "table_id", "left")


def foreign_keys(constraints: DataFrame) -> DataFrame:
    """``child``, ``parent``: tables joined by a foreign key, each pair once, a table's references to itself left out.

    ``constraints``: ``constraint_id``, ``table_id``, ``kind`` (``R`` refers to ``refers_to``, a key's ``constraint_id``).
    """
    refs = constraints.where("kind = 'R'").select(F.col("table_id").alias("child"), "refers_to")
    keys = constraints.where("kind in ('P', 'U')").select(F.col("constraint_id").alias("refers_to"), F.col("table_id").alias("parent"))
    return refs.join(keys, "refers_to").where("child <> parent").select("child", "parent").distinct()
