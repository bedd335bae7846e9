"""Catalog, change-log and run-state tables derived from the given tables, in Spark and as SQL CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table

TYPES = (
    "VARCHAR2", "NVARCHAR2", "CHAR", "CLOB", "NUMBER", "NUMBER", "NUMBER", "DATE", "TIMESTAMP", "TIMESTAMP(6) WITH TIME ZONE", "BLOB", "RAW",
    "BINARY_FLOAT", "FLOAT", "ROWID", "XMLTYPE", "INTERVAL DAY(2) TO SECOND(6)", "LONG", "BFILE", "SDO_GEOMETRY",
)
LIVE_TYPES = ("varchar(40)", "text", "char(10)", "smallint", "integer", "bigint", "numeric", "numeric(20,4)", "numeric(8,1)", "timestamp(0) without time zone",
              "timestamptz", "bytea", "real", "float8", "xml", "interval", "int4", "timestamp(3)", "jsonb", "varchar")


def listed(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def sql_listed(values: tuple[str, ...], index: str) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[CAST({index} AS INTEGER) + 1]"


def columns(spark: SparkSession, sf: str) -> DataFrame:
    """Source columns: a line of an order stands for a column of a table."""
    q = F.round("l_quantity").cast("int")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("position"),
        F.concat(F.when(F.col("l_suppkey") % 2 == 0, "COL_").otherwise("Col_"), F.col("l_linenumber").cast("string")).alias("name"),
        listed(TYPES, F.col("l_partkey") % len(TYPES)).alias("source_type"), (q * 3).alias("length"),
        F.when(F.col("l_suppkey") % 5 != 0, q % 39).alias("precision"), (F.col("l_suppkey") % 4).cast("int").alias("scale"),
        (F.col("l_returnflag") != "R").alias("nullable"), listed(LIVE_TYPES, F.col("l_suppkey") % len(LIVE_TYPES)).alias("live_type"),
    )


COLUMNS = f"""cols AS (
  SELECT l_orderkey AS table_id, l_linenumber AS position, CASE WHEN l_suppkey % 2 = 0 THEN 'COL_' ELSE 'Col_' END || l_linenumber AS name,
         {sql_listed(TYPES, f'l_partkey % {len(TYPES)}')} AS source_type, CAST(round(l_quantity) AS INTEGER) * 3 AS length,
         CASE WHEN l_suppkey % 5 <> 0 THEN CAST(round(l_quantity) AS INTEGER) % 39 END AS precision, CAST(l_suppkey % 4 AS INTEGER) AS scale,
         l_returnflag <> 'R' AS nullable, {sql_listed(LIVE_TYPES, f'l_suppkey % {len(LIVE_TYPES)}')} AS live_type
  FROM lineitem)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of table runs: an order stands for a chunk, its lines for the batches copied."""
    run = F.col("l_orderkey") % 97
    status = F.when((run % 3 == 0) & (F.col("l_orderkey") % 11 == 0), "Failed").when((run % 3 == 1) & (F.col("l_orderkey") % 11 < 2), "Pending").otherwise("Done")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.round("l_quantity").cast("long")).alias("rows"), F.sum(F.round("l_extendedprice").cast("long")).alias("bytes"), F.max("l_shipdate").alias("leased_until")
    ).select(F.col("l_orderkey").alias("chunk_id"), run.alias("run_id"), (run % 10).alias("job_id"), status.alias("status"), "rows", "bytes", "leased_until")


CHUNKS = """chunks AS (
  SELECT l_orderkey AS chunk_id, l_orderkey % 97 AS run_id, (l_orderkey % 97) % 10 AS job_id,
         CASE WHEN (l_orderkey % 97) % 3 = 0 AND l_orderkey % 11 = 0 THEN 'Failed'
              WHEN (l_orderkey % 97) % 3 = 1 AND l_orderkey % 11 < 2 THEN 'Pending' ELSE 'Done' END AS status,
         CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS rows, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes, max(l_shipdate) AS leased_until
  FROM lineitem GROUP BY l_orderkey)"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("user_id") % 50).alias("job_id"), F.col("ts").alias("sampled_at"), F.col("event_id").alias("total"))


SAMPLES = "samples AS (SELECT user_id % 50 AS job_id, ts AS sampled_at, event_id AS total FROM events)"


def change_source(spark: SparkSession, sf: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") * 1.1).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").where("o_orderkey % 11 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"))


def change_target(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderkey % 13 <> 0").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    ops = F.when(F.col("event_id") % 101 == 0, "DDL").when(F.col("event_id") % 103 == 0, "UNSUPPORTED").otherwise("UPDATE")
    key = F.when(F.col("event_id") % 17 != 0, F.expr("event_id div 3"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("scn"), (F.col("user_id") % 5).alias("table_id"), ops.alias("op"), (F.col("event_id") % 107 == 0).cast("int").alias("status"),
        key.alias("old_key"), F.when(F.col("event_id") % 19 == 0, F.expr("event_id div 3 + 1")).otherwise(key).alias("new_key"),
        F.when(F.col("event_id") % 34 == 0, F.col("user_id")).alias("address"),
    )


CDC = """src AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice * CAST(1.1 AS DOUBLE) ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0),
tgt AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 <> 0),
log AS (SELECT event_id AS scn, user_id % 5 AS table_id, CASE WHEN event_id % 101 = 0 THEN 'DDL' WHEN event_id % 103 = 0 THEN 'UNSUPPORTED' ELSE 'UPDATE' END AS op,
  CASE WHEN event_id % 107 = 0 THEN 1 ELSE 0 END AS status, CASE WHEN event_id % 17 <> 0 THEN event_id // 3 END AS old_key,
  CASE WHEN event_id % 19 = 0 THEN event_id // 3 + 1 WHEN event_id % 17 <> 0 THEN event_id // 3 END AS new_key, CASE WHEN event_id % 34 = 0 THEN user_id END AS address FROM events),
keys AS (SELECT DISTINCT event_id // 3 AS o_orderkey FROM events),
rws AS (SELECT s.* FROM src s SEMI JOIN keys k ON s.o_orderkey = k.o_orderkey)"""


def change_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.expr("event_id div 3").alias("o_orderkey")).distinct()
