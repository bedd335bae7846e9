"""Registered queries on stored tables: merge-on-read, rows as of a position, log coverage, shared block targets, replayed states, names, documents, footers and prepared copies."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import documents, values
from millrace.operators import cdc, copying, lookups, ordered, planning, prepare
from millrace.plans import catalogue as c
from millrace.plans import derived as d
from millrace.plans import more
from millrace.plans.catalogue import query
from millrace.sources import footers, store
from millrace.sources.checkpoints import checkpoint_dir
from millrace.sources.tables import table
from millrace.streaming import tables as streams


def scratch(s: SparkSession) -> str:
    return f"{checkpoint_dir(s).rstrip('/')}/millrace-{uuid.uuid4().hex}"


# --- merge-on-read -----------------------------------------------------------

BATCHES = 3
KEYS = ["o_orderkey"]


def batch_keys(s: SparkSession, sf: str, batch: int) -> DataFrame:
    return table(s, sf, "events").where((F.expr("event_id div 3") % (batch + 2)) == 0).select(F.expr("event_id div 3").alias("o_orderkey"))


def batch_rows(s: SparkSession, sf: str, batch: int) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + batch).otherwise(F.col("o_totalprice"))
    return table(s, sf, "orders").where(F.col("o_orderkey") % (10 + batch) != 0).select("o_orderkey", "o_custkey", "o_orderstatus", price.alias("o_totalprice"))


def stored(s: SparkSession, sf: str) -> str:
    """A store after three batches of changes, compacted behind the second."""
    path = scratch(s)
    store.create(s, path, d.change_target(s, sf), KEYS, 100)
    for batch in range(BATCHES):
        store.apply(s, path, batch, batch_keys(s, sf, batch), batch_rows(s, sf, batch), KEYS, 200 + batch)
        if batch == 1:
            store.compact(s, path, KEYS)
    return path


def state_sql(batch: int) -> str:
    """The table after each batch up to ``batch``, as CTEs t_-1 (named ``t0``), ``t1``, ..."""
    out = ["t0 AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 13 <> 0)"]
    for b in range(batch + 1):
        out.append(f"k{b} AS (SELECT DISTINCT event_id // 3 AS o_orderkey FROM events WHERE (event_id // 3) % {b + 2} = 0)")
        out.append(
            f"s{b} AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + {b} ELSE o_totalprice END AS o_totalprice FROM orders SEMI JOIN k{b} USING (o_orderkey) WHERE o_orderkey % {10 + b} <> 0)"
        )
        out.append(f"t{b + 1} AS (SELECT * FROM t{b} ANTI JOIN k{b} USING (o_orderkey) UNION ALL SELECT * FROM s{b})")
    return ", ".join(out)


@query(f"WITH {state_sql(2)} SELECT * FROM t3")
def q_store_rows(s: SparkSession, sf: str) -> DataFrame:
    """A table read over its base and the deltas of three batches."""
    return store.read(s, stored(s, sf), KEYS)


@query(f"WITH {state_sql(0)} SELECT * FROM t1")
def q_store_as_of(s: SparkSession, sf: str) -> DataFrame:
    """The same table as it was at the position of its first batch, though it has been compacted since."""
    path = stored(s, sf)
    return store.read(s, path, KEYS, store.batch_at(s, path, 200))


def count_sql(b: int) -> str:
    return f"""SELECT CAST({b} AS INTEGER) AS batch, count(*) FILTER (WHERE n.o_orderkey IS NOT NULL AND (o.o_custkey, o.o_orderstatus, o.o_totalprice) IS DISTINCT FROM (n.o_custkey, n.o_orderstatus, n.o_totalprice)) AS written,
 count(*) FILTER (WHERE n.o_orderkey IS NULL) AS deleted FROM (SELECT * FROM t{b} SEMI JOIN k{b} USING (o_orderkey)) o FULL JOIN s{b} n ON o.o_orderkey = n.o_orderkey"""


@query(f"WITH {state_sql(2)} {' UNION ALL '.join(map(count_sql, range(BATCHES)))}")
def q_store_counts(s: SparkSession, sf: str) -> DataFrame:
    """What each batch wrote: rows that differ, and keys whose row is gone."""
    return store.commits(s, stored(s, sf)).where("batch >= 0").select("batch", "written", "deleted")


@query(f"WITH {state_sql(1)}, h AS (SELECT *, 100 AS valid_from FROM t0 UNION ALL SELECT *, 200 FROM t1 EXCEPT SELECT *, 200 FROM t0) SELECT count(*) AS versions, count(DISTINCT o_orderkey) AS keys FROM h")
def q_store_versions(s: SparkSession, sf: str) -> DataFrame:
    """Versions of rows held after one batch."""
    path = scratch(s)
    store.create(s, path, d.change_target(s, sf), KEYS, 100)
    store.apply(s, path, 0, batch_keys(s, sf, 0), batch_rows(s, sf, 0), KEYS, 200)
    return store.history(s, path, KEYS).agg(F.count("*").alias("versions"), F.count_distinct("o_orderkey").alias("keys"))


IMAGES = "img AS (SELECT user_id AS id, event_id AS position, CASE WHEN event_type = 'view' THEN 'gone' ELSE 'put' END AS op, value, user_id % 5 AS table_id FROM events)"


def images(s: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "gone").otherwise("put")
    return table(s, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("position"), op.alias("op"), "value", (F.col("user_id") % 5).alias("table_id"))


@query(f"""WITH {IMAGES}, v AS (SELECT *, lead(position) OVER (PARTITION BY id ORDER BY position) AS valid_to FROM img), m AS (SELECT max(position) AS m FROM img)
SELECT id, value, table_id FROM v, m WHERE op = 'put' AND position <= m // 2 + table_id * 20 AND (valid_to IS NULL OR valid_to > m // 2 + table_id * 20) AND id % 3 <> 0 AND value > 10""")
def q_reread_as_of(s: SparkSession, sf: str) -> DataFrame:
    """Rows of changed keys as of each table's own position, under a row filter."""
    changes = images(s, sf)
    versions = store.validity(changes, ["id"], "position")
    keys = changes.where("id % 3 <> 0").select("id")
    half = changes.agg(F.floor(F.max("position") / 2)).scalar()
    return store.reread_as_of(versions, keys, ["id"], half + F.col("table_id") * 20, F.col("value") > 10)


@query(f"""WITH {d.CDC}, {c.TABLES}, l AS (SELECT scn, table_id, CASE WHEN table_id = 3 THEN op ELSE 'UPDATE' END AS op, old_key, new_key, address FROM log),
stopped AS (SELECT DISTINCT table_id FROM l JOIN tabs USING (table_id) WHERE scn > from_scn AND op <> 'UPDATE')
SELECT DISTINCT table_id, key FROM (SELECT table_id, scn, old_key AS key FROM l UNION ALL SELECT table_id, scn, new_key FROM l) JOIN tabs USING (table_id) WHERE scn > from_scn AND key IS NOT NULL AND table_id NOT IN (SELECT table_id FROM stopped)""")
def q_stream_keys(s: SparkSession, sf: str) -> DataFrame:
    """Keys mined by a stream whose state is each table's own point; a table with a change of structure is stopped, the others are not."""
    path = scratch(s)
    k = F.col("table_id")
    log = d.change_log(s, sf).select("scn", k, F.when(k == 3, F.col("op")).otherwise("UPDATE").alias("op"), F.lit(0).alias("status"), *[streams.key_text([F.col(x)]).alias(x) for x in ("old_key", "new_key")], F.lit("a").alias("address"))
    log.write.parquet(f"{path}/log")
    # a row a table
    starts = {r.table_id: r.from_scn for r in c.log_tables(s, sf).select("table_id", "from_scn").collect()}
    found = streams.mined(s.readStream.schema(log.schema).parquet(f"{path}/log"), starts)
    found.writeStream.format("parquet").option("path", f"{path}/keys").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    keys = s.read.schema(found.schema).parquet(f"{path}/keys").select("table_id", F.explode("keys").alias("key"))
    return keys.select("table_id", F.from_json("key", "array<string>")[0].cast("long").alias("key")).distinct()


# --- log coverage ------------------------------------------------------------

FILES = """files AS (SELECT user_id % 4 AS thread, event_id // 20 AS sequence, 'f' || event_id AS name, event_id // 20 * 20 AS first_scn, CASE WHEN event_id // 20 < (SELECT max(event_id) // 20 FROM events) THEN event_id // 20 * 20 + CASE WHEN event_id // 20 % 50 = 9 THEN 15 ELSE 20 END END AS next_scn,
 event_id % 2 = 0 AS archived, event_id // 20 % 13 = 5 AS deleted, CASE WHEN event_id < 200 THEN 0 ELSE 200 END AS incarnation FROM events)"""


def log_files(s: SparkSession, sf: str) -> DataFrame:
    events = table(s, sf, "events")
    n = F.expr("event_id div 20")
    last = events.agg(F.expr("max(event_id) div 20")).scalar()
    return events.select(
        (F.col("user_id") % 4).alias("thread"), n.alias("sequence"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"), (n * 20).alias("first_scn"),
        F.when(n < last, n * 20 + F.when(n % 50 == 9, 15).otherwise(20)).alias("next_scn"), (F.col("event_id") % 2 == 0).alias("archived"), (n % 13 == 5).alias("deleted"),
        F.when(F.col("event_id") < 200, 0).otherwise(200).alias("incarnation"),
    )


@query(f"""WITH {FILES}, w AS (SELECT 150 AS f, (SELECT max(event_id) - 30 FROM events) AS u), i AS (SELECT files.* FROM files, w WHERE (next_scn IS NULL OR next_scn > f) AND first_scn <= u AND incarnation = 200),
b AS (SELECT thread, sequence, first_scn, next_scn FROM (SELECT *, row_number() OVER (PARTITION BY thread, sequence ORDER BY archived DESC, name, first_scn, next_scn) AS r FROM i WHERE NOT deleted) WHERE r = 1),
p AS (SELECT *, lag(sequence) OVER x AS before, lag(next_scn) OVER x AS ended FROM b WINDOW x AS (PARTITION BY thread ORDER BY sequence))
SELECT 'reset' AS kind, CAST(NULL AS BIGINT) AS thread, CAST(f AS BIGINT) AS low, CAST(200 AS BIGINT) AS high FROM w WHERE f < 200
UNION ALL SELECT 'missing', NULL, f + 1, coalesce((SELECT min(first_scn) FROM b), u + 1) FROM w WHERE coalesce((SELECT min(first_scn) FROM b) > f + 1, true)
UNION ALL SELECT 'hole', thread, ended, first_scn FROM p WHERE sequence <> before + 1 OR first_scn > ended
UNION ALL SELECT 'ends early', thread, max(coalesce(next_scn, 4611686018427387904)), any_value(u) + 1 FROM b, w GROUP BY thread HAVING max(coalesce(next_scn, 4611686018427387904)) <= any_value(u)
UNION ALL SELECT 'deleted', thread, min(first_scn), max(next_scn) FROM i WHERE deleted AND (thread, sequence) NOT IN (SELECT (thread, sequence) FROM b) GROUP BY thread, sequence""")
def q_history_problems(s: SparkSession, sf: str) -> DataFrame:
    """What the log files of the current incarnation do not tell, thread by thread."""
    upto = table(s, sf, "events").agg(F.max("event_id") - 30).scalar()
    return cdc.history_problems(log_files(s, sf), F.lit(200), F.lit(150), upto)


# --- plans -------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT l_suppkey % 20 AS object_id, l_returnflag AS part, l_orderkey * 8 + l_linenumber AS position, CAST(round(l_quantity) AS BIGINT) AS blocks FROM lineitem WHERE l_suppkey % 20 <> 7),
t AS (SELECT object_id, ceil(sum(blocks) / 16.0) AS target FROM e GROUP BY 1), x AS (SELECT e.*, row_number() OVER (PARTITION BY object_id, part ORDER BY position, blocks) AS r, target FROM e JOIN t USING (object_id)),
f AS (SELECT object_id, part, r, position, 0 AS chunk, blocks AS held, target FROM x WHERE r = 1
 UNION ALL SELECT x.object_id, x.part, x.r, x.position, CASE WHEN f.held >= f.target THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.held >= f.target THEN x.blocks ELSE f.held + x.blocks END, x.target FROM f JOIN x ON x.object_id = f.object_id AND x.part = f.part AND x.r = f.r + 1)
SELECT object_id, part, chunk, min(position) AS first, max(position) AS last, max(held) AS blocks FROM f GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT l_suppkey % 20, l_returnflag, 0, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM lineitem WHERE l_suppkey % 20 = 7""")
def q_partition_chunks(s: SparkSession, sf: str) -> DataFrame:
    """Chunks of partitioned tables under one block target for each table; partitions without extents are read whole."""
    lines = table(s, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("object_id"), F.col("l_returnflag").alias("part"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), F.round("l_quantity").cast("long").alias("blocks"))
    return planning.partition_chunks(lines, lines.where("object_id <> 7"), "object_id", "part", 16)


@query(f"""WITH {c.NTILE}, r AS (SELECT bucket - 1 AS chunk, lag(bound) OVER (ORDER BY bucket) AS low, CASE WHEN bucket = max(bucket) OVER () THEN NULL ELSE bound END AS high FROM b)
SELECT chunk, count(*) AS source_rows, count(*) AS target_rows, true AS passed FROM orders JOIN r ON (low IS NULL OR o_orderkey > low) AND (high IS NULL OR o_orderkey <= high) WHERE o_orderstatus <> 'P' GROUP BY chunk""")
def q_copied_chunks(s: SparkSession, sf: str) -> DataFrame:
    """A whole copy in chunks, written, read back and validated chunk by chunk."""
    orders = table(s, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return copying.copy_table(orders, scratch(s), "o_orderkey", 12, {"o_totalprice": "decimal(12,2)"}, "o_orderstatus <> 'P'")


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'purchase' AND value > 50")
def q_partition_folder(s: SparkSession, sf: str) -> DataFrame:
    """One partition of a table stored by partition: only its folder is read."""
    path = scratch(s)
    table(s, sf, "events").write.partitionBy("event_type").parquet(path)
    return s.read.parquet(path).where((F.col("event_type") == "purchase") & (F.col("value") > 50)).select("event_id", "ts", "value")


STATES = ("Pending", "Queued", "Running", "Done", "Failed")
MOVES = f"""m AS (SELECT user_id % 50 AS chunk_id, event_id AS moved_at, {d.sql_listed(STATES, "event_id % 3 + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END")} AS expected, {d.sql_listed(STATES, "(event_id % 3 + 1 + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END) % 5")} AS next FROM events)"""


@query(f"""WITH RECURSIVE {MOVES}, x AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY moved_at) AS r FROM m),
f AS (SELECT chunk_id, moved_at, r, 'Pending' AS state_before, expected, next FROM x WHERE r = 1 UNION ALL SELECT x.chunk_id, x.moved_at, x.r, CASE WHEN f.expected = f.state_before THEN f.next ELSE f.state_before END, x.expected, x.next FROM f JOIN x ON x.chunk_id = f.chunk_id AND x.r = f.r + 1)
SELECT chunk_id, moved_at, expected, next, state_before, expected = state_before AS accepted FROM f""")
def q_transitions(s: SparkSession, sf: str) -> DataFrame:
    """State changes of chunks, each accepted only where the state is the one it expects."""
    e = F.col("event_id")
    expected = d.listed(STATES, e % 3 + F.when(e % 7 == 0, 1).otherwise(0))
    to = d.listed(STATES, (e % 3 + 1 + F.when(e % 5 == 0, 2).otherwise(0)) % 5)
    moves = table(s, sf, "events").select((F.col("user_id") % 50).alias("chunk_id"), e.alias("moved_at"), expected.alias("expected"), to.alias("next"))
    return ordered.replayed(moves, ["chunk_id"], ["moved_at"], "expected", "next", list(STATES), "Pending")


@query("""WITH w AS (SELECT lower(trim(p_name)) AS name, max(p_partkey) AS run_id FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
h AS (SELECT lower(p_name) AS name, max(p_partkey) AS run_id, 'created' AS status FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT w.name, w.run_id, 'reserved' AS status, CASE WHEN h.run_id = w.run_id THEN 'kept' WHEN h.run_id IS NOT NULL THEN 'rebound' WHEN o.run_id IS NOT NULL THEN 'moved' ELSE 'new' END AS action
FROM w LEFT JOIN h USING (name) LEFT JOIN h o ON o.run_id = w.run_id
UNION ALL SELECT name, run_id, status, 'untouched' FROM h WHERE name NOT IN (SELECT name FROM w) AND run_id NOT IN (SELECT run_id FROM w)""")
def q_allocated_names(s: SparkSession, sf: str) -> DataFrame:
    """Target names after runs have asked for them: each name has one run, a rerun keeps or takes over its name."""
    part = table(s, sf, "part")
    held = part.where("p_partkey % 2 = 0").groupBy(F.lower("p_name").alias("name")).agg(F.max("p_partkey").alias("run_id")).withColumn("status", F.lit("created"))
    return lookups.allocated_names(part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("run_id"), F.concat(F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("base_name")), held)


@query(f"""WITH tabs AS (SELECT c_custkey AS table_id, CASE WHEN c_custkey % 2 = 0 THEN 'Tab_' ELSE 'TAB_' END || c_custkey AS name, {more.STRATEGY} AS strategy FROM customer),
res AS (SELECT table_id, strategy, CASE WHEN table_id % 3 = 1 THEN name ELSE lower(name) END AS target_name, table_id % 3 < 2 AS present FROM tabs),
{c.DIFF}, {c.KINDS}, small AS (SELECT DISTINCT table_id, name FROM cols),
taken AS (SELECT table_id, min(folded) AS folded FROM (SELECT table_id, lower(name) AS folded FROM small GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1),
unfit AS (SELECT table_id, min_by('column ' || name || ': ' || verdict, (name, verdict)) AS reason FROM diff WHERE verdict IN ('block', 'missing', 'missing, spelt otherwise', 'extra and required') AND table_id IN (SELECT table_id FROM res WHERE present) GROUP BY 1),
refused AS (SELECT table_id, coalesce('columns differ only in case: ' || folded, reason) AS reason FROM taken FULL JOIN unfit USING (table_id)),
go AS (SELECT * FROM res ANTI JOIN refused USING (table_id)), ks AS (SELECT k.table_id, CAST(name AS VARCHAR) AS name, CASE WHEN inbound THEN 5 WHEN kind = 'p' THEN 1 WHEN kind = 'u' THEN 2 WHEN kind = 'c' THEN 3 ELSE 4 END AS step FROM kinds k SEMI JOIN (SELECT * FROM go WHERE present) USING (table_id)),
steps AS (SELECT table_id, 0 AS major, 0 AS minor, '' AS b, 'refuse' AS action, reason AS detail FROM refused SEMI JOIN res USING (table_id)
 UNION ALL SELECT table_id, 1, 0, '', CASE WHEN present THEN 'snapshot' ELSE 'create' END, target_name FROM go UNION ALL SELECT table_id, 2, -step, name, 'drop constraint', name FROM ks
 UNION ALL SELECT table_id, 3, 0, '', 'truncate', target_name FROM go WHERE present UNION ALL SELECT table_id, 4, 0, '', 'plan', strategy FROM go UNION ALL SELECT table_id, 5, 0, '', 'load', target_name FROM go
 UNION ALL SELECT table_id, 6, 0, '', 'validate', target_name FROM go UNION ALL SELECT table_id, 7, step, name, 'restore constraint', name FROM ks)
SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY major, minor, b, action, detail) AS INTEGER) AS step, action, detail FROM steps""")
def q_prepare(s: SparkSession, sf: str) -> DataFrame:
    """The steps before, around and after the load of every table, or why it is refused."""
    k, custs = F.col("c_custkey"), table(s, sf, "customer")
    strategy = planning.chunk_strategy(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 4 == 0, k % 2 == 0, F.col("c_acctbal") > 0, k % 3 != 0)
    tabs = custs.select(k.alias("table_id"), F.concat(F.when(k % 2 == 0, "Tab_").otherwise("TAB_"), k.cast("string")).alias("name"), strategy.alias("strategy"))
    live = tabs.where("table_id % 3 = 0").select(F.lower("name").alias("live_name")).unionByName(tabs.where("table_id % 3 = 1").select(F.col("name").alias("live_name")))
    found = prepare.resolved(tabs, live)
    manifest, live_columns = c.manifest_and_live(s, sf)
    return prepare.prepared(found, prepare.refusals(found, d.columns(s, sf), manifest, live_columns), more.constraints(s, sf))


# --- documents ---------------------------------------------------------------

KEY = T.StructType([
    T.StructField("table_id", T.LongType()), T.StructField("is_ready", T.BooleanType()),
    T.StructField("key_columns", T.ArrayType(T.StructType([T.StructField("column_name", T.StringType()), T.StructField("key_position", T.IntegerType()), T.StructField("max_value", T.DoubleType())]))),
])


@query("""SELECT l_orderkey AS table_id, bool_or(l_linenumber = 1) AS is_ready, CAST(count(*) AS INTEGER) AS columns, string_agg(l_returnflag || l_linenumber, ',' ORDER BY l_linenumber, l_returnflag, l_quantity) AS named, max(l_quantity) AS greatest, CASE WHEN l_orderkey % 2 = 0 THEN '"' || l_orderkey || '"' END AS unknown FROM lineitem GROUP BY l_orderkey""")
def q_documents(s: SparkSession, sf: str) -> DataFrame:
    """Nested rows written as documents and read back, half of them with names in other cases and a field that nobody knows."""
    part = F.struct(F.col("l_returnflag").alias("column_name"), F.col("l_linenumber").cast("int").alias("key_position"), F.col("l_quantity").cast("double").alias("max_value"))
    order = F.struct("l_linenumber", "l_returnflag", "l_quantity")
    rows = table(s, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_linenumber") == 1).alias("is_ready"), F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), part.alias("p")))), lambda x: x["p"]).alias("key_columns"))
    text = documents.to_document(F.struct(F.col("l_orderkey").cast("long").alias("table_id"), "is_ready", "key_columns"), KEY)
    other = F.concat(F.lit('{"NewField":"'), F.col("l_orderkey").cast("string"), F.lit('",'), F.substring(F.replace(F.replace(text, F.lit("keyColumns"), F.lit("KEYCOLUMNS")), F.lit("maxValue"), F.lit("MaxValue")), F.lit(2), F.length(text)))
    stored_text = F.when(F.col("l_orderkey") % 2 == 0, other).otherwise(text)
    read = rows.select(stored_text.alias("text")).select(documents.from_document(F.col("text"), KEY).alias("d"), documents.unknown_fields(F.col("text"), KEY).alias("u"))
    named = F.array_join(F.transform("d.key_columns", lambda k: F.concat(k["column_name"], k["key_position"].cast("string"))), ",")
    return read.select(
        "d.table_id", "d.is_ready", F.size("d.key_columns").alias("columns"), named.alias("named"), F.array_max(F.transform("d.key_columns", lambda k: k["max_value"])).alias("greatest"),
        F.when(F.size("u") > 0, F.concat(F.lit('"'), F.col("u.NewField"), F.lit('"'))).alias("unknown"),
    )


# --- footers -----------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS rows, count(*) > 0 AS sized FROM {t}" for t in TABLES))
def q_stored_sizes(s: SparkSession, sf: str) -> DataFrame:
    """Exact rows and bytes of every table from its files, without reading a column."""
    found: DataFrame | None = None
    for name in TABLES:
        one = footers.synced(s, name, f"{sf}/{name}.parquet")
        found = one if found is None else found.unionByName(one)
    return found.select("name", "rows", (F.col("bytes") > 0).alias("sized"))


@query("SELECT count(*) AS rows, min(o_orderkey) AS low_o_orderkey, max(o_orderkey) AS high_o_orderkey, count(*) - count(o_orderkey) AS nulls_o_orderkey, min(o_custkey) AS low_o_custkey, max(o_custkey) AS high_o_custkey, count(*) - count(o_custkey) AS nulls_o_custkey FROM orders")
def q_footer_bounds(s: SparkSession, sf: str) -> DataFrame:
    """Row count, bounds and nulls of two columns from the footers."""
    return footers.footer_bounds(s, f"{sf}/orders.parquet", ["o_orderkey", "o_custkey"])


@query(f"""WITH {d.CHUNKS}, t AS (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN CAST(sum(bytes) AS BIGINT) END AS file_bytes, CASE WHEN run_id % 5 <> 0 THEN CAST(sum(rows) AS BIGINT) END AS n, CASE WHEN run_id % 7 <> 0 THEN 40 END AS len FROM chunks GROUP BY 1)
SELECT run_id, CASE WHEN file_bytes IS NOT NULL THEN file_bytes ELSE n * len END AS bytes, CASE WHEN file_bytes IS NOT NULL THEN 'files' WHEN n * len IS NOT NULL THEN 'estimate' ELSE 'unknown' END AS known_from FROM t""")
def q_size_chain(s: SparkSession, sf: str) -> DataFrame:
    """A table's size from its files, else from rows by average length, else unknown."""
    r = F.col("run_id")
    sums = d.chunks(s, sf).groupBy("run_id").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("n"))
    none: Column = F.lit(None)
    size = footers.size_of(F.when(r % 3 == 0, F.col("b")), F.when(r % 5 != 0, F.col("n")).otherwise(none), F.when(r % 7 != 0, 40).otherwise(none))
    return sums.select("run_id", size.alias("s")).select("run_id", "s.bytes", "s.known_from")


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CAST(round(value * value * 10) AS BIGINT) END AS ms, CAST(round(value * 100000) AS BIGINT) AS n FROM events)
SELECT event_id, CASE WHEN ms IS NULL THEN '' WHEN ms < 10000 THEN ((ms * 2 + 100) // 200) // 10 || '.' || ((ms * 2 + 100) // 200) % 10 || ' s' WHEN (ms + 500) // 1000 < 60 THEN (ms + 500) // 1000 || ' s' ELSE (ms + 500) // 60000 || ' min ' || ((ms + 500) // 1000) % 60 || ' s' END AS took,
 CASE WHEN ms IS NULL THEN 'Unknown' ELSE format('{:,}', n) END AS counted FROM v""")
def q_durations(s: SparkSession, sf: str) -> DataFrame:
    """Durations and counts as people read them."""
    ms = F.when(F.col("event_id") % 11 != 0, F.round(F.col("value") * F.col("value") * 10).cast("long"))
    n = F.when(ms.isNotNull(), F.round(F.col("value") * 100_000).cast("long"))
    return table(s, sf, "events").select("event_id", values.human_duration(ms).alias("took"), values.human_count(n).alias("counted"))
