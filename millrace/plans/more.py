"""Further registered queries: lookups, composite keys, upsert rules, chunked copies and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import values
from millrace.operators import cdc, copying, lookups, monitor, planning, schema
from millrace.plans import catalogue as c
from millrace.plans import derived as d
from millrace.plans.catalogue import query
from millrace.sources.tables import table

# --- chunked copy ------------------------------------------------------------


@query(f"""WITH {c.NTILE}, r AS (SELECT bucket - 1 AS chunk, lag(bound) OVER (ORDER BY bucket) AS low, CASE WHEN bucket = max(bucket) OVER () THEN NULL ELSE bound END AS high FROM b)
SELECT chunk, o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderstatus FROM orders JOIN r ON (low IS NULL OR o_orderkey > low) AND (high IS NULL OR o_orderkey <= high)
WHERE o_orderstatus <> 'P' AND chunk % 4 <> 1""")
def q_chunked_scan(s: SparkSession, sf: str) -> DataFrame:
    """The chunks that no fence row covers, each row with its chunk, under the row filter and in the target's types."""
    orders = table(s, sf, "orders")
    plan = planning.key_ranges(planning.ntile_bounds(orders, "o_orderkey", 12))
    done = plan.where("chunk % 4 = 1").select("chunk")
    rows = copying.chunk_rows(orders, plan, "o_orderkey", "o_orderstatus <> 'P'", done)
    return copying.coerced(rows.select("chunk", "o_orderkey", "o_totalprice", "o_orderstatus"), {"o_totalprice": "decimal(12,2)"})


@query(f"""WITH {c.NTILE}, r AS (SELECT bucket - 1 AS chunk, lag(bound) OVER (ORDER BY bucket) AS low, CASE WHEN bucket = max(bucket) OVER () THEN NULL ELSE bound END AS high FROM b)
SELECT chunk, count(*) FILTER (WHERE o_orderstatus <> 'P') AS source_rows, count(*) FILTER (WHERE o_orderstatus <> 'P' AND chunk % 5 <> 2) AS target_rows, chunk % 5 <> 2 OR count(*) FILTER (WHERE o_orderstatus <> 'P') = 0 AS passed
FROM orders JOIN r ON (low IS NULL OR o_orderkey > low) AND (high IS NULL OR o_orderkey <= high) GROUP BY chunk""")
def q_chunk_validation(s: SparkSession, sf: str) -> DataFrame:
    """A copy that lost whole chunks, chunk by chunk."""
    orders = table(s, sf, "orders")
    plan = copying.read_plan(planning.key_ranges(planning.ntile_bounds(orders, "o_orderkey", 12)))
    rows = copying.chunk_rows(orders, plan, "o_orderkey", "o_orderstatus <> 'P'")
    return monitor.validated_counts(rows, rows.where("chunk % 5 <> 2"), ["chunk"])


@query("""SELECT event_type AS part, count(*) AS rows, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS position,
CAST(ceil(count(*) / greatest(1, ceil(sum(count(*)) OVER () / 16.0))) AS INTEGER) AS chunks FROM events GROUP BY 1""")
def q_partition_plan(s: SparkSession, sf: str) -> DataFrame:
    """A plan over partitions: chunks of one size in rows for all of them."""
    return planning.partition_plan(table(s, sf, "events"), "event_type", 16).withColumnRenamed("event_type", "part")


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'purchase' AND value > 50")
def q_partition_scan(s: SparkSession, sf: str) -> DataFrame:
    """One partition of a table under a row filter; on a table stored by partition Spark reads that folder only."""
    return table(s, sf, "events").where(F.col("event_type") == "purchase").where(values.checked_filter("value > 50")).select("event_id", "ts", "value")


STRATEGY = """CASE WHEN c_mktsegment = 'BUILDING' THEN CASE WHEN c_custkey % 3 <> 0 THEN 'key range' ELSE 'single' END WHEN c_nationkey % 4 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'partition' WHEN c_acctbal > 0 THEN 'range' ELSE 'single' END
 WHEN c_acctbal > 0 THEN 'range' WHEN c_custkey % 3 <> 0 THEN 'key range' ELSE 'hash' END"""


@query(f"SELECT c_custkey, {STRATEGY} AS strategy FROM customer")
def q_chunk_strategy(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    strategy = planning.chunk_strategy(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 4 == 0, k % 2 == 0, F.col("c_acctbal") > 0, k % 3 != 0)
    return table(s, sf, "customer").select("c_custkey", strategy.alias("strategy"))


# --- composite keys ----------------------------------------------------------

KEY_TEXTS = """SELECT CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id // 2 AS VARCHAR) END AS part_0, CASE WHEN event_id % 11 = 0 THEN 'none' WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id % 7 + 1 AS VARCHAR) END AS part_1 FROM events"""


def key_texts(s: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    part = F.when(e % 11 == 0, "none").when(e % 13 == 0, F.lit(None)).otherwise((F.col("user_id") % 7 + 1).cast("string"))
    return table(s, sf, "events").select("event_id", F.when(e % 9 != 0, F.expr("event_id div 2").cast("string")).alias("part_0"), part.alias("part_1"))


@query(f"WITH k AS ({KEY_TEXTS}) SELECT part_0 || '/' || part_1 AS key, count(*) AS n FROM k WHERE part_0 IS NOT NULL AND part_1 IS NOT NULL GROUP BY 1")
def q_full_keys(s: SparkSession, sf: str) -> DataFrame:
    keys = key_texts(s, sf).select(lookups.full_key([F.col("part_0"), F.col("part_1")]).alias("key")).where("key is not null")
    return keys.groupBy(F.array_join("key", "/").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH k AS (SELECT DISTINCT TRY_CAST(part_0 AS BIGINT) AS a, TRY_CAST(part_1 AS INTEGER) AS b FROM ({KEY_TEXTS})) SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity FROM lineitem l SEMI JOIN k ON l_orderkey = a AND l_linenumber = b")
def q_composite_reread(s: SparkSession, sf: str) -> DataFrame:
    lines = table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lookups.rows_of_keys(lines, key_texts(s, sf), ["l_orderkey", "l_linenumber"])


@query("SELECT event_id, CASE event_type WHEN 'click' THEN props->>'k' WHEN 'purchase' THEN CAST(user_id AS VARCHAR) END AS slot_0, CASE event_type WHEN 'click' THEN event_type END AS slot_1 FROM events")
def q_mined_values(s: SparkSession, sf: str) -> DataFrame:
    image = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), "user_id", "event_type"))
    slots = {"click": ["k", "event_type"], "purchase": ["user_id"]}
    return table(s, sf, "events").select("event_id", *[lookups.mined_value(image, slots, F.col("event_type"), i).alias(f"slot_{i}") for i in (0, 1)])


LINES = """t AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS quantity, min(l_returnflag) AS flag, min(l_partkey) AS made FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2),
k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 3 = 0),
w AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS quantity, max(l_returnflag) AS flag, max(l_partkey) AS made FROM lineitem SEMI JOIN k USING (l_orderkey, l_linenumber) WHERE l_suppkey % 5 <> 0 GROUP BY 1, 2)"""


def line_changes(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines, key = table(s, sf, "lineitem"), ["l_orderkey", "l_linenumber"]

    def least(df: DataFrame, of) -> DataFrame:  # noqa: ANN001
        return df.groupBy(*key).agg(of("l_quantity").alias("quantity"), of("l_returnflag").alias("flag"), of("l_partkey").alias("made"))

    keys = lines.where("l_partkey % 3 = 0").select(*key).distinct()
    return least(lines.where("l_suppkey % 7 <> 0"), F.min), keys, least(lines.where("l_suppkey % 5 <> 0").join(keys, key, "left_semi"), F.max)


@query(f"""WITH {LINES} SELECT coalesce(t.l_orderkey, w.l_orderkey) AS l_orderkey, coalesce(t.l_linenumber, w.l_linenumber) AS l_linenumber, CASE WHEN w.l_orderkey IS NULL THEN t.quantity ELSE w.quantity END AS quantity,
 CASE WHEN w.l_orderkey IS NULL THEN t.flag ELSE w.flag END AS flag, coalesce(t.made, w.made) AS made
FROM t FULL JOIN w ON t.l_orderkey = w.l_orderkey AND t.l_linenumber = w.l_linenumber LEFT JOIN k ON k.l_orderkey = t.l_orderkey AND k.l_linenumber = t.l_linenumber WHERE w.l_orderkey IS NOT NULL OR k.l_orderkey IS NULL""")
def q_composite_upsert(s: SparkSession, sf: str) -> DataFrame:
    """The identity column ``made`` of a row that is there is never set."""
    return cdc.upserted_rows(*line_changes(s, sf), ["l_orderkey", "l_linenumber"], ["quantity", "flag"])


@query(f"""WITH {LINES}, j AS (SELECT w.l_orderkey IS NOT NULL AS has_new, t.l_orderkey IS NOT NULL AS has_old, (t.quantity, t.flag) IS DISTINCT FROM (w.quantity, w.flag) AS differs, k.l_orderkey IS NOT NULL AS changed
FROM t FULL JOIN w ON t.l_orderkey = w.l_orderkey AND t.l_linenumber = w.l_linenumber LEFT JOIN k ON k.l_orderkey = t.l_orderkey AND k.l_linenumber = t.l_linenumber)
SELECT count(*) FILTER (WHERE has_new AND (NOT has_old OR differs)) AS written, count(*) FILTER (WHERE has_old AND changed AND NOT has_new) AS deleted FROM j""")
def q_composite_upsert_counts(s: SparkSession, sf: str) -> DataFrame:
    return cdc.upsert_counts(*line_changes(s, sf), ["l_orderkey", "l_linenumber"], ["quantity", "flag"])


@query(f"WITH {d.CDC} SELECT * FROM (SELECT * FROM tgt UNION ALL SELECT * FROM tgt WHERE o_orderkey % 5 = 0) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM keys) UNION ALL SELECT * FROM rws")
def q_cdc_settled_table(s: SparkSession, sf: str) -> DataFrame:
    """A table without a key, whose fuzzy load copied rows twice: every copy of a changed key goes, its current row is put once."""
    target, keys, rows, key = c.changes(s, sf)
    return cdc.applied(target.unionByName(target.where("o_orderkey % 5 = 0")), keys, rows, key)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 5")
def q_duplicates_reported(s: SparkSession, sf: str) -> DataFrame:
    """What stands in the message that refuses a key: at most five duplicates, the most frequent first."""
    return cdc.duplicate_keys(table(s, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).orderBy(F.desc("n"), "l_orderkey", "l_linenumber").limit(5)


# --- lookups -----------------------------------------------------------------


@query("""WITH n AS (SELECT count(*) AS rows, count(*) FILTER (WHERE event_id IS NULL) AS a, count(*) FILTER (WHERE ts IS NULL) AS b, count(*) FILTER (WHERE user_id IS NULL) AS c, count(*) FILTER (WHERE event_type IS NULL) AS d, count(*) FILTER (WHERE value IS NULL) AS e, count(*) FILTER (WHERE props IS NULL) AS f FROM events)
SELECT 'event_id' AS name, 1 AS position, 'bigint' AS type, rows, a AS nulls FROM n UNION ALL SELECT 'ts', 2, 'timestamp_ntz', rows, b FROM n UNION ALL SELECT 'user_id', 3, 'bigint', rows, c FROM n
UNION ALL SELECT 'event_type', 4, 'string', rows, d FROM n UNION ALL SELECT 'value', 5, 'double', rows, e FROM n UNION ALL SELECT 'props', 6, 'string', rows, f FROM n""")
def q_live_columns(s: SparkSession, sf: str) -> DataFrame:
    return lookups.live_columns(table(s, sf, "events"))


@query("SELECT DISTINCT lower(p_name) AS name, lower(p_name) IN (SELECT p_name FROM part WHERE p_size > 25) AS present FROM part")
def q_existing_targets(s: SparkSession, sf: str) -> DataFrame:
    part = table(s, sf, "part")
    return lookups.existing(part.select(F.lower("p_name").alias("name")), part.where("p_size > 25").select(F.col("p_name").alias("name")), "name")


def constraints(s: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey") % 4
    kind = F.when(part == 0, "f").when(part == 1, "c").when(part == 2, "u").otherwise("p")
    return table(s, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("name"), kind.alias("kind"), ((F.col("l_suppkey") % 3 == 0) & (part == 0)).alias("inbound"))


@query(f"""WITH {c.KINDS} SELECT table_id, name, kind, inbound, CASE WHEN inbound THEN 5 WHEN kind = 'p' THEN 1 WHEN kind = 'u' THEN 2 WHEN kind = 'c' THEN 3 ELSE 4 END AS step
FROM kinds ANTI JOIN (SELECT l_orderkey AS table_id, l_linenumber AS name FROM lineitem WHERE l_quantity > 40) USING (table_id, name)""")
def q_restore_order(s: SparkSession, sf: str) -> DataFrame:
    present = table(s, sf, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("name"))
    return lookups.restore_order(constraints(s, sf), present, "table_id", "name")


@query("SELECT p_brand, lower(p_name) AS folded, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def q_name_taken(s: SparkSession, sf: str) -> DataFrame:
    return lookups.duplicate_names(table(s, sf, "part"), ["p_brand"], "p_name")


@query("SELECT p_partkey, trim(part) AS name FROM (SELECT p_partkey, unnest(regexp_split_to_array(p_name || ' , ' || p_brand || chr(10) || ' ,' || p_type, '[\\n,]')) AS part FROM part) WHERE trim(part) <> ''")
def q_paste_list(s: SparkSession, sf: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" , "), "p_brand", F.lit("\n ,"), "p_type")
    return lookups.listed_names(table(s, sf, "part").select("p_partkey", text.alias("text")), "p_partkey", "text")


@query(f"WITH {c.SIDES} SELECT source_name, target_name, status FROM stat WHERE status IN ('missing', 'extra', 'error') AND (contains(lower(source_name), '7') OR contains(lower(target_name), '7'))")
def q_count_filter(s: SparkSession, sf: str) -> DataFrame:
    """The comparison's differences, searched by name."""
    found = c.compared(s, sf).where(F.col("status").isin("missing", "extra", "error"))
    return found.where(F.lower("source_name").contains("7") | F.lower("target_name").contains("7")).select("source_name", "target_name", "status")


@query("SELECT lower(name) AS folded, name FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer) ORDER BY 1, 2")
def q_key_order(s: SparkSession, sf: str) -> DataFrame:
    names = table(s, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"))
    return names.select(F.lower("name").alias("folded"), "name").orderBy("folded", "name")


@query(f"WITH {d.COLUMNS} SELECT table_id, CAST(sum(bytes) AS BIGINT) AS lob_bytes FROM (SELECT DISTINCT table_id, position AS segment FROM cols WHERE source_type IN ('BLOB', 'CLOB')) JOIN (SELECT l_linenumber AS segment, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1) USING (segment) GROUP BY 1")
def q_lob_sizes(s: SparkSession, sf: str) -> DataFrame:
    lobs = d.columns(s, sf).where(F.col("source_type").isin("BLOB", "CLOB")).select("table_id", F.col("position").alias("segment"))
    segments = table(s, sf, "lineitem").select(F.col("l_linenumber").alias("segment"), F.round("l_quantity").cast("long").alias("bytes"))
    return lookups.lob_sizes(lobs, segments, "segment", "table_id")


@query("""SELECT l_orderkey, l_linenumber, coalesce(n.p_partkey, i.p_partkey) AS table_id FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS named, l_partkey + l_linenumber % 2 * 1000000 AS object_id FROM lineitem)
LEFT JOIN part n ON n.p_partkey = named LEFT JOIN part i ON i.p_partkey = object_id""")
def q_record_tables(s: SparkSession, sf: str) -> DataFrame:
    lines, parts = table(s, sf, "lineitem"), table(s, sf, "part")
    n = F.col("l_linenumber")
    name = F.when(n % 3 != 0, F.concat(F.lit("T"), F.col("l_partkey").cast("string")))
    records = lines.select("l_orderkey", "l_linenumber", F.lit("APP").alias("owner"), name.alias("name"), (F.col("l_partkey") + n % 2 * 1_000_000).alias("object_id"))
    tables = parts.select(F.lit("APP").alias("owner"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("object_id"), F.col("p_partkey").alias("table_id"))
    return lookups.record_tables(records, tables).select("l_orderkey", "l_linenumber", "table_id")


@query(f"WITH {d.CDC} SELECT DISTINCT o_orderkey FROM orders SEMI JOIN (SELECT address FROM log WHERE old_key IS NULL AND new_key IS NULL AND address IS NOT NULL) a ON o_custkey = address")
def q_keys_by_address(s: SparkSession, sf: str) -> DataFrame:
    records = d.change_log(s, sf).where("old_key is null and new_key is null")
    return lookups.keys_at(records, table(s, sf, "orders").withColumnRenamed("o_custkey", "address"), "address", ["o_orderkey"])


@query("""SELECT e.event_id, CASE WHEN s.user_id IS NOT NULL THEN 'u' || e.user_id END AS user_name, s.program FROM (SELECT * FROM events WHERE event_id % 37 = 0) e
LEFT JOIN (SELECT user_id, event_type, min(props) AS program FROM events WHERE event_id % 5 = 0 GROUP BY 1, 2) s ON s.user_id = e.user_id AND s.event_type = e.event_type""")
def q_open_transactions(s: SparkSession, sf: str) -> DataFrame:
    events = table(s, sf, "events")
    sessions = events.where("event_id % 5 = 0").groupBy("user_id", "event_type").agg(F.min("props").alias("program")).withColumn("user_name", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return lookups.open_transactions(events.where("event_id % 37 = 0"), sessions, ["user_id", "event_type"]).select("event_id", "user_name", "program")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def q_files_of_spaces(s: SparkSession, sf: str) -> DataFrame:
    """Data files of the table spaces that any of three lists names."""
    a = table(s, sf, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"))
    b = table(s, sf, "nation").where("n_regionkey = 1").select("n_nationkey")
    named = a.unionByName(b).unionByName(table(s, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))).distinct()
    spaces = table(s, sf, "nation").join(named, "n_nationkey", "left_semi")
    return table(s, sf, "supplier").join(spaces, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@query(f"WITH {c.LOGS} SELECT thread, sequence, min(name) AS member FROM logs WHERE NOT archived GROUP BY 1, 2")
def q_log_members(s: SparkSession, sf: str) -> DataFrame:
    return c.logs(s, sf).where(~F.col("archived")).groupBy("thread", "sequence").agg(F.min("name").alias("member"))


@query("SELECT event_type, min(ts) AS earliest, max(ts) AS latest, max(event_id) FILTER (WHERE value > 100) AS unlogged_at FROM events GROUP BY 1")
def q_history_bounds(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "events").groupBy("event_type").agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.max(F.when(F.col("value") > 100, F.col("event_id"))).alias("unlogged_at"))


# --- saved state -------------------------------------------------------------


@query("SELECT n.c_custkey, o.included FROM (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) n LEFT JOIN (SELECT c_custkey, c_custkey % 2 = 0 AS included FROM customer WHERE c_custkey % 3 <> 0) o USING (c_custkey)")
def q_refresh_list(s: SparkSession, sf: str) -> DataFrame:
    customers = table(s, sf, "customer")
    saved = customers.where("c_custkey % 3 <> 0").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("included"))
    return monitor.refreshed(saved, customers.where("c_custkey % 5 <> 0"), "c_custkey")


@query("""SELECT coalesce(o.k, n.k) AS c_custkey, CASE WHEN o.k IS NOT NULL THEN o.created ELSE n.created END AS created, CASE WHEN n.k IS NOT NULL THEN n.point ELSE o.point END AS point
FROM (SELECT c_custkey AS k, c_nationkey AS created, c_custkey AS point FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, 100 AS created, c_custkey * 2 AS point FROM customer WHERE c_custkey % 2 = 0) n USING (k)""")
def q_state_upsert(s: SparkSession, sf: str) -> DataFrame:
    customers, k = table(s, sf, "customer"), F.col("c_custkey")
    state = customers.where(k % 3 != 0).select(k, F.col("c_nationkey").alias("created"), k.alias("point"))
    return monitor.upserted(state, customers.where(k % 2 == 0).select(k, F.lit(100).alias("created"), (k * 2).alias("point")), "c_custkey", ["created"])


@query(f"WITH {d.CHUNKS} SELECT chunk_id, run_id, status FROM chunks WHERE run_id % 4 <> 0 OR status = 'Pending'")
def q_delete_history(s: SparkSession, sf: str) -> DataFrame:
    runs = d.chunks(s, sf).select("chunk_id", "run_id", "status")
    return monitor.without_history(runs, runs.where("run_id % 4 = 0"), "run_id", F.col("status") == "Pending").select("chunk_id", "run_id", "status")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'needs_bulk_copy' WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'needs_first_sync' END AS state FROM orders")
def q_tracker_state(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "orders").select("o_orderkey", lookups.tracker_state(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 9 == 0).alias("state"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'unsupported' WHEN p_size % 2 = 0 THEN 'log files' WHEN p_brand LIKE '%3' THEN 'unsupported' WHEN p_size >= 21 THEN 'pluggable database' ELSE 'unsupported' END AS mode FROM part""")
def q_mining_mode(s: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    multitenant = F.when(size % 10 != 0, size % 2 != 0)
    container = F.when(F.col("p_brand").endswith("3"), "CDB$ROOT").otherwise("APP")
    return table(s, sf, "part").select("p_partkey", lookups.mining_mode(multitenant, container, size).alias("mode"))


# --- messages ----------------------------------------------------------------

LABELS_SQL = "CASE st " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.STATUS_LABELS.items()) + " WHEN '' THEN '—' ELSE st END"


@query(f"WITH {d.CHUNKS} SELECT chunk_id, {LABELS_SQL} AS label FROM (SELECT chunk_id, CASE WHEN chunk_id % 8 = 0 THEN '' WHEN chunk_id % 8 = 1 THEN 'Odd' WHEN chunk_id % 8 = 2 THEN 'CompletedWithErrors' ELSE status END AS st FROM chunks)")
def q_status_labels(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("chunk_id") % 8
    state = F.when(k == 0, "").when(k == 1, "Odd").when(k == 2, "CompletedWithErrors").otherwise(F.col("status"))
    return d.chunks(s, sf).select("chunk_id", values.status_label(state).alias("label"))


@query("SELECT event_id, CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(values.READ_ADVICE.values())) + " END AS advice FROM events")
def q_error_advice(s: SparkSession, sf: str) -> DataFrame:
    code = F.get(F.array(*map(F.lit, (*values.READ_ADVICE, 942, 1722))), (F.col("event_id") % 6).cast("int"))
    return table(s, sf, "events").select("event_id", values.read_advice(code).alias("advice"))


@query("SELECT doc_id, left(split_part(text, chr(10), 1), 500) AS line FROM documents")
def q_first_line(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "documents").select("doc_id", values.first_line(F.col("text")).alias("line"))


@query("""WITH a AS (SELECT event_id, greatest(CAST(round(value * value) AS BIGINT), 0) AS s FROM events)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' WHEN s // 86400 = 1 THEN '1 day ago' ELSE (s // 86400) || ' days ago' END AS age FROM a""")
def q_age(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "events").select("event_id", values.human_age(F.round(F.col("value") * F.col("value")).cast("long")).alias("age"))


@query(f"""WITH {c.DIFF}, bad AS (SELECT table_id, name, verdict, row_number() OVER (PARTITION BY table_id ORDER BY name, verdict) AS r, count(*) OVER (PARTITION BY table_id) AS n FROM diff WHERE verdict IN ('block', 'missing', 'missing, spelt otherwise', 'extra and required'))
SELECT table_id, min(n) || CASE WHEN min(n) = 1 THEN ' incompatibility:' ELSE ' incompatibilities:' END || chr(10) || string_agg('  - column ' || name || ': ' || verdict, chr(10) ORDER BY r) FILTER (WHERE r <= 5) || CASE WHEN min(n) > 5 THEN chr(10) || '  ...and ' || (min(n) - 5) || ' more.' ELSE '' END AS message FROM bad GROUP BY 1""")
def q_mismatch_message(s: SparkSession, sf: str) -> DataFrame:
    found = schema.schema_diff(*c.manifest_and_live(s, sf), ["table_id"])
    return lookups.listed_problems(found.where(F.col("verdict").isin("block", "missing", "missing, spelt otherwise", "extra and required")), ["table_id"])
