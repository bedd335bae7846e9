"""Registered queries on claims, readiness and the destination's side: state, catalog and setting tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import cdc, claims, readiness, runs, scan, targets
from millrace.plans import catalogue as c
from millrace.plans import derived as d
from millrace.plans.catalogue import query
from millrace.sources.tables import table

# --- claims ------------------------------------------------------------------

STATES = """chunks AS (SELECT o_orderkey AS chunk_id, o_orderkey // 50 AS run_id, CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'P' THEN 'Running' ELSE 'Done' END AS status,
 CASE WHEN o_custkey % 3 = 0 THEN o_orderdate END AS retry_after, CASE WHEN o_custkey % 4 <> 0 THEN CAST(o_custkey % 4 AS INTEGER) END AS attempts FROM orders),
runs AS (SELECT DISTINCT o_orderkey // 50 AS run_id, o_orderkey // 50 % 20 AS job_id, CASE WHEN o_orderkey // 50 % 7 = 0 THEN 'Planning' ELSE 'Loading' END AS status FROM orders WHERE o_orderkey // 50 % 11 <> 3),
jobs AS (SELECT n_nationkey AS job_id, CASE n_nationkey % 5 WHEN 0 THEN 'Queued' WHEN 3 THEN 'Failed' WHEN 4 THEN 'Completed' ELSE 'Running' END AS status FROM nation)"""


def states(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks (orders, fifty a run), runs and jobs (nations)."""
    run = F.expr("o_orderkey div 50")
    orders = table(s, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "O", "Pending").when(F.col("o_orderstatus") == "P", "Running").otherwise("Done")
    chunks = orders.select(F.col("o_orderkey").alias("chunk_id"), run.alias("run_id"), state.alias("status"), F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderdate")).alias("retry_after"), F.when(F.col("o_custkey") % 4 != 0, (F.col("o_custkey") % 4).cast("int")).alias("attempts"))
    runs = orders.select(run.alias("run_id")).distinct().where("run_id % 11 <> 3").select("run_id", (F.col("run_id") % 20).alias("job_id"), F.when(F.col("run_id") % 7 == 0, "Planning").otherwise("Loading").alias("status"))
    k = F.col("n_nationkey") % 5
    jobs = table(s, sf, "nation").select(F.col("n_nationkey").alias("job_id"), F.when(k == 0, "Queued").when(k == 3, "Failed").when(k == 4, "Completed").otherwise("Running").alias("status"))
    return chunks, runs, jobs


FREE = "c.status = 'Pending' AND (retry_after IS NULL OR retry_after <= TIMESTAMP '1998-01-01') AND r.status = 'Loading' AND j.status = 'Running'"


@query(f"WITH {STATES} SELECT run_id, count(*) AS chunks, min(chunk_id) AS first FROM chunks c JOIN runs r USING (run_id) JOIN jobs j USING (job_id) WHERE {FREE} GROUP BY 1")
def q_free_chunks(s: SparkSession, sf: str) -> DataFrame:
    """How many chunks of each run may be taken now, by the states of chunk, run and job."""
    return claims.claimable(*states(s, sf), F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("run_id").agg(F.count("*").alias("chunks"), F.min("chunk_id").alias("first"))


@query(f"""WITH {STATES} SELECT chunk_id, run_id, 'Running' AS status, 'w1' AS worker, CAST(coalesce(attempts, 0) + 1 AS INTEGER) AS attempts, TIMESTAMP '1998-01-01 00:10:00' AS leased_until
FROM chunks c JOIN runs r USING (run_id) JOIN jobs j USING (job_id) WHERE {FREE} ORDER BY chunk_id LIMIT 40""")
def q_claimed_chunks(s: SparkSession, sf: str) -> DataFrame:
    """The forty chunks that a worker takes next, as they are then."""
    now = F.lit("1998-01-01").cast("timestamp_ntz")
    return claims.claimed(claims.claimable(*states(s, sf), now), "w1", now, 40)


@query(f"""WITH {STATES}, t AS (SELECT c_custkey AS tracker, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey + 3 END AS active_job_id FROM customer)
SELECT tracker, j.job_id AS active_job_id, active_job_id IS NOT NULL AND j.job_id IS NULL AS released FROM t LEFT JOIN (SELECT job_id FROM jobs WHERE status IN ('Queued', 'Running')) j ON j.job_id = t.active_job_id""")
def q_released_trackers(s: SparkSession, sf: str) -> DataFrame:
    """Trackers (customers) without the claims of jobs that have ended or never were."""
    trackers = table(s, sf, "customer").select(F.col("c_custkey").alias("tracker"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") + 3).alias("active_job_id"))
    return claims.released(trackers, states(s, sf)[2])


@query(f"""WITH {STATES}, l AS (SELECT run_id, count(*) AS n, string_agg(chunk_id || ' ' || status, ',' ORDER BY chunk_id) AS chunks FROM chunks GROUP BY 1)
SELECT j.job_id, j.status AS job_status, r.run_id, r.status AS run_status, CAST(coalesce(n, 0) AS INTEGER) AS n_chunks, coalesce(chunks, '') AS chunks FROM jobs j LEFT JOIN runs r USING (job_id) LEFT JOIN l ON l.run_id = r.run_id""")
def q_jobs_loaded(s: SparkSession, sf: str) -> DataFrame:
    """Jobs with their runs and each run's chunks."""
    chunks, runs, jobs = states(s, sf)
    text = F.array_join(F.transform("chunks", lambda x: F.concat(x["chunk_id"].cast("string"), F.lit(" "), x["status"])), ",")
    return claims.job_tree(jobs, runs, chunks).select("job_id", "job_status", "run_id", "run_status", F.size("chunks").alias("n_chunks"), text.alias("chunks"))


@query("""WITH f AS (SELECT CASE WHEN p_size < 10 THEN 'Draft' WHEN p_size < 30 THEN 'Copied' END AS status FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%')
SELECT status, count(*) AS tables FROM f GROUP BY 1 UNION ALL SELECT 'All', count(*) FROM f""")
def q_search_counts(s: SparkSession, sf: str) -> DataFrame:
    """Statuses of the tables that a search finds; tables never copied have none."""
    status = F.when(F.col("p_size") < 10, "Draft").when(F.col("p_size") < 30, "Copied")
    parts = table(s, sf, "part").select(F.col("p_name").alias("table_name"), F.col("p_type").alias("owner"), status.alias("status"))
    return claims.status_counts(claims.searched(parts, " RING "))


# --- readiness ---------------------------------------------------------------

SOURCES = """settings AS (SELECT n_nationkey AS source, CASE WHEN n_nationkey % 7 <> 6 THEN 'ARCHIVELOG' WHEN n_nationkey % 2 = 0 THEN 'NOARCHIVELOG' END AS log_mode,
 CASE n_nationkey % 4 WHEN 0 THEN 'IMPLICIT' WHEN 3 THEN 'NO' ELSE 'YES' END AS minimal, CASE WHEN n_nationkey % 3 = 0 THEN 'YES' ELSE 'NO' END AS key_logging, CASE WHEN n_nationkey % 5 = 1 THEN 'YES' END AS pdb_key_logging,
 CASE WHEN n_nationkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS forced FROM nation WHERE n_nationkey <> 17),
tabs AS (SELECT s_nationkey AS source, 'APP' AS owner, CASE WHEN s_suppkey % 13 = 5 THEN s_name ELSE 'T' || s_suppkey END AS name, s_suppkey % 6 <> 1 AS has_key, CASE WHEN s_acctbal < 0 THEN 2 ELSE 0 END AS unlogged_parts,
 s_suppkey % 17 <> 2 AS reads_back, CASE WHEN s_suppkey % 19 = 4 THEN 'NONE' WHEN s_suppkey % 19 < 4 THEN 'FULL' END AS support FROM supplier),
groups AS (SELECT source, owner, name FROM tabs WHERE source % 4 = 2)"""
PROBLEM_SQL = f"""{SOURCES}, logged AS (SELECT t.*, (g.name IS NOT NULL OR coalesce(s.key_logging = 'YES', false) OR coalesce(s.pdb_key_logging = 'YES', false)) AS logged, '"' || t.owner || '"."' || t.name || '"' AS q
 FROM tabs t LEFT JOIN groups g USING (source, owner, name) LEFT JOIN settings s USING (source)),
judged AS (SELECT source, owner, name, CASE WHEN NOT regexp_full_match(name, '[A-Za-z][A-Za-z0-9_$#]{{0,127}}') THEN 'its name cannot be quoted' ELSE concat_ws('; ', CASE WHEN NOT has_key THEN 'no usable key' END, CASE WHEN NOT logged THEN 'key columns are not logged' END,
 CASE WHEN unlogged_parts > 0 THEN 'writes may leave no history' END, CASE WHEN NOT reads_back THEN 'earlier moments cannot be read' END, CASE WHEN support = 'NONE' THEN 'history cannot describe its columns' END) END AS problems,
 CASE WHEN NOT regexp_full_match(name, '[A-Za-z][A-Za-z0-9_$#]{{0,127}}') THEN '' ELSE concat_ws(' ', CASE WHEN NOT logged THEN 'ALTER TABLE ' || q || ' ADD SUPPLEMENTAL LOG DATA (PRIMARY KEY) COLUMNS;' END, CASE WHEN unlogged_parts > 0 THEN 'ALTER TABLE ' || q || ' LOGGING;' END,
 CASE WHEN NOT reads_back THEN 'GRANT FLASHBACK ON ' || q || ' TO TRACK;' END) END AS fixes FROM logged)"""
ITEM_SQL = """items AS (SELECT source, 'archived log' AS item, coalesce(log_mode = 'ARCHIVELOG', false) AS ok, coalesce(log_mode = 'ARCHIVELOG', false) AS done, 'ALTER DATABASE ARCHIVELOG;' AS fix FROM settings
 UNION ALL SELECT source, 'minimal logging', minimal IN ('YES', 'IMPLICIT'), minimal IN ('YES', 'IMPLICIT'), 'ALTER DATABASE ADD SUPPLEMENTAL LOG DATA;' FROM settings
 UNION ALL SELECT source, 'key logging', key_logging = 'YES' OR coalesce(pdb_key_logging = 'YES', false), key_logging = 'YES' OR coalesce(pdb_key_logging = 'YES', false), 'ALTER DATABASE ADD SUPPLEMENTAL LOG DATA (PRIMARY KEY) COLUMNS;' FROM settings
 UNION ALL SELECT source, 'forced logging', true, forced = 'YES', 'ALTER DATABASE FORCE LOGGING;' FROM settings)"""


def sources(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Settings (nations), tables (suppliers) and their own log groups."""
    n = F.col("n_nationkey")
    settings = table(s, sf, "nation").where(n != 17).select(
        n.alias("source"), F.when(n % 7 != 6, "ARCHIVELOG").when(n % 2 == 0, "NOARCHIVELOG").alias("log_mode"), F.when(n % 4 == 0, "IMPLICIT").when(n % 4 == 3, "NO").otherwise("YES").alias("minimal"),
        F.when(n % 3 == 0, "YES").otherwise("NO").alias("key_logging"), F.when(n % 5 == 1, "YES").alias("pdb_key_logging"), F.when(n % 2 == 0, "YES").otherwise("NO").alias("forced"),
    )
    k = F.col("s_suppkey")
    tables = table(s, sf, "supplier").select(
        F.col("s_nationkey").alias("source"), F.lit("APP").alias("owner"), F.when(k % 13 == 5, F.col("s_name")).otherwise(F.concat(F.lit("T"), k.cast("string"))).alias("name"), (k % 6 != 1).alias("has_key"),
        F.when(F.col("s_acctbal") < 0, 2).otherwise(0).alias("unlogged_parts"), (k % 17 != 2).alias("reads_back"), F.when(k % 19 == 4, "NONE").when(k % 19 < 4, "FULL").alias("support"),
    )
    groups = tables.where("source % 4 = 2").select("source", "owner", "name", F.lit("PRIMARY KEY LOGGING").alias("kind"))
    return settings, tables, groups


@query(f"WITH {SOURCES}, {ITEM_SQL} SELECT source, item, ok, CASE WHEN NOT done THEN fix END AS fix FROM items")
def q_setting_checks(s: SparkSession, sf: str) -> DataFrame:
    """Each source's settings for change tracking and the statements that are missing."""
    return readiness.setting_checks(sources(s, sf)[0])


@query(f"WITH {PROBLEM_SQL} SELECT source, owner, name, problems = '' AS ok, problems, fixes FROM judged")
def q_table_checks(s: SparkSession, sf: str) -> DataFrame:
    """What stands in the way of tracking each table, and the statements that mend it."""
    found = readiness.table_checks(*sources(s, sf), "TRACK")
    return found.withColumns({"problems": F.array_join("problems", "; "), "fixes": F.array_join("fixes", " ")})


@query(f"""WITH {PROBLEM_SQL}, {ITEM_SQL}, a AS (SELECT source, count(*) FILTER (WHERE NOT ok) AS failed_items FROM items GROUP BY 1), b AS (SELECT source, count(*) FILTER (WHERE problems <> '') AS failed_tables FROM judged GROUP BY 1)
SELECT source, failed_items, coalesce(failed_tables, 0) AS failed_tables, failed_items = 0 AND coalesce(failed_tables, 0) = 0 AS ready FROM a LEFT JOIN b USING (source)""")
def q_sources_ready(s: SparkSession, sf: str) -> DataFrame:
    """Sources that are ready with all their tables."""
    settings, tables, groups = sources(s, sf)
    return readiness.ready(readiness.setting_checks(settings), readiness.table_checks(settings, tables, groups, "TRACK"))


# --- the destination's side --------------------------------------------------


@query("""WITH p AS (SELECT CASE p_size % 6 WHEN 0 THEN 'pg_' || p_brand WHEN 1 THEN 'information_schema' ELSE p_brand || p_size % 6 END AS schema, p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'USAGE' WHEN 1 THEN 'CREATE' ELSE 'OTHER' END AS privilege FROM part)
SELECT schema, bool_or(privilege = 'CREATE') AS can_create FROM p WHERE schema NOT LIKE 'pg\\_%' ESCAPE '\\' AND schema <> 'information_schema' GROUP BY 1 HAVING bool_or(privilege = 'USAGE')""")
def q_target_schemas(s: SparkSession, sf: str) -> DataFrame:
    """Schemas a copy may use, and whether it may make tables there."""
    k = F.col("p_size") % 6
    name = F.when(k == 0, F.concat(F.lit("pg_"), "p_brand")).when(k == 1, "information_schema").otherwise(F.concat("p_brand", k.cast("string")))
    held = F.when(F.col("p_partkey") % 3 == 0, "USAGE").when(F.col("p_partkey") % 3 == 1, "CREATE").otherwise("OTHER")
    p = table(s, sf, "part").select(name.alias("schema"), held.alias("privilege"))
    return targets.usable_schemas(p, p)


@query("SELECT CASE WHEN p_partkey % 40 = 1 THEN 'finished' ELSE 'p' || p_partkey END AS name FROM part WHERE p_brand = 'Brand#2' AND p_size % 4 < 2 AND p_partkey % 7 <> 0 AND p_partkey % 40 <> 1")
def q_target_tables(s: SparkSession, sf: str) -> DataFrame:
    """Tables of one schema, without partitions, views, indexes and the table of finished chunks."""
    k = F.col("p_partkey")
    classes = table(s, sf, "part").select(F.col("p_brand").alias("schema"), F.get(F.array(*map(F.lit, "rpvi")), (F.col("p_size") % 4).cast("int")).alias("kind"), (k % 7 == 0).alias("is_partition"), F.when(k % 40 == 1, "finished").otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("name"))
    return targets.listed_tables(classes, "Brand#2", "finished")


INDEXES = f"""{d.COLUMNS}, ic AS (SELECT DISTINCT table_id, scale AS index_id, lower(name) AS name FROM cols), ix AS (SELECT DISTINCT table_id, index_id, table_id % 4 <> 0 AS is_unique, (table_id + index_id) % 9 <> 0 AS valid, (table_id + index_id) % 7 <> 0 AS immediate, table_id % 11 = 5 AND index_id = 1 AS partial, table_id % 13 = 5 AND index_id = 2 AS expressions FROM ic),
wanted AS (SELECT DISTINCT table_id, lower(name) AS name FROM cols WHERE scale = table_id % 4)"""


def indexes(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indexes, their columns, and the columns of the keys wanted."""
    cols = d.columns(s, sf)
    parts = cols.select("table_id", F.col("scale").alias("index_id"), F.lower("name").alias("name")).distinct()
    t, i = F.col("table_id"), F.col("index_id")
    flags = {"is_unique": t % 4 != 0, "valid": (t + i) % 9 != 0, "immediate": (t + i) % 7 != 0, "partial": (t % 11 == 5) & (i == 1), "expressions": (t % 13 == 5) & (i == 2)}
    return parts.select("table_id", "index_id").distinct().withColumns(flags), parts, cols.where("scale = table_id % 4").select("table_id", F.lower("name").alias("name"))


@query(f"""WITH {INDEXES}, a AS (SELECT table_id, index_id, string_agg(name, ',' ORDER BY name) AS names FROM ic GROUP BY 1, 2), w AS (SELECT table_id, string_agg(name, ',' ORDER BY name) AS names FROM wanted GROUP BY 1)
SELECT table_id, index_id FROM a JOIN w USING (table_id, names) JOIN ix USING (table_id, index_id) WHERE is_unique AND valid AND immediate AND NOT partial AND NOT expressions""")
def q_arbiters(s: SparkSession, sf: str) -> DataFrame:
    """Indexes on exactly the wanted key that an upsert can rely on."""
    return targets.arbiters(*indexes(s, sf), ["table_id"])


@query("""WITH k AS (SELECT 'S' || l_suppkey % 3 AS schema, 'Tab' || l_suppkey AS name, l_orderkey || '/' || l_partkey AS key FROM lineitem), t AS (SELECT DISTINCT schema, name FROM k),
taken AS (SELECT schema, lower(name) || '_pkey' AS relation FROM t WHERE CAST(substr(name, 4) AS INTEGER) % 5 = 0 UNION ALL SELECT schema, lower(name) || '_m_pkey' FROM t WHERE CAST(substr(name, 4) AS INTEGER) % 10 = 0),
dup AS (SELECT schema, name, key, row_number() OVER (PARTITION BY schema, name ORDER BY key) AS r FROM k GROUP BY 1, 2, 3 HAVING count(*) > 1), e AS (SELECT schema, name, string_agg(key, ', ' ORDER BY key) AS examples FROM dup WHERE r <= 5 GROUP BY 1, 2),
n AS (SELECT t.schema, t.name, examples, CASE WHEN a.relation IS NULL THEN lower(t.name) || '_pkey' WHEN b.relation IS NULL THEN lower(t.name) || '_m_pkey' END AS relation FROM t LEFT JOIN e USING (schema, name) LEFT JOIN taken a ON a.schema = t.schema AND a.relation = lower(t.name) || '_pkey' LEFT JOIN taken b ON b.schema = t.schema AND b.relation = lower(t.name) || '_m_pkey'),
f AS (SELECT *, CASE WHEN examples IS NOT NULL THEN 'keys with more than one row: ' || examples WHEN relation IS NULL THEN 'no free name for the key' END AS refused FROM n)
SELECT schema, name, refused, CASE WHEN refused IS NULL THEN 'CREATE UNIQUE INDEX CONCURRENTLY "' || relation || '" ON "' || schema || '"."' || name || '" ("k")' END AS build, CASE WHEN refused IS NULL THEN 'ALTER TABLE "' || schema || '"."' || name || '" ADD CONSTRAINT "' || relation || '" PRIMARY KEY USING INDEX "' || relation || '"' END AS promote FROM f""")
def q_key_promotions(s: SparkSession, sf: str) -> DataFrame:
    """What settling ends with: duplicate keys named, or the key's statements under a free name."""
    line = table(s, sf, "lineitem")
    keys = line.select(F.concat(F.lit("S"), (F.col("l_suppkey") % 3).cast("string")).alias("schema"), F.concat(F.lit("Tab"), F.col("l_suppkey").cast("string")).alias("name"), F.concat_ws("/", "l_orderkey", "l_partkey").alias("key"))
    tables = keys.select("schema", "name").distinct().withColumn("columns", F.lit('"k"'))
    number = F.substring("name", 4, 20).cast("int")
    taken = [tables.where(number % m == 0).select("schema", F.concat(F.lower("name"), F.lit(end)).alias("relation")) for m, end in ((5, "_pkey"), (10, "_m_pkey"))]
    return targets.promotions(keys, tables, taken[0].unionByName(taken[1]))


@query(f"""WITH {d.COLUMNS}, k AS (SELECT DISTINCT table_id, position, name FROM cols WHERE scale = 0 AND position % 6 <> 5),
i AS (SELECT table_id, scale, string_agg(DISTINCT name, ', ' ORDER BY name) AS columns FROM cols WHERE scale > 1 GROUP BY 1, 2)
SELECT 'App' AS schema, 'T' || table_id AS name, 'ALTER TABLE "App"."T' || table_id || '" ADD CONSTRAINT "pk_t' || table_id || '" PRIMARY KEY (' || string_agg('"' || lower(name) || '"', ', ' ORDER BY position, lower(name)) || ');' AS statement FROM k GROUP BY table_id
UNION ALL SELECT 'App', 'T' || table_id, 'CREATE ' || CASE WHEN scale = 2 THEN 'UNIQUE INDEX' ELSE 'INDEX' END || ' "idx_t' || table_id || '_i' || scale || '" ON "App"."T' || table_id || '" ("' || replace(lower(columns), ', ', '", "') || '");' FROM i""")
def q_key_and_index_text(s: SparkSession, sf: str) -> DataFrame:
    """Statements for primary keys and indexes, names in lower case."""
    cols = d.columns(s, sf).select(F.lit("App").alias("schema"), F.concat(F.lit("T"), F.col("table_id").cast("string")).alias("name"), "position", F.col("name").alias("column"), "scale")
    parts = cols.groupBy("schema", "name", "scale").agg(F.array_join(F.sort_array(F.collect_set("column")), ", ").alias("columns")).where("scale > 1")
    indexes = parts.select("schema", "name", F.concat(F.lit("I"), F.col("scale").cast("string")).alias("index"), (F.col("scale") == 2).alias("is_unique"), "columns")
    keys = cols.select("schema", "name", "position", "column", (F.col("scale") == 0).alias("is_key"), (F.col("position") % 6 == 5).alias("excluded")).distinct()
    return targets.key_and_index_text(keys, indexes)


@query(f"""WITH {d.COLUMNS}, g AS (SELECT table_id, lower(name) AS folded, string_agg(DISTINCT '"' || name || '"', ' and ' ORDER BY '"' || name || '"') AS names FROM cols GROUP BY 1, 2 HAVING count(DISTINCT name) > 1)
SELECT table_id, string_agg(names || ' would all be "' || folded || '"', '; ' ORDER BY folded) AS message FROM g GROUP BY 1""")
def q_collision_messages(s: SparkSession, sf: str) -> DataFrame:
    """Columns that become one once their names are in lower case, table by table."""
    return targets.collision_message(d.columns(s, sf), ["table_id"], "name")


@query(f"""WITH {c.DIFF} SELECT j.table_id, j.name, r.verdict AS severity, 'column "' || j.name || '" needs ' || j.want_type || ', the destination has ' || j.live_type AS message FROM j JOIN compat r ON r.want_type = j.want_type AND r.live_type = j.live_type WHERE r.verdict <> 'ok'""")
def q_type_messages(s: SparkSession, sf: str) -> DataFrame:
    """Columns whose types do not fit, in words."""
    manifest, live = c.manifest_and_live(s, sf)
    both = manifest.select("table_id", "name", F.col("type").alias("want_type")).join(live.select("table_id", "name", F.col("type").alias("live_type")), ["table_id", "name"])
    return targets.type_messages(both).select("table_id", "name", "severity", "message")


@query(f"""WITH {c.MAPPED}, t AS (SELECT o_orderkey AS table_id, 'T' || o_orderkey AS name, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS rows, CAST(round(o_totalprice) AS BIGINT) AS bytes, o_orderkey % 2 = 0 AS is_estimate, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 2 END AS lob_bytes FROM orders),
l AS (SELECT table_id, count(*) AS columns, string_agg(position || ' ' || name || ' ' || source_type || ' ' || want_type || CASE WHEN nullable THEN ' null' ELSE '' END, ', ' ORDER BY position, name, source_type, want_type, nullable) AS listed FROM mapped GROUP BY 1)
SELECT t.table_id, name, true AS included, rows, bytes, is_estimate, coalesce(lob_bytes > 0, false) AS has_lobs, coalesce(CAST(columns AS INTEGER), 0) AS n_columns, listed FROM t LEFT JOIN l USING (table_id)""")
def q_new_selection(s: SparkSession, sf: str) -> DataFrame:
    """A selection made from a scan: tables (orders) with their figures, columns (lines) with mapped types."""
    k = F.col("o_orderkey")
    tables = table(s, sf, "orders").select(
        k.alias("table_id"), F.concat(F.lit("T"), k.cast("string")).alias("name"), F.when(k % 3 != 0, F.col("o_custkey")).alias("rows"), F.round("o_totalprice").cast("long").alias("bytes"),
        (k % 2 == 0).alias("is_estimate"), F.when(k % 5 != 0, F.col("o_custkey") % 2).alias("lob_bytes"),
    )
    text = F.transform("columns", lambda x: F.concat(x["position"].cast("string"), F.lit(" "), x["name"], F.lit(" "), x["source_type"], F.lit(" "), x["target_type"], F.when(x["nullable"], " null").otherwise("")))
    return targets.selection(tables, d.columns(s, sf)).withColumns({"n_columns": F.coalesce(F.size("columns"), F.lit(0)), "listed": F.array_join(text, ", ")}).drop("columns")


@query("""WITH cons AS (SELECT p_partkey AS constraint_id, p_partkey // 2 AS table_id, CASE p_size % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'U' ELSE 'R' END AS kind, CASE WHEN p_size % 3 = 2 THEN p_partkey // 4 END AS refers_to FROM part)
SELECT DISTINCT r.table_id AS child, k.table_id AS parent FROM cons r JOIN cons k ON r.refers_to = k.constraint_id WHERE r.kind = 'R' AND k.kind IN ('P', 'U') AND r.table_id <> k.table_id""")
def q_foreign_keys(s: SparkSession, sf: str) -> DataFrame:
    """Pairs of child and parent tables from a table of constraints."""
    k = F.col("p_size") % 3
    constraints = table(s, sf, "part").select(F.col("p_partkey").alias("constraint_id"), F.expr("p_partkey div 2").alias("table_id"), F.when(k == 0, "P").when(k == 1, "U").otherwise("R").alias("kind"), F.when(k == 2, F.expr("p_partkey div 4")).alias("refers_to"))
    return targets.foreign_keys(constraints)


# --- scans -------------------------------------------------------------------

SCAN = """tabs AS (SELECT p_partkey AS table_id, upper(p_brand) AS owner, 'T' || p_partkey AS name, CASE p_size % 5 WHEN 0 THEN 'IOT' WHEN 1 THEN 'IOT_OVERFLOW' END AS iot_type, p_size = 7 AS nested, CASE WHEN p_size % 11 <> 0 THEN p_size % 11 = 1 END AS dropped, p_type = 'ECONOMY' AS temporary FROM part)"""
OFFERED = "NOT nested AND NOT coalesce(dropped, false) AND NOT temporary AND (iot_type IS NULL OR iot_type = 'IOT')"


def scan_tables(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size")
    return table(s, sf, "part").select(
        F.col("p_partkey").alias("table_id"), F.upper("p_brand").alias("owner"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("name"), F.when(k % 5 == 0, "IOT").when(k % 5 == 1, "IOT_OVERFLOW").alias("iot_type"),
        (k == 7).alias("nested"), F.when(k % 11 != 0, k % 11 == 1).alias("dropped"), (F.col("p_type") == "ECONOMY").alias("temporary"),
    )


@query(f"WITH {SCAN} SELECT owner, name FROM tabs WHERE {OFFERED} AND owner = 'BRAND#2'")
def q_offered_tables(s: SparkSession, sf: str) -> DataFrame:
    """Tables of one owner that can be copied."""
    return scan.offered_tables(scan_tables(s, sf), "brand#2").select("owner", "name")


@query(f"""WITH {SCAN}, w AS (SELECT DISTINCT upper(p_brand) AS owner, 'T' || l_partkey AS name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 48),
c AS (SELECT l_partkey AS table_id, string_agg(l_linenumber || ' ' || l_returnflag || ' ' || l_linestatus, ', ' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS listed, count(*) AS n FROM lineitem GROUP BY 1)
SELECT owner, name, CAST(coalesce(n, 0) AS INTEGER) AS n_columns, coalesce(listed, '') AS listed FROM tabs LEFT JOIN c USING (table_id) WHERE {OFFERED} AND (owner, name) IN (SELECT (owner, name) FROM w)""")
def q_targeted_scan(s: SparkSession, sf: str) -> DataFrame:
    """A scan of the tables asked for, with their columns."""
    tables = scan_tables(s, sf)
    line = table(s, sf, "lineitem").select(F.col("l_partkey").alias("table_id"), F.col("l_linenumber").cast("long").alias("position"), F.col("l_returnflag").alias("column"), F.col("l_linestatus").alias("source_type"), "l_quantity")
    placed = line.join(tables.select("table_id", "owner", "name"), "table_id")
    wanted = placed.where("l_quantity > 48").select(F.lower("owner").alias("owner"), F.lower("name").alias("name"))
    found = scan.with_columns(scan.offered_tables(tables, wanted=wanted), placed.select("owner", "name", "position", "column", "source_type"))
    text = F.array_join(F.transform("columns", lambda x: F.concat_ws(" ", x["position"].cast("string"), x["column"], x["source_type"])), ", ")
    return found.select("owner", "name", F.size("columns").alias("n_columns"), text.alias("listed"))


@query(f"""WITH {d.COLUMNS}, con AS (SELECT DISTINCT table_id, table_id * 10 AS constraint_id, table_id % 7 <> 0 AS enforced FROM cols WHERE table_id % 5 <> 0),
kc AS (SELECT DISTINCT table_id * 10 AS constraint_id, position, name FROM cols WHERE scale = 1 OR position = 1), x AS (SELECT table_id, name, min(source_type) AS source_type FROM cols WHERE position <> 6 GROUP BY 1, 2),
p AS (SELECT con.table_id, enforced, kc.position, kc.name, source_type FROM con JOIN kc USING (constraint_id) JOIN x ON x.table_id = con.table_id AND x.name = kc.name),
g AS (SELECT table_id, bool_and(enforced) AS enforced, count(*) AS n, string_agg(name, ',' ORDER BY position, name) AS key, min(name) AS one, min(source_type) AS kind, bool_and(source_type IN ('NUMBER', 'VARCHAR2', 'CHAR', 'DATE', 'RAW')) AS readable FROM p GROUP BY 1)
SELECT t.table_id, key, CASE WHEN n = 1 AND kind IN ('NUMBER', 'FLOAT', 'BINARY_FLOAT', 'BINARY_DOUBLE') THEN one END AS split_by, CASE WHEN g.table_id IS NULL THEN 'no primary key' WHEN NOT enforced THEN 'the key is not enforced' WHEN NOT readable THEN 'a key column cannot be read from the history' END AS problem
FROM (SELECT DISTINCT table_id FROM cols) t LEFT JOIN g USING (table_id)""")
def q_enforced_keys(s: SparkSession, sf: str) -> DataFrame:
    """Primary keys from constraints, their columns and the tables' columns."""
    cols = d.columns(s, sf)
    constraints = cols.where("table_id % 5 <> 0").select("table_id", (F.col("table_id") * 10).alias("constraint_id"), F.lit("P").alias("kind"), (F.col("table_id") % 7 != 0).alias("enabled"), F.lit(True).alias("validated")).distinct()
    parts = cols.where("scale = 1 or position = 1").select((F.col("table_id") * 10).alias("constraint_id"), "position", F.col("name").alias("column")).distinct()
    seen = cols.where("position <> 6").groupBy("table_id", F.col("name").alias("column")).agg(F.min("source_type").alias("source_type"))
    return scan.enforced_keys(cols, constraints, parts, seen)


@query("""WITH l AS (SELECT event_id // 20 AS group_id, user_id % 4 AS thread, event_id // 20 AS sequence, event_id // 20 * 20 AS first_scn, event_id // 20 * 20 + 20 AS next_scn, CASE WHEN event_id // 20 = 3 THEN 'CURRENT' ELSE 'ACTIVE' END AS status FROM events),
f AS (SELECT event_id // 20 AS group_id, min('log' || event_id) AS member FROM events WHERE event_type <> 'error' GROUP BY 1), w AS (SELECT 900 AS low, (SELECT max(event_id) - 500 FROM events) AS high)
SELECT thread, sequence, first_scn, next_scn, min(member) AS member FROM l JOIN f USING (group_id), w WHERE first_scn <= high AND (next_scn > low OR status = 'CURRENT') GROUP BY 1, 2, 3, 4""")
def q_online_logs(s: SparkSession, sf: str) -> DataFrame:
    """Online logs that hold a stretch of positions, each with its first member."""
    events, n = table(s, sf, "events"), F.expr("event_id div 20")
    logs = events.select(n.alias("group_id"), (F.col("user_id") % 4).alias("thread"), n.alias("sequence"), (n * 20).alias("first_scn"), (n * 20 + 20).alias("next_scn"), F.when(n == 3, "CURRENT").otherwise("ACTIVE").alias("status"))
    files = events.select(n.alias("group_id"), F.when(F.col("event_type") == "error", "STANDBY").otherwise("ONLINE").alias("kind"), F.concat(F.lit("log"), F.col("event_id").cast("string")).alias("member"))
    return scan.online_logs(logs, files, F.lit(900), F.lit(events.agg(F.max("event_id")).first()[0] - 500))


@query("""WITH t AS (SELECT o_custkey AS table_id, max(o_orderkey) AS from_scn FROM orders GROUP BY 1), pl AS (SELECT DISTINCT o_custkey AS table_id, o_orderkey % 300 AS space FROM orders),
m AS (SELECT l_suppkey % 300 AS space, max(CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS mark FROM lineitem GROUP BY 1), u AS (SELECT table_id, max(mark) AS marked_at FROM pl JOIN m USING (space) GROUP BY 1),
n AS (SELECT o_custkey, max(o_orderkey) AS data_id FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT table_id, CASE WHEN n.o_custkey IS NULL THEN 'dropped' WHEN n.data_id <> from_scn THEN 'truncated or moved' WHEN marked_at > from_scn THEN 'written without logging' END AS stopped FROM t LEFT JOIN n ON n.o_custkey = table_id LEFT JOIN u USING (table_id)""")
def q_stopped_tables(s: SparkSession, sf: str) -> DataFrame:
    """Tables that stop before their log is read: objects that drifted, or writes without logging."""
    orders = table(s, sf, "orders").select(F.col("o_custkey").alias("table_id"), "o_orderkey")
    tables = orders.groupBy("table_id").agg(F.max("o_orderkey").alias("from_scn"))
    places = orders.select("table_id", (F.col("o_orderkey") % 300).alias("space"))
    files = table(s, sf, "lineitem").select((F.col("l_suppkey") % 300).alias("space"), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("unlogged_scn"))
    now = orders.where("o_orderkey % 3 <> 0").groupBy(F.col("table_id").alias("object_id")).agg(F.max("o_orderkey").alias("data_id"))
    drift = cdc.object_drift(tables.select(F.col("table_id").alias("object_id"), F.col("from_scn").alias("data_id")), now).withColumnRenamed("object_id", "table_id")
    return scan.stops(tables, drift, scan.unlogged_writes(tables, places, files))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN coalesce(CAST(CASE WHEN event_id % 5 <> 0 THEN user_id END AS VARCHAR), 'null') || '/' || event_type END AS key FROM events""")
def q_present_keys(s: SparkSession, sf: str) -> DataFrame:
    """Keys of records that hold all key columns, nulls among them; the other records have none."""
    k = F.col("event_id")
    full = F.to_json(F.struct(F.when(k % 5 != 0, F.col("user_id")).alias("user_id"), "event_type", "value"), {"ignoreNullFields": "false"})
    image = F.when(k % 3 != 0, full).otherwise(F.to_json(F.struct("event_type", "value")))
    key = scan.present_key(["user_id", "event_type"], image)
    return table(s, sf, "events").select("event_id", F.when(key.isNotNull(), F.array_join(key, "/", "null")).alias("key"))


# --- runs --------------------------------------------------------------------


@query("""WITH r AS (SELECT o_custkey AS run_id, 'S' || o_custkey % 12 AS schema, o_custkey % 17 <> 0 AS can_read, CASE WHEN o_custkey % 19 <> 0 THEN 12 + o_custkey % 6 END AS version FROM (SELECT DISTINCT o_custkey FROM orders)),
sc AS (SELECT 'S' || n_nationkey AS schema, n_nationkey <> 5 AS can_use, n_nationkey % 2 = 0 AS can_create FROM nation WHERE n_nationkey <> 9), w AS (SELECT DISTINCT o_custkey AS run_id, 'p' || o_orderkey % 500 AS name FROM orders), e AS (SELECT DISTINCT 'S' || p_partkey % 12 AS schema, 'p' || p_partkey AS name FROM part),
m AS (SELECT run_id, name FROM w JOIN r USING (run_id) ANTI JOIN e USING (schema, name)), x AS (SELECT run_id, count(*) AS missing, list(name ORDER BY name) AS names FROM m GROUP BY 1),
j AS (SELECT run_id, can_read, version, coalesce(can_use, false) AS u, coalesce(can_create, false) AS c, coalesce(missing, 0) AS missing, names FROM r LEFT JOIN sc USING (schema) LEFT JOIN x USING (run_id)),
f AS (SELECT run_id, missing, c, concat_ws('; ', CASE WHEN NOT can_read THEN 'the source cannot be read' END, CASE WHEN NOT coalesce(version >= 14, false) THEN 'the destination is older than 14' END, CASE WHEN NOT u THEN 'the schema cannot be used' END,
 CASE WHEN NOT c AND missing > 0 THEN 'tables must be made: ' || array_to_string(names[1:10], ', ') || CASE WHEN missing > 10 THEN ', ...' ELSE '' END END) AS failed FROM j)
SELECT run_id, failed = '' AS passed, failed, missing, CASE WHEN NOT c AND missing = 0 THEN 'no tables can be made here, and none need to be' END AS warning FROM f""")
def q_run_preflight(s: SparkSession, sf: str) -> DataFrame:
    """What stops a run before it starts; tables need only be made where some are missing."""
    k, orders = F.col("o_custkey"), table(s, sf, "orders")
    named = lambda n: F.concat(F.lit("S"), n.cast("string"))
    made = orders.select(k).distinct().select(k.alias("run_id"), named(k % 12).alias("schema"), (k % 17 != 0).alias("can_read"), F.when(k % 19 != 0, k % 6 + 12).alias("version"))
    n = F.col("n_nationkey")
    schemas = table(s, sf, "nation").where(n != 9).select(named(n).alias("schema"), (n != 5).alias("can_use"), (n % 2 == 0).alias("can_create"))
    wanted = orders.select(k.alias("run_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 500).cast("string")).alias("name"))
    existing = table(s, sf, "part").select(named(F.col("p_partkey") % 12).alias("schema"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return runs.preflight(made, schemas, wanted, existing)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) AS rows, CAST(round(l_extendedprice) AS BIGINT) * l_suppkey AS bytes, l_partkey * 7 % 5000 AS e, CASE WHEN l_partkey % 9 <> 0 THEN l_partkey * 7 % 5000 // 3 END AS a, l_partkey * 7 % 5000 // 4 AS z FROM lineitem)
SELECT l_orderkey, rows * 1000.0::DOUBLE / greatest(e, 1) AS rows_per_s, bytes * 1000.0::DOUBLE / 1048576 / greatest(e, 1) AS mb_per_s, CAST(floor(coalesce(a, 0) * 100.0::DOUBLE / greatest(e, 1) + 0.5) AS INTEGER) AS source_share, CAST(floor(z * 100.0::DOUBLE / greatest(e, 1) + 0.5) AS INTEGER) AS target_share FROM b""")
def q_batch_rates(s: SparkSession, sf: str) -> DataFrame:
    """Speed of each batch and its shares of waiting."""
    took, rows = F.expr("l_partkey * 7 % 5000"), F.round("l_extendedprice").cast("long")
    batches = table(s, sf, "lineitem").select(
        "l_orderkey", rows.alias("rows"), (rows * F.col("l_suppkey")).alias("bytes"), took.alias("elapsed_ms"), F.when(F.col("l_partkey") % 9 != 0, F.expr("(l_partkey * 7 % 5000) div 3")).alias("source_ms"), F.expr("(l_partkey * 7 % 5000) div 4").alias("target_ms")
    )
    return runs.batch_rates(batches).select("l_orderkey", "rows_per_s", "mb_per_s", "source_share", "target_share")


@query("SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def q_last_run(s: SparkSession, sf: str) -> DataFrame:
    """The run made last."""
    return runs.last_run(table(s, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at")))


@query("""WITH t AS (SELECT c_custkey AS table_id, c_custkey * 5 AS start_scn, 'ready' AS state FROM customer WHERE c_custkey % 3 <> 0), f AS (SELECT o_custkey AS table_id, max(o_orderkey) AS start_scn FROM orders WHERE o_custkey % 4 <> 1 GROUP BY 1),
n AS (SELECT table_id, start_scn, CASE WHEN start_scn % 5 = 0 THEN 'no key' END AS reason FROM f)
SELECT coalesce(t.table_id, n.table_id) AS table_id, CASE WHEN n.table_id IS NOT NULL AND reason IS NULL THEN n.start_scn ELSE t.start_scn END AS start_scn, CASE WHEN n.table_id IS NULL THEN t.state ELSE coalesce(reason, 'needs_first_sync') END AS state,
 CASE WHEN n.table_id IS NULL THEN 'kept' WHEN reason IS NOT NULL THEN 'refused' WHEN t.table_id IS NULL THEN 'added' ELSE 'restarted' END AS action FROM t FULL JOIN n ON n.table_id = t.table_id""")
def q_registered_trackers(s: SparkSession, sf: str) -> DataFrame:
    """Trackers after bulk copies: added, restarted, refused or kept."""
    held = table(s, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("table_id"), (F.col("c_custkey") * 5).alias("start_scn"), F.lit("ready").alias("state"))
    fresh = table(s, sf, "orders").where("o_custkey % 4 <> 1").select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("start_scn"), F.when(F.col("o_orderkey") % 5 == 0, "no key").alias("reason"))
    return runs.registered(held, fresh, ["table_id"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance ASC NULLS LAST, c_custkey")
def q_sort_ascending(s: SparkSession, sf: str) -> DataFrame:
    """Rows by a figure, smallest first, unknown ones last."""
    df = table(s, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"))
    return runs.sorted_known_first(df, "balance", False, "c_custkey")
