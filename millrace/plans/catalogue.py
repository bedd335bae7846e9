"""The registered queries: each applies an operator to the given tables, beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import types, values
from millrace.operators import cdc, monitor, planning, schema
from millrace.plans import derived as d
from millrace.sources.tables import table
from millrace.sources.writer import missing_chunks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- bulk copy ---------------------------------------------------------------


@query("""SELECT o_orderkey, o_custkey, nullif(replace(o_orderstatus, chr(0), ''), '') AS o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice,
date_trunc('second', o_orderdate) AS o_orderdate FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'""")
def q_bulk_copy_orders(s: SparkSession, sf: str) -> DataFrame:
    kept = table(s, sf, "orders").where(values.checked_filter("o_totalprice > 1000 AND o_orderstatus <> 'P'")).drop("o_orderpriority")
    out = values.normalise_strings(kept)
    return out.withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(12,2)"), "o_orderdate": F.date_trunc("second", "o_orderdate").cast("timestamp_ntz")})


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def q_project_exclude(s: SparkSession, sf: str) -> DataFrame:
    excluded = {"c_name", "c_acctbal"}
    df = table(s, sf, "customer")
    return df.select([c for c in df.columns if c not in excluded])


@query('SELECT s_suppkey AS "suppkey", s_name AS "name", s_nationkey AS "nationkey", s_acctbal AS "acctbal" FROM supplier')
def q_rename_lower(s: SparkSession, sf: str) -> DataFrame:
    df = table(s, sf, "supplier")
    return df.withColumnsRenamed({c: c.lower().removeprefix("s_") for c in df.columns})


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity < 24 AND l_discount > 0.05)")
def q_row_filter(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "lineitem").where(values.checked_filter("l_quantity < 24 AND l_discount > 0.05")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT doc_id, length(nullif(replace(t, chr(0), ''), '')) AS n, nullif(replace(t, chr(0), ''), '') IS NULL AS missing FROM (
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN chr(0) WHEN doc_id % 5 = 2 THEN NULL ELSE chr(0) || text END AS t FROM documents)""")
def q_normalize(s: SparkSession, sf: str) -> DataFrame:
    nul = F.char(F.lit(0))
    dirty = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, nul).when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise(F.concat(nul, "text"))
    clean = values.normalised(dirty)
    return table(s, sf, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), clean.isNull().alias("missing"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS line, CAST(l_quantity AS DECIMAL(10,0)) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
CAST(l_discount AS FLOAT) AS discount FROM lineitem""")
def q_coerce_types(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("smallint").alias("line"), F.col("l_quantity").cast("decimal(10,0)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"), F.col("l_discount").cast("float").alias("discount"),
    )


@query("SELECT c_custkey, CAST(8 + length(c_name) + 4 + 8 + length(c_mktsegment) AS BIGINT) AS row_bytes FROM customer")
def q_row_bytes(s: SparkSession, sf: str) -> DataFrame:
    df = table(s, sf, "customer")
    return df.select("c_custkey", values.row_bytes(df).alias("row_bytes"))


@query("SELECT count(*) AS source_rows FROM orders WHERE o_orderstatus = 'O'")
def q_count_source(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "orders").where(values.checked_filter("o_orderstatus = 'O'")).agg(F.count("*").alias("source_rows"))


@query(f"WITH {d.CDC} SELECT count(*) AS target_rows FROM tgt")
def q_count_target(s: SparkSession, sf: str) -> DataFrame:
    return d.change_target(s, sf).agg(F.count("*").alias("target_rows"))


@query(f"""WITH {d.CDC}, one AS (SELECT * FROM src WHERE o_orderkey % 10 <> 3), two AS (SELECT * FROM tgt WHERE o_orderkey % 10 <> 4)
SELECT coalesce(a.k, b.k) AS o_part, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows, coalesce(a.n, 0) = coalesce(b.n, 0) AS passed
FROM (SELECT o_orderkey % 10 AS k, count(*) n FROM one GROUP BY 1) a FULL JOIN (SELECT o_orderkey % 10 AS k, count(*) n FROM two GROUP BY 1) b ON a.k = b.k""")
def q_validate_rowcount(s: SparkSession, sf: str) -> DataFrame:
    """One part is missing on either side."""
    part = (F.col("o_orderkey") % 10).alias("o_part")
    source, target = d.change_source(s, sf).select("*", part).where("o_part <> 3"), d.change_target(s, sf).select("*", part).where("o_part <> 4")
    return monitor.validated_counts(source, target, ["o_part"])


@query(f"WITH {d.CHUNKS} SELECT chunk_id, run_id FROM chunks c ANTI JOIN (SELECT chunk_id FROM chunks WHERE status = 'Done') f USING (chunk_id)")
def q_fence_skip_done(s: SparkSession, sf: str) -> DataFrame:
    chunks = d.chunks(s, sf)
    return missing_chunks(chunks.select("chunk_id", "run_id"), chunks.where("status = 'Done'").select("chunk_id"))


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_shipdate IS NULL) AS null_dates, min(l_quantity) AS min_quantity, max(l_quantity) AS max_quantity,
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS sum_price, count(DISTINCT l_partkey) AS parts FROM lineitem""")
def q_deep_column_stats(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "lineitem").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_shipdate").isNull()).alias("null_dates"), F.min("l_quantity").alias("min_quantity"), F.max("l_quantity").alias("max_quantity"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,2)").alias("sum_price"), F.countDistinct("l_partkey").alias("parts"),
    )


@query(f"""WITH {d.CDC} SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.h IS NULL THEN 'extra' WHEN b.h IS NULL THEN 'missing' ELSE 'differs' END AS finding
FROM (SELECT o_orderkey, md5(concat_ws('|', o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR))) h FROM src) a
FULL JOIN (SELECT o_orderkey, md5(concat_ws('|', o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR))) h FROM tgt) b USING (o_orderkey) WHERE a.h IS DISTINCT FROM b.h""")
def q_deep_row_hash(s: SparkSession, sf: str) -> DataFrame:
    h = F.md5(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderstatus", F.col("o_totalprice").cast("decimal(14,2)").cast("string")))
    a = d.change_source(s, sf).select("o_orderkey", h.alias("a"))
    b = d.change_target(s, sf).select("o_orderkey", h.alias("b"))
    found = a.join(b, "o_orderkey", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return found.select("o_orderkey", F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("differs").alias("finding"))


# --- chunk plans -------------------------------------------------------------


@query("SELECT CAST(CASE WHEN o_orderkey <= 3000 THEN 0 WHEN o_orderkey <= 6000 THEN 1 WHEN o_orderkey <= 9000 THEN 2 ELSE 3 END AS INTEGER) AS chunk, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def q_chunk_pk_range(s: SparkSession, sf: str) -> DataFrame:
    chunk = F.lit(3)
    for i, bound in ((2, 9000), (1, 6000), (0, 3000)):
        chunk = F.when(F.col("o_orderkey") <= bound, i).otherwise(chunk)
    return table(s, sf, "orders").groupBy(chunk.alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("SELECT CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 16 AS INTEGER) AS bucket, count(*) AS n FROM orders GROUP BY 1")
def q_chunk_hash_bucket(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "orders").groupBy(planning.hash_bucket(F.col("o_orderkey"), 16, portable=True).alias("bucket")).agg(F.count("*").alias("n"))


NTILE = "b AS (SELECT CAST(bucket AS INTEGER) AS bucket, max(o_orderkey) AS bound FROM (SELECT o_orderkey, ntile(12) OVER (ORDER BY o_orderkey) AS bucket FROM orders) GROUP BY 1)"


@query(f"WITH {NTILE} SELECT * FROM b")
def q_ntile_bounds(s: SparkSession, sf: str) -> DataFrame:
    return planning.ntile_bounds(table(s, sf, "orders"), "o_orderkey", 12)


@query(f"WITH {NTILE} SELECT bucket - 1 AS chunk, lag(bound) OVER (ORDER BY bucket) AS low, CASE WHEN bucket = max(bucket) OVER () THEN NULL ELSE bound END AS high FROM b")
def q_chunk_plan(s: SparkSession, sf: str) -> DataFrame:
    return planning.key_ranges(planning.ntile_bounds(table(s, sf, "orders"), "o_orderkey", 12))


@query("""WITH RECURSIVE e AS (SELECT l_orderkey % 500 AS object_id, l_orderkey * 8 + l_linenumber AS position, CAST(round(l_quantity) AS BIGINT) AS blocks FROM lineitem),
x AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY position, blocks) AS r, ceil(sum(blocks) OVER (PARTITION BY object_id) / 8.0) AS target FROM e),
f AS (SELECT object_id, r, position, 0 AS chunk, blocks AS held, target FROM x WHERE r = 1
 UNION ALL SELECT x.object_id, x.r, x.position, CASE WHEN f.held >= f.target THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.held >= f.target THEN x.blocks ELSE f.held + x.blocks END, x.target FROM f JOIN x ON x.object_id = f.object_id AND x.r = f.r + 1)
SELECT object_id, chunk, min(position) AS first, max(position) AS last, max(held) AS blocks FROM f GROUP BY 1, 2""")
def q_coalesce_extents(s: SparkSession, sf: str) -> DataFrame:
    extents = table(s, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("object_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), F.round("l_quantity").cast("long").alias("blocks"))
    return planning.coalesce_extents(extents, ["object_id"], 8)


@query(f"""WITH {d.CHUNKS} SELECT run_id, CAST(CASE WHEN run_id % 7 = 0 THEN 16 ELSE least(greatest(ceil(sum(rows) * 1000 / CASE WHEN run_id % 2 = 0 THEN 25000.0 ELSE 200000.0 END), 1), 2000) END AS INTEGER) AS batches
FROM chunks GROUP BY run_id""")
def q_batch_count(s: SparkSession, sf: str) -> DataFrame:
    runs = d.chunks(s, sf).groupBy("run_id").agg(F.sum("rows").alias("rows"))
    known = F.when(F.col("run_id") % 7 != 0, F.col("rows") * 1000)
    return runs.select("run_id", planning.batch_count(known, F.col("run_id") % 2 == 0).alias("batches"))


# --- types, names, schemas ---------------------------------------------------

MAPPED = f"""{d.COLUMNS}, mapped AS (SELECT *, CASE
 WHEN source_type IN ('VARCHAR2','NVARCHAR2') THEN CASE WHEN length > 0 THEN 'varchar(' || length || ')' ELSE 'text' END
 WHEN source_type = 'CHAR' THEN CASE WHEN length > 0 THEN 'char(' || length || ')' ELSE 'text' END
 WHEN source_type IN ('CLOB','LONG') THEN 'text'
 WHEN source_type = 'NUMBER' THEN CASE WHEN precision IS NULL THEN 'numeric' WHEN scale = 0 THEN CASE WHEN precision <= 4 THEN 'smallint' WHEN precision <= 9 THEN 'integer' WHEN precision <= 18 THEN 'bigint' ELSE 'numeric(' || precision || ')' END ELSE 'numeric(' || precision || ', ' || scale || ')' END
 WHEN source_type = 'DATE' THEN 'timestamp(0) without time zone' WHEN source_type = 'TIMESTAMP' THEN 'timestamp without time zone'
 WHEN source_type = 'TIMESTAMP(6) WITH TIME ZONE' THEN 'timestamp with time zone' WHEN source_type IN ('BLOB','RAW','BFILE') THEN 'bytea'
 WHEN source_type = 'BINARY_FLOAT' THEN 'real' WHEN source_type = 'FLOAT' THEN 'double precision' WHEN source_type = 'ROWID' THEN 'varchar(4000)'
 WHEN source_type = 'XMLTYPE' THEN 'xml' WHEN source_type = 'INTERVAL DAY(2) TO SECOND(6)' THEN 'interval' ELSE 'text' END AS want_type FROM cols)"""


def base_sql(c: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(lower({c}), '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g'))"
    return "CASE " + plain + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in types.ALIASES.items()) + f" ELSE {plain} END"


def family_sql(base: str) -> str:
    return f"CASE {base} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in types.FAMILIES.items()) + " ELSE 'unknown' END"


def judged_sql(pairs: str) -> str:
    """CTEs ``based``, ``fam`` and ``compat`` over a table with ``want_type`` and ``live_type``."""
    return f"""based AS (SELECT *, {base_sql('want_type')} AS wb, {base_sql('live_type')} AS lb,
 TRY_CAST(nullif(regexp_extract(want_type, '\\(\\s*(\\d+)', 1), '') AS INTEGER) AS a1, TRY_CAST(nullif(regexp_extract(want_type, '\\(\\s*\\d+\\s*,\\s*(\\d+)', 1), '') AS INTEGER) AS a2,
 TRY_CAST(nullif(regexp_extract(live_type, '\\(\\s*(\\d+)', 1), '') AS INTEGER) AS b1, TRY_CAST(nullif(regexp_extract(live_type, '\\(\\s*\\d+\\s*,\\s*(\\d+)', 1), '') AS INTEGER) AS b2 FROM {pairs}),
fam AS (SELECT *, {family_sql('wb')} AS wf, {family_sql('lb')} AS lf FROM based),
compat AS (SELECT *, CASE WHEN lf = 'unknown' OR wf = 'unknown' THEN 'block'
 WHEN wf = 'string' OR (wf = 'xml' AND lf <> 'xml') THEN CASE WHEN lf <> 'string' THEN 'block' WHEN b1 IS NOT NULL AND (wf = 'xml' OR a1 IS NULL OR a1 > b1) THEN 'block' WHEN lb = 'character' THEN 'warn' ELSE 'ok' END
 WHEN wf IN ('integer','float') THEN CASE WHEN wb = lb THEN 'ok' ELSE 'block' END
 WHEN wf = 'numeric' THEN CASE WHEN lf <> 'numeric' THEN 'block' WHEN b1 IS NULL THEN 'ok' WHEN a1 IS NULL OR coalesce(b2,0) < coalesce(a2,0) OR b1 - coalesce(b2,0) < a1 - coalesce(a2,0) THEN 'block' ELSE 'ok' END
 WHEN wf = 'timestamp' THEN CASE WHEN lf <> 'timestamp' OR wb <> lb THEN 'block' WHEN coalesce(b1,6) < coalesce(a1,6) THEN 'warn' ELSE 'ok' END
 WHEN wb = lb THEN 'ok' ELSE 'block' END AS verdict FROM fam)"""


PARTS = f"{MAPPED}, {judged_sql('mapped')}"


def mapped(s: SparkSession, sf: str) -> DataFrame:
    return types.with_mapped_type(d.columns(s, sf))


@query(f"WITH {MAPPED} SELECT source_type, length, precision, scale, want_type AS target_type, count(*) AS n FROM mapped GROUP BY ALL")
def q_type_map(s: SparkSession, sf: str) -> DataFrame:
    kinds = d.columns(s, sf).groupBy("source_type", "length", "precision", "scale").agg(F.count("*").alias("n"))
    return types.with_mapped_type(kinds).withColumnRenamed("want_type", "target_type")


@query(f"WITH {PARTS} SELECT DISTINCT live_type, lb AS base, lf AS family, b1 AS arg1, b2 AS arg2 FROM fam")
def q_type_parse(s: SparkSession, sf: str) -> DataFrame:
    parts = types.with_type_parts(d.columns(s, sf).select("live_type").distinct(), "live_type", "t")
    return parts.select("live_type", F.col("t_base").alias("base"), F.col("t_family").alias("family"), F.col("t_1").alias("arg1"), F.col("t_2").alias("arg2"))


@query(f"WITH {PARTS} SELECT want_type, live_type, verdict, count(*) AS n FROM compat GROUP BY ALL")
def q_type_compat(s: SparkSession, sf: str) -> DataFrame:
    pairs = mapped(s, sf).groupBy("want_type", "live_type").agg(F.count("*").alias("n"))  # each pair of types is judged once
    return types.with_compatibility(pairs, "want_type", "live_type")


def manifest_and_live(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = mapped(s, sf)
    manifest = m.where("position % 6 <> 5").groupBy("table_id", "name").agg(F.min("want_type").alias("type"), F.bool_or("nullable").alias("nullable"))
    live = m.where("position % 6 <> 4").groupBy("table_id", F.when(F.col("position") % 3 == 0, F.lower("name")).otherwise(F.col("name")).alias("name")).agg(
        F.min("live_type").alias("type"), F.bool_or(F.col("scale") == 0).alias("not_null"), F.bool_or(F.col("scale") == 3).alias("has_default")
    )
    return manifest, live


DIFF = f"""{MAPPED}, manifest AS (SELECT table_id, name, min(want_type) AS want_type, bool_or(nullable) AS nullable FROM mapped WHERE position % 6 <> 5 GROUP BY 1, 2),
live AS (SELECT table_id, CASE WHEN position % 3 = 0 THEN lower(name) ELSE name END AS name, min(live_type) AS live_type, bool_or(scale = 0) AS not_null, bool_or(scale = 3) AS has_default FROM mapped WHERE position % 6 <> 4 GROUP BY 1, 2),
near AS (SELECT table_id, lower(name) AS folded, min(name) AS near_name FROM live GROUP BY 1, 2),
j AS (SELECT coalesce(m.table_id, l.table_id) AS table_id, coalesce(m.name, l.name) AS name, m.want_type, m.nullable, l.live_type, l.not_null, l.has_default FROM manifest m FULL JOIN live l ON m.table_id = l.table_id AND m.name = l.name),
k AS (SELECT j.*, n.near_name FROM j LEFT JOIN near n ON n.table_id = j.table_id AND n.folded = lower(j.name)),
pairs AS (SELECT DISTINCT want_type, live_type FROM j WHERE want_type IS NOT NULL AND live_type IS NOT NULL), {judged_sql('pairs')},
diff AS (SELECT k.table_id, k.name, CASE WHEN k.live_type IS NULL AND near_name IS NOT NULL THEN 'missing, spelt otherwise' WHEN k.live_type IS NULL THEN 'missing'
 WHEN k.want_type IS NULL AND not_null AND NOT has_default THEN 'extra and required' WHEN k.want_type IS NULL THEN 'extra' WHEN r.verdict <> 'ok' THEN r.verdict
 WHEN nullable AND not_null THEN 'nulls into not null' ELSE 'ok' END AS verdict FROM k LEFT JOIN compat r ON r.want_type = k.want_type AND r.live_type = k.live_type)"""


@query(f"WITH {DIFF} SELECT * FROM diff")
def q_schema_diff(s: SparkSession, sf: str) -> DataFrame:
    return schema.schema_diff(*manifest_and_live(s, sf), ["table_id"])


@query(f"WITH {DIFF} SELECT verdict, count(*) AS n FROM diff GROUP BY 1")
def q_schema_diff_types(s: SparkSession, sf: str) -> DataFrame:
    return schema.schema_diff(*manifest_and_live(s, sf), ["table_id"]).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"WITH {d.COLUMNS} SELECT lower(name) AS folded, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM cols GROUP BY 1 HAVING count(DISTINCT name) > 1")
def q_name_collisions(s: SparkSession, sf: str) -> DataFrame:
    return schema.name_collisions(d.columns(s, sf), "name")


@query(f"""WITH {d.COLUMNS} SELECT table_id, CASE WHEN count(*) FILTER (WHERE lower(name) = name OR position % 3 = 0) > count(*) FILTER (WHERE position % 3 <> 0) THEN 'lower' ELSE 'source' END AS style FROM cols GROUP BY 1""")
def q_name_style(s: SparkSession, sf: str) -> DataFrame:
    low = F.count_if((F.lower("name") == F.col("name")) | (F.col("position") % 3 == 0))
    return d.columns(s, sf).groupBy("table_id").agg(F.when(low > F.count_if(F.col("position") % 3 != 0), "lower").otherwise("source").alias("style"))


@query(f"""WITH {MAPPED} SELECT table_id, 'CREATE TABLE t_' || table_id || ' (' || string_agg(line, ', ' ORDER BY position, line) || ')' AS ddl
FROM (SELECT table_id, position, lower(name) || ' ' || want_type || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END AS line FROM mapped) GROUP BY 1""")
def q_generate_ddl(s: SparkSession, sf: str) -> DataFrame:
    m = mapped(s, sf).select("table_id", "position", F.lower("name").alias("name"), F.col("want_type").alias("type"), "nullable")
    return schema.create_table_text(m, ["table_id"])


@query("""SELECT p_partkey, regexp_full_match(n, '[A-Za-z][A-Za-z0-9_$#]{0,127}') AS valid, '"' || replace(n, '"', '""') || '"' AS quoted FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', '_') ELSE p_name || '"x' END AS n FROM part)""")
def q_identifier_check(s: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("p_size") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.concat("p_name", F.lit('"x')))
    return table(s, sf, "part").select("p_partkey", values.is_identifier(n).alias("valid"), values.quoted(n).alias("quoted"))


@query("SELECT doc_id, text[1:list_max(list_filter(range(0, 64), lambda n: n <= length(text) AND octet_length(encode(text[1:n])) <= 63))] AS name FROM documents")
def q_truncate63(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "documents").select("doc_id", values.truncated63(F.col("text")).alias("name"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS key_text FROM orders")
def q_key_text(s: SparkSession, sf: str) -> DataFrame:
    df = table(s, sf, "orders")
    parts = [values.key_text(F.col(c), df.schema[c].dataType) for c in ("o_orderkey", "o_orderdate")]
    return df.select("o_orderkey", F.concat_ws("|", *parts).alias("key_text"))


CODES = (3113, 1722, 8103, 942, 12541, 12153, 12514, 12528, 12543, 12582, 50000)
STATES = ("08006", "57P01", "23505", "53300", "57P02", "57P03", "42601", "53301")
MESSAGES = ("Failed to connect to host", "TNS:packet reader failure", "value too long")


@query(f"""SELECT event_id, CASE a WHEN 1 THEN 30 WHEN 2 THEN 60 WHEN 3 THEN 120 ELSE 300 END AS delay, CASE WHEN stalled OR io THEN true
 WHEN code IS NOT NULL THEN CASE WHEN code = 8103 THEN a < 2 ELSE code IN {values.SOURCE_TRANSIENT} END
 WHEN state IS NOT NULL THEN state LIKE '08%' OR state IN {values.TARGET_TRANSIENT} ELSE message ILIKE '%failed to connect%' OR message ILIKE '%tns:packet reader failure%' END AS retry
FROM (SELECT event_id, event_id % 5 + 1 AS a, user_id % 7 = 0 AS stalled, event_id % 31 = 0 AS io, CASE WHEN event_id % 3 = 0 THEN ({list(CODES)})[event_id // 3 % {len(CODES)} + 1] END AS code,
 CASE WHEN event_id % 3 = 1 THEN ({list(STATES)})[event_id // 3 % {len(STATES)} + 1] END AS state, ({list(MESSAGES)})[event_id // 3 % {len(MESSAGES)} + 1] AS message FROM events)""")
def q_retry_policy(s: SparkSession, sf: str) -> DataFrame:
    e, third = F.col("event_id"), F.expr("event_id div 3")

    def one_of(listed: tuple) -> Column:
        return F.get(F.array(*map(F.lit, listed)), (third % len(listed)).cast("int"))

    code, state = F.when(e % 3 == 0, one_of(CODES)), F.when(e % 3 == 1, one_of(STATES))
    retry = values.worth_retrying(code, state, e % 5 + 1, F.col("user_id") % 7 == 0, e % 31 == 0, one_of(MESSAGES))
    return table(s, sf, "events").select("event_id", values.retry_delay(e % 5 + 1).alias("delay"), retry.alias("retry"))


@query("""SELECT event_id, user_id, event_type FROM events""")
def q_json_roundtrip(s: SparkSession, sf: str) -> DataFrame:
    as_text = F.to_json(F.struct("event_id", "user_id", "event_type"))
    return table(s, sf, "events").select(F.from_json(as_text, "event_id long, user_id long, event_type string").alias("x")).select("x.*")


# --- change tracking ---------------------------------------------------------


def log_tables(s: SparkSession, sf: str) -> DataFrame:
    return d.change_log(s, sf).groupBy("table_id").agg((F.min("scn") + F.col("table_id") * 10).alias("from_scn"))


TABLES = "tabs AS (SELECT table_id, min(scn) + table_id * 10 AS from_scn FROM log GROUP BY table_id)"


@query(f"""WITH {d.CDC}, {TABLES}, upto AS (SELECT max(scn) - 50 AS m FROM log), x AS (SELECT l.* FROM log l JOIN tabs USING (table_id), upto WHERE scn > from_scn AND scn <= m)
SELECT DISTINCT table_id, key FROM (SELECT table_id, old_key AS key FROM x UNION ALL SELECT table_id, new_key FROM x) WHERE key IS NOT NULL""")
def q_cdc_mine_keys(s: SparkSession, sf: str) -> DataFrame:
    log = d.change_log(s, sf)
    upto = log.agg((F.max("scn") - 50).alias("m")).scalar()
    return cdc.mine_keys(log, log_tables(s, sf), upto)


def changes(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    keys = d.change_keys(s, sf)
    return d.change_target(s, sf), keys, cdc.reread(d.change_source(s, sf), keys, "o_orderkey"), "o_orderkey"


@query(f"WITH {d.CDC} SELECT * FROM rws")
def q_cdc_reread(s: SparkSession, sf: str) -> DataFrame:
    return changes(s, sf)[2]


@query(f"WITH {d.CDC} SELECT t.* FROM tgt t SEMI JOIN keys k USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM rws)")
def q_cdc_delete_keys(s: SparkSession, sf: str) -> DataFrame:
    return cdc.deleted_keys(*changes(s, sf))


@query(f"WITH {d.CDC} SELECT * FROM tgt WHERE o_orderkey NOT IN (SELECT o_orderkey FROM keys) UNION ALL SELECT * FROM rws")
def q_cdc_upsert(s: SparkSession, sf: str) -> DataFrame:
    return cdc.applied(*changes(s, sf))


PLAN = """o AS (SELECT t.* FROM tgt t SEMI JOIN keys k USING (o_orderkey)),
plan AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN n.o_orderkey IS NULL THEN 'delete'
 WHEN (o.o_custkey, o.o_orderstatus, o.o_totalprice) IS DISTINCT FROM (n.o_custkey, n.o_orderstatus, n.o_totalprice) THEN 'update' END AS action FROM o FULL JOIN rws n ON o.o_orderkey = n.o_orderkey)"""


@query(f"WITH {d.CDC}, {PLAN} SELECT * FROM plan WHERE action IS NOT NULL")
def q_cdc_change_plan(s: SparkSession, sf: str) -> DataFrame:
    return cdc.change_plan(*changes(s, sf))


@query(f"WITH {d.CDC}, {PLAN} SELECT count(*) FILTER (WHERE action <> 'delete') AS written, count(*) FILTER (WHERE action = 'delete') AS deleted FROM plan")
def q_cdc_apply_counts(s: SparkSession, sf: str) -> DataFrame:
    return cdc.apply_counts(*changes(s, sf))


@query(f"WITH {d.CDC} SELECT (SELECT count(*) FROM rws) AS written, (SELECT count(*) FROM tgt t SEMI JOIN keys USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM rws)) AS deleted")
def q_cdc_settle(s: SparkSession, sf: str) -> DataFrame:
    return cdc.settle_counts(*changes(s, sf))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_cdc_settle_dups(s: SparkSession, sf: str) -> DataFrame:
    return cdc.duplicate_keys(table(s, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {d.CDC} SELECT table_id, least(max(scn) - 1, coalesce(min(scn) FILTER (WHERE status = 1) - 1, max(scn) - 1)) AS resume_scn FROM log GROUP BY 1")
def q_resume_point(s: SparkSession, sf: str) -> DataFrame:
    open_ = F.min(F.when(F.col("status") == 1, F.col("scn")))
    return d.change_log(s, sf).groupBy("table_id").agg(cdc.resume_point(F.max("scn"), open_).alias("resume_scn"))


@query(f"WITH {d.CDC}, {TABLES} SELECT min(from_scn) AS mining_start, count(*) AS tables FROM tabs")
def q_mining_start(s: SparkSession, sf: str) -> DataFrame:
    return log_tables(s, sf).agg(F.min("from_scn").alias("mining_start"), F.count("*").alias("tables"))


@query(f"""WITH {d.CDC}, r AS (SELECT table_id, least(max(scn) - 1, coalesce(min(scn) FILTER (WHERE status = 1) - 1, max(scn) - 1)) AS held FROM log GROUP BY 1)
SELECT table_id, count(*) FILTER (WHERE scn <= held) AS done, count(*) FILTER (WHERE scn > held) AS again FROM log JOIN r USING (table_id) GROUP BY 1""")
def q_cdc_late_commit(s: SparkSession, sf: str) -> DataFrame:
    held = q_resume_point(s, sf)
    ahead = F.col("scn") > F.col("resume_scn")
    return d.change_log(s, sf).join(held, "table_id").groupBy("table_id").agg(F.count_if(~ahead).alias("done"), F.count_if(ahead).alias("again"))


@query(f"""WITH {d.CDC} SELECT scn, table_id, CASE WHEN op = 'DDL' THEN 'structure changed' WHEN op = 'UNSUPPORTED' THEN 'unsupported operation' WHEN status <> 0 THEN 'unreadable record'
WHEN old_key IS NULL AND new_key IS NULL AND address IS NULL THEN 'no key and no address' WHEN old_key IS NULL AND new_key IS NULL THEN 'look up by address' END AS reason FROM log""")
def q_cdc_stop_reasons(s: SparkSession, sf: str) -> DataFrame:
    reason = cdc.stop_reason(*[F.col(c) for c in ("op", "status", "old_key", "new_key", "address")])
    return d.change_log(s, sf).select("scn", "table_id", reason.alias("reason"))


LOGS = "logs AS (SELECT user_id % 4 AS thread, event_id // 9 AS sequence, 'f' || event_id AS name, event_id % 2 = 0 AS archived FROM events WHERE event_id % 41 > 3)"


def logs(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "events").where("event_id % 41 > 3").select((F.col("user_id") % 4).alias("thread"), F.expr("event_id div 9").alias("sequence"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("name"), (F.col("event_id") % 2 == 0).alias("archived"))


@query(f"WITH {LOGS} SELECT thread, sequence, name, archived FROM (SELECT *, row_number() OVER (PARTITION BY thread, sequence ORDER BY archived DESC, name) AS r FROM logs) WHERE r = 1")
def q_log_dedupe(s: SparkSession, sf: str) -> DataFrame:
    return cdc.preferred_logs(logs(s, sf))


@query(f"WITH {LOGS} SELECT * FROM (SELECT thread, sequence, lag(sequence) OVER (PARTITION BY thread ORDER BY sequence) AS previous FROM (SELECT DISTINCT thread, sequence FROM logs)) WHERE sequence <> previous + 1")
def q_log_gaps(s: SparkSession, sf: str) -> DataFrame:
    return cdc.log_gaps(logs(s, sf).select("thread", "sequence").distinct())


@query("""SELECT o.o_custkey AS object_id, CASE WHEN n.o_custkey IS NULL THEN 'dropped' WHEN n.data_id <> o.data_id THEN 'truncated or moved' ELSE 'same' END AS drift
FROM (SELECT o_custkey, max(o_orderkey) AS data_id FROM orders GROUP BY 1) o LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS data_id FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1) n USING (o_custkey)""")
def q_object_drift(s: SparkSession, sf: str) -> DataFrame:
    o = table(s, sf, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("data_id"))
    return cdc.object_drift(o.groupBy("object_id").agg(F.max("data_id").alias("data_id")), o.where("data_id % 3 <> 0").groupBy("object_id").agg(F.max("data_id").alias("data_id")))


@query(f"WITH {d.CDC}, k AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM keys) SELECT o_orderkey, (r - 1) // 1000 AS batch FROM k")
def q_key_batches(s: SparkSession, sf: str) -> DataFrame:
    """Batches of 1,000 keys in key order, numbered range by range."""
    keys = d.change_keys(s, sf)
    parts = max(1, int(s.conf.get("spark.sql.shuffle.partitions")))
    ranged = keys.repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey").withColumn("part", F.spark_partition_id())
    local = ranged.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("o_orderkey")))
    sizes = local.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before"))
    return local.join(F.broadcast(before), "part").select("o_orderkey", F.floor((F.col("before") + F.col("place") - 1) / 1000).alias("batch"))


# --- comparison, runs, monitoring --------------------------------------------

SIDES = """a AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(c_name) ELSE c_name END AS name, CASE WHEN c_custkey % 10 <> 0 THEN CAST(round(c_acctbal) AS BIGINT) END AS rows, CASE WHEN c_custkey % 17 = 0 THEN 'denied' END AS error FROM customer WHERE c_custkey % 23 <> 0),
b AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN upper(c_name) ELSE c_name END AS name, CAST(round(c_acctbal) AS BIGINT) + CASE WHEN c_custkey % 5 = 0 THEN 12 WHEN c_custkey % 7 = 0 THEN -12 ELSE 0 END AS rows, CAST(NULL AS VARCHAR) AS error FROM customer WHERE c_custkey % 29 <> 0),
exact AS (SELECT a.name AS source_name, b.name AS target_name, a.rows AS source_rows, b.rows AS target_rows, a.error AS source_error, b.error AS target_error FROM a JOIN b USING (name)),
ra AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY name) AS r FROM a WHERE name NOT IN (SELECT name FROM b)),
rb AS (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY name) AS r FROM b WHERE name NOT IN (SELECT name FROM a)),
pairs AS (SELECT * FROM exact UNION ALL SELECT ra.name, rb.name, ra.rows, rb.rows, ra.error, rb.error FROM ra FULL JOIN rb ON lower(ra.name) = lower(rb.name) AND ra.r = rb.r),
stat AS (SELECT *, CASE WHEN source_name IS NULL THEN 'target_only' WHEN target_name IS NULL THEN 'source_only' WHEN source_error IS NOT NULL OR target_error IS NOT NULL THEN 'error' WHEN source_rows IS NULL OR target_rows IS NULL THEN 'not_counted'
 WHEN source_rows = target_rows THEN 'match' WHEN target_rows < source_rows THEN 'missing' ELSE 'extra' END AS status FROM pairs)"""


def compared(s: SparkSession, sf: str) -> DataFrame:
    c, k = table(s, sf, "customer"), F.col("c_custkey")
    rows = F.round("c_acctbal").cast("long")
    a = c.where(k % 23 != 0).select(F.when(k % 3 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("name"), F.when(k % 10 != 0, rows).alias("rows"), F.when(k % 17 == 0, "denied").alias("error"))
    b = c.where(k % 29 != 0).select(F.when(k % 4 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("name"), (rows + F.when(k % 5 == 0, 12).when(k % 7 == 0, -12).otherwise(0)).alias("rows"), F.lit(None).cast("string").alias("error"))
    return monitor.count_status(monitor.pair_names(a, b))


@query(f"WITH {SIDES} SELECT source_name, target_name, source_rows, target_rows, status, CASE WHEN status IN ('match','missing','extra') THEN target_rows - source_rows END AS difference FROM stat")
def q_rowcount_compare(s: SparkSession, sf: str) -> DataFrame:
    return compared(s, sf).select("source_name", "target_name", "source_rows", "target_rows", "status", "difference")


@query(f"WITH {SIDES} SELECT status, count(*) AS n, CAST(sum(coalesce(source_rows, 0)) AS BIGINT) AS source_rows, CAST(sum(coalesce(target_rows, 0)) AS BIGINT) AS target_rows FROM stat GROUP BY 1")
def q_rowcount_summary(s: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0)
    return compared(s, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.coalesce("source_rows", zero)).alias("source_rows"), F.sum(F.coalesce("target_rows", zero)).alias("target_rows"))


@query(f"WITH {d.CHUNKS} SELECT job_id, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE status = 'Pending') AS waiting FROM chunks GROUP BY 1")
def q_job_totals(s: SparkSession, sf: str) -> DataFrame:
    return d.chunks(s, sf).groupBy("job_id").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count_if(F.col("status") == "Pending").alias("waiting"))


TSTAT = f"{d.CHUNKS}, ts AS (SELECT run_id, min(job_id) AS job_id, CASE WHEN bool_or(status IN ('Pending','Running')) THEN 'InProgress' WHEN bool_or(status = 'Failed') THEN 'Failed' ELSE 'Validating' END AS table_status FROM chunks GROUP BY 1)"


@query(f"WITH {TSTAT} SELECT run_id, table_status FROM ts")
def q_table_status(s: SparkSession, sf: str) -> DataFrame:
    return monitor.table_status(d.chunks(s, sf), "run_id", "status")


@query(f"WITH {TSTAT}, e AS (SELECT job_id, CASE table_status WHEN 'Validating' THEN 'Completed' WHEN 'InProgress' THEN 'Running' ELSE table_status END AS st FROM ts) SELECT job_id, CASE WHEN NOT bool_and(st IN ('Completed','Failed','Cancelled')) THEN 'Running' WHEN bool_and(st = 'Completed') THEN 'Completed' ELSE 'CompletedWithErrors' END AS job_status FROM e GROUP BY 1")
def q_job_status(s: SparkSession, sf: str) -> DataFrame:
    runs = monitor.table_status(d.chunks(s, sf), "run_id", "status").withColumn("job_id", F.col("run_id") % 10)
    ended = F.when(F.col("table_status") == "Validating", "Completed").when(F.col("table_status") == "InProgress", "Running").otherwise(F.col("table_status"))
    return monitor.job_status(runs.withColumn("st", ended), "job_id", "st")


@query(f"WITH {d.CHUNKS} SELECT run_id, CASE WHEN count(*) FILTER (WHERE status = 'Done') = count(*) THEN 'Completed' WHEN count(*) FILTER (WHERE status = 'Done') = 0 THEN 'Failed' ELSE 'CompletedWithErrors' END AS change_status FROM chunks GROUP BY 1")
def q_change_job_status(s: SparkSession, sf: str) -> DataFrame:
    return d.chunks(s, sf).groupBy("run_id").agg(monitor.change_status(F.count_if(F.col("status") == "Done"), F.count("*")).alias("change_status"))


@query(f"WITH {d.CHUNKS} SELECT run_id, CAST(round(100.0 * count(*) FILTER (WHERE status = 'Done') / count(*)) AS INTEGER) AS percent FROM chunks GROUP BY 1")
def q_progress(s: SparkSession, sf: str) -> DataFrame:
    return d.chunks(s, sf).groupBy("run_id").agg(monitor.progress(F.count_if(F.col("status") == "Done"), F.count("*")).alias("percent"))


@query(f"""WITH {d.SAMPLES} SELECT job_id, sampled_at, total, coalesce(greatest((total - lag(total) OVER w) / greatest(epoch(sampled_at) - lag(epoch(sampled_at)) OVER w, 0.5), 0.0), 0.0) AS rate FROM samples WINDOW w AS (PARTITION BY job_id ORDER BY sampled_at, total)""")
def q_rates(s: SparkSession, sf: str) -> DataFrame:
    return monitor.rates(d.samples(s, sf), "job_id", "sampled_at", "total")


RATES = f"""{d.SAMPLES}, rated AS (SELECT job_id, sampled_at, total, coalesce(greatest((total - lag(total) OVER w) / greatest(epoch(sampled_at) - lag(epoch(sampled_at)) OVER w, 0.5), 0.0), 0.0) AS rate
 FROM samples WINDOW w AS (PARTITION BY job_id ORDER BY sampled_at, total)), moment AS (SELECT max(sampled_at) AS now FROM samples)"""
LATEST = "SELECT job_id, sampled_at, total, rate FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sampled_at DESC, total DESC) AS r FROM rated, moment WHERE job_id % 3 <> 0 AND sampled_at >= now - INTERVAL 3 HOUR) WHERE r = 1"


def running_jobs(s: SparkSession, sf: str) -> DataFrame:
    return d.samples(s, sf).where("job_id % 3 <> 0").select("job_id").distinct()


@query(f"WITH {RATES} {LATEST}")
def q_latest_metric(s: SparkSession, sf: str) -> DataFrame:
    """The given events are minutes apart, so a sample of three hours counts as recent."""
    rated = monitor.rates(d.samples(s, sf), "job_id", "sampled_at", "total")
    now = d.samples(s, sf).agg(F.max("sampled_at")).scalar()
    return monitor.recent_metrics(rated, running_jobs(s, sf), "job_id", "sampled_at", ["total", "rate"], now, 3 * 3600)


@query(f"""WITH {d.CHUNKS}, {RATES}, m AS (SELECT max(leased_until) AS upto FROM chunks),
done AS (SELECT sum(rows) AS rows, sum(bytes) AS bytes FROM chunks, m WHERE status = 'Done' AND leased_until >= upto - INTERVAL 24 HOUR),
speed AS (SELECT sum(rate) AS rate FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sampled_at DESC, rate DESC) AS r FROM rated, moment WHERE job_id % 3 <> 0 AND sampled_at >= now - INTERVAL 30 SECOND) WHERE r = 1)
SELECT (SELECT count(DISTINCT job_id) FROM samples WHERE job_id % 3 <> 0) AS runs_in_progress, CAST(coalesce(rows, 0) AS BIGINT) AS copied_rows, CAST(coalesce(bytes, 0) AS BIGINT) AS copied_bytes, coalesce(rate, 0.0) AS rows_per_second FROM done, speed""")
def q_dashboard_summary(s: SparkSession, sf: str) -> DataFrame:
    chunks = d.chunks(s, sf).withColumnRenamed("leased_until", "completed_at")
    rated = monitor.rates(d.samples(s, sf), "job_id", "sampled_at", "total")
    now, sampled = chunks.agg(F.max("completed_at")).scalar(), d.samples(s, sf).agg(F.max("sampled_at")).scalar()
    return monitor.dashboard(chunks, rated, running_jobs(s, sf), now, sampled)


@query(f"WITH {d.CHUNKS} SELECT job_id, count(*) AS chunks, CAST(sum(rows) FILTER (WHERE chunk_id % 6 <> 0) AS BIGINT) AS known_rows, count(*) FILTER (WHERE chunk_id % 6 = 0) AS unknown FROM chunks GROUP BY 1")
def q_selection_stats(s: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("chunk_id") % 6 != 0, F.col("rows"))
    return d.chunks(s, sf).groupBy("job_id").agg(F.count("*").alias("chunks"), F.sum(known).alias("known_rows"), F.count_if(known.isNull()).alias("unknown"))


@query("""SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(o.included, true) AS included, coalesce(o.row_filter, '') AS row_filter FROM (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0) n
FULL JOIN (SELECT c_custkey, c_custkey % 2 = 0 AS included, 'seg = ' || c_mktsegment AS row_filter FROM customer WHERE c_custkey % 3 <> 0) o USING (c_custkey)""")
def q_selection_merge(s: SparkSession, sf: str) -> DataFrame:
    c = table(s, sf, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("included"), F.concat(F.lit("seg = "), "c_mktsegment").alias("row_filter"))
    return monitor.merged_selection(old, c.where("c_custkey % 5 <> 0"), "c_custkey", {"included": F.lit(True), "row_filter": F.lit("")})


@query("SELECT p_partkey, p_name FROM part WHERE (lower(p_name) LIKE '%1%' OR lower(p_brand) LIKE '%1%') AND p_size > 10")
def q_table_search(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "part").where(F.lower("p_name").contains("1") | F.lower("p_brand").contains("1")).where("p_size > 10").select("p_partkey", "p_name")


@query("SELECT c_custkey, balance FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS balance FROM customer) ORDER BY balance DESC NULLS LAST, c_custkey")
def q_sort_unknown_last(s: SparkSession, sf: str) -> DataFrame:
    df = table(s, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("balance"))
    return df.orderBy(F.desc_nulls_last("balance"), "c_custkey")


@query("""SELECT name, list_aggregate(list_transform(regexp_extract_all(lower(name), '\\d+|\\D+'), lambda x: CASE WHEN regexp_full_match(x, '\\d+') THEN lpad(CAST(length(regexp_replace(x, '^0+(.)', '\\1')) AS VARCHAR), 6, '0') || regexp_replace(x, '^0+(.)', '\\1') ELSE x END), 'string_agg', '') AS sort_key
FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'BL_' ELSE 'bl_' END || c_custkey || '_' || c_nationkey AS name FROM customer) ORDER BY 2, 1""")
def q_natural_sort(s: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, "BL_").otherwise("bl_"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_nationkey").cast("string"))
    return table(s, sf, "customer").select(name.alias("name")).withColumn("sort_key", values.natural_key(F.col("name"))).orderBy("sort_key", "name")


KINDS = "kinds AS (SELECT l_orderkey AS table_id, l_linenumber AS name, CASE l_partkey % 4 WHEN 0 THEN 'f' WHEN 1 THEN 'c' WHEN 2 THEN 'u' ELSE 'p' END AS kind, l_suppkey % 3 = 0 AND l_partkey % 4 = 0 AS inbound FROM lineitem)"


@query(f"WITH {KINDS} SELECT table_id, string_agg(kind || name, ' ' ORDER BY CASE WHEN inbound THEN 0 WHEN kind = 'f' THEN 1 WHEN kind = 'c' THEN 2 WHEN kind = 'u' THEN 3 ELSE 4 END, name, kind) AS drop_order FROM kinds GROUP BY 1")
def q_constraint_order(s: SparkSession, sf: str) -> DataFrame:
    part = F.col("l_partkey") % 4
    kind = F.when(part == 0, "f").when(part == 1, "c").when(part == 2, "u").otherwise("p")
    rank = F.when((F.col("l_suppkey") % 3 == 0) & (part == 0), 0).when(part == 0, 1).when(part == 1, 2).when(part == 2, 3).otherwise(4)
    item = F.struct(rank.alias("rank"), F.col("l_linenumber").alias("name"), kind.alias("kind"))
    listed = table(s, sf, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return listed.select("table_id", F.array_join(F.transform("items", lambda x: F.concat(x["kind"], x["name"].cast("string"))), " ").alias("drop_order"))


@query(f"WITH {d.CHUNKS} SELECT chunk_id, run_id, job_id FROM chunks WHERE status = 'Pending' AND leased_until <= TIMESTAMP '1998-01-01' ORDER BY chunk_id LIMIT 25")
def q_claimable_chunks(s: SparkSession, sf: str) -> DataFrame:
    free = d.chunks(s, sf).where((F.col("status") == "Pending") & (F.col("leased_until") <= F.lit("1998-01-01").cast("timestamp_ntz")))
    return free.orderBy("chunk_id").limit(25).select("chunk_id", "run_id", "job_id")


@query(f"WITH {d.CHUNKS} SELECT chunk_id, CASE WHEN leased_until < TIMESTAMP '1997-01-01' THEN 'Pending' ELSE status END AS status FROM chunks WHERE status <> 'Done'")
def q_expired_leases(s: SparkSession, sf: str) -> DataFrame:
    late = F.col("leased_until") < F.lit("1997-01-01").cast("timestamp_ntz")
    return d.chunks(s, sf).where("status <> 'Done'").select("chunk_id", F.when(late, "Pending").otherwise(F.col("status")).alias("status"))


@query("SELECT c_custkey FROM customer c ANTI JOIN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') o ON c.c_custkey = o.o_custkey")
def q_stale_claims(s: SparkSession, sf: str) -> DataFrame:
    live = table(s, sf, "orders").where("o_orderstatus = 'O'")
    return table(s, sf, "customer").join(live, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"WITH {TSTAT} SELECT job_id, run_id, table_status FROM ts ORDER BY CASE table_status WHEN 'InProgress' THEN 0 WHEN 'Failed' THEN 1 ELSE 2 END, run_id LIMIT 1")
def q_next_job(s: SparkSession, sf: str) -> DataFrame:
    runs = monitor.table_status(d.chunks(s, sf), "run_id", "status")
    rank = F.when(F.col("table_status") == "InProgress", 0).when(F.col("table_status") == "Failed", 1).otherwise(2)
    return runs.orderBy(rank, "run_id").limit(1).select((F.col("run_id") % 10).alias("job_id"), "run_id", "table_status")


@query("SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q_job_tree(s: SparkSession, sf: str) -> DataFrame:
    per = table(s, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))  # before the joins, so that customers stay one row each
    both = table(s, sf, "customer").join(per, "c_custkey", "left").join(table(s, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return both.groupBy("n_name").agg(F.count("*").alias("customers"), F.sum(F.coalesce("n", F.lit(0))).alias("orders"))


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def q_union_distinct(s: SparkSession, sf: str) -> DataFrame:
    a = table(s, sf, "customer").select(F.col("c_nationkey").alias("nationkey")).distinct()
    return a.unionByName(table(s, sf, "supplier").select(F.col("s_nationkey").alias("nationkey")).distinct()).distinct()


@query("SELECT count(*) AS nologging FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def q_nologging_count(s: SparkSession, sf: str) -> DataFrame:
    a = table(s, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return a.unionByName(table(s, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("k"))).agg(F.count("*").alias("nologging"))


@query("""SELECT p.p_partkey, s.rows, s.bytes FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS rows, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1) s ON s.l_partkey = p.p_partkey""")
def q_discover_sizes(s: SparkSession, sf: str) -> DataFrame:
    sizes = table(s, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("rows"), F.sum(F.round("l_extendedprice").cast("long")).alias("bytes"))
    return table(s, sf, "part").join(sizes, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "rows", "bytes")


@query("SELECT p_brand AS owner, count(*) AS tables, count(*) FILTER (WHERE NOT regexp_full_match(p_name, '[A-Za-z][A-Za-z0-9_$#]{0,127}')) AS skipped FROM part GROUP BY 1")
def q_list_schemas(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "part").groupBy(F.col("p_brand").alias("owner")).agg(F.count("*").alias("tables"), F.count_if(~values.is_identifier(F.col("p_name"))).alias("skipped"))


@query("SELECT p_brand AS owner, p_name AS table_name, CASE WHEN p_size > 5 THEN CAST(p_size AS BIGINT) * 1000 END AS num_rows FROM part WHERE p_type NOT LIKE '%TEMP%'")
def q_discover_tables(s: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("p_size") > 5, F.col("p_size").cast("long") * 1000)
    return table(s, sf, "part").where(~F.col("p_type").contains("TEMP")).select(F.col("p_brand").alias("owner"), F.col("p_name").alias("table_name"), known.alias("num_rows"))


@query(f"WITH {d.COLUMNS} SELECT table_id, string_agg(name, ',' ORDER BY position, name) AS key_columns FROM cols WHERE scale = 0 GROUP BY 1 HAVING bool_and(source_type IN ('NUMBER','VARCHAR2','CHAR','DATE','RAW'))")
def q_trackable_keys(s: SparkSession, sf: str) -> DataFrame:
    keyed = d.columns(s, sf).where("scale = 0").groupBy("table_id").agg(
        F.every(F.col("source_type").isin("NUMBER", "VARCHAR2", "CHAR", "DATE", "RAW")).alias("ok"), F.sort_array(F.collect_list(F.struct("position", "name"))).alias("list")
    )
    return keyed.where("ok").select("table_id", F.array_join("list.name", ",").alias("key_columns"))


@query(f"WITH {d.COLUMNS} SELECT table_id, scale AS index_id FROM cols WHERE nullable = false GROUP BY 1, 2 HAVING string_agg(DISTINCT CAST(position AS VARCHAR), ',' ORDER BY CAST(position AS VARCHAR)) IN ('1', '1,2', '2')")
def q_arbiter_index(s: SparkSession, sf: str) -> DataFrame:
    sets = d.columns(s, sf).where(~F.col("nullable")).groupBy("table_id", F.col("scale").alias("index_id")).agg(F.array_join(F.sort_array(F.collect_set(F.col("position").cast("string"))), ",").alias("set"))
    return sets.where(F.col("set").isin("1", "1,2", "2")).select("table_id", "index_id")


@query("SELECT p_partkey FROM part ANTI JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) l ON p_partkey = l_partkey")
def q_missing_targets(s: SparkSession, sf: str) -> DataFrame:
    return table(s, sf, "part").join(table(s, sf, "lineitem").where("l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey")


@query(f"""WITH {d.CDC}, {TABLES} SELECT table_id, bool_and(op <> 'DDL') AS no_ddl, bool_and(op <> 'UNSUPPORTED') AS supported, count(*) FILTER (WHERE status <> 0) AS unreadable, bool_and(op <> 'DDL') AND bool_and(op <> 'UNSUPPORTED') AND count(*) FILTER (WHERE status <> 0) = 0 AS ready FROM log GROUP BY 1""")
def q_readiness(s: SparkSession, sf: str) -> DataFrame:
    checks = d.change_log(s, sf).groupBy("table_id").agg(F.every(F.col("op") != "DDL").alias("no_ddl"), F.every(F.col("op") != "UNSUPPORTED").alias("supported"), F.count_if(F.col("status") != 0).alias("unreadable"))
    return checks.withColumn("ready", F.col("no_ddl") & F.col("supported") & (F.col("unreadable") == 0))


ELIGIBLE = "CASE WHEN k.table_id IS NULL THEN 'no key' WHEN NOT r.logged THEN 'not logged' WHEN r.chunks_left > 0 THEN 'copy not finished' ELSE 'ready' END"


@query(f"""WITH {d.COLUMNS}, {d.CHUNKS}, k AS (SELECT DISTINCT table_id FROM cols WHERE scale = 0), r AS (SELECT chunk_id AS table_id, run_id % 4 <> 0 AS logged, CASE WHEN status = 'Done' THEN 0 ELSE 1 END AS chunks_left FROM chunks)
SELECT r.table_id, {ELIGIBLE} AS eligibility FROM r LEFT JOIN k USING (table_id)""")
def q_cdc_eligibility(s: SparkSession, sf: str) -> DataFrame:
    keyed = d.columns(s, sf).where("scale = 0").select(F.col("table_id").alias("chunk_id"), F.lit(True).alias("keyed")).distinct()
    r = d.chunks(s, sf).join(keyed, "chunk_id", "left")
    why = F.when(F.col("keyed").isNull(), "no key").when(F.col("run_id") % 4 == 0, "not logged").when(F.col("status") != "Done", "copy not finished").otherwise("ready")
    return r.select(F.col("chunk_id").alias("table_id"), why.alias("eligibility"))


@query("""SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.error IS NOT NULL OR n.c_custkey IS NULL THEN o.rows ELSE n.rows END AS rows, n.error
FROM (SELECT c_custkey, c_custkey * 2 AS rows FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, c_custkey * 2 + 1 AS rows, CASE WHEN c_custkey % 7 = 0 THEN 'timeout' END AS error FROM customer WHERE c_custkey % 2 = 0) n USING (c_custkey)""")
def q_count_merge(s: SparkSession, sf: str) -> DataFrame:
    c, k = table(s, sf, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k, (k * 2).alias("rows"))
    return monitor.merged_counts(old, c.where(k % 2 == 0).select(k, (k * 2 + 1).alias("rows"), F.when(k % 7 == 0, "timeout").alias("error")), "c_custkey")


def fixed_sql(unit: int, places: int) -> str:
    parts = f"((b * {2 * 10**places} + {unit}) // {2 * unit})"
    return f"({parts} // {10**places}) || '.' || lpad(CAST({parts} % {10**places} AS VARCHAR), {places}, '0')"


@query(f"""SELECT l_orderkey, CASE WHEN b IS NULL THEN 'Unknown' WHEN b >= 1073741824 THEN {fixed_sql(1 << 30, 2)} || ' GB' WHEN b >= 1048576 THEN {fixed_sql(1 << 20, 2)} || ' MB' WHEN b >= 1024 THEN {fixed_sql(1024, 1)} || ' KB' ELSE b || ' B' END AS size
FROM (SELECT l_orderkey, CASE WHEN l_linenumber <> 3 THEN CAST(round(l_extendedprice) AS BIGINT) * (CAST(l_linenumber AS BIGINT) * l_linenumber * l_linenumber * l_linenumber * 100) // 500 END AS b FROM lineitem)""")
def q_format(s: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    b = F.when(n != 3, F.expr("cast(round(l_extendedprice) as bigint) * (cast(l_linenumber as bigint) * l_linenumber * l_linenumber * l_linenumber * 100) div 500"))
    return table(s, sf, "lineitem").select("l_orderkey", values.human_bytes(b).alias("size"))


@query(f"WITH {d.CHUNKS} SELECT run_id, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(rows) AS DOUBLE) / 120 AS rows_per_s, CAST(sum(bytes) AS DOUBLE) / 120 / 1048576 AS mb_per_s FROM chunks WHERE status = 'Done' GROUP BY 1")
def q_batch_summary(s: SparkSession, sf: str) -> DataFrame:
    done = d.chunks(s, sf).where("status = 'Done'").groupBy("run_id").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
    return done.select("run_id", "rows", (F.col("rows") / 120).alias("rows_per_s"), (F.col("bytes") / 120 / 1048576).alias("mb_per_s"))


@query(f"WITH {MAPPED} SELECT table_id, count(*) AS columns, count(*) FILTER (WHERE source_type IN ('BLOB','CLOB','LONG','BFILE')) AS lobs, bool_or(name <> lower(name)) AS renamed FROM mapped GROUP BY 1")
def q_manifest_generate(s: SparkSession, sf: str) -> DataFrame:
    return mapped(s, sf).groupBy("table_id").agg(F.count("*").alias("columns"), F.count_if(F.col("source_type").isin(*types.LOB_TYPES)).alias("lobs"), F.bool_or(F.col("name") != F.lower("name")).alias("renamed"))


@query("""WITH RECURSIVE edges AS (SELECT p_partkey AS child, CASE WHEN p_partkey % 30 = 7 THEN p_partkey ELSE p_partkey // 3 END AS parent FROM part UNION SELECT p_partkey, p_partkey * 3 FROM part WHERE p_partkey % 20 = 9 AND p_partkey * 3 IN (SELECT p_partkey FROM part)),
real AS (SELECT * FROM edges WHERE child <> parent), nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges),
looped AS (SELECT DISTINCT child AS node FROM real WHERE parent = child * 3 UNION SELECT parent FROM real WHERE parent = child * 3),
below(node) AS (SELECT node FROM looped UNION SELECT e.child FROM below b JOIN real e ON e.parent = b.node),
reached(node, level) AS (SELECT node, 0 FROM nodes WHERE node NOT IN (SELECT child FROM real) UNION SELECT e.child, r.level + 1 FROM reached r JOIN real e ON e.parent = r.node WHERE e.child NOT IN (SELECT node FROM below)),
levels AS (SELECT node, max(level) AS level FROM reached GROUP BY node)
SELECT node, level FROM levels UNION ALL SELECT node, (SELECT max(level) + 1 FROM levels) FROM below""")
def q_fk_order(s: SparkSession, sf: str) -> DataFrame:
    part = table(s, sf, "part").select("p_partkey")
    up = F.when(F.col("p_partkey") % 30 == 7, F.col("p_partkey")).otherwise(F.expr("p_partkey div 3"))
    back = part.where("p_partkey % 20 = 9").select(F.col("p_partkey").alias("child"), (F.col("p_partkey") * 3).alias("parent"))
    back = back.join(part, F.col("parent") == F.col("p_partkey"), "left_semi")
    return planning.parents_first(part.select(F.col("p_partkey").alias("child"), up.alias("parent")).unionByName(back))


@query(f"""WITH {d.COLUMNS}, {d.CDC}, keyed AS (SELECT table_id, count(*) FILTER (WHERE scale = 0) AS key_columns, count(*) FILTER (WHERE scale = 0 AND position % 6 = 5) AS excluded FROM cols GROUP BY 1),
points AS (SELECT old_key AS table_id, min(scn) AS start_scn FROM log WHERE old_key IS NOT NULL GROUP BY 1)
SELECT table_id, start_scn, CASE WHEN start_scn IS NULL THEN 'no start point' WHEN key_columns = 0 THEN 'no key' WHEN excluded > 0 THEN 'key column not copied' ELSE 'ready' END AS state FROM keyed LEFT JOIN points USING (table_id)""")
def q_cdc_trackable(s: SparkSession, sf: str) -> DataFrame:
    in_key = F.col("scale") == 0
    keyed = d.columns(s, sf).groupBy("table_id").agg(F.count_if(in_key).alias("key_columns"), F.count_if(in_key & (F.col("position") % 6 == 5)).alias("excluded"))
    points = d.change_log(s, sf).where("old_key is not null").groupBy(F.col("old_key").alias("table_id")).agg(F.min("scn").alias("start_scn"))
    state = F.when(F.col("start_scn").isNull(), "no start point").when(F.col("key_columns") == 0, "no key").when(F.col("excluded") > 0, "key column not copied").otherwise("ready")
    return keyed.join(points, "table_id", "left").select("table_id", "start_scn", state.alias("state"))


@query("""SELECT p_brand AS connection, bool_and(p_size > 1) AS usage_granted, count(*) FILTER (WHERE l.l_partkey IS NULL) AS missing, bool_and(p_size > 1) AND (count(*) FILTER (WHERE l.l_partkey IS NULL) = 0 OR bool_or(p_size > 40)) AS passed
FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45) l ON l.l_partkey = p_partkey GROUP BY 1""")
def q_preflight(s: SparkSession, sf: str) -> DataFrame:
    present = table(s, sf, "lineitem").where("l_quantity > 45").select("l_partkey").distinct()
    both = table(s, sf, "part").join(present, F.col("p_partkey") == F.col("l_partkey"), "left")
    checks = both.groupBy(F.col("p_brand").alias("connection")).agg(
        F.every(F.col("p_size") > 1).alias("usage_granted"), F.count_if(F.col("l_partkey").isNull()).alias("missing"), F.bool_or(F.col("p_size") > 40).alias("may_create")
    )
    return checks.select("connection", "usage_granted", "missing", (F.col("usage_granted") & ((F.col("missing") == 0) | F.col("may_create"))).alias("passed"))
