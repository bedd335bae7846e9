"""Golden cases and properties of the replication operators."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import types, values
from millrace.operators import cdc, copying, lookups, monitor, planning
from millrace.sources import tables, writer
from millrace.streaming import changes


@pytest.mark.parametrize(
    ("source", "length", "precision", "scale", "want"),
    [
        ("NUMBER", None, 4, 0, "smallint"), ("NUMBER", None, 9, 0, "integer"), ("NUMBER", None, 12, 0, "bigint"), ("NUMBER", None, 19, 0, "numeric(19)"),
        ("NUMBER", None, 10, 2, "numeric(10, 2)"), ("NUMBER", None, None, None, "numeric"), ("NUMBER", None, None, 0, "numeric"), ("VARCHAR2", 50, None, None, "varchar(50)"),
        ("VARCHAR2", 0, None, None, "text"), ("DATE", None, None, None, "timestamp(0) without time zone"), ("TIMESTAMP(6) WITH TIME ZONE", None, None, None, "timestamp with time zone"),
        ("MYSTERY", None, None, None, "text"), ("LONG RAW", None, None, None, "bytea"),
    ],
)
def test_type_map(spark, source, length, precision, scale, want):
    df = spark.createDataFrame([(source, length, precision, scale)], "s string, l int, p int, c int")
    assert df.select(types.map_type(*map(F.col, "slpc"))).first()[0] == want


def test_type_map_compat_mode_loses_the_zone(spark):
    df = spark.createDataFrame([("TIMESTAMP(6) WITH TIME ZONE",)], "s string")
    none = F.lit(None).cast("int")
    assert df.select(types.map_type(F.col("s"), none, none, none, strict=False)).first()[0] == "timestamp without time zone"


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ("varchar(50)", "varchar(50)", "ok"), ("varchar(50)", "text", "ok"), ("varchar(50)", "varchar(40)", "block"), ("text", "varchar(40)", "block"), ("varchar(5)", "char(10)", "warn"),
        ("varchar(5)", "bytea", "block"), ("integer", "int4", "ok"), ("integer", "bigint", "block"), ("numeric(10, 2)", "numeric(12,2)", "ok"), ("numeric(10, 2)", "numeric(10,1)", "block"),
        ("numeric(10, 2)", "numeric(10,4)", "block"), ("numeric", "numeric(10,2)", "block"), ("numeric(10, 2)", "numeric", "ok"), ("timestamp without time zone", "timestamptz", "block"),
        ("timestamp without time zone", "timestamp(3)", "warn"), ("timestamp(0) without time zone", "timestamp", "ok"), ("timestamp without time zone", "date", "block"), ("xml", "text", "ok"),
        ("text", "integer[]", "block"), ("bytea", "bytea", "ok"), ("xml", "varchar(40)", "block"), ("xml", "char(40)", "block"), ("xml", "character", "warn"), ("xml", "xml", "ok"),
        ("char(10)", "char(10)", "warn"), ("char(10)", "character varying(10)", "ok"), ("varchar(20)", "char(10)", "block"), ("time", "time without time zone", "ok"), ("time", "timetz", "block"),
        ("point", "point", "block"), ("text", "xml", "block"), ("timestamptz", "timestamp with time zone", "ok"), ("date", "date", "ok"), ("numeric(18)", "numeric(18,0)", "ok"),
    ],
)
def test_type_compatibility(spark, source, target, want):
    df = spark.createDataFrame([(source, target)], "s string, t string")
    assert types.with_compatibility(df, "s", "t").first().verdict == want


def test_values(spark):
    df = spark.createDataFrame([("a\0b",), ("\0",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(values.normalised(F.col("s"))).collect()] == ["ab", None, None, None]
    names = spark.createDataFrame([("x" * 70,), ("é" * 40,), ("short",)], "n string")
    assert [r[0] for r in names.select(values.truncated63(F.col("n"))).collect()] == ["x" * 63, "é" * 31, "short"]
    for bad in ("1 = 1; drop table x", "a = 'x' -- y", "a = 'x' or delete", "a = 'x", "note = '' ; x"):
        with pytest.raises(ValueError, match="not allowed"):
            values.checked_filter(bad)
    for good in ("status = 'drop'", "note = 'a;b'", "note = 'it''s -- so'", '"update" = 1'):
        values.checked_filter(good)


def test_formats(spark):
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1500: "1.5 KB", 1048575: "1024.0 KB", 1048576: "1.00 MB", 1600000: "1.53 MB", 1073741823: "1024.00 MB", 1073741824: "1.00 GB", 5 * 10**12: "4656.61 GB", None: "Unknown"}
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert {r.n: r.size for r in df.select("n", values.human_bytes(F.col("n")).alias("size")).collect()} == sizes
    ages = {-5: "just now", 59: "just now", 60: "1 min ago", 3599: "59 min ago", 7200: "2 h ago", 86400: "1 day ago", 200000: "2 days ago", None: ""}
    df = spark.createDataFrame([(n,) for n in ages], "n long")
    assert {r.n: r.age for r in df.select("n", values.human_age(F.col("n")).alias("age")).collect()} == ages
    labels = {"Queued": "Waiting", "CompletedWithErrors": "Finished with errors", "New": "New", "": "—", None: "—"}
    df = spark.createDataFrame([(n,) for n in labels], "n string")
    assert {r.n: r.l for r in df.select("n", values.status_label(F.col("n")).alias("l")).collect()} == labels


RETRIES = [  # source code, target state, attempt, stalled, I/O failure, message, worth it
    *[(code, None, 5, False, False, None, True) for code in (3113, 3114, 3135, 12153, 12170, 12514, 12516, 12518, 12519, 12520, 12521, 12528, 12537, 12541, 12543, 12545, 12547, 12560, 12570, 12571, 12582, 50000)],
    *[(code, None, 1, False, False, "Failed to connect", False) for code in (1722, 942, 1031, 1555, 12899)],
    (8103, None, 1, False, False, None, True), (8103, None, 2, False, False, None, False), (942, None, 1, True, False, None, True), (942, None, 1, False, True, None, True),
    *[(None, state, 1, False, False, None, True) for state in ("08006", "08001", "57P01", "57P02", "57P03", "53300")], (None, "23505", 1, False, False, "failed to connect", False),
    (None, None, 1, False, False, "x FAILED TO CONNECT y", True), (None, None, 1, False, False, "TNS:packet reader failure", True), (None, None, 1, False, False, "other", False), (None, None, 1, False, False, None, False),
]


def test_what_is_worth_retrying(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(RETRIES)], "i int, c int, s string, a int, st boolean, io boolean, m string, want boolean")
    got = df.select("i", "want", values.worth_retrying(*map(F.col, ("c", "s", "a", "st", "io", "m"))).alias("got")).collect()
    assert all(r.got is r.want for r in got)


@pytest.mark.parametrize(("rows", "lobs", "want"), [(1_000_000, False, 5), (1_000_001, False, 6), (1_000_000, True, 40), (25_000_000, True, 1000), (0, False, 1), (10, True, 1), (None, False, 16)])
def test_batch_count(spark, rows, lobs, want):
    df = spark.createDataFrame([(rows, lobs)], "n long, l boolean")
    assert df.select(planning.batch_count(F.col("n"), F.col("l"))).first()[0] == want


def test_retry(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "a int")
    assert [r[0] for r in df.select(values.retry_delay(F.col("a"))).collect()] == [30, 60, 120, 300, 300]


def test_chunk_ranges_are_disjoint_and_complete(spark):
    keys = spark.range(0, 1003).select((F.col("id") * F.col("id")).alias("k"))
    plan = planning.key_ranges(planning.ntile_bounds(keys, "k", 7))
    met = keys.join(F.broadcast(plan), planning.in_range(F.col("k"), F.col("low"), F.col("high")))
    assert met.count() == 1003 and met.select("k").distinct().count() == 1003
    sizes = [r["count"] for r in met.groupBy("chunk").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_extents(spark):
    rows = [(1, p, b) for p, b in ((0, 5), (1, 5), (2, 30), (3, 1), (4, 2))] + [(2, 0, 1)]
    got = planning.coalesce_extents(spark.createDataFrame(rows, "o int, position long, blocks long"), ["o"], 3).orderBy("o", "chunk").collect()
    assert [(r.o, r.first, r.last, r.blocks) for r in got] == [(1, 0, 2, 40), (1, 3, 4, 3), (2, 0, 0, 1)]


def test_row_count_pairing(spark):
    side = "name string, rows long, error string"
    a = spark.createDataFrame([("ORDERS", 100, None), ("orders", 7, None), ("Emp", 5, None), ("GONE", 1, None), ("BAD", 3, "denied")], side)
    b = spark.createDataFrame([("orders", 7, None), ("ORDERs", 88, None), ("EMP", 6, None), ("new", 2, None), ("bad", 3, None)], side)
    got = {(r.source_name, r.target_name): (r.status, r.difference) for r in monitor.count_status(monitor.pair_names(a, b)).collect()}
    assert got == {
        ("orders", "orders"): ("match", 0), ("ORDERS", "ORDERs"): ("missing", -12), ("Emp", "EMP"): ("extra", 1),
        ("GONE", None): ("source_only", None), (None, "new"): ("target_only", None), ("BAD", "bad"): ("error", None),
    }


def test_change_set_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    source = spark.createDataFrame([(1, "A"), (3, None), (4, "d")], "id long, name string")
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    rows = cdc.reread(source, keys, "id")
    assert tuple(cdc.apply_counts(target, keys, rows, "id").first()) == (2, 1)
    after = cdc.applied(target, keys, rows, "id")
    assert sorted(map(tuple, after.collect()), key=str) == [(1, "A"), (3, None), (4, "d")]
    assert tuple(cdc.apply_counts(after, keys, rows, "id").first()) == (0, 0)


def test_resume_point(spark):
    df = spark.createDataFrame([(100, None), (100, 40), (100, 200)], "s long, o long")
    assert [r[0] for r in df.select(cdc.resume_point(F.col("s"), F.col("o"))).collect()] == [99, 39, 99]


def test_chunks_are_written_once(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 4).alias("chunk"))
    path = str(tmp_path / "t")
    writer.write_chunks(df, path)
    writer.write_chunks(df.where("chunk = 2"), path)  # a retried chunk replaces itself
    assert tuple(writer.validated(spark, df, path).first()) == (100, 100, True)
    assert tables.range_predicates("id", [10, 20]) == ['"id" <= 10', '"id" > 10 AND "id" <= 20', '"id" > 20']
    moment = datetime.datetime(2020, 1, 1, 0, 0)
    assert tables.range_predicates('a"b', [moment]) == ["\"a\"\"b\" <= TIMESTAMP '2020-01-01 00:00:00'", "\"a\"\"b\" > TIMESTAMP '2020-01-01 00:00:00'"]
    assert tables.range_predicates("n", ["o'x", "z"])[1] == "\"n\" > 'o''x' AND \"n\" <= 'z'"
    assert tables.literal(datetime.date(2020, 1, 2)) == "DATE '2020-01-02'" and tables.literal(b"\x01\xff") == "X'01ff'" and tables.literal(decimal.Decimal("1.50")) == "1.50"


def test_a_chunked_copy(spark, tmp_path):
    df = spark.range(1000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("v"), (F.col("id") * 1.5).alias("x"))
    path = str(tmp_path / "copy")
    first = copying.copy_table(df, path, "id", 7, {"x": "decimal(12,2)"}, "id % 10 <> 3").collect()
    assert len(first) == 7 and all(r.passed for r in first) and sum(r.target_rows for r in first) == 900
    done = spark.createDataFrame([(0,), (2,)], "chunk int")
    again = copying.copy_table(df.withColumn("x", F.col("x") + 1), path, "id", 7, {"x": "decimal(12,2)"}, "id % 10 <> 3", done).collect()
    assert all(r.passed for r in again)
    changed = spark.read.parquet(path).groupBy("chunk").agg(F.every(F.col("x") == F.col("id") * 1.5 + 1).alias("new")).collect()
    assert {r.chunk: r.new for r in changed} == {i: i not in (0, 2) for i in range(7)}


def test_one_sided_groups_fail_their_validation(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "g int"), spark.createDataFrame([(1,), (1,), (3,)], "g int")
    got = {r.g: (r.source_rows, r.target_rows, r.passed) for r in monitor.validated_counts(a, b, ["g"]).collect()}
    assert got == {1: (2, 2, True), 2: (1, 0, False), 3: (0, 1, False)}


def levels(spark, edges):
    return {r.node: r.level for r in planning.parents_first(spark.createDataFrame(edges, "child string, parent string")).collect()}


def test_parents_first(spark):
    want = {"region": 0, "nation": 1, "customer": 2, "orders": 3, "lineitem": 4, "part": 0}
    assert levels(spark, [("nation", "region"), ("customer", "nation"), ("orders", "customer"), ("lineitem", "orders"), ("lineitem", "part"), ("part", "part"), ("orders", None)]) == want
    assert levels(spark, [("b", "a"), ("c", "d"), ("d", "c"), ("e", "d"), ("c", "b")]) == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 2}
    diamonds = [e for i in range(12) for e in ((f"l{i}", f"n{i}"), (f"r{i}", f"n{i}"), (f"n{i + 1}", f"l{i}"), (f"n{i + 1}", f"r{i}"))]
    got = levels(spark, diamonds)
    assert len(got) == 37 and got["n12"] == 24
    assert levels(spark, []) == {}


def test_upsert_rules(spark):
    """As the reference's cases: applied once, the same again changes nothing; an identity column is never set."""
    schema = "id long, name string, made long"
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], schema)
    rows, keys = spark.createDataFrame([(1, "A", 99), (4, "d", 40)], schema), spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert tuple(cdc.upsert_counts(target, keys, rows, ["id"], ["name"]).first()) == (2, 1)
    after = cdc.upserted_rows(target, keys, rows, ["id"], ["name"])
    assert sorted(map(tuple, after.collect())) == [(1, "A", 10), (3, "c", 30), (4, "d", 40)]
    assert tuple(cdc.upsert_counts(after, keys, rows, ["id"], ["name"]).first()) == (0, 0)
    assert sorted(map(tuple, cdc.upserted_rows(target, keys, rows, ["id"], []).collect())) == [(1, "a", 10), (3, "c", 30), (4, "d", 40)]


def test_composite_keys_in_text(spark):
    schema = "d timestamp_ntz, r binary, n decimal(38,0), v string"
    at, n = datetime.datetime(2024, 5, 6, 7, 8, 9), decimal.Decimal("12345678901234567890123456789012345678")
    target = spark.createDataFrame([(at, b"\x01\xab", n, "x"), (at, b"\x01\xab", n - 1, "y"), (at, b"\x02", n, "z")], schema)
    texts = [("2024-05-06 07:08:09", "01AB", str(n), "x"), ("2024-05-06 07:08:09", "02", str(n), None), ("not a date", "02", str(n), "z"), (None, "02", str(n), "z")]
    keys = spark.createDataFrame(texts, "part_0 string, part_1 string, part_2 string, part_3 string")
    assert [r.v for r in lookups.rows_of_keys(target, keys, ["d", "r", "n", "v"]).collect()] == ["x"]


def test_listed_problems(spark):
    rows = [(1, f"c{i}", "block") for i in range(7)] + [(2, "x", "missing")]
    got = {r.t: r.message for r in lookups.listed_problems(spark.createDataFrame(rows, "t int, name string, verdict string"), ["t"]).collect()}
    assert got[2] == "1 incompatibility:\n  - column x: missing"
    assert got[1].startswith("7 incompatibilities:\n  - column c0: block\n") and got[1].endswith("  - column c4: block\n  ...and 2 more.")


def test_saved_state(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted(map(tuple, monitor.refreshed(a, b, "k").collect())) == [(2, "y"), (3, None)]
    state, rows = spark.createDataFrame([(1, 5, "old"), (2, 6, "old")], "k int, made int, v string"), spark.createDataFrame([(2, 9, None), (3, 9, "new")], "k int, made int, v string")
    assert sorted(map(tuple, monitor.upserted(state, rows, "k", ["made"]).collect())) == [(1, 5, "old"), (2, 6, None), (3, 9, "new")]


def test_changes_are_streamed_once(spark, tmp_path):
    log, target, state = (str(tmp_path / x) for x in ("log", "target", "state"))
    source = spark.createDataFrame([(1, "A"), (3, "c"), (4, "d")], "id long, name string")
    changes.start(spark, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string"), target)
    entries = spark.createDataFrame([(1, 1), (2, None), (None, 4)], "old_key long, new_key long").coalesce(1)
    entries.write.parquet(log)
    for want in (0, 0):  # a second run finds nothing new
        changes.apply_changes(spark, log, entries.schema, lambda: source, target, "id", state).awaitTermination()
        assert changes.current_version(spark, target) == want
    assert sorted(map(tuple, changes.read_current(spark, target).collect())) == [(1, "A"), (3, "c"), (4, "d")]
    entries.where("new_key = 4").write.mode("append").parquet(log)
    changes.apply_changes(spark, log, entries.schema, lambda: source.where("id <> 4"), target, "id", state).awaitTermination()
    assert changes.current_version(spark, target) == 1
    assert sorted(map(tuple, changes.read_current(spark, target).collect())) == [(1, "A"), (3, "c")]


def test_open_transactions_are_mined_again(spark, tmp_path):
    log, target, state = (str(tmp_path / x) for x in ("log", "target", "state"))
    changes.start(spark, spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), target)
    schema = "scn long, open_scn long, old_key long, new_key long"
    now = [(1, "a"), (2, "b")]

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(log)
        entries = spark.createDataFrame(rows, schema).schema
        changes.apply_changes(spark, log, entries, lambda: spark.createDataFrame(now, "id long, name string"), target, "id", state).awaitTermination()
        return sorted(map(tuple, changes.read_current(spark, target).collect()))

    now[0] = (1, "A")
    assert run([(10, 20, 1, 1), (25, 20, 2, 2)]) == [(1, "A"), (2, "b")]  # key 2 is of a transaction not yet committed
    now[1] = (2, "late")
    assert run([(30, None, 1, 1)]) == [(1, "A"), (2, "late")]
    now[:] = [(1, "again"), (2, "unseen")]
    assert run([(40, None, 1, 1)]) == [(1, "again"), (2, "late")]
    assert changes.current_version(spark, target) == 2 and not (tmp_path / "target" / "v=0").exists()
