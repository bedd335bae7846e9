"""Scans of a source and runs of copies: golden cases, nulls, ties and empty tables."""

from pyspark.sql import functions as F

from millrace.operators import runs, scan


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


TABLES = "owner string, name string, iot_type string, nested boolean, dropped boolean, temporary boolean"


def test_tables_that_can_be_copied(spark):
    made = spark.createDataFrame([
        ("HR", "HEAP", None, False, False, False), ("HR", "IOT", "IOT", False, None, False), ("HR", "OVER", "IOT_OVERFLOW", False, False, False), ("HR", "NEST", None, True, False, False),
        ("HR", "BIN", None, False, True, False), ("HR", "TEMP", None, False, False, True), ("OE", "Mixed", None, None, None, None),
    ], TABLES)
    assert rows(scan.offered_tables(made).select("name")) == [("HEAP",), ("IOT",), ("Mixed",)]
    assert rows(scan.offered_tables(made, "hr").select("name")) == [("HEAP",), ("IOT",)]
    wanted = spark.createDataFrame([("oe", "MIXED"), ("oe", "mixed"), ("hr", "temp"), (None, "heap")], "owner string, name string")
    found = scan.offered_tables(made, wanted=wanted)
    assert rows(found.select("owner", "name")) == [("OE", "Mixed")]
    columns = spark.createDataFrame([("OE", "Mixed", 2, "B", "DATE"), ("OE", "Mixed", 1, "A", "NUMBER"), ("HR", "HEAP", 1, "X", "RAW")], "owner string, name string, position long, column string, source_type string")
    assert [[c.column for c in r.columns] for r in scan.with_columns(found, columns).collect()] == [["A", "B"]]
    assert [r.columns for r in scan.with_columns(found, columns.where("false")).collect()] == [[]]


def test_keys_need_to_be_enforced(spark):
    ids = range(1, 8)
    tables = spark.createDataFrame([(i,) for i in ids], "table_id long")
    constraints = spark.createDataFrame([(1, 10, "P", True, True), (2, 20, "P", True, False), (3, 30, "U", True, True), (4, 40, "P", True, True), (5, 50, "P", True, True), (6, 60, "P", None, True)], "table_id long, constraint_id long, kind string, enabled boolean, validated boolean")
    parts = spark.createDataFrame([(10, 1, "ID"), (20, 1, "ID"), (30, 1, "ID"), (40, 2, "B"), (40, 1, "A"), (50, 1, "NOTE"), (60, 1, "ID")], "constraint_id long, position long, column string")
    columns = spark.createDataFrame([(i, "ID", "NUMBER") for i in ids] + [(4, "A", "NUMBER"), (4, "B", "DATE"), (5, "NOTE", "CLOB")], "table_id long, column string, source_type string")
    got = {r.table_id: (r.key, r.split_by, r.problem) for r in scan.enforced_keys(tables, constraints, parts, columns).collect()}
    assert got == {
        1: ("ID", "ID", None), 2: ("ID", "ID", "the key is not enforced"), 3: (None, None, "no primary key"), 4: ("A,B", None, None), 5: ("NOTE", None, "a key column cannot be read from the history"),
        6: ("ID", "ID", "the key is not enforced"), 7: (None, None, "no primary key"),
    }


def test_online_logs_hold_the_positions(spark):
    logs = spark.createDataFrame([(1, 1, 7, 0, 100, "INACTIVE"), (2, 1, 8, 100, 200, "ACTIVE"), (3, 1, 9, 200, 999, "ACTIVE"), (4, 1, 6, 0, 50, "CURRENT"), (5, 2, 3, 150, 160, "ACTIVE"), (6, 1, 99, 301, 400, "ACTIVE")], "group_id long, thread int, sequence long, first_scn long, next_scn long, status string")
    files = spark.createDataFrame([(2, "ONLINE", "b"), (2, "ONLINE", "a"), (2, "STANDBY", "0"), (3, "ONLINE", "c"), (4, "ONLINE", "d"), (1, "ONLINE", "e"), (6, "ONLINE", "f")], "group_id long, kind string, member string")
    got = rows(scan.online_logs(logs, files, F.lit(100), F.lit(300)).select("sequence", "member"))
    assert got == [(6, "d"), (8, "a"), (9, "c")]  # a log that ends at the first position holds nothing after it; a group without an online file is none


def test_one_stop_does_not_stop_others(spark):
    tables = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, 100)], "table_id long, from_scn long")
    places = spark.createDataFrame([(1, "A"), (1, "B"), (2, "B"), (3, "C"), (4, "D")], "table_id long, space string")
    files = spark.createDataFrame([("A", 100), ("A", None), ("B", 101), ("B", 5), ("C", None)], "space string, unlogged_scn long")
    unlogged = scan.unlogged_writes(tables, places, files)
    assert rows(unlogged) == [(1, 101), (2, 101)]
    assert scan.unlogged_writes(tables, places, files, forced=True).count() == 0
    drift = spark.createDataFrame([(2, "same"), (2, "truncated or moved"), (2, "dropped"), (3, "same")], "table_id long, drift string")
    assert rows(scan.stops(tables, drift, unlogged)) == [(1, "written without logging"), (2, "dropped"), (3, None), (4, None)]


def test_a_key_column_may_be_null_but_not_absent(spark):
    images = spark.createDataFrame([('{"a": 1, "b": null}',), ('{"a": 1}',), ("{}",), (None,), ("no json",), ('{"b": "x", "a": 2, "c": 3}',)], "image string")
    assert [r[0] for r in images.select(scan.present_key(["a", "b"], F.col("image"))).collect()] == [["1", None], None, None, None, None, ["2", "x"]]


def test_preflight(spark):
    made = spark.createDataFrame([(1, "s", True, 14), (2, "s", True, 13), (3, "poor", True, 17), (4, "poor", True, 17), (5, "gone", False, None)], "run_id long, schema string, can_read boolean, version int")
    schemas = spark.createDataFrame([("s", True, True), ("poor", True, False)], "schema string, can_use boolean, can_create boolean")
    wanted = spark.createDataFrame([(1, "new"), (3, "old"), *[(4, f"t{i:02}") for i in range(12)], (4, "t00")], "run_id long, name string")
    existing = spark.createDataFrame([("poor", "old"), ("s", "old")], "schema string, name string")
    got = {r.run_id: (r.passed, r.failed, r.missing, r.warning) for r in runs.preflight(made, schemas, wanted, existing).collect()}
    assert got[1] == (True, "", 1, None) and got[2] == (False, "the destination is older than 14", 0, None)
    assert got[3] == (True, "", 0, "no tables can be made here, and none need to be")
    assert got[4] == (False, "tables must be made: " + ", ".join(f"t{i:02}" for i in range(10)) + ", ...", 12, None)
    assert got[5][:2] == (False, "the source cannot be read; the destination is older than 14; the schema cannot be used")


def test_rates_of_batches(spark):
    batches = spark.createDataFrame([(1000, 1048576, 500, 125, 250), (7, 0, 0, None, 0)], "rows long, bytes long, elapsed_ms long, source_ms long, target_ms long")
    got = [(r.rows_per_s, r.mb_per_s, r.source_share, r.target_share) for r in runs.batch_rates(batches).collect()]
    assert got == [(2000.0, 2.0, 25, 50), (7000.0, 0.0, 0, 0)]


def test_trackers_after_copies(spark):
    held = spark.createDataFrame([(1, 5, "ready"), (2, 5, "ready"), (3, 5, "ready")], "t long, start_scn long, state string")
    fresh = spark.createDataFrame([(1, 9, None), (1, 8, "no key"), (2, 9, "no key"), (4, 1, None), (5, None, "no start point")], "t long, start_scn long, reason string")
    got = rows(runs.registered(held, fresh, ["t"]))
    assert got == [(1, 9, "needs_first_sync", "restarted"), (2, 5, "no key", "refused"), (3, 5, "ready", "kept"), (4, 1, "needs_first_sync", "added"), (5, None, "no start point", "refused")]
    again = spark.createDataFrame([(1, 9, "needs_first_sync")], held.schema)
    assert rows(runs.registered(again, fresh.where("t = 1"), ["t"])) == [(1, 9, "needs_first_sync", "restarted")]
    assert runs.registered(held.where("false"), fresh.where("false"), ["t"]).count() == 0


def test_last_run_and_sorting(spark):
    jobs = spark.createDataFrame([(1, "2024-01-02"), (3, "2024-01-03"), (2, "2024-01-03"), (4, None)], "job_id long, created_at string")
    assert [r.job_id for r in runs.last_run(jobs).collect()] == [3] and runs.last_run(jobs.where("false")).count() == 0
    known = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 5)], "k long, n long")
    assert [[r.k for r in runs.sorted_known_first(known, "n", down, "k").collect()] for down in (False, True)] == [[1, 4, 3, 2], [3, 1, 4, 2]]
