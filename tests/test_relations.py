"""Claims, readiness and the destination's side: golden cases, nulls, ties and empty tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators import claims, readiness, targets

NOW = datetime.datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(spark, data, names):
    return spark.createDataFrame(data, names)


@pytest.fixture
def states(spark):
    late, due = NOW + datetime.timedelta(seconds=1), NOW
    chunks = made(spark, [(1, 1, "Pending", None, None), (2, 1, "Pending", late, 1), (3, 1, "Pending", due, 2), (4, 1, "Running", None, 0), (5, 2, "Pending", None, 0), (6, 3, "Pending", None, 0), (7, 9, "Pending", None, 0), (8, 1, None, None, 0)], "chunk_id long, run_id long, status string, retry_after timestamp_ntz, attempts int")
    runs = made(spark, [(1, 1, "Loading"), (2, 1, "Planning"), (3, 2, "Loading")], "run_id long, job_id long, status string")
    jobs = made(spark, [(1, "Running"), (2, "Paused"), (3, None)], "job_id long, status string")
    return chunks, runs, jobs


def test_a_chunk_is_free_only_if_its_run_and_job_go_on(states):
    now = F.lit(NOW).cast("timestamp_ntz")
    free = claims.claimable(*states, now)
    assert rows(free.select("chunk_id")) == [(1,), (3,)]
    assert rows(claims.claimed(free, "w", now, 1)) == [(1, 1, "Running", "w", 1, NOW + datetime.timedelta(minutes=10))]
    assert rows(claims.claimed(free, "w", now, 9).select("chunk_id", "attempts")) == [(1, 1), (3, 3)]


def test_claims_of_ended_jobs_are_released(spark, states):
    trackers = made(spark, [("a", 1), ("b", 2), ("c", None), ("d", 99), ("e", 3)], "name string, active_job_id long")
    got = rows(claims.released(trackers, states[2]).select("name", "active_job_id", "released"))
    assert got == [("a", 1, False), ("b", None, True), ("c", None, False), ("d", None, True), ("e", None, True)]


def test_job_tree_keeps_jobs_and_runs_without_parts(states):
    chunks, runs, jobs = states
    got = {(r.job_id, r.run_id): [x.chunk_id for x in r.chunks] for r in claims.job_tree(jobs, runs, chunks.where("run_id <> 2")).collect()}
    assert got == {(1, 1): [1, 2, 3, 4, 8], (1, 2): [], (2, 3): [6], (3, None): []}


def test_search_counts(spark):
    tables = made(spark, [("EMP", "HR", "Done"), ("emp_old", "hr", None), ("X", "TEMPS", "Done"), ("Y", "Z", "Done")], "table_name string, owner string, status string")
    assert rows(claims.status_counts(claims.searched(tables, " Emp "))) == [("All", 3), ("Done", 2), (None, 1)]
    assert claims.searched(tables, " ").count() == 4
    assert rows(claims.status_counts(claims.searched(tables, "nowhere"))) in ([], [("All", 0)])


SETTINGS = "source string, log_mode string, minimal string, key_logging string, pdb_key_logging string, forced string"


def test_settings(spark):
    settings = made(spark, [("good", "archivelog", "IMPLICIT", "NO", "YES", "NO"), ("bad", "NOARCHIVELOG", "NO", "NO", None, "YES"), ("unread", None, None, None, None, None)], SETTINGS)
    got = {(r.source, r.item): (r.ok, r.fix) for r in readiness.setting_checks(settings).collect()}
    assert [got["good", i][0] for i in ("archived log", "minimal logging", "key logging", "forced logging")] == [True] * 4
    assert got["good", "forced logging"] == (True, "ALTER DATABASE FORCE LOGGING;") and got["good", "key logging"][1] is None  # advice only
    assert [got[s, i][0] for s in ("bad", "unread") for i in ("archived log", "minimal logging", "key logging", "forced logging")] == [False, False, False, True] * 2


def test_tables_and_their_fixes(spark):
    settings = made(spark, [("s", "ARCHIVELOG", "YES", "NO", None, "YES"), ("whole", "ARCHIVELOG", "YES", "YES", None, "YES")], SETTINGS)
    names = "source string, owner string, name string, has_key boolean, unlogged_parts long, reads_back boolean, support string"
    tables = made(spark, [("s", "A", "OWN", True, 0, True, "FULL"), ("s", "A", "T", True, 2, False, "NONE"), ("whole", "A", "T", None, None, True, None), ("s", "A", "b#d; x", True, 0, True, None), ("none", "A", "T", True, 0, True, None)], names)
    groups = made(spark, [("s", "A", "OWN", "PRIMARY KEY LOGGING"), ("s", "A", "OWN", "PRIMARY KEY LOGGING"), ("s", "A", "T", "ALL COLUMN LOGGING")], "source string, owner string, name string, kind string")
    found = readiness.table_checks(settings, tables, groups, "U")
    got = {(r.source, r.name): (r.ok, r.problems, r.fixes) for r in found.collect()}
    assert len(got) == found.count() == 5
    assert got["s", "OWN"] == (True, [], [])
    assert got["s", "T"][1] == ["key columns are not logged", "writes may leave no history", "earlier moments cannot be read", "history cannot describe its columns"]
    assert got["s", "T"][2] == ['ALTER TABLE "A"."T" ADD SUPPLEMENTAL LOG DATA (PRIMARY KEY) COLUMNS;', 'ALTER TABLE "A"."T" LOGGING;', 'GRANT FLASHBACK ON "A"."T" TO U;']
    assert got["whole", "T"] == (False, ["no usable key"], [])
    assert got["s", "b#d; x"] == (False, ["its name cannot be quoted"], [])
    assert got["none", "T"][1] == ["key columns are not logged"]
    assert rows(readiness.ready(readiness.setting_checks(settings), found)) == [("s", 1, 2, False), ("whole", 0, 1, False)]


def test_schemas_and_tables_of_the_destination(spark):
    held = made(spark, [("app", "USAGE"), ("app", "CREATE"), ("app", "USAGE"), ("old", "USAGE"), ("shut", "CREATE"), ("pg_toast", "USAGE"), ("pgx", "USAGE"), ("information_schema", "USAGE")], "schema string, privilege string")
    assert rows(targets.usable_schemas(held, held)) == [("app", True), ("old", False), ("pgx", False)]
    classes = made(spark, [("app", "a", "r", False), ("app", "p", "p", False), ("app", "p_1", "r", True), ("app", "v", "v", False), ("app", "fence", "r", False), ("old", "b", "r", False)], "schema string, name string, kind string, is_partition boolean")
    assert rows(targets.listed_tables(classes, "app", "fence")) == [("a",), ("p",)]


def test_arbiters_need_exactly_the_key(spark):
    flags = "t string, index_id int, is_unique boolean, valid boolean, immediate boolean, partial boolean, expressions boolean"
    good = (True, True, True, False, False)
    bad = [tuple(not x if i == k else x for i, x in enumerate(good)) for k in range(5)]
    indexes = made(spark, [("a", 1, *good), ("a", 2, *good), ("a", 3, *good), *[("a", 4 + i, *b) for i, b in enumerate(bad)], ("b", 1, *good)], flags)
    columns = made(spark, [("a", i, n) for i in (1, *range(4, 9)) for n in ("y", "x")] + [("a", 2, "x"), *[("a", 3, n) for n in "xyz"], ("b", 1, "X")], "t string, index_id int, name string")
    wanted = made(spark, [("a", "x"), ("a", "y"), ("a", "x"), ("b", "x")], "t string, name string")
    assert rows(targets.arbiters(indexes, columns, wanted, ["t"])) == [("a", 1)]


def test_promotion_of_settled_keys(spark):
    keys = made(spark, [("s", "Twice", k) for k in "ggffeeddccbbaa"] + [("s", "Emp", k) for k in "abc"] + [("s", "Full", "a")], "schema string, name string, key string")
    tables = made(spark, [("s", n, '"id"') for n in ("Twice", "Emp", "Full", "Empty")] + [("o", "Emp", '"id"')], "schema string, name string, columns string")
    taken = made(spark, [("s", "emp_pkey"), ("s", "full_pkey"), ("s", "full_m_pkey")], "schema string, relation string")
    got = {(r.schema, r.name): (r.refused, r.build, r.promote) for r in targets.promotions(keys, tables, taken).collect()}
    assert got["s", "Twice"] == ("keys with more than one row: a, b, c, d, e", None, None)
    assert got["s", "Full"][0] == "no free name for the key"
    assert got["s", "Emp"] == (None, 'CREATE UNIQUE INDEX CONCURRENTLY "emp_m_pkey" ON "s"."Emp" ("id")', 'ALTER TABLE "s"."Emp" ADD CONSTRAINT "emp_m_pkey" PRIMARY KEY USING INDEX "emp_m_pkey"')
    assert '"emp_pkey"' in got["o", "Emp"][1] and '"empty_pkey"' in got["s", "Empty"][1]


def test_key_and_index_statements(spark):
    columns = made(spark, [("S", "T", 2, "B", True, False), ("S", "T", 1, 'A"x', True, False), ("S", "T", 3, "C", True, True), ("S", "U", 1, "A", False, False)], "schema string, name string, position int, column string, is_key boolean, excluded boolean")
    indexes = made(spark, [("S", "U", "I1", True, "A, B"), ("S", "U", "I2", False, "A")], "schema string, name string, index string, is_unique boolean, columns string")
    assert [r[2] for r in rows(targets.key_and_index_text(columns, indexes))] == [
        'ALTER TABLE "S"."T" ADD CONSTRAINT "pk_t" PRIMARY KEY ("a""x", "b");', 'CREATE INDEX "idx_u_i2" ON "S"."U" ("a");', 'CREATE UNIQUE INDEX "idx_u_i1" ON "S"."U" ("a", "b");',
    ]
    assert 'CREATE INDEX "idx_U_I2" ON "S"."U" ("A");' in [r[2] for r in rows(targets.key_and_index_text(columns, indexes, lower=False))]


def test_messages(spark):
    names = made(spark, [(1, n) for n in ("Emp", "EMP", "emp", "Emp", "Dept", "DEPT", "X")] + [(2, "x")], "t int, n string")
    assert rows(targets.collision_message(names, ["t"], "n")) == [(1, '"DEPT" and "Dept" would all be "dept"; "EMP" and "Emp" and "emp" would all be "emp"')]
    columns = made(spark, [("a", "bigint", "integer"), ("b", "text", "text"), ("c", "text", None)], "name string, want_type string, live_type string")
    assert rows(targets.type_messages(columns).select("name", "severity", "message")) == [("a", "block", 'column "a" needs bigint, the destination has integer')]


def test_selection_and_foreign_keys(spark):
    tables = made(spark, [(1, "T", None, 5, True, 0), (2, "U", 3, None, False, 9)], "table_id long, name string, rows long, bytes long, is_estimate boolean, lob_bytes long")
    columns = made(spark, [(1, 2, "B", "NUMBER", 22, 5, 0, True), (1, 1, "A", "VARCHAR2", 10, None, None, False)], "table_id long, position int, name string, source_type string, length int, precision int, scale int, nullable boolean")
    got = {r.table_id: r for r in targets.selection(tables, columns).collect()}
    assert [(x.name, x.target_type, x.is_key, x.excluded) for x in got[1].columns] == [("A", "varchar(10)", False, False), ("B", "integer", False, False)]
    assert (got[1].included, got[1].rows, got[1].has_lobs, got[2].has_lobs, got[2].columns) == (True, None, False, True, None)
    constraints = made(spark, [(1, 10, "P", None), (2, 20, "R", 1), (3, 20, "R", 1), (4, 10, "R", 1), (5, 30, "R", 99), (6, 30, "R", 2), (7, 40, "R", None)], "constraint_id long, table_id long, kind string, refers_to long")
    assert rows(targets.foreign_keys(constraints)) == [(20, 10)]


def test_empty_tables(spark, states):
    none = [x.where("false") for x in states]
    assert claims.claimable(*none, F.lit(NOW)).count() == claims.job_tree(none[2], none[1], none[0]).count() == 0
    settings = made(spark, [], SETTINGS)
    assert readiness.setting_checks(settings).count() == 0
