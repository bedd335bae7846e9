"""Merge-on-read stores, streams of several tables, ordered folds and prepared copies: golden cases."""

import decimal
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import documents, values
from millrace.operators import cdc, copying, lookups, ordered, planning, prepare
from millrace.sources import footers, store
from millrace.streaming import tables as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def people(spark, tmp_path):
    path = str(tmp_path / "people")
    store.create(spark, path, spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id long, name string, made int"), ["id"], 100)
    return path


def test_a_batch_writes_only_what_differs(spark, people):
    keys = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id long")
    now = spark.createDataFrame([(1, "a", 10), (3, "C", 99), (4, "d", 40), (9, "not asked for", 0)], "id long, name string, made int")
    assert store.apply(spark, people, 0, keys, now, ["id"], 200, settable=["name"]) == (2, 1)
    assert spark.read.parquet(f"{people}/delta/batch=0").count() == 3
    assert rows(store.read(spark, people, ["id"])) == [(1, "a", 10), (3, "C", 30), (4, "d", 40)]  # ``made`` is never set on a row that is there
    assert store.apply(spark, people, 0, keys, now, ["id"], 200, settable=["name"]) == (2, 1)  # run again: the same
    assert store.apply(spark, people, 1, keys, now, ["id"], 300, settable=["name"]) == (0, 0)
    assert rows(store.read(spark, people, ["id"], as_of=-1)) == [(1, "a", 10), (2, "b", 20), (3, "c", 30)]
    assert store.batch_at(spark, people, 250) == 0


def test_compaction_changes_no_reading(spark, people):
    now = spark.createDataFrame([(2, "B", 20), (5, "e", 50)], "id long, name string, made int")
    for batch, key in enumerate((2, 5, 1)):
        store.apply(spark, people, batch, spark.createDataFrame([(key,)], "id long"), now, ["id"], 200 + batch)
        if batch == 1:
            before = rows(store.read(spark, people, ["id"]))
            assert store.compact(spark, people, ["id"]) == 1
            assert rows(store.read(spark, people, ["id"])) == before == [(1, "a", 10), (2, "B", 20), (3, "c", 30), (5, "e", 50)]
    last = rows(store.read(spark, people, ["id"]))
    assert last == [(2, "B", 20), (3, "c", 30), (5, "e", 50)]
    versions = store.history(spark, people, ["id"])
    for position, batch in ((100, -1), (200, 0), (201, 1), (500, 2)):
        assert rows(store.rows_as_of(versions, F.lit(position))) == rows(store.read(spark, people, ["id"], batch))
    store.vacuum(spark, people, ["id"], 2)
    assert rows(store.read(spark, people, ["id"])) == last
    with pytest.raises(ValueError, match="gone"):
        store.read(spark, people, ["id"], 0)


def test_settling_puts_one_row_for_all_copies(spark, tmp_path):
    path = str(tmp_path / "t")
    store.create(spark, path, spark.createDataFrame([(1, "a")] * 3 + [(2, "b")] * 2 + [(3, "c")], "id long, name string"), ["id"])
    got = store.apply(spark, path, 0, spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, "a")], "id long, name string"), ["id"], 1, settle=True)
    assert got == (1, 2)  # one row put, two copies of key 2 gone
    assert rows(store.read(spark, path, ["id"])) == [(1, "a"), (3, "c")]


def test_a_batch_reads_only_the_folders_of_its_keys(spark, people):
    changed = spark.createDataFrame([(1,)], "id long")
    plan = store.View(spark, people, ["id"]).rows_of(changed)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_rows_as_of_a_position(spark):
    images = spark.createDataFrame([(1, 10, "put", "a"), (1, 20, "put", "b"), (1, 30, "gone", None), (1, 40, "put", "c"), (2, 15, "put", "x"), (None, 5, "put", "null key")], "id long, at long, op string, v string")
    versions = store.validity(images, ["id"], "at")
    assert rows(versions.select("v", "valid_from", "valid_to")) == [("a", 10, 20), ("b", 20, 30), ("c", 40, None), ("null key", 5, None), ("x", 15, None)]
    for at, want in ((9, ["null key"]), (10, ["a", "null key"]), (29, ["b", "null key", "x"]), (35, ["null key", "x"]), (99, ["c", "null key", "x"])):
        assert sorted(r.v for r in store.rows_as_of(versions, F.lit(at)).collect()) == want
    keys = spark.createDataFrame([(1,), (2,)], "id long")
    assert rows(store.reread_as_of(versions, keys, ["id"], F.lit(25), F.col("v") != "b").select("v")) == [("x",)]


LOG = "scn long, table_id long, op string, status int, old_key string, new_key string, address string, open_scn long"


def test_stream_of_three_tables(spark, tmp_path):
    log, root, state = (str(tmp_path / x) for x in ("log", "root", "state"))
    now = {1: [(1, "A"), (3, "C"), (4, "d")], 2: [(1, 1, "X"), (9, 9, "n")], 3: [(8, "new")]}
    kinds = {1: "id long, name string", 2: "id long, line int, v string", 3: "id long, z string"}
    calls, failing = [], []

    def source(n):
        def read():
            calls.append(n)
            if n in failing:
                failing.remove(n)
                raise RuntimeError("a parent row is locked")
            return spark.createDataFrame(now[n], kinds[n])

        return read

    def table(n, keys, **more):
        return streams.Table(n, keys, source(n), str(tmp_path / f"t{n}"), **more)

    tables = [table(2, ["id", "line"], parents=[1]), table(1, ["id"], from_scn=5), table(3, ["id"])]
    first = {1: [(1, "a"), (2, "b"), (3, "c")], 2: [(1, 1, "x"), (1, 2, "y")], 3: [(7, "q")]}
    for t in tables:
        store.create(spark, t.path, spark.createDataFrame(first[t.table_id], kinds[t.table_id]), t.keys)

    def run(*entries):
        spark.createDataFrame(list(entries), LOG).coalesce(1).write.mode("append").parquet(log)
        calls.clear()
        streams.apply_tables(spark, log, spark.createDataFrame([], LOG).schema, tables, root, state).awaitTermination()
        last = {r.table_id: r for r in streams.statuses(spark, root).collect() if r.batch == batch[0]}
        batch[0] += 1
        return {t.table_id: rows(store.read(spark, t.path, t.keys)) for t in tables}, last

    def update(scn, n, old, new=None, open_scn=None):
        return scn, n, "UPDATE", 0, json.dumps(list(map(str, old))), json.dumps(list(map(str, new or old))), None, open_scn

    batch = [0]
    got, status = run(update(3, 1, [1]), update(6, 1, [2], [4]), update(7, 2, [1, 2], [9, 9]), update(8, 3, [7], [8]))
    assert calls == [1, 3, 2]  # parents first
    assert got == {1: [(1, "a"), (3, "c"), (4, "d")], 2: [(1, 1, "x"), (9, 9, "n")], 3: [(8, "new")]}  # key 1 of table 1 lies before its own point
    assert [(status[i].position, status[i].status, status[i].written, status[i].deleted) for i in (1, 2, 3)] == [(6, "ready", 1, 1), (7, "ready", 1, 1), (8, "ready", 1, 1)]

    # table 3 changes its structure and is stopped; table 1 fails once and is tried again at the end; an open transaction holds key 3 of table 1
    now[3] = [(99, "never")]
    failing[:] = [1]
    got, status = run(update(10, 1, [3], open_scn=10), (11, 3, "DDL", 0, None, None, None, None), update(12, 3, [99]), update(13, 2, [1, 1]))
    assert calls == [1, 2, 1]
    assert got == {1: [(1, "a"), (3, "C"), (4, "d")], 2: [(1, 1, "X"), (9, 9, "n")], 3: [(8, "new")]}
    assert (status[3].status, status[3].error, status[3].position) == ("needs_bulk_copy", "structure changed", 8)
    assert status[1].status == "ready"

    # both attempts fail: the keys wait for the next batch; key 3 is mined again though the log does not name it
    now[1] = [(1, "A"), (3, "late"), (4, "d")]
    failing[:] = [1, 1]
    got, status = run(update(20, 1, [4]))
    assert (status[1].status, status[1].error) == ("failed", "a parent row is locked")
    assert got[1] == [(1, "a"), (3, "C"), (4, "d")]


def test_failed_keys_wait(spark, tmp_path):
    log, root, state = (str(tmp_path / x) for x in ("log", "root", "state"))
    broken = [True]

    def write(table):  # the target refuses, not the source
        if broken[0]:
            raise RuntimeError("the target refuses")
        return None

    now = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    table = streams.Table(1, ["id"], lambda: now, str(tmp_path / "t"))
    store.create(spark, table.path, spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"), ["id"])
    real = store.apply

    def refusing(*args, **more):
        write(table)
        return real(*args, **more)

    streams.store.apply = refusing
    try:
        for scn, key in ((1, 1), (2, 2)):
            spark.createDataFrame([(scn, 1, "UPDATE", 0, f'["{key}"]', f'["{key}"]', None, None)], LOG).coalesce(1).write.mode("append").parquet(log)
            streams.apply_tables(spark, log, spark.createDataFrame([], LOG).schema, [table], root, state).awaitTermination()
            broken[0] = False
    finally:
        streams.store.apply = real
    assert rows(store.read(spark, table.path, ["id"])) == [(1, "A"), (2, "B")]


def test_parents_first_with_a_cycle():
    t = {i: streams.Table(i, [], None, "", parents=p) for i, p in ((1, [2]), (2, []), (3, [4, 1]), (4, [3]), (5, [5]))}
    assert [x.table_id for x in streams.parents_first(list(t.values()))] == [2, 5, 1, 3, 4]


# --- ordered -----------------------------------------------------------------


def test_fold_of_one_large_object(spark):
    extents = spark.range(100_000).select(F.lit(1).alias("o"), F.col("id").alias("position"), (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).alias("blocks"))
    got = rows(planning.coalesce_extents(extents, ["o"], 37).select("first", "last", "blocks"))
    blocks = [r.blocks for r in extents.orderBy("position").collect()]
    target, want, first, held = -(-sum(blocks) // 37), [], None, 0
    for i, b in enumerate(blocks):
        first, held = i if first is None else first, held + b
        if held >= target or i == len(blocks) - 1:
            want.append((first, i, held))
            first, held = None, 0
    assert got == sorted(want, key=str)


def test_shared_target(spark):
    extents = spark.createDataFrame([("t", "a", i, 10) for i in range(8)] + [("t", "b", i, 10) for i in range(2)], "tab string, part string, position long, blocks long")
    parts = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "empty")], "tab string, part string")
    got = planning.partition_chunks(parts, extents, "tab", "part", 4).orderBy("part", "chunk").collect()
    # 100 blocks in 4 chunks: the target is 25, so partition a is cut at 30, 30 and 20, b is one chunk and the empty one is read whole
    assert [(r.part, r.chunk, r.first, r.last, r.blocks) for r in got] == [("a", 0, 0, 2, 30), ("a", 1, 3, 5, 30), ("a", 2, 6, 7, 20), ("b", 0, 0, 1, 20), ("empty", 0, None, None, None)]


def test_the_row_before_across_partitions(spark):
    rnd = random.Random(2)
    data = [(rnd.choice([1, 1, 1, None, 2]), i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(data, "k int, at long, v string").repartition(7)
    got = {(r.k, r.at): r.before.v if r.before else None for r in ordered.previous(df, ["k"], ["at"], ["v"]).collect()}
    last = {}
    for k, at, v in data:
        assert got[k, at] == last.get(k)
        last[k] = v
    assert ordered.previous(df.where("false"), ["k"], ["at"], ["v"]).count() == 0


def test_replayed_transitions(spark):
    rnd = random.Random(6)
    states = ["Pending", "Running", "Done", "Failed"]
    moves = [(1 if i % 3 else i % 5, i, rnd.choice(states), rnd.choice([*states, "Nowhere"])) for i in range(2000)]
    df = spark.createDataFrame(moves, "k int, at long, expected string, next string").repartition(5)
    got = {r.at: (r.state_before, r.accepted) for r in ordered.replayed(df, ["k"], ["at"], "expected", "next", states, "Pending").collect()}
    now = {}
    for k, at, expected, to in moves:
        state = now.get(k, "Pending")
        ok = state == expected and to in states
        assert got[at] == (state, ok)
        now[k] = to if ok else state


# --- logs, names, plans ------------------------------------------------------


def test_history_problems(spark):
    schema = "thread int, sequence long, name string, first_scn long, next_scn long, archived boolean, deleted boolean, incarnation long"
    logs = [
        (1, 1, "a", 100, 200, True, False, 0), (1, 2, "b", 200, 300, True, True, 0), (1, 2, "b2", 200, 300, False, False, 0), (1, 3, "c", 300, 400, True, False, 0),
        (1, 5, "e", 500, None, False, False, 0), (2, 7, "x", 90, 350, True, False, 0), (2, 8, "y", 350, 420, True, True, 0), (2, 1, "old", 0, 90, True, False, -1),
    ]
    df = spark.createDataFrame(logs, schema)
    assert rows(cdc.history_problems(df, F.lit(0), F.lit(150), F.lit(520))) == [("deleted", 2, 350, 420), ("ends early", 2, 350, 521), ("hole", 1, 400, 500)]
    assert rows(cdc.history_problems(df, F.lit(0), F.lit(150), F.lit(320))) == []
    assert ("missing", None, 51, 90) in rows(cdc.history_problems(df, F.lit(0), F.lit(50), F.lit(320)))
    assert ("reset", None, 150, 160) in rows(cdc.history_problems(df, F.lit(160), F.lit(150), F.lit(320)))
    assert rows(cdc.history_problems(df.where("false"), F.lit(0), F.lit(10), F.lit(20))) == [("missing", None, 11, 21)]


def test_names_are_allocated_once(spark):
    held = spark.createDataFrame([("a", 1, "created"), ("b", 2, "created"), ("c", 3, "created"), ("z", 9, "created")], "name string, run_id int, status string")
    wanted = spark.createDataFrame([(1, "A"), (3, " B "), (4, "new"), (5, "NEW"), (6, " ")], "run_id int, base_name string")
    got = lookups.allocated_names(wanted, held)
    # run 3 takes b over and gives up c; of two that want one name the later has it
    assert rows(got) == [("a", 1, "reserved", "kept"), ("b", 3, "reserved", "rebound"), ("new", 5, "reserved", "new"), ("z", 9, "created", "untouched")]
    again = lookups.allocated_names(wanted.where("run_id <> 4"), got.drop("action"))
    assert rows(again.select("name", "run_id")) == rows(got.select("name", "run_id"))
    assert {r.action for r in again.collect()} == {"kept", "untouched"}


@pytest.mark.parametrize(
    ("index_only", "partitioned", "visible", "extents", "numeric", "want"),
    [
        (True, False, False, True, True, "key range"), (True, True, True, True, False, "single"), (False, True, True, False, False, "partition"), (False, True, False, True, True, "range"),
        (False, True, False, False, True, "single"), (False, False, False, True, True, "range"), (False, False, False, False, True, "key range"), (False, False, False, False, False, "hash"),
    ],
)
def test_chunk_strategy(spark, index_only, partitioned, visible, extents, numeric, want):
    assert spark.range(1).select(planning.chunk_strategy(*map(F.lit, (index_only, partitioned, visible, extents, numeric)))).first()[0] == want


def test_partition_plan_rounds_up(spark):
    df = spark.createDataFrame([("a",)] * 90 + [("b",)] * 10, "p string")
    assert [tuple(r) for r in planning.partition_plan(df, "p", 8).orderBy("p").collect()] == [("a", 90, 0, 7), ("b", 10, 1, 1)]  # 13 rows a chunk


def test_natural_order_of_long_numbers(spark):
    names = ["T1", "t10", "t2", "t" + "9" * 25 + "1", "t" + "9" * 25 + "2", "t002", "a", "t0", "é9", "é10"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", values.natural_key(F.col("n")))
    got = [r.n for r in df.orderBy("k", "n").collect()]
    assert got == ["a", "t0", "T1", "t002", "t2", "t10", "t" + "9" * 25 + "1", "t" + "9" * 25 + "2", "é9", "é10"]


def test_people_read(spark):
    df = spark.createDataFrame([(400,), (9_999,), (12_400,), (59_499,), (59_500,), (185_000,), (None,)], "ms long")
    assert [r[0] for r in df.select(values.human_duration(F.col("ms"))).collect()] == ["0.4 s", "10.0 s", "12 s", "59 s", "1 min 0 s", "3 min 5 s", ""]
    df = spark.createDataFrame([(1234567, False), (3 << 20, True), (None, True)], "n long, e boolean")
    assert [tuple(r) for r in df.select(values.human_count(F.col("n")), values.human_size(F.col("n"), F.col("e"))).collect()] == [("1,234,567", "1.18 MB"), ("3,145,728", "~3.00 MB"), ("Unknown", "Unknown")]


def test_prepared_copies(spark):
    tables = spark.createDataFrame([(1, "Orders", "range"), (2, "OLD", "hash"), (3, "Bad", "single"), (4, "Clash", "hash")], "table_id int, name string, strategy string")
    live = spark.createDataFrame([("OLD",), ("bad",)], "live_name string")
    found = prepare.resolved(tables, live)
    assert rows(found.select("table_id", "target_name", "present")) == [(1, "orders", False), (2, "OLD", True), (3, "bad", True), (4, "clash", False)]
    names = spark.createDataFrame([(4, "ID"), (4, "Id"), (1, "ID"), (1, "ID")], "table_id int, name string")
    wanted = spark.createDataFrame([(2, "a", "integer", True), (3, "a", "integer", True)], "table_id int, name string, type string, nullable boolean")
    there = spark.createDataFrame([(2, "a", "integer", False, False), (3, "a", "text", False, False), (3, "q", "text", True, False)], "table_id int, name string, type string, not_null boolean, has_default boolean")
    refused = prepare.refusals(found, names, wanted, there)
    assert rows(refused) == [(3, "column a: block"), (4, "columns differ only in case: id")]
    kept = spark.createDataFrame([(2, "pk", "p", False), (2, "fk", "f", False), (2, "ck", "c", False), (2, "theirs", "f", True), (3, "pk", "p", False)], "table_id int, name string, kind string, inbound boolean")
    steps = [(r.table_id, r.action, r.detail) for r in prepare.prepared(found, refused, kept).orderBy("table_id", "step").collect()]
    assert steps == [
        (1, "create", "orders"), (1, "plan", "range"), (1, "load", "orders"), (1, "validate", "orders"),
        (2, "snapshot", "OLD"), (2, "drop constraint", "theirs"), (2, "drop constraint", "fk"), (2, "drop constraint", "ck"), (2, "drop constraint", "pk"), (2, "truncate", "OLD"),
        (2, "plan", "hash"), (2, "load", "OLD"), (2, "validate", "OLD"), (2, "restore constraint", "pk"), (2, "restore constraint", "ck"), (2, "restore constraint", "fk"), (2, "restore constraint", "theirs"),
        (3, "refuse", "column a: block"), (4, "refuse", "columns differ only in case: id"),
    ]


# --- documents, files --------------------------------------------------------


def test_nested_documents(spark):
    kind = T.StructType([
        T.StructField("table_name", T.StringType()), T.StructField("is_ready", T.BooleanType()), T.StructField("last_scn", T.DecimalType(38, 0)),
        T.StructField("key_columns", T.ArrayType(T.StructType([T.StructField("column_name", T.StringType()), T.StructField("parts", T.ArrayType(T.IntegerType()))]))),
        T.StructField("owner", T.StructType([T.StructField("user_name", T.StringType())])),
    ])
    row = ("T'\"1", True, decimal.Decimal(10**30), [("a", [1, 2]), ("b", None)], ("me",))
    df = spark.createDataFrame([(row,), ((None, None, None, None, None),)], T.StructType([T.StructField("r", kind)]))
    text = df.withColumn("t", documents.to_document(F.col("r"), kind))
    one = json.loads(text.first().t)
    assert set(one) == {"tableName", "isReady", "lastScn", "keyColumns", "owner"}
    assert one["keyColumns"][0] == {"columnName": "a", "parts": [1, 2]}
    assert text.where(~documents.from_document(F.col("t"), kind).eqNullSafe(F.col("r"))).count() == 0
    odd = '{"TABLENAME":"x","Key_Columns":[{"COLUMNNAME":"c","more":1}],"lastSCN":"oops","later":{"a":[1]},"tableName":"last"}'
    df = spark.createDataFrame([(odd,), ("not json",), (None,)], "t string")
    got = df.select(documents.from_document(F.col("t"), kind).alias("r"), documents.unknown_fields(F.col("t"), kind).alias("u")).collect()
    assert (got[0].r.table_name, got[0].r.last_scn, got[0].r.key_columns[0].column_name, got[0].r.owner) == ("last", None, "c", None)
    assert got[0].u == {"later": '{"a":[1]}'}
    assert got[2].r is None


def test_sizes_come_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select("id", F.when(F.col("id") % 4 != 0, F.col("id") * 2).alias("v"), F.lit("x" * 50).alias("pad")).repartition(3).write.parquet(path)
    bounds = footers.footer_bounds(spark, path, ["id", "v"])
    assert tuple(bounds.first()) == (1000, 0, 999, 0, 2, 1998, 250)
    assert "PushedAggregation: [COUNT(*), MIN(id)" in bounds._jdf.queryExecution().toString()
    extents = footers.file_extents(spark.read.parquet(path))
    assert extents.agg(F.sum("rows")).first()[0] == 1000
    assert "ReadSchema: struct<>" in extents._jdf.queryExecution().toString()
    assert extents.count() == 3
    assert footers.synced(spark, "gone", str(tmp_path / "gone")).first().error == "PATH_NOT_FOUND"
    cache = spark.createDataFrame([("t", 5, 5), ("gone", 7, 7)], "name string, rows long, bytes long")
    found = footers.synced(spark, "t", path).unionByName(footers.synced(spark, "gone", str(tmp_path / "gone")))
    got = {r.name: r for r in footers.refreshed_sizes(cache, found).collect()}
    assert got["t"].rows == 1000
    assert got["t"].bytes > 5
    assert (got["gone"].rows, got["gone"].bytes, got["gone"].error) == (7, 7, "PATH_NOT_FOUND")


def test_chunks_are_found_by_search_and_pruned(spark):
    df = spark.range(1000).select(F.when(F.col("id") != 500, F.col("id")).alias("k"))
    plan = copying.read_plan(planning.key_ranges(planning.ntile_bounds(df.where("k is not null"), "k", 30)))
    got = copying.chunk_rows(df, plan, "k", done=spark.createDataFrame([(c,) for c in range(3, 20)], "chunk int"))
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    want = {}
    for k in [None, *(i for i in range(1000) if i != 500)]:
        chunk = 0 if k is None else next(r.chunk for r in plan if r.high is None or k <= r.high)
        if chunk not in range(3, 20):
            want[chunk] = want.get(chunk, 0) + 1
    assert {r.chunk: r["count"] for r in got.groupBy("chunk").count().collect()} == want
