"""Order-dependent steps without a window over one group: the row before, and the fold that starts anew when it is full.

Rows are dealt by ranges of (keys, order), so one key that holds all rows is spread
over all partitions. Each partition is read once, in order; what it needs from the
partitions before it is one row (``previous``) or one packed row a key
(``full_groups``), so nothing else crosses a partition's edge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.checkpoints import cut


def dealt(df: DataFrame, order: list[str]) -> DataFrame:
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def same(keys: list[str], other: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{other}.{k}"))
    return out


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds ``before``: ``columns`` of the row before in ``order`` among the rows with the same ``keys``; null for the first.

    ``order`` has to tell all rows of a key apart that differ in ``columns``. Nulls come first.
    """
    kept = list(dict.fromkeys([*keys, *columns]))
    fields = [df.schema[c] for c in kept]
    struct = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    schema = T.StructType([*df.schema.fields, T.StructField("before", struct), T.StructField("part_no", T.IntegerType()), T.StructField("at_head", T.BooleanType()), T.StructField("at_tail", T.BooleanType())])

    def step(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, held = TaskContext.get().partitionId(), None, None

        def out(batch: pa.RecordBatch, last: pa.RecordBatch | None, tail: bool) -> pa.RecordBatch:
            n = batch.num_rows
            lagged = []
            for c in kept:
                column = batch.column(c)
                first = pa.nulls(1, column.type) if last is None else last.column(c)
                lagged.append(pa.concat_arrays([first, column.slice(0, n - 1)]))
            head, end = np.zeros(n, bool), np.zeros(n, bool)
            head[0], end[-1] = last is None, tail
            rows = pa.StructArray.from_arrays(lagged, kept, mask=pa.array(head))
            return pa.RecordBatch.from_arrays([*batch.columns, rows, pa.array(np.full(n, part, np.int32)), pa.array(head), pa.array(end)], [*batch.schema.names, "before", "part_no", "at_head", "at_tail"])

        for batch in found:
            if not batch.num_rows:
                continue
            if held is not None:
                yield out(held, last, False)
                last = held.slice(held.num_rows - 1)
            held = batch
        if held is not None:
            yield out(held, last, True)

    rows = cut(dealt(df, [*keys, *order]).mapInArrow(step, schema))
    # one row a partition
    tails = rows.where("at_tail").select("part_no", F.struct(*kept).alias("tail"))
    handed = tails.select(F.lead("part_no").over(Window.orderBy("part_no")).alias("to_part"), "tail").where("to_part is not null")
    joined = rows.join(F.broadcast(handed), (F.col("part_no") == F.col("to_part")) & F.col("at_head"), "left").withColumn("before", F.coalesce("before", "tail"))
    before = F.when(F.col("before").isNotNull() & same(keys, "before"), F.struct(*[F.col(f"before.{c}").alias(c) for c in columns]))
    return joined.withColumn("before", before).select(*df.columns, "before")


def full_groups(df: DataFrame, keys: list[str], position: str, amount: str, target: str) -> DataFrame:
    """Joins neighbouring rows of a key, in order of ``position``, until their ``amount`` reaches the key's ``target``, then starts the next group.

    ``keys``, ``chunk`` (from 0), ``first``, ``last``, and ``amount`` of each group. Every
    partition packs its rows into one row a key; these are read in order, holding one at
    a time, and each group's end is found by search in the running sums.
    """
    names = [*keys, "part_no", "target", "positions", "amounts"]
    key_fields = [df.schema[k] for k in keys]
    packed_schema = T.StructType([
        *key_fields, T.StructField("part_no", T.IntegerType()), T.StructField("target", T.LongType()), T.StructField("positions", T.ArrayType(T.LongType())), T.StructField("amounts", T.ArrayType(T.LongType())),
    ])
    group_schema = T.StructType([*key_fields, *[T.StructField(c, T.LongType()) for c in ("chunk", "first", "last", amount)]])

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, tables = TaskContext.get().partitionId(), []
        for batch in found:
            if batch.num_rows:
                tables.append(batch)
        if not tables:
            return
        rows = pa.Table.from_batches(tables).combine_chunks()
        n = rows.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for k in keys:
            codes = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        offsets = pa.array(np.append(starts, n).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks().cast(pa.int64())) for c in (position, amount)]
        heads = rows.take(pa.array(starts))
        columns = [heads.column(k).combine_chunks() for k in keys]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(starts), part, np.int32)), heads.column(target).combine_chunks().cast(pa.int64()), *lists], names)

    def fold(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, last, held, chunk = None, None, None, 0, 0
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            fields = [*(found_schema.field(k).type for k in keys), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, fields, strict=True)], group_schema.fieldNames())

        found_schema = None
        for batch in found:
            found_schema = batch.schema
            key_rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            goals = batch.column("target").to_pylist()
            for i, own in enumerate(key_rows):
                if own != key:
                    if first is not None:
                        out.append((*key, chunk, first, last, held))
                    key, first, last, held, chunk = own, None, None, 0, 0
                positions, amounts = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("positions", "amounts"))
                sums, at, done = np.cumsum(amounts), 0, 0
                while at < len(sums):
                    if first is None:
                        first = int(positions[at])
                    end = int(np.searchsorted(sums, goals[i] - held + done))
                    if end >= len(sums):
                        held, last, at = held + int(sums[-1]) - done, int(positions[-1]), len(sums)
                        break
                    out.append((*key, chunk, first, int(positions[end]), held + int(sums[end]) - done))
                    first, held, done, chunk, at = None, 0, int(sums[end]), chunk + 1, end + 1
            if len(out) >= 4096:
                yield table()
                out.clear()
        if first is not None:
            out.append((*key, chunk, first, last, held))
        if out:
            yield table()

    rows = dealt(df.select(*keys, position, amount, target), [*keys, position, amount]).mapInArrow(pack, packed_schema)
    rows = rows.repartition(*keys) if keys else rows.coalesce(1)
    return rows.sortWithinPartitions(*keys, "part_no").mapInArrow(fold, group_schema)


def replayed(df: DataFrame, keys: list[str], order: list[str], expected: str, to: str, states: list[str], start: str) -> DataFrame:
    """Replays compare-and-set transitions: adds ``state_before`` and ``accepted``.

    A transition is accepted where its key's state is the ``expected`` one, and then sets
    ``to``; else nothing changes. A key's transitions in one partition are a map from each
    of the ``states`` to another; these maps are applied one after the other for keys that
    cross a partition's edge, a row a partition, and then every partition replays its own.
    ``order`` has to tell a key's transitions apart.
    """
    number = {s: i for i, s in enumerate(states)}
    begin = number[start]
    key_fields = [df.schema[k] for k in keys]
    rows = cut(dealt(df, [*keys, *order]))

    def coded(batch: pa.RecordBatch) -> tuple[list[tuple], list[int], list[int]]:
        own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        return own, [number.get(x, -1) for x in batch.column(expected).to_pylist()], [number.get(x, -1) for x in batch.column(to).to_pylist()]

    def maps(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the partition's first and last key's transitions make of each state."""
        from pyspark import TaskContext

        part, edges, key, now, seen = TaskContext.get().partitionId(), [], None, [], False
        kinds: list[pa.DataType] = []
        for batch in found:
            kinds = [batch.schema.field(k).type for k in keys]
            for own, want, then in zip(*coded(batch), strict=True):
                if not seen or own != key:
                    if seen and not edges:
                        edges.append((*key, part, now))
                    key, now, seen = own, list(range(len(states))), True
                if then >= 0:
                    now = [then if s == want else s for s in now]
        if seen:
            edges.append((*key, part, now))
            columns = list(zip(*edges, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int32(), pa.list_(pa.int32())], strict=True)], [*keys, "part_no", "map"])

    def enter(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("part_no").to_pylist(), table.column("map").to_pylist(), strict=True))
        state, out = begin, []
        for _, m in parts:
            out.append(state)
            state = m[state]
        return pa.table([*[pa.concat_arrays([table.column(k).combine_chunks().slice(0, 1)] * len(parts)) for k in keys], pa.array([p for p, _ in parts], pa.int32()), pa.array(out, pa.int32())], [*keys, "part_no", "enters"])

    edge_schema = T.StructType([*key_fields, T.StructField("part_no", T.IntegerType()), T.StructField("map", T.ArrayType(T.IntegerType()))])
    enter_schema = T.StructType([*key_fields, T.StructField("part_no", T.IntegerType()), T.StructField("enters", T.IntegerType())])
    # at most two rows a partition
    entries = rows.mapInArrow(maps, edge_schema).groupBy(*keys).applyInArrow(enter, enter_schema)
    marked = rows.withColumn("here", F.spark_partition_id())
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    joined = marked.alias("r").join(F.broadcast(entries.alias("e")), [*on, F.col("r.here") == F.col("e.part_no")], "left").select("r.*", "e.enters").drop("here")
    schema = T.StructType([*df.schema.fields, T.StructField("state_before", T.StringType()), T.StructField("accepted", T.BooleanType())])

    def replay(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, seen = None, begin, False
        for batch in found:
            entered = batch.column("enters").to_pylist()
            before, accepted = [], []
            for i, (own, want, then) in enumerate(zip(*coded(batch), strict=True)):
                if not seen or own != key:
                    key, seen = own, True
                    state = begin if entered[i] is None else entered[i]
                before.append(states[state])
                accepted.append(want == state and then >= 0)
                state = then if accepted[-1] else state
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "enters"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.string()), pa.array(accepted, pa.bool_())], [*[n for n in batch.schema.names if n != "enters"], "state_before", "accepted"])

    return joined.mapInArrow(replay, schema)
