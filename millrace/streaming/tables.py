"""Change copies of many tables as one stream, applied to merge-on-read stores.

One pass over the log serves all tables. How far a table has come is keyed state of the
stream: records at or before its own point are passed over, a record that the log
cannot describe stops this table only (nothing of it is applied from then on, it needs
a new bulk copy), and keys changed at or after the oldest open transaction are mined
again with the next batch. The log's records reach the state packed, some thousands of
keys a row, so a table that most records belong to costs its task few rows.

In each batch tables are written parents first, each with its composite key. A table
that fails is tried once more when all others are done; if it fails again its keys wait
for the next batch. A batch that is run again replaces what it wrote.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators import cdc, lookups
from millrace.sources import store
from millrace.sources.checkpoints import remove

#: Keys that one packed row of the log holds at most.
PACKED_KEYS = 4096
PACKED = "table_id long, upto long, open_scn long, stop_scn long, stop_reason string, scns array<long>, keys array<string>"
MINED = "table_id long, position long, stop_reason string, keys array<string>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Table:
    """A tracked table: its key, the rows of the source as they are now, and its parents."""

    table_id: int
    keys: list[str]
    rows: Callable[[], DataFrame]
    path: str
    from_scn: int = 0
    parents: list[int] = field(default_factory=list)
    settable: list[str] | None = None
    settle: bool = False


def parents_first(tables: list[Table]) -> list[Table]:
    """Parents before their children; tables of a cycle in the given order behind those that do not need them."""
    left, out = list(tables), []
    while left:
        waiting = {t.table_id for t in left}
        ready = [t for t in left if not (waiting - {t.table_id}).intersection(t.parents)] or left
        out += ready
        left = [t for t in left if t not in ready]
    return out


def key_text(parts: list[Column]) -> Column:
    """A composite key as one JSON text; null if a part is missing."""
    return F.when(lookups.full_key(parts).isNotNull(), F.to_json(F.array(*[p.cast("string") for p in parts])))


def packed(log: DataFrame) -> DataFrame:
    """Log records (``scn``, ``table_id``, ``op``, ``status``, ``old_key``, ``new_key``, ``address``, and ``open_scn`` if known) as packed rows."""
    reason = cdc.stop_reason(F.col("op"), F.col("status"), F.col("old_key"), F.col("new_key"), F.col("address"))
    stops = F.when(reason != "look up by address", reason)
    open_scn = F.col("open_scn") if "open_scn" in log.columns else F.lit(None)
    rows = log.select(F.col("table_id").cast("long"), F.col("scn").cast("long"), open_scn.cast("long").alias("open_scn"), stops.alias("reason"), F.array_compact(F.array("old_key", "new_key")).alias("keys"))

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
        names = ["table_id", "upto", "open_scn", "stop_scn", "stop_reason", "scns", "keys"]
        for batch in found:
            by_table: dict[int, list[dict]] = {}
            for row in batch.to_pylist():
                if row["table_id"] is not None and row["scn"] is not None:
                    by_table.setdefault(row["table_id"], []).append(row)
            out = []
            for table_id, all_rows in by_table.items():
                for at in range(0, len(all_rows), PACKED_KEYS):
                    some = all_rows[at : at + PACKED_KEYS]
                    stop = [(r["scn"], r["reason"]) for r in some if r["reason"]]
                    last: dict[str, int] = {}
                    for r in some:
                        for k in r["keys"]:
                            last[k] = max(last.get(k, r["scn"]), r["scn"])
                    held = [r["open_scn"] for r in some if r["open_scn"] is not None]
                    # every stop counts on its own: one at or before the table's point is passed over
                    first = stop or [(None, None)]
                    out.append((table_id, max(r["scn"] for r in some), min(held, default=None), *first[0], list(last.values()), list(last)))
                    out += [(table_id, s, None, s, why, [], []) for s, why in first[1:]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(pack, PACKED)


class Miner(StatefulProcessor):
    """Per table: the point it has come to, why it was stopped, and the keys to be mined again."""

    def __init__(self, starts: dict[int, int]) -> None:
        self.starts = starts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "position long, stopped string, waiting string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        (table_id,) = key
        if table_id not in self.starts:
            return
        position, stopped, waiting = self.state.get() if self.state.exists() else (self.starts[table_id], None, None)
        if stopped is not None:
            return
        found = pd.concat(list(rows))
        stops = found[found.stop_scn.notna() & (found.stop_scn > position)]
        if len(stops):
            stopped = stops.sort_values("stop_scn").stop_reason.iloc[0]
            self.state.update((position, stopped, None))
            yield pd.DataFrame([(table_id, position, stopped, [])], columns=["table_id", "position", "stop_reason", "keys"])
            return
        upto = int(found.upto.max())
        held = found.open_scn.min()
        keys = dict.fromkeys(json.loads(waiting) if waiting else [])
        again = {}
        for scns, names in zip(found.scns, found["keys"], strict=True):
            for scn, name in zip(scns, names, strict=True):
                if scn > position:
                    keys[name] = None
                    if held == held and scn >= held:  # not NaN: a transaction that began there is still open
                        again[name] = None
        position = max(position, upto)
        self.state.update((position, None, json.dumps(list(again)) if again else None))
        names = list(keys)
        for at in range(0, max(1, len(names)), PACKED_KEYS):
            yield pd.DataFrame([(table_id, position, None, names[at : at + PACKED_KEYS])], columns=["table_id", "position", "stop_reason", "keys"])

    def close(self) -> None:
        pass


def mined(log: DataFrame, starts: dict[int, int]) -> DataFrame:
    """The keys to re-read, table by table, as a stream: ``table_id``, the ``position`` reached, ``stop_reason`` and packed ``keys``."""
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return packed(log).groupBy("table_id").transformWithStateInPandas(Miner(starts), MINED, "Append", "None")


def keys_of(found: DataFrame, table: Table, schema: StructType) -> DataFrame:
    """A table's mined keys in the types of its own columns."""
    texts = found.where(F.col("table_id") == table.table_id).select(F.explode("keys").alias("key")).distinct()
    parts = F.from_json("key", "array<string>")
    return texts.select(*[lookups.typed_key(parts[i], schema[k].dataType).alias(k) for i, k in enumerate(table.keys)]).dropna().distinct()


def apply_tables(spark: SparkSession, log: str, schema: StructType, tables: list[Table], root: str, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Applies all log files not yet applied to the tables' stores, then ends. ``root`` holds the status of each batch.

    The log's ``old_key`` and ``new_key`` are key texts (see ``key_text``).
    """
    in_order = parents_first(tables)

    def copy(table: Table, found: DataFrame, number: int, position: int) -> tuple[int, int]:
        rows = table.rows()
        changed = keys_of(found, table, rows.schema)
        left = store.rows_at(spark, f"{root}/waiting/batch={number - 1}/table={table.table_id}")
        changed = changed if left is None else changed.unionByName(left)
        waiting = f"{root}/waiting/batch={number}/table={table.table_id}"
        try:
            counts = store.apply(spark, table.path, number, changed, rows, table.keys, position, table.settable, table.settle)
        except Exception:
            changed.write.mode("overwrite").parquet(waiting)
            raise
        remove(spark, waiting)  # of an attempt before this one
        return counts

    def batch(found: DataFrame, number: int) -> None:
        found = found.persist()
        # one row a table
        state = {r.table_id: r for r in found.groupBy("table_id").agg(F.max("position").alias("position"), F.max("stop_reason").alias("why")).collect()}
        left = store.rows_at(spark, f"{root}/status/batch={number - 1}")
        before = {r.table_id: r for r in left.collect()} if left is not None else {}
        status: dict[int, tuple] = {}

        def attempt(table: Table) -> bool:
            now, last = state.get(table.table_id), before.get(table.table_id)
            position = now.position if now else last.position if last else table.from_scn
            if (now and now.why) or (last and last.status == "needs_bulk_copy"):
                status[table.table_id] = (position, "needs_bulk_copy", now.why if now and now.why else last.error, 0, 0)
                return True
            try:
                status[table.table_id] = (position, "ready", None, *copy(table, found, number, position))
            except Exception as e:  # noqa: BLE001  whatever it is, the other tables go on and the keys wait
                status[table.table_id] = (position, "failed", str(e)[:500], 0, 0)
                return False
            return True

        again = [t for t in in_order if not attempt(t)]
        for t in again:
            attempt(t)
        for t in tables:  # readers of a table without changes see the batch too
            if status[t.table_id][1] != "ready":
                store.skip(spark, t.path, number, status[t.table_id][0], t.keys)
        rows = [(t, *status[t]) for t in sorted(status)]
        spark.createDataFrame(rows, "table_id long, position long, status string, error string, written long, deleted long").coalesce(1).write.mode("overwrite").parquet(f"{root}/status/batch={number}")
        found.unpersist()

    entries = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(log)
    stream = mined(entries, {t.table_id: t.from_scn for t in tables})
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statuses(spark: SparkSession, root: str) -> DataFrame:
    """``batch``, ``table_id``, ``position``, ``status``, ``error``, ``written``, ``deleted``."""
    return spark.read.option("basePath", f"{root}/status").parquet(f"{root}/status")
