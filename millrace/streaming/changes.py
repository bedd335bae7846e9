"""Change copies as a stream: new files of a change log are mined, re-read and applied exactly once.

The log's position is the stream's checkpoint. A batch writes the target's next
version into a folder of its own and only then names it current, so a batch that
is run again after a failure writes the same version once more and nothing is
applied twice. The version before the last is kept for readers, older ones go.

A log may say how far back transactions were still open (``open_scn``): keys
changed at or after that position (``scn``) are applied now and kept to be mined
again with the next batch, so what such a transaction commits later is not
missed. Applying a key again only re-reads its current row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.operators import cdc
from millrace.sources.checkpoints import cut, remove


def version_path(target: str, version: int) -> str:
    return f"{target}/v={version}"


def current_version(spark: SparkSession, target: str) -> int:
    """The last version with a commit row; -1 is the state before any batch."""
    return spark.read.parquet(f"{target}/commits").agg(F.max("version")).first()[0]


def read_current(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(version_path(target, current_version(spark, target)))


def commit(spark: SparkSession, target: str, version: int, written: int, deleted: int) -> None:
    row = spark.createDataFrame([(version, written, deleted)], "version long, written long, deleted long")
    row.write.mode("overwrite").parquet(f"{target}/commits/batch={version}")


def keys_waiting(spark: SparkSession, target: str, batch: int) -> DataFrame | None:
    """Keys that the batch has kept to be mined again."""
    path = f"{target}/waiting/batch={batch}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def start(spark: SparkSession, first: DataFrame, target: str) -> None:
    """Writes the bulk copy that the stream goes on from."""
    first.write.mode("overwrite").parquet(version_path(target, -1))
    commit(spark, target, -1, 0, 0)


def apply_changes(
    spark: SparkSession, log: str, schema: StructType, snapshot: Callable[[], DataFrame], target: str, key: str, checkpoint: str, files_a_batch: int = 100
) -> StreamingQuery:
    """Applies all log files not yet applied, then ends. ``old_key`` and ``new_key`` of the log name changed keys."""

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        mined = rows.select(F.explode(F.array("old_key", "new_key")).alias(key), *[c for c in ("scn", "open_scn") if c in rows.columns]).where(F.col(key).isNotNull())
        keys = mined.select(key).distinct()
        if "open_scn" in rows.columns:
            held = rows.agg(F.min("open_scn")).scalar()
            waiting = keys_waiting(session, target, number - 1)
            keys = keys if waiting is None else keys.unionByName(waiting).distinct()
            mined.where(F.col("scn") >= held).select(key).distinct().write.mode("overwrite").parquet(f"{target}/waiting/batch={number}")
        keys = cut(keys)
        before = session.read.parquet(version_path(target, number - 1))
        current = cut(cdc.reread(snapshot(), keys, key))  # read once: counts and rows are of one moment
        counts = cdc.apply_counts(before, keys, current, key).first()
        cdc.applied(before, keys, current, key).write.mode("overwrite").parquet(version_path(target, number))
        commit(session, target, number, counts.written, counts.deleted)
        if number >= 2:
            remove(session, version_path(target, number - 2))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(log)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
