"""Token ids of every document as Parquet list columns, in document order.

Documents are range-partitioned by ``doc_id`` and a hash of the text, so that
even one id, or a missing one, that a third of all rows hold is spread over many
ranges. Each range is sorted, encoded in that order and written by Spark's own
Parquet writer: ids as ``list<int>``, dictionary- or delta-encoded, with small
row groups and data pages so that the page index lets a reader fetch single
documents, or the metadata columns without the ids.

Defined results: a null text is empty and has the end id only; a null ``doc_id``
sorts before all others; rows of one ``doc_id`` are ordered by the text's hash,
then the text; an empty table writes files without rows; further columns are
left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, partitions, text_bytes
from .encoding import encoder, vocabulary

END_ID = 2
FILE_SCHEMA = "part int, place int, doc_id long, before long, n_tokens int, ids array<int>"


def ordered(docs: DataFrame, ranges: int) -> DataFrame:
    """``doc_id``, ``text`` in sorted ranges, one in each Spark partition, in the partitions' order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return docs.repartitionByRange(ranges, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 128 << 10,
    ranges: int | None = None,
) -> str:
    """Write the ids of ``docs`` to ``path``; ``encoding`` is "dictionary" or "delta"."""
    tokenizer = tokenizer or vocabulary()

    def encode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, before = TaskContext.get().partitionId(), 0, 0
        tail = np.array([end_id], "<u4").tobytes()
        encode_ids = encoder(tokenizer).ids
        for batch in batches(found, rows=512, size=4 << 20):
            n = batch.num_rows
            ids = encode_ids(text_bytes(batch.column(1)))
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 + 1 for x in ids])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(tail.join([*ids, b""]), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n, dtype=np.int32)), batch.column(0), pa.array(before + offsets[:-1]), pa.array(np.diff(offsets).astype(np.int32)), lists],
                ["part", "place", "doc_id", "before", "n_tokens", "ids"],
            )
            place, before = place + n, before + int(offsets[-1])

    rows = ordered(docs, ranges or partitions(docs.sparkSession)).mapInArrow(encode, FILE_SCHEMA)
    writer = rows.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", 2000)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    elif encoding != "dictionary":
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    writer.parquet(path)
    return path


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` without reading the ids' column."""
    return starts(spark.read.schema(FILE_SCHEMA).parquet(path)).select("doc_id", "start", "n_tokens")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """``doc_id``, ``ids`` of single documents: the filter reaches the files, which skip the row groups and pages without them."""
    return spark.read.schema(FILE_SCHEMA).parquet(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def starts(rows: DataFrame) -> DataFrame:
    """Adds ``base``, the ids of all ranges before, and ``start``, those of all documents before."""
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))  # one small row for each range
    base = sums.withColumn("base", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part")).select("part", "base")
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("before"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    rows = starts(spark.read.schema(FILE_SCHEMA).parquet(path))
    return rows.select("base", "doc_id", "before", "ids", "n_tokens").mapInArrow(_digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in found:
        lists = batch.column(3)
        raw = memoryview(np.ascontiguousarray(lists.values.to_numpy()).astype("<u4", copy=False)).cast("B")
        at = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        start = batch.column(0).to_numpy() + batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(start), batch.column(4).cast(pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
