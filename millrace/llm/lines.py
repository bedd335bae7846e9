"""Line dedup with range-partitioned hashes and per-document keep bitmaps.

Lines become (hash, document, position) rows, range-partitioned and sorted by
all of them. Each partition streams its sorted rows: runs of one hash that lie
inside the partition are decided at once, runs that touch a partition's edge
wait for the counts of the neighbouring partitions. Since the range bounds are
taken over hash, document and position together, a line that a third of all
documents share is simply spread over many ranges. The decisions come back as
one compressed bitmap per document; texts are never shuffled by line.

Defined results: a null text is one empty line; a line whose key is empty (only
white space) is always kept; rows equal in ``doc_id`` and text count as one
document, are counted once and get the same bitmap; a null ``doc_id`` is a document id like any
other; an empty table gives an empty result; columns other than ``doc_id`` and
``text`` are left out of the work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, cut, partitions, text_bytes

LINE_SCHEMA = "hi long, lo long, doc_id long, text_key long, pos int, new_in_doc boolean, n_lines int"
RUN_SCHEMA = "hi long, lo long, doc_id long, text_key long, pos int, n_lines int, dropped boolean, part int, n_docs long, head boolean"


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased."""
    return line.strip(ASCII_SPACE).lower()


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and ``text_key``, which together name a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def line_rows(docs: DataFrame) -> DataFrame:
    """A row for each line with a key: its 128-bit hash, document and position."""

    def explode(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in found:
            ids, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            digests: list[int] = []
            new, pos, count, row = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                lines = text.split(b"\n")
                seen = set()
                for k, line in enumerate(lines):
                    if key := line.strip(ASCII_SPACE).lower():
                        d = digest(key)
                        digests.append(d)
                        new.append(d not in seen)
                        seen.add(d)
                        pos.append(k)
                        row.append(i)
                        count.append(len(lines))
            both = np.frombuffer(b"".join(d.to_bytes(16, "big") for d in digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both[:, 0]), pa.array(both[:, 1]),
                    pa.array([ids[i] for i in row], pa.int64()), pa.array([keys[i] for i in row], pa.int64()),
                    pa.array(pos, pa.int32()), pa.array(new, pa.bool_()), pa.array(count, pa.int32()),
                ],
                ["hi", "lo", "doc_id", "text_key", "pos", "new_in_doc", "n_lines"],
            )

    return docs.select("doc_id", "text", "text_key").mapInArrow(explode, LINE_SCHEMA)


def stream_runs(ranged: DataFrame, min_docs: int, keep_first: bool) -> DataFrame:
    """Stream the sorted rows of each partition, run by run of one hash.

    Rows of runs inside a partition come out decided (only dropped ones). Rows
    of the partition's first and last run come out undecided (``dropped`` is
    null) with what this partition knows: the run's documents here, whether the
    row is the run's first here, and the partition's number. Rows equal in all
    that they are ranged by come from a repeated document and count once; they
    stand one after the other, and always in one partition.
    """

    def stream(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["hi", "lo", "doc_id", "text_key", "pos", "n_lines"]
        open_run: list[pa.Table] = []  # the run that the next batch may continue
        first = True
        last_row: list = []

        def once(batch: pa.RecordBatch) -> pa.RecordBatch:
            """Without the rows that equal the one before, in this batch or the last."""
            nonlocal last_row
            doc = batch.column("doc_id")
            columns = [np.asarray(c) for c in (batch.column("hi"), batch.column("lo"), doc.fill_null(0), doc.is_null(), batch.column("text_key"), batch.column("pos"))]
            new = np.zeros(batch.num_rows, bool)
            new[0] = [c[0] for c in columns] != last_row
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            last_row = [c[-1] for c in columns]
            return batch if new.all() else batch.filter(pa.array(new))

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            nonlocal first
            if not open_run:
                return
            run = pa.concat_tables(open_run)
            open_run.clear()
            edge = edge or first
            first = False
            docs = int(np.count_nonzero(run.column("new_in_doc").to_numpy()))
            head = np.zeros(run.num_rows, bool)
            head[0] = True
            if not edge:
                if docs < min_docs:
                    return
                out = ~head if keep_first else np.ones(run.num_rows, bool)
                run, head = run.filter(pa.array(out)), head[out]
            yield from tagged(run, pa.nulls(run.num_rows, pa.bool_()) if edge else pa.array(np.ones(run.num_rows, bool)), np.full(run.num_rows, docs), head)

        def tagged(run: pa.Table, dropped: pa.Array, docs: np.ndarray, head: np.ndarray) -> Iterator[pa.RecordBatch]:
            if run.num_rows:
                n = run.num_rows
                table = pa.table([*(run.column(c) for c in names), dropped, pa.array(np.full(n, part, np.int32)), pa.array(docs.astype(np.int64)), pa.array(head)], [*names, "dropped", "part", "n_docs", "head"])
                yield from table.combine_chunks().to_batches()

        for batch in found:
            if not batch.num_rows or not (batch := once(batch)).num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
            if open_run:
                last = open_run[-1]
                if last.column("hi")[-1].as_py() == hi[0] and last.column("lo")[-1].as_py() == lo[0]:
                    end = int(starts[1]) if len(starts) > 1 else batch.num_rows
                    open_run.append(rows.slice(0, end))
                    rows, starts = rows.slice(end), starts[1:] - end
                    if not len(starts):
                        continue
                yield from close(edge=False)
            if first and len(starts) > 1:  # the partition's first run
                open_run.append(rows.slice(0, int(starts[1])))
                yield from close(edge=True)
                rows, starts = rows.slice(int(starts[1])), starts[1:] - starts[1]
            open_run.append(rows.slice(int(starts[-1])))
            if len(starts) > 1:  # whole runs inside the batch, decided together
                rows = rows.slice(0, int(starts[-1]))
                new = rows.column("new_in_doc").to_numpy().astype(np.int64)
                docs = np.add.reduceat(new, starts[:-1])
                sizes = np.diff(np.append(starts[:-1], rows.num_rows))
                head = np.zeros(rows.num_rows, bool)
                head[starts[:-1]] = True
                each = np.repeat(docs, sizes)
                out = (each >= min_docs) & ~(head & keep_first)
                rows = rows.filter(pa.array(out))
                yield from tagged(rows, pa.array(np.ones(rows.num_rows, bool)), each[out], head[out])
        yield from close(edge=True)

    return ranged.mapInArrow(stream, RUN_SCHEMA)


def drop_bitmaps(docs: DataFrame, min_docs: int = 1, keep_first: bool = True) -> DataFrame:
    """One row per document that loses lines: ``doc_id``, ``text_key``, ``n_lines``, ``keep``.

    ``keep`` is a zlib-compressed bitmap, bit p (most significant first) set if
    line p stays. Lines whose key is found in at least ``min_docs`` documents go,
    all but the first in (document, position) order, or all of them without
    ``keep_first``.
    """
    spark = docs.sparkSession
    order = ["hi", "lo", "doc_id", "text_key", "pos"]
    # the rows are few bytes a line; written once, the sampling for the range
    # bounds and the deal itself both read them instead of the texts
    rows = cut(line_rows(docs))
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    runs = cut(stream_runs(ranged, min_docs, keep_first))
    done = runs.where("dropped").select("doc_id", "text_key", "pos", "n_lines")
    edge = runs.where("dropped is null")
    # at most two hashes for each partition, so this side is bounded by the partitions
    sums = edge.where("head").groupBy("hi", "lo").agg(F.sum("n_docs").alias("all_docs"), F.min("part").alias("first_part"))
    waiting = edge.join(F.broadcast(sums), ["hi", "lo"])
    out = F.col("all_docs") >= min_docs
    if keep_first:
        out &= ~(F.col("head") & (F.col("part") == F.col("first_part")))
    dropped = done.unionByName(waiting.where(out).select("doc_id", "text_key", "pos", "n_lines"))
    lists = dropped.groupBy("doc_id", "text_key").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def pack(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            maps = []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                bits = np.ones(n, bool)
                bits[gone] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(maps, pa.binary())], ["doc_id", "text_key", "n_lines", "keep"])

    return lists.mapInArrow(pack, "doc_id long, text_key long, n_lines int, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """The lines that a bitmap keeps, and how many it drops (no bitmap: none)."""
    lines = text.split(b"\n")
    if keep is None:
        return lines, 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    left = [x for x, stays in zip(lines, bits, strict=True) if stays]
    return left, len(lines) - len(left)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Each row of ``keyed(docs)`` with its document's ``keep`` bitmap, null if it loses nothing."""
    maps = bitmaps.select(F.col("doc_id").alias("map_id"), F.col("text_key").alias("map_key"), "keep")
    return docs.join(maps, F.col("doc_id").eqNullSafe(F.col("map_id")) & (F.col("text_key") == F.col("map_key")), "left").drop("map_id", "map_key")


def dedup_lines(docs: DataFrame, min_docs: int = 1, keep_first: bool = True) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_dropped``, ``kept`` (bytes of the kept lines joined by a line feed)."""
    docs = keyed(docs)

    def apply(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n_lines, n_dropped, kept = [], [], []
            for text, keep in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                left, gone = kept_lines(text, keep)
                n_lines.append(len(left) + gone)
                n_dropped.append(gone)
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return with_bitmaps(docs, drop_bitmaps(docs, min_docs, keep_first)).select("doc_id", "text", "keep").mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept binary")
