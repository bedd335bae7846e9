"""Cost-balanced packing of token sequences.

Each input partition is packed in blocks of a bounded number of sequences, so
no shuffle is needed, memory is bounded and a lost task is simply run again. In
a block, documents longer than a sequence first fill whole sequences; what is
left of each document is dealt in descending order of estimated cost (linear
plus quadratic attention cost) to the lowest-cost sequence with room for it. A
piece that fits nowhere is cut at the room of the lowest-cost open sequence.
The block's capacities add up to exactly its tokens: sequences of full length,
then one for each power of two in the remainder, which need no padding.

Defined results: a null text is empty and has the end id only; repeated rows
are packed each; a null ``doc_id`` is carried; an empty table gives no pieces;
further columns are left out. Sequence ids depend on the input's partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, text_bytes
from .encoding import encoder, vocabulary

END_ID = 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_cost double"


def cost(length: float, quadratic: float) -> float:
    """Estimated cost of ``length`` tokens that attend to each other."""
    return length + quadratic * length * length


def capacities(tokens: int, limit: int) -> list[int]:
    """Full sequences, then the powers of two of the remainder, largest first."""
    rest = tokens % limit
    return [limit] * (tokens // limit) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_block(lengths: list[int], limit: int, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) of a block, and each sequence's cost."""
    pieces, costs = [], []
    rests = []
    for doc, n in enumerate(lengths):
        whole = n // limit
        for k in range(whole):
            pieces.append((doc, k * limit, limit, len(costs), 0))
            costs.append(cost(limit, quadratic))
        if n % limit:
            rests.append((n % limit, doc, whole * limit))
    first = len(costs)
    size = np.array(capacities(sum(r[0] for r in rests), limit), np.int64)
    room, load = size.copy(), np.zeros(len(size))
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while n:
            fits = room >= n
            k = int(np.argmin(np.where(fits if fits.any() else room > 0, load, np.inf)))
            take = min(n, int(room[k]))
            pieces.append((doc, start, take, first + k, int(size[k] - room[k])))
            room[k] -= take
            load[k] += cost(take, quadratic)
            start, n = start + take, n - take
    return pieces, costs + load.tolist()


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    limit: int = 4096,
    end_id: int = END_ID,
    quadratic: float = 1 / 4096,
    block_sequences: int = 512,
) -> DataFrame:
    """Pieces of all documents with their sequence and place in it.

    ``quadratic`` weighs the squared length against the length. A block closes
    when its documents fill ``block_sequences`` sequences.
    """
    tokenizer = tokenizer or vocabulary()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        tail = np.array([end_id], "<u4").tobytes()
        encode_ids = encoder(tokenizer).ids
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal sequence, held
            lengths = [len(x) // 4 for x in ids]
            pieces, costs = pack_block(lengths, limit, quadratic)
            crcs = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]) for d, s, n, _, _ in pieces]
            doc, start, length, place, offset = np.array(pieces, np.int64).reshape(-1, 5).T
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([names[d] for d in doc], pa.int64()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()),
                    pa.array(np.array(lengths, np.int64)[doc]), pa.array(place + sequence), pa.array(offset), pa.array(np.array(costs)[place]),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_cost"],
            )
            sequence += len(costs)
            ids.clear()
            names.clear()
            held = 0
            return out

        for batch in batches(found, rows=512, size=4 << 20):
            new = [x + tail for x in encode_ids(text_bytes(batch.column(1)))]
            names += batch.column(0).to_pylist()
            ids += new
            held += sum(map(len, new)) // 4
            if held >= block_sequences * limit:
                yield close()
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)
