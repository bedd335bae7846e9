"""Helpers shared by the training-data operators.

Words everywhere in this subpackage are maximal runs of ``[^\\x20\\x09-\\x0D]``.
``bytes.split()`` splits on exactly those six bytes, so Python code works on
UTF-8 bytes and never needs a regular expression for it.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.checkpoints import checkpoint_dir, cut  # noqa: F401  operators take ``cut`` from here

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/millrace-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def code_points(data: bytes) -> int:
    """Number of code points of UTF-8 bytes, without decoding them."""
    return len(data) if data.isascii() else int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


class WordHasher:
    """64-bit hashes of words. Nothing is kept: to look a word up costs more than to hash it, and vocabularies grow with the corpus."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` consecutive word hashes, by doubling."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    block, width = hashes, 1
    rest = size
    while rest:
        if rest & 1:
            part = block[done : done + n]
            if out is None:
                out = part.copy()
            else:
                out = out * np.uint64(pow(base, width, 1 << 64)) + part
            done += width
        rest >>= 1
        if rest:
            block = block[:-width] * np.uint64(pow(base, width, 1 << 64)) + block[width:]
            width *= 2
    return mix(out)


def range_bounds(docs: DataFrame, column: str, count: int) -> np.ndarray:
    """Sorted values that cut ``column`` into at most ``count`` ranges of about equal rows.

    Approximate quantiles, so what reaches the driver is bounded by ``count``;
    any bounds give right results, good ones give even ranges.
    """
    if count <= 1:
        return np.zeros(0, np.int64)
    points = [i / count for i in range(1, count)]
    values = docs.where(F.col(column).isNotNull()).approxQuantile(column, points, max(1e-4, 0.2 / count))
    return np.unique(np.array([int(v) for v in values], np.int64))


def range_of(column: Column, bounds: np.ndarray) -> Column:
    """Number of the range that a value lies in; nulls go to range 0, before all.

    A search in two steps of about the square root of the bounds each.
    """
    value = F.coalesce(column.cast("long"), F.lit(-(2**63)))
    if not len(bounds):
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    groups = [[int(x) for x in bounds[i : i + step]] for i in range(0, len(bounds), step)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= value))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("long") for x in values])

    group = F.greatest(below(longs([g[0] for g in groups])) - 1, F.lit(0))
    return (group * step + below(F.get(F.array(*[longs(g) for g in groups]), group))).cast("int")


CODEC = pa.Codec("zstd")


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers from 0 on: as few bytes each as the largest needs, all first bytes before all second ones, compressed."""
    out = []
    for c in columns:
        c = c.astype(np.min_scalar_type(int(c.max())) if len(c) else np.uint8)
        planes = np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes()
        data = CODEC.compress(planes, asbytes=True)
        out += [struct.pack("<BQQ", c.itemsize, len(c), len(data)), data]
    return b"".join(out)


def columns_of(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width, n, size = struct.unpack_from("<BQQ", data, at)
        at += 17
        planes = np.frombuffer(CODEC.decompress(data[at : at + size], width * n, asbytes=True), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(width, n).T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += size
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def batches(found: Iterator[pa.RecordBatch], rows: int = 2048, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``size`` bytes."""
    for batch in found:
        step = rows if batch.nbytes <= size else max(1, int(rows * size / batch.nbytes))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
