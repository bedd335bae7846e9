"""Removal of repeated word sequences, by prefix-partitioned suffix trees.

Suffixes here start at words. Two suffixes share a node of depth 20 or more in
the corpus's suffix tree exactly if their first 20 words (a window) are equal,
and the words under windows that meet in such a node are the repeats. The tree
is never held as a whole:

* Short prefixes first. Every window contains content-chosen anchors: the
  8-word sequences of least hash among its 13. Equal windows have equal anchors,
  and only about a seventh of all positions are anchors. Anchors are counted
  over the whole corpus in groups of hashed prefixes small enough for a task. A
  prefix found once has one leaf below it, so no deep node, and is dropped.
* Prefixes found again are lengthened to the full 20 words. Again groups of
  hashed prefixes fit a task; sorting a group's entries brings the leaves of
  each depth-20 node together in document order, and every leaf but the first
  is a repeat.

Documents are kept in blocks, ranges of ``doc_id`` of bounded size. A block
sends each distinct prefix once, whatever its number of copies, as packed hash
arrays, and gets back one bit for each: so a passage that a third of all
documents share adds one entry a block to its group. Prefixes are told apart by
64-bit hashes in the first step (a collision there only keeps a candidate) and
by 128 bits in the second.

Defined results: a null text has no words; texts shorter than a window lose
nothing; rows are ordered by ``doc_id`` (null first), then text, so of repeated
rows the later ones are repeats; an empty table gives no rows; further columns
are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, grams, mix, partitions, range_bounds, range_of, text_bytes

WINDOW = 20
ANCHOR = 8
#: Bytes of text in a block, about.
BLOCK_BYTES = 16 << 20


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``block``, ``doc_id``, ``text``: ranges of ``doc_id`` with about ``block_bytes`` of text each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(partitions(docs.sparkSession), -(-total // block_bytes))
    return docs.select(range_of(F.col("doc_id"), range_bounds(docs, "doc_id", count)).alias("block"), "doc_id", "text")


def running(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over each run of ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = of(x[:-step], x[step:])
        have += step
    return x


@dataclass
class Block:
    """The words of a block's documents in order, and its windows."""

    ids: list[int | None]
    words: list[list[bytes]]
    offsets: np.ndarray  # of each document's first word
    hashes: np.ndarray
    starts: np.ndarray  # words at which a window starts
    least: np.ndarray  # hash of each window's anchors
    anchors: np.ndarray  # hashes of all anchors, one for each place


HASHER: list[WordHasher] = []


def read_block(table: pa.Table, window: int, anchor: int) -> Block:
    ids, texts = table.column("doc_id").to_pylist(), text_bytes(table.column("text"))
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    words = [texts[i].split() for i in order]
    if not HASHER:
        HASHER.append(WordHasher())
    counts = np.array([len(w) for w in words], np.int64)
    hashes = np.concatenate([HASHER[0](w) for w in words]) if words else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if len(hashes) < window:
        starts, least, anchors = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    else:
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        inside = doc[window - 1 :] == doc[: len(doc) - window + 1]  # the window ends in the document it starts in
        short, width = grams(hashes, anchor), window - anchor + 1
        least = running(short, width, np.minimum)
        # a place is an anchor if it is the least of some window around it
        pad = np.zeros(width - 1, np.uint64)
        anchors = short[running(np.concatenate([pad, np.where(inside, least, np.uint64(0)), pad]), width, np.maximum) == short]
        starts = np.flatnonzero(inside)
        least = least[starts]
    return Block([ids[i] for i in order], words, offsets, hashes, starts, least, anchors)


def bucket_cuts(sorted_keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the 64-bit keys begins in a sorted array."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]])


def split_out(block: int, keys: np.ndarray, more: np.ndarray | None, buckets: int) -> pa.Table:
    """A row for each bucket that has keys: packed hashes, distinct and sorted."""
    cuts = bucket_cuts(keys, buckets)
    used = np.flatnonzero(np.diff(cuts))
    a = [keys[cuts[b] : cuts[b + 1]].tobytes() for b in used]
    m = [more[cuts[b] : cuts[b + 1]].tobytes() for b in used] if more is not None else [b""] * len(used)
    return pa.table([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block, np.int32)), pa.array(a, pa.binary()), pa.array(m, pa.binary())], ["bucket", "block", "keys", "more"])


PACKED = "bucket int, block int, keys binary, more binary"
BITS = "block int, level int, bucket int, bits binary"


def answer(level: int, earlier_only: bool):  # noqa: ANN201
    """Tell each block which of its keys other blocks have too (or earlier blocks only)."""

    def tell(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks)
        raw, more = table.column("keys").to_pylist(), table.column("more").to_pylist()
        parts = [np.frombuffer(raw[i], np.uint64) for i in order]
        sizes = np.array([len(p) for p in parts])
        keys = np.concatenate(parts)
        # in block order already, so a stable sort keeps the leaves of a node in document order
        if earlier_only:
            other = np.concatenate([np.frombuffer(more[i], np.uint64) for i in order])
            rank = np.lexsort((other, keys))
            same = (keys[rank][1:] == keys[rank][:-1]) & (other[rank][1:] == other[rank][:-1])
        else:
            rank = np.argsort(keys, kind="stable")
            same = keys[rank][1:] == keys[rank][:-1]
        found = np.zeros(len(keys), bool)
        found[rank[1:]] = same
        if not earlier_only:
            found[rank[:-1]] |= same
        ends = np.cumsum(sizes)
        bits = [np.packbits(found[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        n = len(order)
        bucket = table.column("bucket").to_numpy()[:1]
        return pa.table([pa.array(blocks[order].astype(np.int32)), pa.array(np.full(n, level, np.int32)), pa.array(np.repeat(bucket, n).astype(np.int32)), pa.array(bits, pa.binary())], ["block", "level", "bucket", "bits"])

    return tell


def read_bits(table: pa.Table, level: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bits of a block's sorted distinct keys, put together from its buckets."""
    out = np.zeros(len(keys), bool)
    cuts = bucket_cuts(keys, buckets)
    for lv, b, bits in zip(table.column("level").to_pylist(), table.column("bucket").to_pylist(), table.column("bits").to_pylist(), strict=True):
        if lv == level:
            n = int(cuts[b + 1] - cuts[b])
            out[cuts[b] : cuts[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return out


def anchors_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchor hashes, and which of them the block has at two different places."""
    keys, counts = np.unique(block.anchors, return_counts=True)
    return keys, counts > 1


def windows_of(block: Block, candidate: np.ndarray, keys: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate windows: their starts, the group of each, and the groups' two keys (sorted)."""
    wanted = candidate[np.searchsorted(keys, block.least)] if len(keys) else np.zeros(0, bool)
    starts = block.starts[wanted]
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return starts, np.zeros(0, np.int64), none, none
    one = grams(block.hashes, window)[starts]
    two = grams(mix(block.hashes), window, base=0xD1342543DE82EF95)[starts]
    rank = np.lexsort((two, one))
    new = np.concatenate([[True], (one[rank][1:] != one[rank][:-1]) | (two[rank][1:] != two[rank][:-1])])
    group = np.empty(len(starts), np.int64)
    group[rank] = np.cumsum(new) - 1
    return starts, group, one[rank][new], two[rank][new]


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept`` (bytes of the kept words joined by a space)."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    docs = blocked(docs, block_bytes)

    def count_prefixes(key: tuple, table: pa.Table) -> pa.Table:
        return split_out(key[0].as_py(), anchors_of(read_block(table, window, anchor))[0], None, buckets)

    def candidates(block: Block, marks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, twice = anchors_of(block)
        return windows_of(block, twice | read_bits(marks, 1, keys, buckets), keys, window)

    def lengthen(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        _, _, one, two = candidates(read_block(table, window, anchor), marks)
        return split_out(key[0].as_py(), one, two, buckets)

    def remove(key: tuple, table: pa.Table, marks: pa.Table) -> pa.Table:
        block = read_block(table, window, anchor)
        starts, group, one, _ = candidates(block, marks)
        repeat = read_bits(marks, 2, one, buckets)[group] if len(group) else np.zeros(0, bool)
        if len(group):
            first = np.zeros(len(one), np.int64)
            first[group[::-1]] = np.arange(len(group))[::-1]  # the group's first window in this block
            repeat |= first[group] != np.arange(len(group))
        delta = np.zeros(len(block.hashes) + window + 1, np.int32)
        np.add.at(delta, starts[repeat], 1)
        np.add.at(delta, starts[repeat] + window, -1)
        covered = np.cumsum(delta)[: len(block.hashes)] > 0
        gone, digest = [], []
        for i, words in enumerate(block.words):
            out = covered[block.offsets[i] : block.offsets[i + 1]]
            n = int(np.count_nonzero(out))
            gone.append(n)
            digest.append(b" ".join([w for w, c in zip(words, out.tolist(), strict=True) if not c] if n else words))
        n_words = np.diff(block.offsets)
        return pa.table([pa.array(block.ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    by_block = docs.groupBy("block")
    short = by_block.applyInArrow(count_prefixes, PACKED).groupBy("bucket").applyInArrow(answer(1, earlier_only=False), BITS)
    long = by_block.cogroup(short.groupBy("block")).applyInArrow(lengthen, PACKED).groupBy("bucket").applyInArrow(answer(2, earlier_only=True), BITS)
    marks = short.unionByName(long)
    return by_block.cogroup(marks.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
