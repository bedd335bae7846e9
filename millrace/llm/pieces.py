"""SentencePiece encoding by a relational lattice, and decoding.

Texts are cut into words at spaces (no piece of the table goes on behind one),
and words where two characters stand side by side that no piece holds side by
side: no piece can cross such a place, so nothing is lost. Distinct segments
become a table; their substrings of bounded length are exploded and equi-joined
to the piece table, which gives the edges of each segment's lattice; edges are
grouped by segment, and a Spark higher-order aggregate folds them into the best
path (greatest sum of scores; of equal sums the one whose last piece is
longest). A character that no piece covers is spelt in byte pieces. So the
lattice work grows with the vocabulary, not with the text.

Scores. The public model is a merge model: its piece scores are ranks, whose sum
says nothing about a path (it would prefer many early pieces to a few late
ones). A piece of rank r costs ``PIECE_COST + ln(2 + r)`` here: few pieces first,
early merges before late ones. The ids are therefore those of the best path, not
always those of the library's merges: see the README for how often they agree. A
model whose scores are log probabilities keeps them (``scores="model"``).

Documents travel as packed blocks of a scan batch. A block asks for its distinct
segments, bucket by bucket, and gets their ids back in the same order; no word
list is broadcast. Only the piece table, whose size is the model's, is. Texts are
read and cut once: what a block holds and what it asks lie in one shuffle, which
every later step reads. A bucket's segments are numbered in their order and travel
in chunks; only numbers come back from the lattice.

Defined results: a null text is empty and has no pieces; U+2581 in a text is a
space, as in the model; repeated rows are encoded each; a null ``doc_id`` is
carried; an empty table gives no rows; further columns are left out. Segments
longer than ``LONG_SEGMENT`` characters are folded by the same recurrence in
Python, where the fold is linear; ids are the same either way.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, columns_of, mix, pack, partitions, ranges, text_bytes

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LONG_SEGMENT = 256
#: Segments that travel to the lattice in one row.
CHUNK = 512
#: What each piece of a merge model costs beside the logarithm of its rank.
PIECE_COST = 5.0
#: What an uncovered character costs below the least score of a piece.
UNKNOWN_COST = 10.0
PIECE_SCHEMA = "piece string, id int, score double"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str, scores: str = "ranks") -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        score = (lambda i: m.get_score(i)) if scores == "model" else (lambda i: -PIECE_COST - math.log(2 - m.get_score(i)))
        self.plain = [(m.id_to_piece(i), i, score(i)) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        self.longest = max(len(p) for p, _, _ in self.plain)
        self.unknown = min(s for _, _, s in self.plain) - UNKNOWN_COST
        crossing = [p for p, _, _ in self.plain if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces go on behind a space: {crossing[:3]}")
        self.table = {p: (i, s) for p, i, s in self.plain}
        # which characters stand side by side in some piece; 0 is any character that no piece has
        used = sorted({c for p in self.table if len(p) > 1 for c in p})
        self.character = np.zeros(0x110000, np.int32)
        self.character[[ord(c) for c in used]] = np.arange(1, len(used) + 1)
        self.joined = np.zeros((len(used) + 1, len(used) + 1), bool)
        for p in self.table:
            at = self.character[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        surface = {i: p.replace(SPACE, " ").encode() for p, i, _ in self.plain} | {i: bytes([b]) for b, i in self.bytes.items()}
        spelt = [surface.get(i, b"") for i in ids]
        self.surface = np.frombuffer(b"".join(spelt), np.uint8)
        self.surface_lengths = np.array([len(x) for x in spelt], np.int64)
        self.surface_starts = np.cumsum(self.surface_lengths) - self.surface_lengths

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Decoded lists of ids, which begin (and the last ends) at ``offsets``; a text's first space mark is none of it."""
        ids = np.where((ids >= 0) & (ids < len(self.surface_lengths)), ids, 0)  # 0 is the unknown piece, which is nothing
        lengths = self.surface_lengths[ids]
        flat = self.surface[ranges(self.surface_starts[ids], lengths)].tobytes()
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets].tolist()
        return [flat[a:b].removeprefix(b" ") for a, b in zip(at[:-1], at[1:], strict=True)]

    def segments(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The segments of all words in a row, a hash of each, and where each word's begin (and the last's end)."""
        if not len(words):
            return pa.array([], pa.string()), np.zeros(0, np.uint64), np.zeros(1, np.int64)
        row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
        text = (SPACE + pc.binary_join(row, SPACE)[0].as_py()).replace(" ", SPACE)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64) + 1)])
        at = self.character[chars]
        cut = np.ones(len(chars) + 1, bool)
        cut[1:-1] = ~self.joined[at[:-1], at[1:]]
        cut[begins] = True
        ends = np.flatnonzero(cut)
        place = np.arange(len(chars)) - np.repeat(ends[:-1], np.diff(ends))
        hashes = np.add.reduceat(mix(chars.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)), ends[:-1])
        in_bytes = np.concatenate([[0], np.cumsum(1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000))])[ends]
        found = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(in_bytes.astype(np.int32)), pa.py_buffer(text.encode()))
        return found, mix(hashes), np.searchsorted(ends, begins)

    def viterbi(self, segment: str) -> list[int]:
        """The fold in Python, for very long segments."""
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        for end in range(1, len(segment) + 1):
            found: tuple[float, int, int] | None = None
            for start in range(max(0, end - self.longest), end):
                hit = self.table.get(segment[start:end])
                if hit is None and end - start == 1:
                    hit = (-1, self.unknown)
                if hit and (found is None or best[start][0] + hit[1] > found[0]):
                    found = (best[start][0] + hit[1], start, hit[0])
            best.append(found)
        out: list[list[int]] = []
        end = len(segment)
        while end:
            _, start, piece = best[end]
            out.append([self.bytes[b] for b in segment[start:end].encode()] if piece < 0 else [piece])
            end = start
        return [i for part in reversed(out) for i in part]


def words_of(text: bytes) -> list[bytes]:
    """Words without their first space mark; further marks of a run are spaces in front."""
    if not text:
        return []
    parts = text.replace(SPACE.encode(), b" ").split(b" ")
    if b"" not in parts:
        return parts
    out, run = [], 0
    for p in parts:
        if p:
            out.append(b" " * run + p)
            run = 0
        else:
            run += 1
    return [*out, b" " * (run - 1)] if run else out


PIECES: dict[tuple[str, str], Pieces] = {}


def pieces_of(path: str, scores: str = "ranks") -> Pieces:
    """One table for each Python worker and model."""
    if (path, scores) not in PIECES:
        PIECES[path, scores] = Pieces(path, scores)
    return PIECES[path, scores]


@dataclass
class Words:
    """The words of a batch of texts."""

    distinct: pa.Array
    n: np.ndarray  # of each text
    word: np.ndarray  # which each one is, text by text


def words_in(texts: pa.Array) -> Words:
    """``words_of`` each text; those without two spaces in a row, or one at an end, are split by Arrow."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.equal(texts, "")
    for some in (pc.match_substring(texts, "  "), pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, SPACE)):
        odd = pc.or_(odd, some)
    plain, odd = pc.split_pattern(texts.filter(pc.invert(odd)), " "), odd.to_numpy(zero_copy_only=False)
    lists = [words_of(t) for t in text_bytes(texts.filter(pa.array(odd)))]
    every = pa.concat_arrays([plain.flatten(), pa.array(list(chain.from_iterable(lists)), pa.binary()).cast(pa.string())]).dictionary_encode()
    n = np.empty(len(texts), np.int64)
    n[~odd], n[odd] = plain.value_lengths().to_numpy(), [len(x) for x in lists]
    order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
    starts = np.empty(len(texts), np.int64)
    starts[order] = np.cumsum(n[order]) - n[order]
    return Words(every.dictionary, n, every.indices.to_numpy().astype(np.int64)[ranges(starts, n)])


def asked(words: pa.Array, pieces: Pieces, buckets: int) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Distinct words' distinct segments by bucket, numbered in this order; how many each word has, and which, in a row.

    All orders follow the texts, so a block that is read again is numbered the same.
    """
    segments, hashes, begins = pieces.segments(words)
    known = segments.dictionary_encode()
    segment, names = known.indices.to_numpy().astype(np.int64), known.dictionary
    bucket = np.empty(len(names), np.int64)
    bucket[segment] = (hashes % np.uint64(buckets)).astype(np.int64)
    by_bucket = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
    place = np.empty(len(names), np.int64)
    place[by_bucket] = np.arange(len(names))
    names = names.take(pa.array(by_bucket))
    cuts = np.searchsorted(bucket[by_bucket], np.arange(buckets + 1)).tolist()
    return [names.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.diff(begins), place[segment]


def held_words(words: Words, n_segments: np.ndarray, segment: np.ndarray) -> bytes:
    """Packed: words of each text; number of each word, frequent ones have small numbers; segments of each number, and which."""
    order = np.argsort(-np.bincount(words.word, minlength=len(words.distinct)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    starts = np.cumsum(n_segments) - n_segments
    return pack(words.n, rank[words.word], n_segments[order], segment[ranges(starts[order], n_segments[order])])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


BLOCKS = "key long, block long, docs binary, data binary"


def blocks(docs: DataFrame, path: str, scores: str, buckets: int) -> DataFrame:
    """``BLOCKS``, packed: what a block asks of each bucket (``key``), and what it holds by itself, under -1 - ``block``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(batches(found, rows=4096, size=5 << 20)):
            texts = text_bytes(batch.column(1))
            words = words_in(batch.column(1))
            lists, n_segments, segment = asked(words.distinct, pieces_of(path, scores), buckets)
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            rows = packed(pa.table([batch.column(0), digests], ["id", "digest"]))
            used = [b for b, some in enumerate(lists) if len(some)]
            data = [held_words(words, n_segments, segment), *(packed(pa.table([lists[b]], ["s"])) for b in used)]
            columns = [pa.array([-1 - first - k, *used], pa.int64()), pa.array([first + k] * len(data), pa.int64()), pa.array([rows] + [None] * len(used), pa.binary()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "block", "docs", "data"])

    return docs.mapInArrow(read, BLOCKS)


def numbered_segments(requests: pa.Table) -> tuple[pa.Array, pa.Array, list[np.ndarray]]:
    """A bucket's blocks in order, its distinct segments by their numbers, and the numbers that each block asks for."""
    requests = requests.sort_by("block")
    lists = [unpacked(x).column("s").combine_chunks() for x in requests.column("data").to_pylist()]
    every = pa.concat_arrays(lists).dictionary_encode()
    order = pc.sort_indices(every.dictionary)
    number = np.empty(len(order), np.int64)
    number[order.to_numpy()] = np.arange(len(order))
    ends = np.cumsum([len(x) for x in lists])
    return requests.column("block"), every.dictionary.take(order), np.split(number[every.indices.to_numpy()], ends[:-1])


def lattice_paths(segments: DataFrame, pieces: Pieces, pieces_df: DataFrame) -> DataFrame:
    """``bucket``, ``number``, ``ids`` of the ``bucket``, ``chunk``, ``segments``, ``ids``; segments that have their ids keep them.

    Groups are told by ``name`` first, which is different in each, so that sorting them compares one number.
    """
    one = segments.select("bucket", "chunk", F.posexplode(F.arrays_zip("segments", "ids")).alias("at", "x"))
    number = F.col("chunk") * CHUNK + F.col("at")
    one = one.select((F.shiftleft(F.col("bucket"), 32) + number).alias("name"), "bucket", "chunk", F.col("x.segments").alias("segment"), F.col("x.ids").alias("ids"))
    keys = ["name", "bucket", "chunk"]
    parts = one.select(*keys, "segment", "ids", F.explode_outer(F.when(F.col("ids").isNull(), F.sequence(F.lit(1), F.length("segment")))).alias("e"))
    parts = parts.select(*keys, "segment", "ids", "e", F.explode_outer(F.when(F.col("e").isNotNull(), F.sequence(F.lit(1), F.least("e", F.lit(pieces.longest))))).alias("n"))
    parts = parts.select(*keys, "ids", "e", (F.col("e") - F.col("n")).alias("s"), F.substring("segment", F.col("e") - F.col("n") + 1, F.col("n")).alias("piece"))
    edges = parts.join(F.broadcast(pieces_df.withColumnRenamed("id", "piece_id")), "piece", "left").where("piece_id is not null or e is null or e - s = 1")
    edge = F.struct("e", "s", F.coalesce("piece_id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"), F.when(F.col("piece_id").isNull(), F.col("piece")).alias("char"))
    grouped = edges.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("e").isNotNull(), edge))).alias("edges"), F.first("ids").alias("ids"))
    state = F.struct(
        F.array(F.lit(0.0)).alias("best"), F.array().cast("array<struct<s:int,id:int,char:string>>").alias("back"),
        F.lit(1).alias("e"), F.lit(None).cast("double").alias("score"), F.struct(F.lit(0).alias("s"), F.lit(-1).alias("id"), F.lit(None).cast("string").alias("char")).alias("edge"),
    )

    def pushed(acc: Column) -> Column:
        return F.struct(
            F.concat(acc["best"], F.array(acc["score"])).alias("best"), F.concat(acc["back"], F.array(acc["edge"])).alias("back"),
            (acc["e"] + 1).alias("e"), F.lit(None).cast("double").alias("score"), acc["edge"].alias("edge"),
        )

    def step(acc: Column, x: Column) -> Column:
        moved = F.when(x["e"] > acc["e"], pushed(acc)).otherwise(acc)

        def better(a: Column) -> Column:
            score = F.get(a["best"], x["s"]) + x["score"]
            taken = F.struct(a["best"].alias("best"), a["back"].alias("back"), a["e"].alias("e"), score.alias("score"), F.struct(x["s"].alias("s"), x["id"].alias("id"), x["char"].alias("char")).alias("edge"))
            return F.when(a["score"].isNull() | (score > a["score"]), taken).otherwise(a)

        return F.get(F.transform(F.array(moved), better), F.lit(0))

    folded = grouped.select("bucket", (F.col("name") - F.shiftleft(F.col("bucket"), 32)).alias("number"), "ids", F.when(F.col("ids").isNull(), F.aggregate("edges", state, step, lambda acc: F.concat(acc["back"], F.array(acc["edge"])))).alias("back"))
    spelt = F.create_map(*[x for b, i in sorted(pieces.bytes.items()) for x in (F.lit(f"{b:02X}"), F.lit(i))])

    def as_bytes(c: Column) -> Column:
        h = F.hex(F.encode(c, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.length(h) - 1, F.lit(2)), lambda i: F.element_at(spelt, F.substring(h, i, F.lit(2))))

    def trace(acc: Column, _: Column) -> Column:
        edge = F.get("back", acc["at"] - 1)
        ids = F.when(edge["id"] < 0, as_bytes(edge["char"])).otherwise(F.array(edge["id"]))
        return F.when(acc["at"] == 0, acc).otherwise(F.struct(edge["s"].alias("at"), F.concat(ids, acc["ids"]).alias("ids")))

    begin = F.struct(F.size("back").alias("at"), F.array().cast("array<int>").alias("ids"))
    return folded.select("bucket", "number", F.coalesce("ids", F.aggregate("back", begin, trace, lambda acc: acc["ids"])).alias("ids"))


@dataclass
class Encoded:
    """A block's documents: ids in a row, and where each document's begin (and the last's end)."""

    names: pa.Array
    n_words: pa.Array
    digests: pa.Array  # of the given texts
    ids: np.ndarray
    offsets: np.ndarray


def encoded(docs: DataFrame, finish: Callable[[Encoded], pa.Table], schema: str, model: str | None = None, scores: str = "ranks") -> DataFrame:
    """What ``finish`` makes of each block of encoded documents."""
    spark = docs.sparkSession
    path = model or model_path()
    pieces = Pieces(path, scores)
    buckets = partitions(spark)
    long = LONG_SEGMENT
    held = blocks(docs, path, scores, buckets)

    def distinct_segments(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        found = numbered_segments(table)[1] if bucket >= 0 else pa.array([], pa.string())
        ids = [pieces_of(path, scores).viterbi(x.as_py()) if n >= long else None for x, n in zip(found, pc.utf8_length(found).to_pylist(), strict=True)]
        starts = pa.array(np.append(np.arange(0, len(found), CHUNK), len(found)), pa.int32())
        n = len(starts) - 1
        columns = [pa.array(np.full(n, bucket)), pa.array(np.arange(n), pa.int32()), pa.ListArray.from_arrays(starts, found), pa.ListArray.from_arrays(starts, pa.array(ids, pa.list_(pa.int32())))]
        return pa.table(columns, ["bucket", "chunk", "segments", "ids"])

    segments = held.groupBy("key").applyInArrow(distinct_segments, "bucket long, chunk int, segments array<string>, ids array<array<int>>")
    paths = lattice_paths(segments.repartition(buckets, "bucket", "chunk"), pieces, spark.createDataFrame(pieces.plain, PIECE_SCHEMA))

    def pack_paths(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            bucket, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.lexsort((number, bucket))
            bucket, number, ids = bucket[order], number[order], batch.column(2).take(pa.array(order))
            cuts = np.flatnonzero(np.append(np.diff(bucket, prepend=-1), 1))
            lists = [ids.slice(a, b - a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            rows = [pack(number[a : a + len(x)], x.value_lengths().to_numpy(), x.flatten().to_numpy()) for a, x in zip(cuts.tolist(), lists, strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(rows, pa.binary())], ["bucket", "paths"])

    paths = paths.mapInArrow(pack_paths, "bucket long, paths binary")

    def give(key: tuple, wanted: pa.Table, known: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:  # what a block holds
            return pa.table([[], [], []], pa.schema([("key", pa.int64()), ("bucket", pa.int64()), ("ids", pa.binary())]))
        blocks_, _, numbers = numbered_segments(wanted)
        number, lengths, ids = (np.concatenate(c) for c in zip(*map(columns_of, known.column("paths").to_pylist()), strict=True))
        order = np.argsort(number)
        starts, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
        rows = [pack(lengths[x], ids[ranges(starts[x], lengths[x])]) for x in numbers]
        return pa.table([pa.array(-1 - blocks_.to_numpy()), pa.array([key[0].as_py()] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["key", "bucket", "ids"])

    answers = held.groupBy("key").cogroup(paths.groupBy("bucket")).applyInArrow(give, "key long, bucket long, ids binary")

    def assemble(key: tuple, mine: pa.Table, answered: pa.Table) -> pa.Table:
        if key[0].as_py() >= 0:  # requests
            none = np.zeros(0, np.int64)
            return finish(Encoded(pa.array(none), pa.array(none), pa.array([], pa.binary()), none, np.zeros(1, np.int64)))
        docs_ = unpacked(mine.column("docs")[0].as_py())
        n_words, word, n_segments, segment = columns_of(mine.column("data")[0].as_py())
        told = answered.column("ids").to_pylist()
        lists = [columns_of(told[i]) for i in np.argsort(answered.column("bucket").to_numpy())]
        lengths, flat = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in lists)]) for k in (0, 1))
        starts = np.cumsum(lengths) - lengths
        # distinct words first, then all words
        ids = flat[ranges(starts[segment], lengths[segment])]
        ends = np.concatenate([[0], np.cumsum(lengths[segment])])[np.concatenate([[0], np.cumsum(n_segments)])]
        sizes = np.diff(ends)
        every = ids[ranges(ends[:-1][word], sizes[word])]
        offsets = np.concatenate([[0], np.cumsum(sizes[word])])[np.concatenate([[0], np.cumsum(n_words)])]
        return finish(Encoded(docs_.column("id"), pa.array(n_words), docs_.column("digest"), every, offsets))

    return held.groupBy("key").cogroup(answers.groupBy("key")).applyInArrow(assemble, schema)


def encode_ids(docs: DataFrame, model: str | None = None, scores: str = "ranks") -> DataFrame:
    """``doc_id``, ``n_words``, ``ids`` of each document."""

    def lists(e: Encoded) -> pa.Table:
        return pa.table([e.names, e.n_words, pa.ListArray.from_arrays(pa.array(e.offsets, pa.int32()), pa.array(e.ids, pa.int32()))], ["doc_id", "n_words", "ids"])

    return encoded(docs, lists, "doc_id long, n_words long, ids array<int>", model, scores)


def decode(tokens: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids, as the library decodes them.

    Null ids stay null, no ids are an empty text, and control, unknown and
    out-of-table ids are nothing. Bytes that are no UTF-8 become U+FFFD. Other
    columns are carried; one named as the output is replaced.
    """
    path = model or model_path()
    names = [c for c in tokens.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.select(*names).schema.fields) + f", `{out}` string"

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in found:
            lists = batch.column(names.index(ids))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            texts = [None if none else t.decode("utf-8", "replace") for t, none in zip(pieces.texts(flat, offsets), lists.is_null().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out])

    return tokens.select(*names).mapInArrow(run, schema)


REPORT = "doc_id long, n_words long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def report(docs: DataFrame, model: str | None = None, scores: str = "ranks") -> DataFrame:
    """Each document's digests: of its ids (little-endian unsigned 32-bit) and of the text decoded from them; does that equal the given text?"""
    path = model or model_path()

    def digest(e: Encoded) -> pa.Table:
        raw = memoryview(e.ids.astype("<u4")).cast("B")
        at = (4 * e.offsets).tolist()
        crcs = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        back = [hashlib.sha256(t).digest() for t in pieces_of(path, scores).texts(e.ids, e.offsets)]
        same = [a == b for a, b in zip(back, e.digests.to_pylist(), strict=True)]
        columns = [e.names, e.n_words, pa.array(np.diff(e.offsets)), pa.array(crcs, pa.int64()), pa.array([d.hex() for d in back], pa.string()), pa.array(same, pa.bool_())]
        return pa.table(columns, [c.split()[0] for c in REPORT.split(", ")])

    return encoded(docs, digest, REPORT, model, scores)
