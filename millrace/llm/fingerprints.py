"""SpotSigs document fingerprints.

Common words of running text (anchors) are followed by content words; an anchor
and the chain of content words behind it form a spot signature. The set of a
text's signatures is its fingerprint: page furniture without anchors adds
nothing to it, and an edit changes only the signatures around it. Fingerprints
are compared by Jaccard likeness; sets whose lengths alone rule out the wanted
likeness are never compared, which is why candidates are kept in partitions of
set length.

Defined results: a null text is empty; each text also has one signature of its
beginning, so that none is empty and equal texts have equal fingerprints; rows
are ordered by ``doc_id`` (null first), then text, and repeated rows follow
each other; the only row's next document is itself; an empty table gives no
rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, code_points, mix, partitions, range_bounds, range_of, text_bytes

# Frequent function words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by can do for from had has have he her his i if in is it its not of on or she so that the their "
    "there they this to was we were which will with would you "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im in ist mit nach "
    "nicht noch oder sich sie sind so um und von war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui que se "
    "son sur un une vous "
    "al como con de del el ella en era es esta este fue ha la las lo los más no para pero por que se su sus un una y"
).split()
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SIGNATURES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures int"


class SpotSigner:
    """Sorted distinct 32-bit spot signatures of texts (UTF-8 bytes)."""

    def __init__(self, anchors: list[str] | None = None, chain: int = 2, distance: int = 1) -> None:
        marks = {w.encode() for w in (ANCHORS if anchors is None else anchors)}
        self.chain, self.distance = chain, distance

        class Hasher:
            """With a bounded cache. Lowest bit: the word is an anchor. 0: no word is left without its punctuation."""

            def __init__(self, limit: int = 300_000) -> None:
                self.limit = limit
                self.known: dict[bytes, int] = {}

            def __call__(self, words: list[bytes]) -> np.ndarray:
                known = self.known
                try:
                    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                except KeyError:
                    missing = set(words).difference(known)
                if len(known) + len(missing) > self.limit:
                    known.clear()
                    missing = set(words)
                digest = xxhash.xxh3_64_intdigest
                for w in missing:
                    bare = w.strip(PUNCTUATION).lower()
                    known[w] = (digest(bare) & ~1 | (bare in marks)) if bare else 0
                return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

        self.hashes = Hasher()

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.hashes(text.split())
        words = words[words != 0]
        anchor = (words & np.uint64(1)).astype(bool)
        content = words[~anchor]
        before = np.cumsum(~anchor)[anchor]  # content words before each anchor
        span = 1 + (self.chain - 1) * self.distance
        first = content if len(content) else words
        begin = np.uint64(xxhash.xxh3_64_intdigest(first[:span].tobytes()))  # the text's beginning stands for an anchor
        full = before + span <= len(content)
        out = words[anchor][full]
        before = before[full]
        for k in range(self.chain):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + content[before + k * self.distance])
        return np.unique(np.append(out, begin).astype(np.uint64) >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 if their lengths alone put it below ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def as_string(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def prefix_bytes(text: bytes, length: int) -> bytes:
    """The first ``length`` code points."""
    return text[:length] if text[: length + 1].isascii() else text.decode()[:length].encode()


def edited(text: bytes, n_chars: int, following: bytes) -> bytes:
    """The last fourth of the text replaced by as many code points of the following one (or all)."""
    cut = n_chars // 4
    return prefix_bytes(text, n_chars - cut) + prefix_bytes(following, cut)


def with_successor(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``part``, ``copy``, ``doc_id``, ``text``: sorted ranges of documents, each closed by a copy of the next range's first document.

    The last range is closed by the first document of all. A copy has ``copy`` 1
    and sorts behind the range's own documents.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * partitions(spark)  # several in each Spark partition, so that these are even
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds = range_bounds(docs, "doc_id", ranges)
    placed = docs.withColumn("part", range_of(F.col("doc_id"), bounds)).withColumn("copy", F.lit(0))
    # one small row for each range
    firsts = sorted(tuple(r) for r in placed.groupBy("part").agg(F.min(key)).collect())
    close = [(firsts[(i + 1) % len(firsts)][1], part) for i, (part, _) in enumerate(firsts)]
    wanted = F.broadcast(spark.createDataFrame(close, "first_key long, part int"))
    copies = docs.where(key.isin([k for k, _ in close])).join(wanted, key == F.col("first_key")).groupBy("part", "doc_id").agg(F.min("text").alias("text"))
    every = placed.unionByName(copies.withColumn("copy", F.lit(1)))
    return every.repartition(partitions(spark), "part").sortWithinPartitions("part", "copy", "doc_id", "text").select("part", "copy", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, anchors: list[str] | None = None, chain: int = 2, distance: int = 1) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = SpotSigner(anchors, chain, distance)
        held: tuple | None = None
        for batch in batches(found):
            out: list[tuple] = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3)), strict=True)
            for part, copy, doc_id, text in rows:
                own = sign(text)
                if held is not None and held[0] == part:
                    _, last_id, last_text, last = held
                    n_chars = code_points(last_text)
                    changed = edited(last_text, n_chars, text)
                    new = sign(changed)
                    out.append((last_id, n_chars, hashlib.sha256(changed).hexdigest(), as_string(last), as_string(new), likeness(last, new), likeness(last, own), len(last)))
                held = None if copy else (part, doc_id, text, own)
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in SIGNATURES.split(", ")])

    return with_successor(docs).mapInArrow(run, SIGNATURES)


def length_partition(n: str, least: float) -> Column:
    """Number of the partition for a set length; alike sets lie in the same one or in neighbours."""
    return F.floor(F.log(F.col(n)) / F.lit(math.log(1 / least))).cast("int")


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs of different fingerprints with likeness of at least ``least``.

    ``prints`` has ``doc_id`` and ``fingerprint``; rows without a fingerprint are
    left out. Documents with one fingerprint form a class named by its smallest
    ``doc_id`` (null if none has one); the result pairs classes: ``class_a``,
    ``class_b``, ``likeness``. Within partitions of set length, classes are indexed
    by the rarest of their signatures only (prefix filter), so that a signature
    of very many texts is behind the prefix of all that have enough rarer ones;
    most unlike pairs never meet, and no pair is emitted within a class of copies.
    """
    size = F.length("fingerprint") / 8
    classes = prints.where("fingerprint <> ''").groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).withColumn("n", size.cast("int"))
    classes = classes.withColumn("part", length_partition("n", least)).withColumn("key", F.unhex(F.md5("fingerprint")))
    tokens = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("fingerprint").substr(i * 8 + 1, F.lit(8)))
    held = classes.select("key", "n", "part", F.explode(tokens).alias("token"))
    ranked = held.join(held.groupBy("token").agg(F.count("*").alias("texts")), "token")
    place = F.row_number().over(Window.partitionBy("key").orderBy("texts", "token"))  # of one text's own signatures
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    index = ranked.withColumn("place", place).where((F.col("place") <= prefix) & (F.col("texts") > 1)).select("key", "n", "part", "token")
    shorter = index.select(F.col("key").alias("key_a"), F.col("n").alias("n_a"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "token")
    longer = index.select(F.col("key").alias("key_b"), F.col("n").alias("n_b"), "part", "token")
    alike_length = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b")))
    pairs = shorter.join(longer, ["part", "token"]).where(alike_length & (F.col("n_a") >= F.col("n_b") * F.lit(least) - F.lit(1e-9)))
    pairs = pairs.select("key_a", "key_b").distinct()
    a = classes.select(F.col("key").alias("key_a"), F.col("class_id").alias("class_a"), F.col("fingerprint").alias("print_a"))
    b = classes.select(F.col("key").alias("key_b"), F.col("class_id").alias("class_b"), F.col("fingerprint").alias("print_b"))

    def verify(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            left = [np.frombuffer(bytes.fromhex(x), ">u4") for x in batch.column(2).to_pylist()]
            right = [np.frombuffer(bytes.fromhex(x), ">u4") for x in batch.column(3).to_pylist()]
            out = pa.array([likeness(x, y, least) for x, y in zip(left, right, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["class_a", "class_b", "likeness"])

    both = pairs.join(a, "key_a").join(b, "key_b").select("class_a", "class_b", "print_a", "print_b")
    return both.mapInArrow(verify, "class_a long, class_b long, likeness double").where(F.col("likeness") >= least - 1e-12)
