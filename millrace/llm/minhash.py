"""Near-duplicate classes by BagMinHash, banding and exact verification.

A text is the multiset of its five-word shingles. Its signature holds, for each
register, the first point of a Poisson process over (time, weight): every
shingle owns such a process, hashed from it, and a text with c copies of the
shingle sees the points at weights below c. Weights are cut at powers of two, so
the process splits into a hierarchy of intervals whose rates double; points of
the topmost interval are thinned by their place in it. Two signatures agree in a
register with a probability of exactly the weighted Jaccard similarity. Points
later than every register can need are never generated.

Texts that share a band of registers are candidates. Exact copies are one node
from the start, so no bucket holds two of one text. A bucket of a few texts
gives all its pairs. In a larger one the most central text, that with the
largest buckets over all bands, is the hub of a star: every member is compared
with it. Members linked to the hub are one class, so what is left to find are
links of the others. A text is then seen through its difference from the hub,
the shingles that one of the two has and the other has not. Two texts of which
one is not linked to the hub can only be linked if their differences overlap by
a number that follows from their sizes, so they share one of the differences'
first elements in a common order (those of the fewest texts of the star come
first, so what a text has alone brings nobody together), and the places of that
element bound the overlap. Texts that share such an element
and pass that bound are the further candidates; this loses no link. Where very
many share one, they are a star of their own, with a hub of their own, and the
step is done again; its texts agree on one more element each time, so it ends.

Bands and rows follow from the similarity sought: the most rows with which two
texts at that similarity share no band with a probability below 1e-6. At 0.8
that is 32 bands of 4 registers and 5e-8.

Defined results: a null text is empty; texts without words are copies of each
other only if equal; a text of one to four words is one shingle; a null
``doc_id`` belongs to a class but does not name it unless the class has no other;
repeated rows give a row each; an empty table gives no rows; further columns are
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHasher, batches, cut, grams, mix, text_bytes
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 128
#: Probability with which two texts at the similarity sought may share no band.
MISSED = 1e-6
#: Buckets of up to so many texts give all pairs; larger ones find the same links by stars.
SMALL = 8
#: Elements that would bring together more pairs than this become stars of their own.
CROWD = 1 << 22
#: Chance of e**-SLACK that a signature needs a second, longer look.
SLACK = 6.0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def banding(similarity: float, registers: int = REGISTERS) -> tuple[int, int]:
    """Bands and rows for a similarity."""
    rows = 1
    while rows * 2 <= registers and (1 - similarity ** (rows * 2)) ** (registers // (rows * 2)) < MISSED:
        rows *= 2
    return registers // rows, rows


def shingles(text: bytes, hasher: WordHasher, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a text and their counts."""
    words = hasher(text.lower().split())
    if not len(words):
        return words, np.zeros(0, np.int64)
    found = np.sort(grams(words, min(size, len(words))))
    starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    return found[starts], np.diff(np.append(starts, len(found)))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum()) if len(both) else 0
    total = int(a[1].sum() + b[1].sum()) - least
    return least / total if total else 0.0


def intervals(doc: np.ndarray, gram: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The weight intervals [0,1), [1,2), [2,4), [4,8), ... below each weight: document, seed, begin, width, weight."""
    docs, seeds, begins, widths, weights = [doc], [mix(gram)], [np.zeros(len(doc))], [np.ones(len(doc))], [weight.astype(np.float64)]
    begin = 1
    while (deep := weight > begin).any():
        doc, gram, weight = doc[deep], gram[deep], weight[deep]
        docs.append(doc)
        seeds.append(mix(gram + np.uint64(begin * int(GOLDEN) % (1 << 64))))
        begins.append(np.full(len(doc), float(begin)))
        widths.append(np.full(len(doc), float(begin)))
        weights.append(weight.astype(np.float64))
        begin *= 2
    return tuple(np.concatenate(x) for x in (docs, seeds, begins, widths, weights))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash signatures, a row for each bag; every bag must have a shingle."""
    out = np.full((len(bags), registers), np.inf)
    total = np.array([float(c.sum()) for _, c in bags])
    horizon = registers / total * (np.log(registers) + SLACK)
    doc = np.repeat(np.arange(len(bags)), [len(g) for g, _ in bags])
    parts = intervals(doc, np.concatenate([g for g, _ in bags]), np.concatenate([c for _, c in bags]))
    todo = np.ones(len(bags), bool)
    while todo.any():
        here = todo[parts[0]]
        doc, seed, begin, width, weight = (p[here] for p in parts)
        late = horizon
        time = np.zeros(len(doc))
        flat = out.reshape(-1)
        step = 0
        while len(doc):
            step += 1
            r = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width
            on = time <= late[doc]
            if not on.all():
                doc, seed, begin, width, weight, time, r = doc[on], seed[on], begin[on], width[on], weight[on], time[on], r[on]
            r = mix(r ^ GOLDEN)
            register = (r % np.uint64(registers)).astype(np.int64)
            place = begin + (r >> np.uint64(11)).astype(np.float64) * 2.0**-53 * width
            seen = place < weight
            np.minimum.at(flat, (doc * registers + register)[seen], time[seen])
            late = np.minimum(horizon, out.max(axis=1))  # no later point can be a register's first
        todo = np.isinf(out).any(axis=1)
        horizon[todo] *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(len(signature), bands, rows)
    out = np.zeros(bits.shape[:2], np.uint64)
    for k in range(rows):
        out = mix(out * GOLDEN + bits[:, :, k])
    return out.view(np.int64)


def text_key(text: Column) -> Column:
    """128-bit digest of a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def with_key(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (128-bit digest of the text), ``text`` (null: empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id``, ``key``, ``bands`` (hash of each band; null without words)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches(found, rows=256, size=2 << 20):
            bags = [shingles(t, hasher) for t in text_bytes(batch.column(2))]
            full = [i for i, b in enumerate(bags) if len(b[0])]
            hashes: list = [None] * len(bags)
            if full:
                for i, row in zip(full, band_hashes(signatures([bags[i] for i in full], bands * rows), bands, rows), strict=True):
                    hashes[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hashes, pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    return docs.mapInArrow(run, "doc_id long, key binary, bands array<long>")


def buckets_of(texts: DataFrame) -> DataFrame:
    """``band``, ``hash``, ``key``, ``n``, ``hub``, ``weight`` for the buckets with two texts or more.

    The hub is the text with the largest buckets over all bands, ``weight`` texts in all.
    """
    rows = texts.select("key", F.posexplode("bands").alias("band", "hash"))
    rows = rows.join(rows.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1"), ["band", "hash"])
    rows = cut(rows.withColumn("weight", F.sum("n").over(Window.partitionBy("key"))))  # a text has a row a band at most
    return rows.join(hubs_of(rows, ["band", "hash"]), ["band", "hash"]).select("band", "hash", "key", "n", "hub", F.col("top_weight").alias("weight"))


def hubs_of(members: DataFrame, group: list[str]) -> DataFrame:
    """``hub``, ``top_weight``: the member of greatest ``weight`` of each group."""
    return members.groupBy(*group).agg(F.max(F.struct("weight", "key")).alias("top")).select(*group, F.col("top.key").alias("hub"), F.col("top.weight").alias("top_weight"))


def pairs_within(groups: DataFrame) -> DataFrame:
    """All pairs of the short lists in ``members``: ``hub``, ``key``."""
    first = groups.select("members", F.posexplode("members").alias("at", "x"))
    return first.select("x", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("y")).select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("key"))


def candidates(buckets: DataFrame, small: int = SMALL) -> DataFrame:
    """``hub``, ``key``, ``star``: all pairs of small buckets (no star), and the stars of large ones."""
    few = pairs_within(buckets.where(F.col("n") <= small).groupBy("band", "hash").agg(F.collect_list("key").alias("members")))
    many = buckets.where(F.col("n") > small).select("key", "hub", "weight")
    # a hub most of whose buckets have another hub hands its own over to that one; any hub serves, a central one serves best
    ruled = many.join(many.select(F.col("hub").alias("key")).distinct(), "key", "left_semi").groupBy("key", "hub").agg(F.count("*").alias("bands"), F.max("weight").alias("weight"))
    hubs = ruled.groupBy("key").agg(F.max(F.struct("bands", "weight", "hub")).alias("top"))
    tops = hubs.select(F.col("key").alias("hub"), F.col("top.hub").alias("top"))
    for _ in range(2):
        tops = cut(tops.join(tops.select(F.col("hub").alias("top"), F.col("top").alias("next")), "top").select("hub", F.col("next").alias("top")))
    around = many.select("hub", "key").distinct().join(tops, "hub").where("key <> top").select(F.xxhash64("top").alias("star"), F.col("top").alias("hub"), "key")
    return few.withColumn("star", F.lit(None).cast("long")).unionByName(around).groupBy("hub", "key").agg(F.max("star").alias("star"))


def difference(x: tuple[np.ndarray, np.ndarray], hub: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of the elements (shingle, number of the copy) that one has and the other has not, the hub's last."""
    grams_, at = np.unique(np.concatenate([x[0], hub[0]]), return_inverse=True)
    own, other = np.zeros(len(grams_), np.int64), np.zeros(len(grams_), np.int64)
    own[at[: len(x[0])]], other[at[len(x[0]) :]] = x[1], hub[1]
    parts = []
    for more, less in ((own, other), (other, own)):
        some = np.flatnonzero(more > less)
        extra = (more - less)[some]
        copy = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + np.repeat(less[some], extra)
        parts.append(np.sort(mix(np.repeat(grams_[some], extra) + copy.astype(np.uint64) * GOLDEN)))
    return np.concatenate(parts)


def prefixes(n: int, n_hub: int, d: int, similarity: float) -> tuple[int, int]:
    """How many first elements of a difference are looked up by, and looked up for, texts that are not linked to the hub.

    The first is 0 for a linked text. Texts of n and m shingles are linked if
    they differ in at most c * (n + m) elements, so their differences from the
    hub, d and e elements, must overlap by (d + e - c * (n + m)) / 2 or more. The
    least of that over all possible partners is taken.
    """
    c = (1 - similarity) / (1 + similarity)
    for_any = max(1, math.ceil((d + c * (n_hub - n)) / 2 - 1e-6))
    beyond = d - c * (n_hub + n)
    by = 0 if beyond <= 1e-6 else max(0, d - max(1, math.ceil(beyond / (1 + c) - 1e-6)) + 1)
    return by, max(0, d - for_any + 1)


#: Pairs of a hub that share one copy of its text, about.
STAR_ROWS = 64
COMPARED = "star long, hub binary, key binary, linked boolean, n int, n_hub int, d int, n_by int, n_for int, elements array<long>"


def compared(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``star``, ``hub``, ``key`` with ``linked``: is their weighted Jaccard similarity of shingles ``similarity`` or more?

    Pairs of a star have the elements of their difference too, if any of them is looked up. A star is cut
    into parts of about ``STAR_ROWS`` pairs; each text goes to its star's part by itself
    and meets one copy of the hub's text there, so neither a star of very many
    texts nor a text of very many stars is one task's, and no row moves with two texts.
    """
    wanted = pairs.select(F.explode(F.array("hub", "key")).alias("key")).distinct()
    texts = docs.join(wanted, "key", "left_semi").select("key", "text").dropDuplicates(["key"])

    def verify(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        last: tuple[bytes | None, tuple] = (None, ())
        for batch in batches(found, rows=256, size=4 << 20):
            out = []
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3)), text_bytes(batch.column(4)), strict=True)
            for hub, key, star, x, y in rows:
                if last[0] != hub:  # a hub's rows follow each other
                    last = (hub, shingles(x, hasher))
                own, other = shingles(y, hasher), last[1]
                linked = weighted_jaccard(own, other) >= similarity
                if star is not None:
                    diff, n, n_hub = difference(own, other), int(own[1].sum()), int(other[1].sum())
                    n_by, n_for = prefixes(n, n_hub, len(diff), similarity)
                    n_by = 0 if linked else n_by
                    out.append((star, hub, key, linked, n, n_hub, len(diff), n_by, n_for, diff[: len(diff) if max(n_by, n_for) else 0].view(np.int64)))
                elif linked:
                    out.append((None, hub, key, True, None, None, None, None, None, None))
            columns = list(zip(*out, strict=True)) or [()] * 10
            types = [pa.int64(), pa.binary(), pa.binary(), pa.bool_(), *[pa.int32()] * 5, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in COMPARED.split(", ")])

    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    placed = pairs.join(sizes, "hub").select("hub", "key", "star", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    own = placed.join(texts.select("key", F.col("text").alias("text_key")), "key")
    hubs = sizes.join(texts.select(F.col("key").alias("hub"), F.col("text").alias("text_hub")), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text_hub")
    both = own.join(hubs, ["hub", "part"]).select("hub", "key", "star", "text_hub", "text_key")
    return both.mapInArrow(verify, COMPARED)


def placed_elements(seen: DataFrame) -> DataFrame:
    """The first elements of each difference with their places ``at``: ``star``, ``key``, ``n``, ``d``, ``n_by``, ``n_for``, ``element``, ``at``.

    A star's elements stand in the order of how many of its texts have them, then
    of their hashes. Those of one text alone take the first places and get no row.
    """
    each = seen.where("size(elements) > 0").select("star", "key", "n", "d", "n_by", "n_for", F.explode("elements").alias("element"))
    held = each.groupBy("star", "element").agg(F.count("*").alias("texts")).where("texts > 1")
    shared = each.join(held, ["star", "element"])
    text = Window.partitionBy("star", "key")
    alone = F.col("d") - F.count("*").over(text)
    shared = shared.withColumn("at", (alone + F.row_number().over(text.orderBy("texts", "element")) - 1).cast("int"))
    return shared.where(F.col("at") < F.greatest("n_by", "n_for")).drop("texts")


def late(seen: DataFrame, similarity: float, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """From the compared stars: pairs that may be linked though one of them is not linked to the hub, and crowded elements' stars."""
    c = (1 - similarity) / (1 + similarity)
    rows = cut(placed_elements(seen))
    by, for_ = F.col("at") < F.col("n_by"), F.col("at") < F.col("n_for")
    sizes = rows.groupBy("star", "element").agg(F.count_if(by).alias("all_by"), F.count_if(for_).alias("all_for"), F.count("*").alias("all"))
    groups = rows.join(sizes.where("all_by > 0 and all_for > 0 and all > 1"), ["star", "element"])
    few = groups.where(F.col("all_by") * F.col("all_for") <= crowd)
    x = few.where(by).select("star", "element", F.col("key").alias("x"), F.col("n").alias("n_x"), F.col("d").alias("d_x"), F.col("at").alias("at_x"), F.col("n_by").alias("by_x"))
    y = few.where(for_).select("star", "element", F.col("key").alias("y"), F.col("n").alias("n_y"), F.col("d").alias("d_y"), F.col("at").alias("at_y"), F.col("n_by").alias("by_y"))
    overlap = (F.col("d_x") + F.col("d_y") - c * (F.col("n_x") + F.col("n_y"))) / 2 - 1e-6
    most = 1 + F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y")) - 1
    once = (F.col("by_y") == 0) | (F.col("x") < F.col("y"))  # two texts apart from the hub meet both ways
    may = (x["star"] == y["star"]) & (x["element"] == y["element"]) & (F.col("x") != F.col("y")) & once & (most >= overlap)
    pairs = x.join(y, may).select(F.least("x", "y").alias("hub"), F.greatest("x", "y").alias("key")).distinct()
    many = groups.where(F.col("all_by") * F.col("all_for") > crowd)
    weights = many.groupBy("star", "key").agg((F.sum("all") / F.max("d")).alias("weight"))
    many = many.join(weights, ["star", "key"])
    group = ["star", "element"]
    return pairs, many.join(hubs_of(many, group), group).where("key <> hub").select(F.xxhash64(*group).alias("star"), "hub", "key")


def all_links(docs: DataFrame, buckets: DataFrame, similarity: float, crowd: int = CROWD) -> DataFrame:
    """``u``, ``v``: links that join all texts which a chain of links inside the buckets joins."""
    pairs = cut(candidates(buckets))
    found = []
    while True:
        seen = cut(compared(docs, pairs, similarity))
        found.append(seen.where("linked"))
        if seen.where("n_by > 0").isEmpty():
            break
        close, more = late(seen, similarity, crowd)
        found.append(compared(docs, cut(close.withColumn("star", F.lit(None).cast("long"))), similarity).where("linked"))
        pairs = cut(more)
    every = found[0]
    for links in found[1:]:
        every = every.unionByName(links)
    return every.select(F.col("hub").alias("u"), F.col("key").alias("v"))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, crowd: int = CROWD) -> DataFrame:
    """``doc_id``, ``key``, ``class_id``, ``first``: each row with the least ``doc_id`` of its class.

    ``first`` is true for one row of each class, the one of least ``doc_id``, then
    least text digest; which of rows equal in both is not told apart here.
    """
    docs = with_key(docs)
    prints = cut(banded(docs, *banding(similarity)))
    texts = prints.where("bands is not null").groupBy("key").agg(F.first("bands").alias("bands"))
    buckets = cut(buckets_of(texts))
    roots = components(all_links(docs, buckets, similarity, crowd))
    rows_ = prints.select("doc_id", "key").join(roots.select(F.col("u").alias("key"), "root"), "key", "left")
    rows_ = rows_.select("doc_id", "key", F.coalesce("root", "key").alias("root"))
    ids = rows_.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("head"))
    out = rows_.join(ids, "root")
    first = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("key") == F.col("head.key"))
    return out.select("doc_id", "key", "class_id", first.alias("first"))
