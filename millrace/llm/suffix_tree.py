"""Language-model scores from a probabilistic suffix tree.

States are contexts of zero to three words: every context seen ``LEAST_COUNT`` times
or more in the training tokens is a candidate (a longer one is looked at only if the
shorter ones in it are), whatever its words are and however large the corpus is. A
state predicts by its counts smoothed with its parent's (the context without its
oldest word) in Witten-Bell proportion, down to the root, whose distribution is the
corpus's word frequencies with half a count added. A candidate is retained if its
divergence from its parent, weighted by how often it is seen, is ``LEAST_GAIN`` nats
or more: the sum over its next symbols of count x log (its probability / its
parent's). Suffixes of retained states are retained. A text is
scored token by token with the longest retained suffix of what precedes.

Documents stay in packed blocks. Each block asks for its distinct words (counts
and numbers), for its distinct pairs of frequent words (are they candidates?) and
for its distinct (context, symbol) entries, which it sends with their training
counts. Entries are dealt out by the context's newest word, so that a context,
its suffixes and all their symbols meet in one bucket, which builds that part of
the tree and tells each block the probabilities. The entries of a word too
frequent for one bucket are dealt out by the context's second word too, those of
a pair too frequent by its third, so that all longer contexts are whole in their
bucket. Only the word itself (the pair) is not: its symbols' counts, added up in
each bucket first, are dealt out by word and symbol, and their probabilities come
back before the bucket answers. The driver gets three numbers for each word and
pair over several buckets, of which there are at most four a bucket.

Defined results: a null text is empty and has the end token only; tokens are
words with A-Z lower-cased; a null ``doc_id`` trains; repeated rows are counted
and scored each; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import gc
import math
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.checkpoints import remove

from .common import WordHasher, batches, columns_of, cut, mix, pack, partitions, shared_dir, text_bytes
from .pieces import packed, unpacked
from .substrings import bucket_cuts

LEAST_GAIN = 4.0
#: Contexts seen less often in the training tokens are never states, however large the corpus is.
LEAST_COUNT = 2
#: Packed tokens for each bucket, at most: there are as many buckets as that takes, so a bucket's part of the tree fits a task whatever the number of partitions.
BUCKET_BYTES = 2 << 20
END = np.uint64(0xE4D0F7E4D0F7E4D1)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


HASHER: list[WordHasher] = []


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, a place of each, and which one stands at each place; several times faster than ``np.unique``."""
    bits = len(values).bit_length()
    if len(values) and values.dtype == np.int64 and 0 <= values.min() and values.max() < 1 << (63 - bits):  # to sort numbers takes a fifth of the time that their places take
        ordered = np.sort(values << bits | np.arange(len(values)))
        order = ordered & ((1 << bits) - 1)
        ordered >>= bits
    else:
        order = np.argsort(values)
        ordered = values[order]
    new = np.ones(len(order), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


def changes(*columns: np.ndarray) -> np.ndarray:
    """Does a run of equal rows begin here?"""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it (and the last ends)."""
    order = np.argsort(bucket.astype(np.min_scalar_type(buckets)), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))


def steps_in(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending runs as their first values and the steps behind them."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def sums_in(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``steps_in`` again."""
    total = np.cumsum(steps)
    starts = np.cumsum(sizes) - sizes
    return total - np.repeat((total - steps)[starts], sizes)


def tokenized(block: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A block: its documents' ids and lengths, sorted distinct token hashes, and tokens as places in them."""
    if not HASHER:
        HASHER.append(WordHasher())
    end = np.array([END])
    parts = [np.append(HASHER[0](t.lower().split()), end) for t in text_bytes(batch.column(1))]
    keys, _, token = distinct(np.concatenate(parts))
    docs = packed(pa.table([batch.column(0), pa.array([len(p) for p in parts], pa.int64())], ["id", "n"]))
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([docs], pa.binary()), pa.array([keys.tobytes()], pa.binary()), pa.array([pack(token)], pa.binary())], ["block", "docs", "words", "tokens"])


def numbered(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and training counts of a block's words."""
    steps, count = columns_of(words)
    return np.cumsum(steps), count


@dataclass
class Tokens:
    ids: list[int | None]
    offsets: np.ndarray  # of each document's first token
    token: np.ndarray  # each token's word, by its place in the block
    place: np.ndarray  # of each token in its document
    train: np.ndarray  # is the token's document a training one?


def read_tokens(docs: bytes, tokens: bytes) -> Tokens:
    t = unpacked(docs)
    ids, counts = t.column("id").to_pylist(), t.column("n").to_numpy()
    offsets = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    return Tokens(ids, offsets, columns_of(tokens)[0], place, np.repeat([not held_out(i) for i in ids], counts))


@dataclass
class Pairs:
    """A block's distinct pairs of frequent words, ascending."""

    newer: np.ndarray
    older: np.ndarray
    seen: np.ndarray
    order: np.ndarray  # by bucket
    cuts: np.ndarray
    at: np.ndarray  # of each token, the pair that ends with it, or -1


def pairs_of(t: Tokens, number: np.ndarray, count: np.ndarray, buckets: int, least: int) -> Pairs:
    often = (count >= least)[t.token]
    last = np.zeros(len(t.token), bool)
    last[t.offsets[1:] - 1] = True  # nothing follows an end token
    ends = np.flatnonzero((t.place[1:] >= 1) & ~last[1:] & often[1:] & often[:-1]) + 1
    bits = len(number).bit_length()
    codes, _, at = distinct(t.token[ends] << bits | t.token[ends - 1])
    seen = np.bincount(at[t.train[ends]], minlength=len(codes))
    newer, older = codes >> bits, codes & ((1 << bits) - 1)
    bucket = (context_hash(number[newer], number[older]) % np.uint64(buckets)).astype(np.int64)
    pair = np.full(len(t.token), -1, np.int64)
    pair[ends] = at
    return Pairs(newer, older, seen, *by_bucket(bucket, buckets), pair)


def context_hash(*words: np.ndarray) -> np.ndarray:
    """Of the words' numbers, newest first; 0 stands for no word."""
    out = mix(words[0].astype(np.uint64))
    for w in words[1:]:
        out = np.where(w > 0, mix(out * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)), out)
    return out


@dataclass
class Entries:
    """A block's distinct (context, symbol) entries, by bucket: each token's one with its longest candidate context."""

    context: np.ndarray
    symbol: np.ndarray
    seen: np.ndarray
    words: list[np.ndarray]  # of each context, newest first, -1: none
    cuts: np.ndarray
    at: np.ndarray  # each token's entry, or -1


def shares_of(count: np.ndarray, buckets: int, n_tokens: int) -> np.ndarray:
    """Buckets over which the entries of a context seen so often are dealt out; under 2: they stay together."""
    return count * 4 * buckets // max(n_tokens, 1)


def entries_of(t: Tokens, number: np.ndarray, count: np.ndarray, pairs: Pairs, pairs_told: np.ndarray, buckets: int, least: int, n_tokens: int) -> Entries:
    """``pairs_told``: 0 for pairs that are no candidates, else 1 and their shares.

    Buckets from ``buckets`` on take words over several buckets, from twice that on pairs over several.
    """
    n, words, pair_shares = len(t.token), len(count), np.zeros(len(pairs.newer) + 1, np.int64)
    pair_shares[pairs.order] = pairs_told  # the last stands for no pair
    is_pair = pair_shares > 0
    one = np.flatnonzero((t.place >= 1) & (count >= least)[np.roll(t.token, 1)])
    before = np.roll(pairs.at, 1)  # the pair before each token
    two = np.flatnonzero((t.place >= 2) & is_pair[before])
    three = np.flatnonzero((t.place >= 3) & is_pair[before] & is_pair[np.roll(pairs.at, 2)])
    bits = words.bit_length()
    triples, _, triple = distinct(before[three] << bits | t.token[three - 3])
    pair = triples >> bits
    none = np.full(words, -1)
    of = [
        np.concatenate([np.arange(words), pairs.newer, pairs.newer[pair]]),
        np.concatenate([none, pairs.older, pairs.older[pair]]),
        np.concatenate([none, np.full(len(pairs.newer), -1), triples & ((1 << bits) - 1)]),
    ]
    # contexts are numbered by length, then in the order of their words, newest first
    longest = np.full(n, -1, np.int64)  # wherever a context precedes a symbol its suffixes do, so these are told from it
    longest[one] = t.token[one - 1]
    longest[two] = words + before[two]
    longest[three] = words + len(pairs.newer) + triple
    where = np.flatnonzero(longest >= 0)
    codes, _, at = distinct(longest[where] << bits | t.token[where])
    seen = np.bincount(at[t.train[where]], minlength=len(codes))
    context, symbol = codes >> bits, codes & ((1 << bits) - 1)
    # where a context lies: by its newest word, or two, and the part that its next word gives (the symbol, if it has none)
    shares = np.concatenate([shares_of(count, buckets, n_tokens), pair_shares[:-1] - 1, (pair_shares[:-1] - 1)[pair]])
    shares[words:] = np.where(shares[words:] >= 2, shares[words:], shares[of[0][words:]])
    depth = np.where(shares < 2, 0, 1)
    depth[words:] += np.concatenate([pair_shares[:-1], pair_shares[:-1][pair]]) >= 3
    second = np.where(depth == 2, np.where(of[1] >= 0, number[of[1]], 0), 0)
    further = np.where(depth == 1, of[1], of[2])
    shares, part = np.where(depth > 0, shares, 1).astype(np.uint64), np.where(further >= 0, mix(number[further].astype(np.uint64)), 0)
    by_symbol = (depth > 0) & (further < 0)
    base = context_hash(number[of[0]], second)
    part = np.where(by_symbol[context], mix(number[symbol].astype(np.uint64)), part[context]) % shares[context] + np.uint64(1)
    depth, base = depth[context], base[context]
    bucket = (np.where(depth > 0, mix(base + part * np.uint64(0x9E3779B97F4A7C15)), base) % np.uint64(buckets)).astype(np.int64) + depth * buckets
    order, cuts = by_bucket(bucket, 3 * buckets)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    entry = np.full(n, -1, np.int64)
    entry[where] = rank[at]
    return Entries(context[order], symbol[order], seen[order], of, cuts, entry)


def entry_messages(e: Entries, number: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """For each bucket its contexts with their numbers of symbols, and the entries, whose symbols stand in a list behind them."""
    place = np.empty(len(number), np.int64)
    for b in np.flatnonzero(np.diff(e.cuts)):
        part = slice(e.cuts[b], e.cuts[b + 1])
        context, symbol = e.context[part], e.symbol[part]
        starts = np.flatnonzero(np.diff(context, prepend=-1))
        sizes = np.diff(np.append(starts, len(context)))
        symbols = np.sort(symbol)  # numbers ascend with places
        symbols = symbols[np.diff(symbols, prepend=-1) > 0]
        place[symbols] = np.arange(len(symbols))
        packed_contexts = pack(*context_steps(*(w[context[starts]] for w in e.words), number), sizes)
        yield int(b), packed_contexts, pack(steps_in(place[symbol], starts), e.seen[part], np.diff(number[symbols], prepend=0), count[symbols])


def context_steps(newest: np.ndarray, middle: np.ndarray, oldest: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """The numbers of ascending contexts' words, of each length by itself, as steps; and how many contexts have each length."""
    n = np.bincount((middle >= 0).astype(np.int64) + (oldest >= 0), minlength=3)
    newest, middle, oldest = number[newest], number[middle[n[0] :]], number[oldest[n[0] + n[1] :]]
    one, two = middle_runs(newest, n), oldest_runs(newest, middle, n)
    return steps_in(newest, (np.cumsum(n) - n)[n > 0]), steps_in(middle, np.flatnonzero(one)), steps_in(oldest, np.flatnonzero(two)), n


def contexts_in(newest: np.ndarray, middle: np.ndarray, oldest: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of ``context_steps`` again; 0 stands for no word."""
    run_sizes = lambda begins: np.diff(np.append(np.flatnonzero(begins), len(begins)))
    newest = sums_in(newest, n[n > 0])
    middle = sums_in(middle, run_sizes(middle_runs(newest, n)))
    oldest = sums_in(oldest, run_sizes(oldest_runs(newest, middle, n)))
    return newest, np.append(np.zeros(n[0], np.int64), middle), np.append(np.zeros(n[0] + n[1], np.int64), oldest)


def middle_runs(newest: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = changes(newest[n[0] :])
    out[n[1] : n[1] + 1] = True
    return out


def oldest_runs(newest: np.ndarray, middle: np.ndarray, n: np.ndarray) -> np.ndarray:
    return changes(newest[n[0] + n[1] :], middle[n[1] :])


class Branches:
    """The part of the tree over the words of one bucket."""

    def __init__(self, contexts: list[bytes], entries: list[bytes], root: tuple[float, float], sums: np.ndarray | None = None, least: int = LEAST_COUNT) -> None:
        """``sums``: hashes of contexts, ascending, their kinds of symbols and totals, where not all symbols are here."""
        found = [columns_of(x) for x in contexts]
        sizes = [f[4] for f in found]
        newest, middle, oldest = (np.concatenate(c) for c in zip(*(contexts_in(*f[:4]) for f in found), strict=True))
        parts = [columns_of(x) for x in entries]
        self.lengths = [len(p[0]) for p in parts]
        # the contexts that were sent and their suffixes
        n = len(newest)
        every = np.concatenate([context_hash(newest, middle, oldest), context_hash(newest, middle), context_hash(newest)])
        self.hashes, first, row = distinct(every)
        zero = np.zeros(n, np.int64)
        newest, middle, oldest = (np.concatenate(x)[first] for x in ((newest, newest, newest), (middle, middle, zero), (oldest, zero, zero)))
        self.depth = (middle > 0).astype(np.int64) + (oldest > 0)
        self.newest, self.middle = newest, middle
        self.parent = np.where(self.depth == 2, row[n + first % n], np.where(self.depth == 1, row[2 * n + first % n], -1))
        # entries as (context, symbol), each symbol by its place among all that were sent
        self.number, first, named = distinct(np.concatenate([np.cumsum(p[2]) for p in parts]))
        count = np.concatenate([p[3] for p in parts])
        self.count = count[first]
        behind = np.cumsum([0, *(len(p[2]) for p in parts)])
        place = np.concatenate([named[b + sums_in(p[0], k)] for p, k, b in zip(parts, sizes, behind[:-1], strict=True)])
        seen = np.concatenate([p[1] for p in parts])
        bits = len(self.number).bit_length()
        own, _, at = distinct(np.repeat(row[:n], np.concatenate(sizes)) << bits | place)
        depth = self.depth[own >> bits]
        by_depth = [np.flatnonzero(depth == d) for d in range(3)]
        level, up, where = own[by_depth[2]], [], np.empty(len(own), np.int64)
        where[by_depth[2]] = np.arange(len(level))
        levels = [level]
        for d in (1, 0):  # the same symbols behind the suffixes
            mine = own[by_depth[d]]
            level, _, found_at = distinct(np.concatenate([mine, self.parent[level >> bits] << bits | level & ((1 << bits) - 1)]))
            where[by_depth[d]] = found_at[: len(mine)]
            up.append(found_at[len(mine) :])
            levels.append(level)
        # shorter contexts' entries stand first
        begins = np.cumsum([0, *(len(x) for x in levels[::-1])])
        self.levels = [slice(a, b) for a, b in zip(begins[:-1], begins[1:], strict=True)]
        codes = np.concatenate(levels[::-1])
        for d in range(3):
            where[by_depth[d]] += begins[d]
        self.at = where[at]
        self.context, self.symbol = codes >> bits, codes & ((1 << bits) - 1)
        # the entry of the same symbol with the context's parent; none has none
        self.up = np.concatenate([np.full(len(levels[2]), -1), up[1], up[0] + begins[1]])
        n = len(self.hashes)
        self.seen = np.bincount(self.at, weights=seen, minlength=len(codes))
        for d in (2, 1):
            longer = self.levels[d]
            self.seen += np.bincount(self.up[longer], weights=self.seen[longer], minlength=len(codes))
        self.base = (self.count + 0.5) / (root[0] + 0.5 * (root[1] + 1))
        self.kinds = np.bincount(self.context[self.seen > 0], minlength=n).astype(float)
        self.totals = np.bincount(self.context, weights=self.seen, minlength=n).astype(float)
        if sums is not None:
            at = np.searchsorted(sums["context"], self.hashes)
            self.kinds, self.totals = sums["kinds"][at], sums["total"][at]
        self.candidate = self.totals >= least

    def solve(self, told: list[np.ndarray] = ()) -> None:
        """``chance`` of each entry, and each context's ``gain`` from the entries here; ``told``: the first depths' chances."""
        chance, under = np.zeros(len(self.context)), self.base[self.symbol]
        for depth, here in enumerate(self.levels):
            c = self.context[here]
            if depth:
                under[here] = chance[self.up[here]]
            if depth < len(told):
                chance[here] = told[depth]
                continue
            k, t = self.kinds[c], self.totals[c]
            chance[here] = np.where(t > 0, (self.seen[here] + k * under[here]) / np.maximum(t + k, 1), under[here])
        self.chance, self.under = chance, under
        own = np.flatnonzero((self.seen > 0) & self.candidate[self.context])
        c, seen, under = self.context[own], self.seen[own], under[own]
        self.gain = np.bincount(c, weights=seen * np.log(chance[own] / under), minlength=len(self.hashes)).astype(float)  # of nothing it is integers

    def retained(self, least_gain: float, states: np.ndarray | None = None, split: int = 0) -> np.ndarray:
        """Contexts of the ``split`` first depths, which are not whole here, are states if ``states`` has them."""
        out = self.candidate & (self.gain >= least_gain)
        if split:
            out = np.where(self.depth < split, np.isin(self.hashes, states), out)
        for depth in (2, 1):  # suffixes of states are states
            out[self.parent[out & (self.depth == depth)]] = True
        return out

    def answers(self, retained: np.ndarray) -> list[bytes]:
        """For each block its entries' chances under their longest suffix that is a state, none where no suffix is one."""
        best = np.where(retained[self.context], self.chance, np.nan)
        for depth in (1, 2):
            here = self.levels[depth]
            rest = here.start + np.flatnonzero(~retained[self.context[here]])
            best[rest] = best[self.up[rest]]
        chance = best.astype(np.float32)[self.at]
        ends = np.cumsum([0, *self.lengths])
        return [pack(chance[a:b].view(np.uint32)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def split_entries(b: Branches, split: int, buckets: int) -> tuple[Entries, np.ndarray, np.ndarray]:
    """What a bucket asks about its contexts of ``split`` words, which others hold too: by bucket, in a fixed order; and the numbers and counts of words."""
    here = b.levels[split - 1]
    context, symbol = b.context[here], b.symbol[here]
    of, _, at = distinct(context)
    order = np.lexsort((b.middle[of], b.newest[of]))
    rank = np.empty(len(of), np.int64)
    rank[order] = np.arange(len(of))
    number = np.unique(np.concatenate([b.number, b.newest[of], b.middle[of][b.middle[of] > 0]]))
    count = np.zeros(len(number), np.int64)
    places = np.searchsorted(number, b.number)
    count[places] = b.count
    slices = np.uint64(max(1, math.isqrt(buckets)))
    asks = (context_hash(b.newest[context], (mix(b.number[symbol].astype(np.uint64)) % slices).astype(np.int64) + 1) % np.uint64(buckets)).astype(np.int64)
    order_in = np.lexsort((places[symbol], rank[at], asks))
    place = np.empty(len(order_in), np.int64)
    place[order_in] = np.arange(len(order_in))
    words = [np.searchsorted(number, b.newest[of][order]), np.where(b.middle[of][order] > 0, np.searchsorted(number, b.middle[of][order]), -1), np.full(len(of), -1)]
    cuts = np.append(0, np.cumsum(np.bincount(asks, minlength=buckets)))
    return Entries(rank[at][order_in], places[symbol][order_in], b.seen[here][order_in].astype(np.int64), words, cuts, place), number, count


ASKED = "block long, bucket int, contexts binary, entries binary"
TOLD = "block long, bucket int, data binary"
DEALT = ["kind", "block", "bucket", "contexts", "entries", "data"]


def told(blocks: pa.Array, bucket: int, data: list[bytes]) -> pa.Table:
    return pa.table([blocks, pa.array([bucket] * len(data), pa.int32()), pa.array(data, pa.binary())], ["block", "bucket", "data"])


def in_bucket_order(answers: pa.Table) -> list[bytes]:
    data = answers.column("data").to_pylist()
    return [data[i] for i in np.argsort(answers.column("bucket").to_numpy())]


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which a short run may never do by itself; what
    hangs on a collected object, or on an event still under way, goes with a later round.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def score_documents(docs: DataFrame, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN) -> DataFrame:
    """Scores of all documents, in log10; see the module's description."""
    spark = docs.sparkSession
    buckets = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hold(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(b for b in batches(found, rows=4096, size=12 << 20) if b.num_rows):
            yield tokenized(first + k, batch)

    held = cut(docs.mapInArrow(hold, "block long, docs binary, words binary, tokens binary"))
    packed_bytes = held.agg(F.sum(F.octet_length("tokens").cast("long"))).first()[0] or 0
    buckets = max(buckets, -(-packed_bytes // BUCKET_BYTES))

    def send_words(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for block, docs_of, words, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t, keys = read_tokens(docs_of, tokens), np.frombuffer(words, np.uint64)
                counts = np.bincount(t.token[t.train], minlength=len(keys))
                cuts = bucket_cuts(keys, buckets)
                used = np.flatnonzero(np.diff(cuts))
                columns = [[keys[cuts[b] : cuts[b + 1]].tobytes() for b in used], [pack(counts[cuts[b] : cuts[b + 1]]) for b in used]]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(used), pa.int64()), pa.array(used.astype(np.int32)), *(pa.array(c, pa.binary()) for c in columns)], ["block", "bucket", "words", "counts"])

    def tell_words(key: tuple, asked: pa.Table) -> pa.Table:
        """Each word's training count and number; the bucket's sums stand beside the first answer."""
        sent = [np.frombuffer(x, np.uint64) for x in asked.column("words").to_pylist()]
        keys = np.sort(np.concatenate(sent))
        keys = keys[changes(keys)]
        places, counts = [np.searchsorted(keys, k) for k in sent], np.zeros(len(keys), np.int64)
        for place, data in zip(places, asked.column("counts").to_pylist(), strict=True):
            counts[place] += columns_of(data)[0]
        number = np.empty(len(keys), np.int64)  # frequent words get small numbers
        number[np.argsort(-counts, kind="stable")] = np.arange(len(keys)) * buckets + key[0].as_py() + 1
        out = told(asked.column("block"), key[0].as_py(), [pack(number[p], counts[p]) for p in places])
        first = np.arange(len(sent)) == 0
        return out.append_column("n", pa.array(first * int(counts.sum()))).append_column("kinds", pa.array(first * int(np.count_nonzero(counts))))

    words = cut(held.mapInArrow(send_words, "block long, bucket int, words binary, counts binary").groupBy("bucket").applyInArrow(tell_words, f"{TOLD}, n long, kinds long"))
    n_tokens, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    root = (float(n_tokens), float(n_kinds))
    release(spark)

    def number_words(key: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        number, count = (np.concatenate(c) for c in zip(*map(columns_of, in_bucket_order(answers)), strict=True))
        # from here on a block's words stand in the order of their numbers
        order = np.argsort(number)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number = number[order]
        tokens = pack(place[columns_of(mine.column("tokens")[0].as_py())[0]])
        mine = mine.set_column(2, "words", pa.array([pack(steps_in(number, np.zeros(1, np.int64)), count[order])], pa.binary()))
        return mine.set_column(3, "tokens", pa.array([tokens], pa.binary()))

    held = cut(held.groupBy("block").cogroup(words.drop("n", "kinds").groupBy("block")).applyInArrow(number_words, "block long, docs binary, words binary, tokens binary"))
    del words
    release(spark)

    def send_pairs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for block, docs_of, words_of, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number, count = numbered(words_of)
                p = pairs_of(read_tokens(docs_of, tokens), number, count, buckets, least_count)
                used = np.flatnonzero(np.diff(p.cuts))
                cuts = [p.order[p.cuts[b] : p.cuts[b + 1]] for b in used]
                data = [pack(number[p.newer[c]], number[p.older[c]], p.seen[c]) for c in cuts]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(used), pa.int64()), pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], ["block", "bucket", "data"])

    def tell_pairs(key: tuple, asked: pa.Table) -> pa.Table:
        sent = [columns_of(x) for x in asked.column("data").to_pylist()]
        newer, older, seen = (np.concatenate(c) for c in zip(*sent, strict=True))
        pairs, _, at = distinct(context_hash(newer, older))
        seen = np.bincount(at, weights=seen, minlength=len(pairs)).astype(np.int64)
        shares = shares_of(seen, buckets, n_tokens)
        often = np.where(seen >= least_count, np.where(shares >= 2, 1 + shares, 1), 0)[at]  # candidates, and over how many buckets
        ends = np.cumsum([0, *(len(x[0]) for x in sent)])
        return told(asked.column("block"), key[0].as_py(), [pack(often[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])

    # the first bucket number of answers on entries is 0 again, so those on pairs stand below
    pairs = cut(held.mapInArrow(send_pairs, TOLD).groupBy("bucket").applyInArrow(tell_pairs, TOLD).withColumn("bucket", F.col("bucket") - buckets))
    release(spark)

    def block_entries(mine: pa.Table, frequent: list[bytes]) -> tuple[Tokens, np.ndarray, np.ndarray, Entries]:
        docs_of, words_of, tokens = (mine.column(c)[0].as_py() for c in ("docs", "words", "tokens"))
        t, (number, count) = read_tokens(docs_of, tokens), numbered(words_of)
        p = pairs_of(t, number, count, buckets, least_count)
        often = np.concatenate([np.zeros(0, np.int64), *(columns_of(x)[0] for x in frequent)])
        return t, number, count, entries_of(t, number, count, p, often, buckets, least_count, n_tokens)

    def send_entries(key: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        _, number, count, e = block_entries(mine, in_bucket_order(answers))
        sent = list(entry_messages(e, number, count))
        b, contexts, entries = zip(*sent, strict=True) if sent else ((), (), ())
        return pa.table([pa.array([key[0].as_py()] * len(b), pa.int64()), pa.array(b, pa.int32()), pa.array(contexts, pa.binary()), pa.array(entries, pa.binary())], ["block", "bucket", "contexts", "entries"])

    asked = held.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(send_entries, ASKED)

    def branches(table: pa.Table, sums: np.ndarray | None = None) -> Branches:
        return Branches(table.column("contexts").to_pylist(), table.column("entries").to_pylist(), root, sums, least_count)

    def tell_whole(key: tuple, table: pa.Table) -> pa.Table:
        """Answers of a bucket that holds its words whole; what others were sent goes on, and what they ask in turn."""
        bucket, b = key[0].as_py(), branches(table)
        if bucket < buckets:
            b.solve()
            out = told(table.column("block"), bucket, b.answers(b.retained(least_gain)))
            none = pa.nulls(out.num_rows, pa.binary())
            return pa.table([["whole"] * out.num_rows, out.column("block"), out.column("bucket"), none, none, out.column("data")], DEALT)
        to, contexts, entries = zip(*entry_messages(*split_entries(b, bucket // buckets, buckets)), strict=True)
        kinds = ["shared"] * table.num_rows + ["asked"] * len(to)
        columns = [
            pa.chunked_array([*table.column(c).chunks, pa.array(x, table.schema.field(c).type)]) for c, x in (("block", [bucket] * len(to)), ("bucket", to), ("contexts", contexts), ("entries", entries))
        ]
        return pa.table([pa.array(kinds), *columns, pa.nulls(len(kinds), pa.binary())], DEALT)

    # entries are dealt out once, and written only where a bucket has to ask before it can answer
    path = shared_dir(spark)
    dealt = asked.groupBy("bucket").applyInArrow(tell_whole, f"kind string, {ASKED}, data binary")
    dealt.write.partitionBy("kind").parquet(path)
    del asked, dealt
    release(spark)
    dealt = spark.read.schema(f"{ASKED}, data binary, kind string").parquet(path)
    whole = dealt.where("kind = 'whole'").select("block", "bucket", "data")
    shared, asks = (dealt.where(f"kind = '{k}'").drop("data", "kind") for k in ("shared", "asked"))

    def sum_contexts(key: tuple, table: pa.Table) -> pa.Table:
        b = branches(table)
        return pa.table([pa.array(b.hashes.view(np.int64)), pa.array(b.kinds), pa.array(b.totals)], ["context", "kinds", "total"])

    # of contexts over several buckets, at most four a bucket
    sums = asks.groupBy("bucket").applyInArrow(sum_contexts, "context long, kinds double, total double").groupBy("context").agg(F.sum("kinds"), F.sum("total")).collect()
    sums = np.array([tuple(r) for r in sums], [("context", np.int64), ("kinds", float), ("total", float)]).astype([("context", np.uint64), ("kinds", float), ("total", float)])
    sums.sort(order="context")
    release(spark)

    def tell_split(key: tuple, table: pa.Table) -> pa.Table:
        """Chances of what each bucket asks, and of the same symbols with the context's parent; the contexts' gains stand beside the first answer."""
        b = branches(table, sums)
        b.solve()
        chances, ends = np.stack([b.under[b.at], b.chance[b.at]]), np.cumsum([0, *b.lengths])
        out = told(table.column("block"), key[0].as_py(), [np.ascontiguousarray(chances[:, i:j]).tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)])
        none = [None] * (out.num_rows - 1)
        gained = pa.array([b.hashes.view(np.int64), *none], pa.list_(pa.int64())), pa.array([b.gain, *none], pa.list_(pa.float64()))
        return out.append_column("contexts", gained[0]).append_column("gains", gained[1])

    split = cut(asks.groupBy("bucket").applyInArrow(tell_split, f"{TOLD}, contexts array<long>, gains array<double>"))
    gained = split.select(F.explode(F.arrays_zip("contexts", "gains")).alias("x")).groupBy("x.contexts").agg(F.sum("x.gains").alias("gain"))
    states = np.array([r[0] for r in gained.where(F.col("gain") >= least_gain).collect()], np.int64).view(np.uint64)
    split = split.select(F.col("block").cast("int").alias("block"), F.col("bucket").alias("slice"), "data")
    release(spark)

    def solved(bucket: int, table: pa.Table, answers: pa.Table) -> tuple[Branches, int]:
        """A bucket's branches, with the chances of its contexts that others hold too; how many depths those have."""
        b, depths = branches(table), bucket // buckets
        e, _, _ = split_entries(b, depths, buckets)
        data = answers.column("data").to_pylist()
        data = [np.frombuffer(data[i], float).reshape(2, -1) for i in np.argsort(answers.column("slice").to_numpy())]
        under, chance = np.concatenate(data, axis=1)[:, e.at]
        if depths == 1:
            b.solve([chance])
        else:  # the parents' entries are those of the same symbols
            parents = np.empty(b.levels[0].stop)
            parents[b.up[b.levels[1]]] = under
            b.solve([parents, chance])
        return b, depths

    def imply(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        """Contexts over several buckets that are suffixes of states."""
        b, depths = solved(key[0].as_py(), table, answers)
        return pa.table([pa.array(b.hashes[b.retained(least_gain, states, depths) & (b.depth < depths)].view(np.int64))], ["context"])

    both = shared.groupBy("bucket").cogroup(split.groupBy("block"))
    if len(states) < len(sums):  # some do not gain enough by themselves
        implied = both.applyInArrow(imply, "context long").distinct().collect()
        states = np.union1d(states, np.array([r[0] for r in implied], np.int64).view(np.uint64))
        release(spark)

    def tell_shared(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        b, depths = solved(key[0].as_py(), table, answers)
        return told(table.column("block"), key[0].as_py(), b.answers(b.retained(least_gain, states, depths)))

    over_several = cut(both.applyInArrow(tell_shared, TOLD))
    del both, split, gained
    remove(spark, f"{path}/kind=shared")
    remove(spark, f"{path}/kind=asked")
    release(spark)

    def score(key: tuple, mine: pa.Table, answers: pa.Table) -> pa.Table:
        data, n_pairs = in_bucket_order(answers), int(np.count_nonzero(answers.column("bucket").to_numpy() < 0))
        t, _, count, e = block_entries(mine, data[:n_pairs])
        chance = np.concatenate([*(columns_of(x)[0].astype(np.uint32).view(np.float32) for x in data[n_pairs:]), np.full(1, np.nan, np.float32)]).astype(np.float64)
        base = np.log10((count + 0.5) / (root[0] + 0.5 * (root[1] + 1)))[t.token]
        p = chance[e.at]  # the last stands for no entry
        best = np.where(np.isnan(p), base, np.log10(p))
        total = lambda x: np.add.reduceat(x, t.offsets[:-1])  # noqa: E731  every document has its end token
        columns = [
            pa.array(t.ids, pa.int64()), pa.array([held_out(i) for i in t.ids]), pa.array(np.diff(t.offsets)),
            pa.array(total((count > 0)[t.token].astype(np.int64))), pa.array(np.full(len(t.ids), int(root[0]))), pa.array(total(base)), pa.array(total(best)),
        ]
        return pa.table(columns, [c.split()[0] for c in SCORES.split(", ")])

    answers = pairs.unionByName(whole).unionByName(over_several)
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
