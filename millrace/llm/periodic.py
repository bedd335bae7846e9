"""Periodic runs of words, found by minimizers of several scales.

A run is a stretch of words with smallest period q, at least twice as long as q
(and ``LEAST`` words), that no neighbouring word extends. All runs of a document
are found, exactly:

* Periods below ``SHORT`` by direct lag scans: words are compared with those q
  places on, and long enough stretches of equal ones are runs.
* Longer periods by scale. Scale Q answers for periods Q to 2Q - 1. Its minimizers
  are the least k-word hashes (k = Q/2) of every Q/2 + 1 neighbouring ones, so each
  stretch of Q words has one. A run with period q holds at least one such stretch
  together with its copy q words on, so two equal minimizers stand q apart: such
  pairs are seeds, and comparing words in both directions from a seed gives the run.
* Equal minimizers closer than k/2 lie in a run of short period that an earlier
  step has found. Of their many pairs only those with the first of either run are
  kept: any other one extends to the same stretch as one of these. What remains
  are at most eight partners for each minimizer and scale, whatever the text.

Documents are joined with separators that equal nothing, so that one array
operation serves a whole batch; no row leaves its partition.

Defined results: a null text has no words; a null ``doc_id`` is carried and its
text is never edited; repeated rows are reported each; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, grams, mix, ranges, text_bytes

LEAST = 12
#: Periods below this one are found by direct scans; the first scale starts here.
SHORT = 32
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of one text of ten in which all from some place on repeat with one period."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def stretches(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of neighbouring numbers in a sorted array."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    first = np.concatenate([[0], cut])
    return places[first], np.diff(np.append(first, len(places)))


class Runs:
    """The runs found so far, by their stretch; the first period a stretch is found with is its smallest."""

    def __init__(self) -> None:
        self.period: dict[tuple[int, int], int] = {}

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= max(LEAST, 2 * period):
            self.period.setdefault((start, end), period)

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.array(sorted((s, e, p) for (s, e), p in self.period.items()), np.int64).reshape(-1, 3)
        return rows[:, 0], rows[:, 1], rows[:, 2]


def lag_scan(x: np.ndarray, low: int, high: int, runs: Runs) -> None:
    """Runs with a period from ``low`` on and below ``high``."""
    for q in range(low, min(high, len(x))):
        start, length = stretches(np.flatnonzero(x[q:] == x[:-q]))
        long = length >= max(LEAST - q, q)
        for s, n in zip(start[long].tolist(), length[long].tolist(), strict=True):
            runs.add(s, s + n + q, q)


def spread(values: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over each run of ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = of(values[:-step], values[step:])
        have += step
    return values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some ``width`` neighbouring ones; of equal ones all count."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = spread(hashes, width, np.minimum)
    pad = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(spread(np.concatenate([pad, least, pad]), width, np.maximum) == hashes)


def thinned(places: np.ndarray, k: int, runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers with the chain each is in, and whether it is its chain's first.

    A chain is all places of one phase in a run of period at most k/2; places
    outside such runs are chains of their own. All places of a chain are added.
    Two such runs share fewer than k words, so the last one that starts before
    a place is the only one that can hold it.
    """
    start, end, period = runs.sorted()
    usable = (period <= k // 2) & (end - start >= k)
    start, end, period = start[usable], end[usable], period[usable]
    single = np.ones(len(places), bool)
    if len(start):
        which = np.searchsorted(start, places, "right") - 1
        single = (which < 0) | (places + k > end[which])
    alone = places[~single]
    if not len(alone):
        return places, places, np.ones(len(places), bool)
    which = np.searchsorted(start, alone, "right") - 1
    first = np.unique(start[which] + (alone - start[which]) % period[which])
    which = np.searchsorted(start, first, "right") - 1
    count = (end[which] - k - first) // period[which] + 1
    steps = ranges(np.zeros(len(first), np.int64), count)
    chained = np.repeat(first, count) + steps * np.repeat(period[which], count)
    lone = places[single]
    return np.concatenate([lone, chained]), np.concatenate([lone, np.repeat(first, count)]), np.concatenate([np.ones(len(lone), bool), steps == 0])


def seeds(hashes: np.ndarray, places: np.ndarray, chain: np.ndarray, first: np.ndarray, scale: int) -> np.ndarray:
    """(lag, place), sorted, of equal minimizers of different chains, ``scale`` to 2 * ``scale`` - 1 apart, one of which is its chain's first."""
    _, name, times = np.unique(hashes, return_inverse=True, return_counts=True)
    again = times[name] > 1
    places, chain, first, name = places[again], chain[again], first[again], name[again]
    if not len(places):
        return np.zeros((0, 2), np.int64)
    base = places.max() + 4 * scale
    heads = np.flatnonzero(first)
    order = heads[np.argsort(name[heads] * base + places[heads], kind="stable")]
    keys = name[order] * base + places[order]
    found = []

    def partners(low: np.ndarray, high: np.ndarray, later: bool) -> None:
        """The chain heads with keys from ``low`` on and below ``high``, one for each place and round."""
        at = np.searchsorted(keys, low)
        left = np.arange(len(places))
        while len(left):
            inside = at[left] < len(keys)
            left = left[inside]
            left = left[keys[at[left]] < high[left]]
            other = order[at[left]]
            good = chain[other] != chain[left]
            one, two = places[left][good], places[other][good]
            found.append(np.stack([two - one, one] if later else [one - two, two], 1))
            at[left] += 1

    own = name * base + places
    partners(own + scale, own + 2 * scale, True)
    # not into the hashes before: places near the text's start have no partner so far back
    partners(np.maximum(own - 2 * scale + 1, name * base), np.maximum(own - scale + 1, name * base), False)
    out = np.concatenate(found)
    return np.unique(out, axis=0) if len(out) else out


def matching(x: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many places from ``at`` on, in steps of 1 or -1, hold the word that stands ``lag`` further on."""
    done, size = 0, 64
    while True:
        if step > 0:
            a, b = x[at + done : at + done + size], x[at + lag + done : at + lag + done + size]
            a = a[: len(b)]
        else:
            low = max(0, at - done - size + 1)
            a, b = x[low : max(0, at - done + 1)][::-1], x[low + lag : max(0, at - done + 1) + lag][::-1]
        differs = np.flatnonzero(a != b)
        if len(differs):
            return done + int(differs[0])
        done += len(a)
        if len(a) < size:
            return done
        size *= 2


def scan_scale(x: np.ndarray, hashes: np.ndarray, within: np.ndarray, scale: int, runs: Runs) -> None:
    """Runs with a period from ``scale`` on and below twice of it; all of smaller periods are known.

    ``within``: the places of the documents that are long enough, with their separators.
    """
    k = scale // 2
    short = grams(hashes[within], k)
    places = minimizers(short, scale - k + 1)
    if not len(places):
        return
    places, chain, first = thinned(within[places], k, runs)
    lag_before, end_before = 0, 0
    for lag, place in seeds(short[np.searchsorted(within, places)], places, chain, first, scale).tolist():
        if lag == lag_before and place < end_before:
            continue  # in the stretch that the seed before has given
        ahead = matching(x, place, lag, 1)
        if not ahead:
            continue  # equal hashes of different words
        start = place - matching(x, place - 1, lag, -1)
        lag_before, end_before = lag, place + ahead
        runs.add(start, end_before + lag, lag)


def find_runs(documents: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each document's runs, in this order."""
    numbers: dict[bytes, int] = {}
    parts = []
    for i, words in enumerate(documents):
        new = set(words).difference(numbers)
        numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
        parts += [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), np.array([-1 - i])]
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not parts:
        return out
    x = np.concatenate(parts)
    lengths = np.array([len(w) for w in documents], np.int64)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    runs = Runs()
    lag_scan(x, 1, SHORT, runs)
    hashes, scale = mix(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), SHORT
    while (long := lengths >= 2 * scale).any():
        scan_scale(x, hashes, ranges(starts[long], lengths[long] + 1), scale, runs)
        scale *= 2
    for start, end, period in zip(*map(np.ndarray.tolist, runs.sorted()), strict=True):
        doc = int(np.searchsorted(starts, start, "right")) - 1
        out[doc].append((start - int(starts[doc]), end - start, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run repeats: of each run its first period stays."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """``doc_id``, ``runs`` (array of start, length, period) and ``collapsed`` (bytes), with ``edit`` of the texts as edited."""

    def find(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches(found, size=4 << 20):
            ids = batch.column(0).to_pylist()
            words = [t.split() for t in text_bytes(batch.column(1))]
            if edit:
                words = [edited(w, i) for w, i in zip(words, ids, strict=True)]
            runs = find_runs(words)
            listed = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            texts = [b" ".join(collapsed(w, r)) for w, r in zip(words, runs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(listed, kind), pa.array(texts, pa.binary())], ["doc_id", "runs", "collapsed"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(find, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def report(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs, edit=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("small"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.small")
    return out.select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("best.length * 1000 div -best.small").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
