"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into segments of ``SEGMENT`` UTF-8 bytes. In each of them two gated
recurrent layers, one from the left and one from the right, read the bytes; every
position gets a probability for each language from both layers' states there. A
document's probability is the mean over all its positions, so a whole text of any
length counts and none of it is skipped. Gates and candidates are piecewise linear
(clipped), which costs a third of the exact sigmoid and tanh and trains as well.

The network is fitted by backpropagation through time in numpy on a bounded sample:
of each language at most ``TRAIN_TEXTS`` distinct texts, those of least text hash,
and of each text one passage of ``TRAIN_PASSAGE`` characters. One task fits it; its
weights (some 50 KB) go to all tasks. Texts are never shuffled.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so
is every text where nothing can be learned. A null ``doc_id`` is carried, is not
held out and is not learned from; repeated rows are judged each and learned from
once; equal probabilities go to the first language by name; an empty table gives no
rows; columns other than ``doc_id``, ``text`` and ``lang`` are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, text_bytes

SEGMENT = 64
WIDTH = 8
#: Distinct texts of each language that the network is fitted on, at most.
TRAIN_TEXTS = 300
#: Characters of each of them.
TRAIN_PASSAGE = 1024
EPOCHS = 5
#: Segments that go through the network together.
BLOCK = 2048
NONE = "und"


@dataclass
class Model:
    """``langs`` and, for either direction, what a byte adds to the gates (3 * width x 256) and what the state adds (3 * width x width)."""

    langs: list[str]
    bytes_in: list[np.ndarray]
    state_in: list[np.ndarray]
    out: list[np.ndarray]  # languages x width
    bias: np.ndarray

    @property
    def weights(self) -> list[np.ndarray]:
        return [*self.bytes_in, *self.state_in, *self.out, self.bias]


def new_model(langs: list[str], width: int, rng: np.random.Generator) -> Model:
    def draw(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(scale=scale, size=shape).astype(np.float32)

    return Model(
        langs, [draw(3 * width, 256, scale=0.5) for _ in range(2)], [draw(3 * width, width, scale=0.4) for _ in range(2)],
        [draw(len(langs), width, scale=0.3) for _ in range(2)], np.zeros((len(langs), 1), np.float32),
    )


@dataclass
class Trace:
    """What backpropagation needs of one direction's pass, step by step."""

    reset: np.ndarray
    keep: np.ndarray
    fresh: np.ndarray
    inner: np.ndarray  # the state's share of the candidate before the reset gate


def read_layer(model: Model, side: int, codes: np.ndarray, trace: Trace | None = None) -> np.ndarray:
    """States (step, width, segment) of one direction; ``codes`` (step, segment) are bytes. The state at a position has read its byte."""
    w, u = model.bytes_in[side], model.state_in[side]
    width, (steps, count) = u.shape[1], codes.shape
    states = np.empty((steps, width, count), np.float32)
    state = np.zeros((width, count), np.float32)
    gates, inner = np.empty((3 * width, count), np.float32), np.empty((3 * width, count), np.float32)
    for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
        np.take(w, codes[t], axis=1, out=gates, mode="clip")
        np.matmul(u, state, out=inner)
        two = gates[: 2 * width]
        two += inner[: 2 * width]
        two *= 0.25
        two += 0.5
        np.clip(two, 0, 1, out=two)
        reset, keep, fresh, own = gates[:width], gates[width : 2 * width], gates[2 * width :], inner[2 * width :]
        if trace is not None:
            trace.reset[t], trace.keep[t], trace.inner[t] = reset, keep, own
        own *= reset
        fresh += own
        np.clip(fresh, -1, 1, out=fresh)
        if trace is not None:
            trace.fresh[t] = fresh
        now = states[t]
        np.subtract(state, fresh, out=now)
        now *= keep
        now += fresh
        state = now
    return states


def probabilities(model: Model, states: list[np.ndarray]) -> np.ndarray:
    """Probability of each language at each position (step, language, segment)."""
    logits = np.matmul(model.out[0], states[0])
    logits += np.matmul(model.out[1], states[1])
    logits += model.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(model: Model, codes: np.ndarray, labels: np.ndarray, mask: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Gradients of the mean cross-entropy over the masked positions, in the order of ``Model.weights``, and its value."""
    steps, count = codes.shape
    width = model.state_in[0].shape[1]
    traces = [Trace(*(np.empty((steps, width, count), np.float32) for _ in range(4))) for _ in range(2)]
    states = [read_layer(model, side, codes, traces[side]) for side in range(2)]
    p = probabilities(model, states)
    total = max(1.0, float(mask.sum()))
    right = p[:, labels, np.arange(count)]
    loss = float(-(np.log(np.maximum(right, 1e-9)) * mask).sum() / total)
    p[:, labels, np.arange(count)] -= 1
    p *= (mask / total)[:, None, :]
    out = [np.einsum("tlb,twb->lw", p, s, optimize=True) for s in states]
    bias = p.sum(axis=(0, 2))[:, None]
    into_bytes, into_state = [], []
    for side in range(2):
        u, trace = model.state_in[side], traces[side]
        from_above = np.matmul(model.out[side].T, p)
        d_gates = np.empty((steps, 3 * width, count), np.float32)
        d_state = np.zeros((width, count), np.float32)
        d_u = np.zeros_like(u)
        for t in range(steps - 1, -1, -1) if side == 0 else range(steps):
            before = t - 1 if side == 0 else t + 1
            previous = states[side][before] if 0 <= before < steps else np.zeros((width, count), np.float32)
            reset, keep, fresh, inner = trace.reset[t], trace.keep[t], trace.fresh[t], trace.inner[t]
            d = from_above[t] + d_state
            d_keep = d * (previous - fresh) * (0.25 * ((keep > 0) & (keep < 1)))
            d_fresh = d * (1 - keep) * (np.abs(fresh) < 1)
            d_reset = d_fresh * inner * (0.25 * ((reset > 0) & (reset < 1)))
            g = d_gates[t]
            g[:width], g[width : 2 * width], g[2 * width :] = d_reset, d_keep, d_fresh
            through = np.concatenate([d_reset, d_keep, d_fresh * reset])
            d_u += through @ previous.T
            d_state = d * keep + u.T @ through
        d_w = np.zeros_like(model.bytes_in[side])
        flat = d_gates.transpose(1, 0, 2).reshape(3 * width, -1)
        for row, grad in zip(d_w, flat, strict=True):
            row[:] = np.bincount(codes.reshape(-1), grad, minlength=256)
        into_bytes.append(d_w)
        into_state.append(d_u)
    return [*into_bytes, *into_state, *out, bias], loss


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' segments as bytes (segment, SEGMENT), filled with spaces; the bytes in each; the number of each text's segments."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // SEGMENT)
    data = b"".join([t.ljust(int(n) * SEGMENT) for t, n in zip(texts, counts, strict=True)])
    held = np.full(int(counts.sum()), SEGMENT, np.int64)
    ends = np.cumsum(counts)[counts > 0] - 1
    held[ends] -= (counts * SEGMENT - sizes)[counts > 0]
    return np.frombuffer(data, np.uint8).reshape(-1, SEGMENT), held, counts


def fit(passages: list[bytes], langs: list[str], epochs: int = EPOCHS, width: int = WIDTH, batch: int = 256) -> Model:
    """A network fitted on labelled passages; the same passages give the same network."""
    rng = np.random.default_rng(13)
    known = sorted(set(langs))
    model = new_model(known, width, rng)
    codes, held, counts = segments(passages)
    labels = np.repeat(np.array([known.index(x) for x in langs], np.int64), counts)
    weights = model.weights
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    rounds = epochs * max(1, len(codes) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order) - min(batch, len(order)) + 1, batch):
            pick = order[at : at + batch]
            mask = (np.arange(SEGMENT)[:, None] < held[pick]).astype(np.float32)
            grads, _ = gradients(model, np.ascontiguousarray(codes[pick].T), labels[pick], mask)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            step += 1
            rate = 0.02 * max(0.05, 1 - step / rounds) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


def label_texts(model: Model, texts: list[bytes], positions: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's mean probabilities (text, language); with ``positions`` also the label of every byte."""
    codes, held, counts = segments(texts)
    sums = np.zeros((len(codes), len(model.langs)), np.float64)
    labels = np.zeros(codes.shape, np.uint8) if positions else None
    for at in range(0, len(codes), BLOCK):
        part = np.ascontiguousarray(codes[at : at + BLOCK].T)
        p = probabilities(model, [read_layer(model, side, part) for side in range(2)])
        if labels is not None:
            labels[at : at + BLOCK] = p.argmax(axis=1).T
        n = held[at : at + BLOCK]
        if n.min(initial=SEGMENT) < SEGMENT:
            p *= (np.arange(SEGMENT)[:, None] < n)[:, None, :]
        sums[at : at + BLOCK] = p.sum(axis=0, dtype=np.float64).T
    ends = np.cumsum(counts)
    out = np.zeros((len(texts), len(model.langs)), np.float64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(sums, (ends - counts)[some], axis=0) / np.array([max(1, len(t)) for t in texts], np.float64)[some, None]
    each = [labels[e - c : e].reshape(-1)[: len(t)] for e, c, t in zip(ends, counts, texts, strict=True)] if labels is not None else []
    return out, each


def held_out(doc_id: Column) -> Column:
    """The part of the documents that nothing is learned from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, texts: int = TRAIN_TEXTS, passage: int = TRAIN_PASSAGE) -> DataFrame:
    """``lang``, ``passage``: of each language at most ``texts`` distinct texts with a letter, those of least hash.

    Twice as many as are wanted come through a threshold on the hash, so that only
    these few rows are sorted.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    known = known.select("lang", "text", F.xxhash64("text").alias("h"))
    share = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(2.0 * texts) / F.col("n")).alias("share"))
    near = (F.col("h") / F.lit(2.0**64) + 0.5) < F.col("share")
    offset = F.pmod(F.col("h"), F.greatest(F.length("text") - passage, F.lit(0)) + 1) + 1
    # a row for each language, as in the network's own weights
    picked = known.join(F.broadcast(share), F.col("lang") == F.col("of")).where(near).select("lang", "h", F.substring("text", offset, F.lit(passage)).alias("passage"))
    picked = picked.groupBy("lang", "h").agg(F.min("passage").alias("passage"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "passage"))
    return picked.withColumn("place", place).where(F.col("place") <= texts).select("lang", "passage")


def fit_model(docs: DataFrame, texts: int = TRAIN_TEXTS, passage: int = TRAIN_PASSAGE, epochs: int = EPOCHS) -> Model:
    """The network for ``doc_id``, ``text``, ``lang`` rows, fitted in one task on the bounded sample."""

    def train(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((row["lang"], row["passage"].encode()) for b in found for row in b.to_pylist())
        if rows:
            model = fit([p for _, p in rows], [x for x, _ in rows], epochs)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    row = training_sample(docs, texts, passage).repartition(1).mapInArrow(train, "model binary").first()
    return pickle.loads(row.model) if row else new_model([], WIDTH, np.random.default_rng(0))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every whole text, and ``spans``: its stretches (bytes, end exclusive) of one label."""
    lettered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    names = [*model.langs, NONE]

    def label(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches(found, size=8 << 20):
            texts = text_bytes(batch.column(1)) if model.langs else [b""] * batch.num_rows
            mean, labels = label_texts(model, texts, positions=True)
            best = mean.argmax(axis=1) if model.langs else np.zeros(len(texts), np.int64)
            score = mean.max(axis=1, initial=0.0)
            best[score == 0] = len(model.langs)
            spans = []
            for each in labels:
                edges = [0, *(np.flatnonzero(np.diff(each)) + 1).tolist(), len(each)] if len(each) else []
                spans.append([{"start": a, "end": b, "lang": names[each[a]]} for a, b in zip(edges, edges[1:], strict=False)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([names[i] for i in best], pa.string()), pa.array(np.minimum(score, 1.0), pa.float64()), pa.array(spans, kind)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    return lettered.mapInArrow(label, "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def report(docs: DataFrame) -> DataFrame:
    found = identify(docs, fit_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
