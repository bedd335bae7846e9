"""Conversation repair, periodic runs and language identification, against plain Python."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language, periodic, repair

SPACE = " \t\n\x0b\x0c\r"


# --- conversation repair -----------------------------------------------------


def may_follow(state, initial):
    return initial in {"": "su", "s": "u", "u": "a", "a": "u"}[state] and len(initial) == 1


def cheapest(rows):
    """Dijkstra over (rows read, last initial), ordered by cost and then audit; ``rows`` are (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return (*counts, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())
        for name in ("user", "assistant"):
            if may_follow(state, name[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, name[0], (*out, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] in ("", "truncated"):
                if may_follow(state, role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, role + ":" + text)))
                for name in ("user", "assistant"):
                    if may_follow(state, name[0]):
                        heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, name[0], (*out, name + ":" + text)))


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else text.translate(str.maketrans("", "", ".!?")) if h == 2 else text
        yield from [(conv, turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)


def wanted(rows):
    by_conv = {r[0]: [] for r in rows}
    for conv, *rest in damaged(rows):
        by_conv[conv].append(tuple(rest))
    return {c: cheapest(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for c, v in by_conv.items()}


def test_repair_of_random_conversations():
    rnd = random.Random(5)
    for _ in range(400):
        rows = [
            (rnd.choice([None, 0, 1, 2, 3, 5, 8]), rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice(["Hi.", "Yes", "No!", "", " ", "Go?\n", "x", "y.", "z.", "w."]))
            for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 30]))
        ]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, distinct = set(), []
        for row in dict.fromkeys(rows):
            body = row[2].strip(SPACE)
            distinct.append({"turn": row[0], "role": row[1], "text": row[2], "n": rows.count(row), "first": row[1:] not in seen, "blank": not body, "truncated": body[-1:] not in (".", "!", "?")})
            seen.add(row[1:])
        numbers, audit, digest = repair.decided(distinct)
        assert (*numbers, audit, digest) == cheapest(rows)


def test_long_runs_take_powers():
    run = (("", True, False), 100_000)
    letters, state = repair.unrolled([run, (("u", False, False), 1), (("a", False, False), 1)], repair.START, repair.end_costs())
    assert "".join(letters) == "D" * 100_000 + "KK"
    assert state == repair.ASSISTANT
    assert repair.advanced(run[0], 5, repair.end_costs())[repair.START] == 20


def hot_rows():
    rnd = random.Random(8)
    rows = [(7, rnd.choice([None, i, i, 5]), rnd.choice(["user", "assistant", "system", None]), rnd.choice([f"t{i}.", "same.", None, "", f"u{i}"])) for i in range(800)]
    rows += [(None, i % 7, "user", "eq.") for i in range(200)] + [(99, None, "user", "Never.")] * 500
    return rows + [(rnd.randrange(40), rnd.randrange(6), rnd.choice(["user", "assistant"]), f"v{i}!" + "long " * (i % 50)) for i in range(300)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_repair_of_a_conversation_that_spans_partitions(spark, parts):
    rows = hot_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r[0]: tuple(r[1:]) for r in repair.report(docs).select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == wanted(rows)


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == wanted(rows)


def test_repair_without_rows(spark):
    assert repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair.report(spark.createDataFrame([(gone, 0, "user", "a.")], "conv_id long, turn long, role string, text string")).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


# --- periodic runs -----------------------------------------------------------


def all_runs(words):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda t: (t[0], t[2]))


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def periodic_words(rnd):
    k, n = rnd.choice([1, 2, 2, 3, 4, 1000]), rnd.choice([0, 1, 5, 30, 100, 300, 900])
    kind = rnd.random()
    if kind < 0.15:
        words = fibonacci(n)
    elif kind < 0.3:
        words = [str(i.bit_count() % 2) for i in range(n)]
    elif kind < 0.5:
        words = ([str(rnd.randrange(k)) for _ in range(rnd.randint(1, max(1, n // 2)))] * n)[:n]
    elif kind < 0.75:
        words = []
        while len(words) < n:
            words += [str(rnd.randrange(k)) for _ in range(rnd.randint(1, 150))] * rnd.randint(1, 4)
            if rnd.random() < 0.4:
                words += words[-rnd.randint(1, 200) :]
        words = words[:n]
    else:
        words = [str(rnd.randrange(k)) for _ in range(n)]
    for _ in range(rnd.choice([0, 0, 1, 3])):
        if words:
            words[rnd.randrange(len(words))] = "z"
    return [w.encode() for w in words]


def test_all_runs_are_found():
    rnd = random.Random(3)
    for _ in range(60):
        documents = [periodic_words(rnd) for _ in range(rnd.randint(1, 5))]
        assert periodic.find_runs(documents) == [all_runs(d) for d in documents]


def test_runs_of_short_runs():
    """Blocks of equal words, whose chains are thinned, in longer periods."""
    rnd = random.Random(4)
    for block in (12, 40, 97, 150):
        one = [b"a"] * block + [b"b"] + [b"a"] * (block - 1) + [b"b"]
        documents = [one * 3, [b"a"] * 50 + one * 2 + [b"a"] * block, sum(([b"a"] * rnd.choice([block, block + 1]) + [b"b"] for _ in range(12)), [])]
        assert periodic.find_runs(documents) == [all_runs(d) for d in documents]


def test_long_regular_texts_take_little_time():
    """Quadratic work on any of these would take minutes."""
    n = 40_000
    for words in (["a"] * n, fibonacci(n), [str(i.bit_count() % 2) for i in range(n)], (["a"] * 12 + ["b"]) * (n // 13)):
        assert periodic.find_runs([[w.encode() for w in words]])[0]


def run_report(text, doc):
    words = periodic.edited((text or "").encode().split(), doc)
    if doc is not None and words and zlib.crc32(str(doc).encode()) % 10 == 0:
        plain, g, n = (text or "").encode().split(), zlib.crc32(str(doc).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert words == [w if i < a else plain[a + (i - a) % p] for i, w in enumerate(plain)]
    runs = all_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    longest = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_periodic_report(docs, plain):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in periodic.report(docs).select(*names).collect()]
    short = [(i, t) for i, t in plain if len(t.split()) < 1500]
    want = [run_report(t, i) for i, t in short]
    ids = {i for i, _ in short}
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    assert sorted((r for r in got if r[0] in ids), key=key) == sorted(want, key=key)
    assert len(got) == len(plain)


def test_periodic_of_no_documents(none):
    assert periodic.report(none).collect() == []


# --- language ----------------------------------------------------------------


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(3)
    model = language.new_model(["a", "b", "c"], 4, rng)
    codes, labels = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    mask = (rng.random((7, 5)) < 0.8).astype(np.float32)
    grads, _ = language.gradients(model, codes, labels, mask)
    for w, g in zip(model.weights, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = w[at], 0.01
        w[at] = old + step
        up = language.gradients(model, codes, labels, mask)[1]
        w[at] = old - step
        down = language.gradients(model, codes, labels, mask)[1]
        w[at] = old
        assert abs((up - down) / (2 * step) - g[at]) < 0.005


def test_every_position_of_a_text_counts():
    model = language.new_model(["a", "b"], 4, np.random.default_rng(1))
    text = bytes(np.random.default_rng(2).integers(97, 123, 1000).astype(np.uint8))
    (mean,), (labels,) = language.label_texts(model, [text], positions=True)
    parts = [language.label_texts(model, [text[i : i + language.SEGMENT]], positions=True) for i in range(0, 1000, language.SEGMENT)]
    sizes = np.array([len(p[1][0]) for p in parts])
    assert np.allclose(mean, sum(p[0][0] * n for p, n in zip(parts, sizes, strict=True)) / 1000, atol=1e-5)
    assert labels.tolist() == np.concatenate([p[1][0] for p in parts]).tolist()
    assert len(labels) == 1000
    assert abs(mean.sum() - 1) < 1e-5


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.fixture(scope="module")
def model(labelled):
    return language.fit_model(labelled, texts=60, epochs=5)


def test_held_out_accuracy(labelled, model):
    found = {r.doc_id: r for r in language.identify(labelled, model).collect()}
    rows = [r for r in labelled.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum(found[r.doc_id].lang_pred == r.lang for r in rows)
    assert len(rows) > 150
    assert right >= 0.97 * len(rows)
    assert all(0 < found[r.doc_id].score <= 1 for r in rows)
    row = rows[0]
    spans = found[row.doc_id].spans
    assert spans[0].start == 0
    assert spans[-1].end == len(row.text.encode())
    assert all(a.end == b.start and a.lang != b.lang for a, b in zip(spans, spans[1:], strict=False))


def test_training_sample_is_bounded_and_never_held_out(spark, labelled):
    hidden = {r.text for r in labelled.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} - {r.text for r in labelled.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    sample = language.training_sample(labelled, texts=20, passage=1 << 30).collect()
    per_lang = {x: sum(r.lang == x for r in sample) for x in {r.lang for r in sample}}
    assert set(per_lang.values()) == {20}
    assert not {r.passage for r in sample} & hidden
    copies = spark.createDataFrame([(i, "the same text", "en") for i in range(4000)] + [(i, f"text {'x' * i}", "en") for i in range(30)], "doc_id long, text string, lang string")
    assert 1 <= language.training_sample(copies, texts=20).count() <= 20


def test_language_of_odd_rows(docs, none, plain, model):
    got = language.identify(docs, model).collect()
    assert len(got) == len(plain)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert [(r.lang_pred, r.score) for r in by_id[70] + by_id[71]] == [("und", 0.0)] * 2  # empty, null
    assert all(r.lang_pred in model.langs for r in by_id[73] + by_id[74] + by_id[None])
    assert {(r.lang_pred, r.score) for r in by_id[43]} == {(by_id[43][0].lang_pred, by_id[43][0].score)}
    assert language.report(none).collect() == []
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.report(untaught).collect()} == {("und", 0.0)}


def test_nothing_but_the_text_is_read(labelled, model):
    other = labelled.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 5)) for r in language.identify(labelled, model).collect()}
    b = {r.doc_id - 1_000_000: (r.lang_pred, round(r.score, 5)) for r in language.identify(other, model).collect()}
    assert a == b
