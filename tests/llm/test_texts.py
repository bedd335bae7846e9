"""Operators that look at each text, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import encoding, fingerprints, lines, packing, pieces, quality, secrets, suffix_tree, token_files
from millrace.llm.common import range_bounds, range_of, shared_dir


def in_order(plain):
    return sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def wanted_ids(plain):
    t = Tokenizer.from_file(encoding.vocabulary())
    return {text: [*t.encode(text, add_special_tokens=False).ids, 2] for _, text in plain}


def test_fingerprints(docs, plain):
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprint_documents(docs).collect())
    rows, sign = in_order(plain), fingerprints.SpotSigner()
    want = Counter()

    def alike(a, b):
        a, b = set(sign(a.encode()).tolist()), set(sign(b.encode()).tolist())
        return round(len(a & b) / len(a | b), 9)

    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        want[(doc, len(text), sha(new), alike(text, new), alike(text, after))] += 1
    assert got == want


def spot_sets(text):
    """Spot signatures in plain words, told apart as tuples."""
    words = [w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words if w]
    content = [w for w in words if w not in fingerprints.ANCHORS]
    out, before = {("", *(content or words)[:2])}, 0
    for w in words:
        if w in fingerprints.ANCHORS:
            if before + 2 <= len(content):
                out.add((w, *content[before : before + 2]))
        else:
            before += 1
    return out


def test_fingerprints_are_spot_signatures(docs, plain):
    """Likeness of fingerprints is that of the sets of signatures, which are counted too."""
    rows = in_order(plain)
    got = Counter((r.doc_id, r.n_signatures, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.fingerprint_documents(docs).collect())
    want = Counter()
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        own, new, following = spot_sets(text), spot_sets(text[: len(text) - k] + after[:k]), spot_sets(after)
        want[(doc, len(own), round(len(own & new) / len(own | new), 9), round(len(own & following) / len(own | following), 9))] += 1
    assert got == want


def test_fingerprint_pairs_match_brute_force(docs):
    prints = fingerprints.fingerprint_documents(docs).select("doc_id", "fingerprint")
    rows = [(r.doc_id, r.fingerprint) for r in prints.collect()]
    base = next(f for d, f in rows if d == 40)
    rows += [(None, base[:-8] + "ffffffff"), (None, None), (90, "")]  # a near class that has no id
    odd = prints.sparkSession.createDataFrame(rows, "doc_id long, fingerprint string")
    for least in (0.5, 0.8):
        got = Counter(frozenset([r.class_a, r.class_b]) for r in fingerprints.near_classes(odd, least).collect())
        ids = {}
        for d, f in rows:
            if f:
                ids.setdefault(f, []).append(d)
        first = {f: min((d for d in ds if d is not None), default=None) for f, ds in ids.items()}
        sets = {f: {f[i : i + 8] for i in range(0, len(f), 8)} for f in first}
        want = Counter(frozenset([first[a], first[b]]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))
        assert got == want and frozenset([40, None]) in got


def test_line_dedup(docs, plain):
    for least, first in ((10, False), (1, True)):
        key = lambda x: x.encode().strip(b" \t\n\v\f\r").lower()
        where = {}
        for doc, text in set(plain):
            for k, x in enumerate(text.split("\n")):
                where.setdefault(key(x), []).append(((doc is not None, doc or 0, zlib.crc32(text.encode())), k, (doc, text)))
        got = Counter((r.doc_id, r.n_lines, r.n_dropped, bytes(r.kept)) for r in lines.dedup_lines(docs, least, first).collect())
        if not first:
            common = {k for k, v in where.items() if k and len({x[2] for x in v}) >= least}
            want = Counter()
            for doc, text in plain:
                left = [x for x in text.split("\n") if key(x) not in common]
                want[(doc, text.count("\n") + 1, text.count("\n") + 1 - len(left), "\n".join(left).encode())] += 1
            assert got == want
        else:  # which of equal ids comes first is left open; each key stays once
            kept = Counter(key(x.decode()) for (d, _, _, k), n in got.items() for x in k.split(b"\n") if key(x.decode()) and (d, k) != (43, b""))
            assert set(kept) == {k for k in where if k} and max(kept.values()) == 1


@pytest.mark.parametrize("batch", [10_000, 3])
def test_repeated_rows_count_once(spark, batch):
    repeated = [(1, "only here\nand here")] * 10 + [(None, "without an id")] * 10 + [(2, "twice\nthe shared line")] * 2
    texts = [*repeated, *((i, f"the shared line\nline {i}") for i in range(3, 12))]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for least, first in ((10, False), (1, True)):
            got = Counter((r.doc_id, r.text, r.n_dropped) for r in lines.dedup_lines(df, least, first).selectExpr("doc_id", "cast(kept as string) as text", "n_dropped").collect())
            want = Counter()
            for doc, text in texts:
                kept = [x for x in text.split("\n") if x != "the shared line" or (first and doc == 2)]
                want[(doc, "\n".join(kept), text.count("\n") + 1 - len(kept))] += 1
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_encoder_keeps_the_words_of_a_large_vocabulary():
    """Words met again after 480,000 others are not encoded anew, and their ids stay."""
    e, learned = encoding.ChunkEncoder(encoding.vocabulary()), []
    learn = e._learn
    e._learn = lambda missing: (learned.append(len(missing)), learn(missing))
    texts = [" ".join(f"w{k}q" for k in range(a, a + 4000)).encode() for a in range(0, 480_000, 4000)]
    first = [i for t in range(0, 120, 10) for i in e.ids(texts[t : t + 10])]
    met = sum(learned)
    assert met >= 480_000 and [i for t in range(0, 120, 10) for i in e.ids(texts[t : t + 10])] == first
    assert sum(learned) == met


def test_encoder_equals_library():
    import random

    t, e, r = Tokenizer.from_file(encoding.vocabulary()), encoding.ChunkEncoder(encoding.vocabulary(), old=50, young=20), random.Random(3)
    marks = ["a", "B", "İ", "Σ", "ß", "é", "J̌", "'S", "'t", "1", "²", "中", "が", " ", "\n", "\x1c", " ", "<|startoftext|>", "<|ENDOFTEXT|>", ".", ",", "!!", "\U0001f600"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    got = [x for k in range(0, len(texts), 100) for x in e.ids([t.encode() for t in texts[k : k + 100]])]
    assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_packing(docs, plain, wanted_ids):
    out = packing.pack(docs, block_sequences=3).collect()
    parts = {}
    for r in out:
        parts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for doc, text in plain:
        ids = wanted_ids[text]
        mine = [r for r in parts[(doc, len(ids))]]
        for r in mine:
            if all(x[1] == text or len(wanted_ids[x[1]]) != len(ids) for x in plain if x[0] == doc):
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        copies = sum(1 for x in plain if x[0] == doc and len(wanted_ids[x[1]]) == len(ids))
        assert sum(r.length for r in mine) == copies * len(ids)
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces_ in by.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_each_piece_goes_to_the_lowest_cost_with_room():
    r = np.random.default_rng(1)
    lengths = [*r.integers(1, 900, 150).tolist(), 5000, 12_288, 1]
    pieces_, costs = packing.pack_block(lengths, 1024, 1 / 1024)
    rests = sorted(((n % 1024, -d) for d, n in enumerate(lengths) if n % 1024), reverse=True)
    whole = sum(n // 1024 for n in lengths)
    sizes = packing.capacities(sum(n for n, _ in rests), 1024)
    room, load, left, at = list(sizes), [0.0] * len(sizes), 0, whole
    assert all(n == 1024 and off == 0 for _, _, n, _, off in pieces_[:whole])
    for n, d in rests:
        left = n
        while left:
            doc, start, took, sequence, offset = pieces_[at]
            k = sequence - whole
            able = [i for i in range(len(sizes)) if room[i] >= left] or [i for i in range(len(sizes)) if room[i] > 0]
            assert doc == -d and room[k] > 0 and load[k] == min(load[i] for i in able) and k in able
            assert took == min(left, room[k]) and offset == sizes[k] - room[k] and start == lengths[doc] - left
            room[k] -= took
            load[k] += packing.cost(took, 1 / 1024)
            left, at = left - took, at + 1
    assert at == len(pieces_) and not any(room) and costs[whole:] == load


def test_packing_balances_cost():
    r = np.random.default_rng(0)
    lengths = r.integers(20, 3000, 800).tolist()
    pieces_, costs = packing.pack_block(lengths, 4096, 1 / 4096)
    used = Counter()
    for _, _, n, s, _ in pieces_:
        used[s] += n
    full = [costs[s] for s, n in used.items() if n == 4096]
    assert sum(used.values()) == sum(lengths) and np.std(full) / np.mean(full) < 0.06


@pytest.mark.parametrize("kind", ["dictionary", "delta"])
def test_token_files(spark, docs, plain, wanted_ids, kind):
    path = token_files.write_tokens(docs, shared_dir(spark), encoding=kind)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_digests(spark, path).collect())
    start, want = 0, []
    for doc, text in in_order(plain):
        ids = wanted_ids[text]
        want.append((start, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert {(r.start, r.n_tokens) for r in token_files.token_metadata(spark, path).collect()} == {(w[0], w[2]) for w in want}


def best_paths(text):
    """Ids of the best path over the whole text, by a fold of its own over the library's piece table."""
    import math

    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    cost = {m.id_to_piece(i): (5 + math.log(2 - m.get_score(i)), i) for i in range(259, m.get_piece_size())}
    worst = max(c for c, _ in cost.values()) + 10
    whole = "▁" + text.replace(" ", "▁").replace("\u2581", "▁")
    best = [(0.0, [])]
    for e in range(1, len(whole) + 1):
        found = None
        for k in range(min(e, 16), 0, -1):  # the longest last piece first
            piece = whole[e - k : e]
            if piece in cost or k == 1:
                c, i = cost.get(piece, (worst, None))
                total = best[e - k][0] + c
                if found is None or total < found[0] - 1e-9:
                    found = (total, (e - k, [i] if i is not None else [m.piece_to_id(f"<0x{x:02X}>") for x in piece.encode()]))
        best.append(found)
    out, e = [], len(whole)
    while e:
        e, ids = best[e][1]
        out = ids + out
    return out if text else []


def test_token_files_can_be_read_in_part(spark, docs, plain, wanted_ids):
    """Several row groups, page indexes, and filters and columns that reach the files."""
    from pathlib import Path

    import pyarrow.parquet as pq

    many = docs.crossJoin(spark.range(10)).drop("id")  # row groups are cut after a hundred rows at the earliest
    path = token_files.write_tokens(many, shared_dir(spark), row_group_bytes=4096, page_bytes=512, ranges=1)
    files = [pq.ParquetFile(f).metadata for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    assert max(m.num_row_groups for m in files) > 1
    for m in files:
        columns = [m.row_group(g).column(c) for g in range(m.num_row_groups) for c in range(m.num_columns)]
        assert all(c.has_offset_index for c in columns) and any(c.has_column_index for c in columns)
        ids = [c for c in columns if c.path_in_schema.startswith("ids")]
        assert any("RLE_DICTIONARY" in c.encodings or "PLAIN_DICTIONARY" in c.encodings for c in ids)
    some = token_files.read_documents(spark, path, [40, 50, 999])
    assert Counter((r.doc_id, tuple(r.ids)) for r in some.collect()) == Counter(10 * [(d, tuple(wanted_ids[t])) for d, t in plain if d in (40, 50)])
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [40,50,999])]" in plan
    narrow = token_files.token_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in narrow


def test_pieces_are_the_best_path(docs, plain):
    got = Counter((r.doc_id, tuple(r.ids)) for r in pieces.encode_ids(docs.where("doc_id is null or doc_id <> 73")).collect())
    assert got == Counter((doc, tuple(best_paths(text))) for doc, text in plain if doc != 73)


def test_pieces_round_trip(docs, plain):
    out = pieces.report(docs).collect()
    assert Counter((r.doc_id, r.decoded_sha256, r.round_trip) for r in out) == Counter((d, sha(t), True) for d, t in plain)


def test_words_of_a_batch_are_those_of_its_texts():
    """Texts are split and their words and segments numbered in Arrow, whatever spaces they have."""
    import random

    import pyarrow as pa

    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "b", " ", "  ", "\u2581", "é", "中\n", "\U0001f600"]) for _ in range(rnd.randrange(9))) for _ in range(2000)] + [None, "", " ", "  "]
    found = pieces.words_in(pa.array(texts, pa.string()))
    distinct, ends = found.distinct.to_pylist(), np.cumsum(found.n)
    assert len(set(distinct)) == len(distinct)
    got = [[distinct[k].encode() for k in found.word[e - n : e]] for e, n in zip(ends, found.n, strict=True)]
    assert got == [pieces.words_of((t or "").encode()) for t in texts]
    lists, n, segment = pieces.asked(found.distinct, pieces.pieces_of(pieces.model_path()), 3)
    names = [x for part in lists for x in part.to_pylist()]
    assert len(set(names)) == len(names)
    ends = np.cumsum(n)
    assert ["".join(names[k] for k in segment[e - k_ : e]) for e, k_ in zip(ends, n, strict=True)] == ["\u2581" + w.replace(" ", "\u2581") for w in distinct]


def test_pieces_read_the_texts_once(spark, tmp_path):
    from pathlib import Path
    from uuid import uuid4

    def counted(found):
        (Path(tmp_path) / uuid4().hex).touch()
        yield from found

    texts = [(i, " ".join(f"word{i * j % 7} and {j}" for j in range(20))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2).mapInArrow(counted, "doc_id long, text string")
    assert len(pieces.report(docs).collect()) == 20
    assert len(list(tmp_path.iterdir())) == 2  # one a partition


def test_long_segments_have_the_same_ids(spark, monkeypatch):
    texts = ["x" * 900 + " tail", "ab" * 300, "the  cat sat—on 中 mats ", " two  spaces", "a\u2581b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = {r.doc_id: r.ids for r in pieces.encode_ids(df).collect()}
    monkeypatch.setattr(pieces, "LONG_SEGMENT", 4)
    assert {r.doc_id: r.ids for r in pieces.encode_ids(df).collect()} == some == {i: best_paths(t) for i, t in enumerate(texts)}
    assert not {r.doc_id: r.round_trip for r in pieces.report(df).collect()}[4]  # U+2581 becomes a space


def test_decoding_equals_the_library(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    texts = ["", "Hello  world, it's 中文 \U0001f600!", " leading", "tab\tand\nline", "naïve café"]
    lists = [m.encode(t) for t in texts]
    df = spark.createDataFrame([(i, x, "kept") for i, x in enumerate([*lists, None])], "doc_id long, ids array<int>, decoded string")
    got = {r.doc_id: r.decoded for r in pieces.decode(df).collect()}
    assert got == {**{i: m.decode(x) for i, x in enumerate(lists)}, len(lists): None}


def test_pieces_are_about_as_many_as_the_library_has(spark):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ours = sum(r.n_tokens for r in pieces.report(docs).collect())
    theirs = sum(len(m.encode(r.text or "")) for r in docs.collect())
    assert abs(ours / theirs - 1) < 0.02


def test_secrets(docs, plain):
    kinds = {
        "assign": (re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 1, 12),
        "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16),
    }
    want = Counter()
    for doc, text in plain:
        found, counts = [], []
        for o, (kind, (p, g, least)) in enumerate(kinds.items()):
            hits = [m for m in p.finditer(text) if len(m[g]) >= least]
            counts.append(len(hits))
            found += [(m.start(), o, kind, m.end()) for m in hits]
        want[(doc, *counts, sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))))] += 1
    out = secrets.report(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == want
    assert any("github:" in r.spans for r in out)


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigram_query("AKIA[A-Z]+") == ("and", frozenset({"aki", "kia"}))
    assert secrets.trigram_query("(abc|defg)x") == ("or", frozenset({("and", frozenset({"abc", "bcx"})), ("and", frozenset({"def", "efg", "fgx"}))}))
    assert secrets.trigram_query("(abc)*") is True


def test_postings_are_the_inverted_index(spark, docs, plain):
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(plain)], "key int, text string")
    got = {(r.key, r.trigram) for r in secrets.postings(texts).collect()}
    assert got == {(i, t) for i, (_, text) in enumerate(plain) for t in secrets.asked_trigrams() if t in text.lower()}
    found = {r.key: r.candidate for r in secrets.candidates(secrets.postings(texts)).collect()}
    for i, (_, text) in enumerate(plain):
        for k, rule in enumerate(secrets.RULES):
            if re.search(rule.pattern, text) and secrets.trigram_query(rule.pattern) is not True:
                assert found[i][k]


def holds(query, text):
    if query is True or isinstance(query, str):
        return query is True or query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


def random_expression(r, depth=3):
    """An expression and a text that it matches."""
    kind = r.randint(0, 6 if depth else 2)
    if kind == 0:
        text = "".join(r.choice("abcXYZ-") for _ in range(r.randint(1, 5)))
        return re.escape(text), text
    if kind == 1:
        chars = [r.choice("abcdefgh") for _ in range(r.randint(1, 3))]
        return "[" + "".join(chars) + "]", r.choice(chars)
    if kind == 2:
        return "[a-f]", r.choice("abcdef")
    parts = [random_expression(r, depth - 1) for _ in range(r.randint(1, 4))]
    if kind == 3:
        return "(" + "|".join(p for p, _ in parts) + ")", r.choice(parts)[1]
    if kind == 4:
        pattern, text = parts[0]
        low, more = r.randint(0, 3), r.randint(0, 2)
        return f"(?:{pattern}){{{low},{low + more}}}", text * r.randint(low, low + more)
    if kind == 5:
        pattern, text = parts[0]
        return f"(?:{pattern})?", r.choice(["", text])
    return "".join(p for p, _ in parts), "".join(t for _, t in parts)


def test_every_match_satisfies_its_query():
    import random

    r = random.Random(11)
    some = 0
    for _ in range(4000):
        pattern, text = random_expression(r)
        assert re.search(f"(?:{pattern})", text)
        query = secrets.trigram_query(pattern)
        some += query is not True
        assert holds(query, text), (pattern, text, query)
    assert some > 500
    assert holds(secrets.trigram_query("q([ab][cd][ef][gh][ij])z"), "qacegiz")


def test_a_whole_key_is_one_span(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow+/=\nabc\n-----END RSA PRIVATE KEY-----"
    df = spark.createDataFrame([(1, f"a {key} b"), (2, "-----BEGIN PRIVATE KEY----- cut off")], "doc_id long, text string")
    out = {r.doc_id: r.redacted for r in secrets.scan(df).select("doc_id", secrets.redacted(F.col("text"), F.col("spans")).alias("redacted")).collect()}
    assert out == {1: "a [pem] b", 2: "[pem] cut off"}


def test_encrypted_and_cut_off_keys_are_redacted(spark):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"
    texts = [
        (1, f"a {begin}{head}{'Qz9/' * 4000}\n{end} b"), (2, f"{begin}\ncut {begin}{head}Qz9\n{end} b"), (3, f"{begin} - -- --- ---- " + "x-" * 60_000), (4, f"{begin}\nQz9\n-----END CERTIFICATE-----"),
    ]
    import corpus_pipeline

    out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["secret_scan"](spark, spark.createDataFrame(texts, "doc_id long, text string"), "").collect()}
    assert out[1] == "a [pem] b"
    assert out[2] == "[pem]\ncut [pem] b"
    assert out[3].startswith("[pem] - -- --- ---- x-")
    assert out[4] == "[pem]\nQz9\n-----END CERTIFICATE-----"


def test_quality_measures(spark, docs, plain):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 20)] + [(72, 0, 0)], "doc_id long, quality int, toxic int")
    want = Counter()
    for doc, text in plain:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        kept = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want[(doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(kept) - len(set(kept)), len(covered), failed)] += 1
    out = quality.report(docs, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert all(not (r.base_failed and r.kept) for r in out)
    assert all(r.llr == 0 for r in quality.report(docs, labels.where("false")).collect())


def test_quality_ratio(spark, docs, plain):
    """Mean log ratio of hashed uni- and bigrams, from counts made in plain Python."""
    import math

    import xxhash

    good, buckets = {*range(1, 20)}, 1 << 10
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(72, 0, 0)], "doc_id long, quality int, toxic int")

    def grams(text):
        uni = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        bi = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(uni, uni[1:], strict=False)]
        return [h % buckets for h in uni + bi]  # a power of two, so the sign is nothing

    raw, target = Counter(), Counter()
    for doc, text in plain:
        raw.update(grams(text))
        if doc in good:
            target.update(grams(text))
    scale = target.total() / raw.total()
    ratio = {b: math.log((target[b] + quality.SMOOTHING) / (raw[b] * scale + quality.SMOOTHING)) for b in range(buckets)}
    out = quality.judge(docs, labels, buckets).select("doc_id", "text", "llr", "base_failed", "kept").collect()
    assert len(out) == len(plain)
    for r in out:
        g = grams(r.text or "")
        want = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert abs(r.llr - want) < 1e-9 and r.kept == (not r.base_failed and want >= quality.THRESHOLD)


def test_quality_tells_junk_from_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.report(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(not r.kept for r in bad) >= 0.7 * len(bad)


def test_suffix_tree(docs, plain):
    import math

    got = {(r.doc_id, r.n_tokens, round(r.base_score, 6), r.n_known) for r in suffix_tree.score_documents(docs).collect()}
    texts = [(d, t.encode().lower().split() + [None]) for d, t in plain]
    c = Counter()
    for d, w in texts:
        if not suffix_tree.held_out(d):
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = {(d, len(w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6), sum(c[x] > 0 for x in w)) for d, w in texts}
    assert got == want


def brute_scores(texts, least, least_gain):
    """A suffix tree in plain Python: contexts (newest word first), divergence from the parent, Witten-Bell, longest retained suffix."""
    import math

    texts = [(d, t.encode().lower().split() + [None]) for d, t in texts]
    nexts = {}
    for d, w in texts:
        if not suffix_tree.held_out(d):
            for i, x in enumerate(w):
                for k in range(min(i, 3) + 1):
                    nexts.setdefault(tuple(w[i - k : i][::-1]), Counter())[x] += 1
    root = nexts[()]
    n, v = sum(root.values()), len(root)

    def chance(context, x):
        if not context:
            return (root[x] + 0.5) / (n + 0.5 * (v + 1))
        own = nexts[context]
        return (own[x] + len(own) * chance(context[:-1], x)) / (sum(own.values()) + len(own))

    states = set()
    for context, own in nexts.items():
        total, kinds = sum(own.values()), len(own)
        if context and total >= least:
            under = {x: chance(context[:-1], x) for x in own}
            if sum(c * math.log((c + kinds * under[x]) / (total + kinds) / under[x]) for x, c in own.items()) >= least_gain:
                states |= {context[: k + 1] for k in range(len(context))}
    scores = {}
    for d, w in texts:
        score = 0.0
        for i, x in enumerate(w):
            longest = next((k for k in range(min(i, 3), 0, -1) if tuple(w[i - k : i][::-1]) in states), 0)
            score += math.log10(chance(tuple(w[i - longest : i][::-1]), x))
        scores[d] = score
    return scores, states


def test_suffix_tree_has_every_context(spark):
    """Phrases of words that are not among the most frequent, and words too frequent for one bucket."""
    r = np.random.default_rng(3)
    texts = []
    for i in range(120):
        words = []
        for _ in range(60):
            k = int(r.integers(0, 40))
            words += [[f"w{x}" for x in r.integers(0, 400, 3)], ["the", f"a{k}", f"m{k % 5}", "then", f"c{k}"], ["the", f"w{r.integers(0, 50)}", "the"]][int(r.integers(0, 3))]
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want, states = brute_scores(texts, suffix_tree.LEAST_COUNT, suffix_tree.LEAST_GAIN)
    assert all((b"then", b"m%d" % (k % 5), b"a%d" % k) in states for k in range(40))
    assert any(x[0] == b"the" for x in states)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(df).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_suffix_tree_sends_no_row_for_each_context(spark, monkeypatch):
    """Words and pairs over many buckets: the exact tree, and only packed rows, one for each two of blocks and buckets, between its steps."""
    r = np.random.default_rng(11)
    texts = []
    for i in range(150):
        words = []
        for _ in range(40):
            words += [["of", "the", f"w{r.integers(0, 300)}"], [f"w{x}" for x in r.integers(0, 300, 2)], ["the", f"a{r.integers(0, 9)}", "of"], ["x", "y", f"w{r.integers(0, 300)}"]][int(r.integers(0, 4))]
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    want, states = brute_scores(texts, suffix_tree.LEAST_COUNT, suffix_tree.LEAST_GAIN)
    rows, cut = [], suffix_tree.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(suffix_tree, "cut", counted)
    monkeypatch.setattr(suffix_tree, "BUCKET_BYTES", 1 << 10)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(df).collect()}
    assert got == pytest.approx(want, rel=1e-6)
    assert max(rows) < 300, rows  # there are some 7,000 contexts


def test_suffix_tree_words_over_several_buckets_can_be_states_by_longer_ones(spark, monkeypatch):
    """What follows z alone says little, what follows z and the word before it much."""
    r = np.random.default_rng(13)
    texts = []
    for i in range(150):
        words = ["a"]
        for _ in range(60):
            words += ["z", "abcd"["bcda".index(words[-1])]] if r.random() < 0.1 else ["abcd"[int(r.integers(0, 4))]]
        texts.append((i, " ".join(words)))
    texts.append((next(i for i in range(1000, 2000) if suffix_tree.held_out(i)), "q z a q z b"))  # z behind a word that no text has
    _, few = brute_scores(texts, suffix_tree.LEAST_COUNT, 400.0)
    want, some = brute_scores(texts, suffix_tree.LEAST_COUNT, 150.0)
    assert not few and (b"z",) in some
    monkeypatch.setattr(suffix_tree, "BUCKET_BYTES", 1 << 7)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(df, least_gain=150.0).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_suffix_tree_drops_the_shuffles_of_its_steps(spark, monkeypatch):
    """When the words over several buckets have their answers, only the last step's shuffles still lie on disk."""
    from pathlib import Path

    def shuffles():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f.name.split("_")[1] for d in found for f in Path(d.getPath()).rglob("shuffle_*.data")}

    lying = []
    removed = suffix_tree.remove
    monkeypatch.setattr(suffix_tree, "remove", lambda spark, path: (lying.append(shuffles()), removed(spark, path)))
    texts = [(i, " ".join(f"the w{(i * j) % 50}" for j in range(60))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    before = shuffles()
    assert suffix_tree.score_documents(df).count() == 60
    assert 1 <= len(lying[0] - before) <= 3


def test_suffix_tree_contexts_come_back_from_their_steps():
    r = np.random.default_rng(2)
    number = np.sort(r.choice(10_000, 60, replace=False)) + 1
    for lengths in ((9, 200, 300), (0, 7, 3), (0, 0, 5), (4, 0, 0), (2, 0, 3)):
        words = [np.unique(r.integers(0, 60, (n, k + 1)), axis=0) for k, n in enumerate(lengths)]
        rows = np.concatenate([np.pad(w, ((0, 0), (0, 2 - k)), constant_values=-1) for k, w in enumerate(words)])
        *steps, n = suffix_tree.context_steps(*rows.T, number)
        assert all((x >= 0).all() for x in steps)
        got = np.stack(suffix_tree.contexts_in(*steps, n), 1)
        assert (got == np.where(rows >= 0, number[rows], 0)).all()


def test_suffix_tree_beats_its_root_on_held_out_texts(spark):
    out = suffix_tree.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    n = sum(r.n_tokens for r in out)
    assert sum(r.base_score for r in out) / n < -4.1
    assert sum(r.score for r in out) / n > -3.65


def test_states_stay_when_the_corpus_grows(spark):
    """A phrase seen three times scores alike in a small corpus and among many texts that do not hold it."""
    r = np.random.default_rng(5)
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 1][0]
    trained = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 != 1]
    phrase = [(i, f"zeta eta theta iota w{i}") for i in trained[:3]] + [(held, "zeta eta theta iota")]

    def gain(others):
        texts = phrase + [(10_000 + i, " ".join(f"v{x}" for x in r.integers(0, 3000, 50))) for i in range(others)]
        row = suffix_tree.score_documents(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).where(f"doc_id = {held}").first()
        return row.score, row.base_score

    (small, small_base), (large, large_base) = gain(10), gain(3000)
    assert large_base < small_base - 5  # each word is rarer now
    assert abs(large - small) < 0.35 * abs(large_base - small_base)  # what follows the phrase's words is as likely as before


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (fingerprints.fingerprint_documents(none), lines.dedup_lines(none), packing.pack(none), pieces.report(none), secrets.report(none), quality.report(none, labels), suffix_tree.score_documents(none)):
        assert out.collect() == []
    assert token_files.read_digests(spark, token_files.write_tokens(none, shared_dir(spark))).collect() == []


def test_ranges(spark):
    df = spark.range(0, 1000).selectExpr("if(id % 50 = 0, null, id * 10000000000000) as k")
    bounds = range_bounds(df, "k", 7)
    got = df.select("k", range_of(df["k"], bounds).alias("r")).collect()
    assert all(r.r == (0 if r.k is None else int(np.searchsorted(bounds, r.k, side="right"))) for r in got)
