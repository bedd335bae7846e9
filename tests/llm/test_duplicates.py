"""Duplicate operators and the pipeline, against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import components, minhash, substrings
from millrace.llm.common import WordHasher


def test_bagminhash_is_unbiased():
    errors, r, hasher = [], np.random.default_rng(5), WordHasher()
    for k in range(80):
        words = [b"%d-%d" % (k, x) for x in r.integers(0, 60, 300)]
        other = list(words)
        for i in r.integers(0, 300, int(r.integers(1, 150))):
            other[i] = b"%d+%d" % (k, r.integers(0, 9))
        a, b = (minhash.shingles(b" ".join(x), hasher, 1) for x in (words, other))
        s = minhash.signatures([a, b], 256)
        errors.append((s[0] == s[1]).mean() - minhash.weighted_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.05


def brute_classes(rows, similarity=0.8):
    hasher = WordHasher()
    bags = [minhash.shingles(t.encode(), hasher) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or minhash.weighted_jaccard(bags[i], bags[j]) >= similarity:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return Counter((rows[i][0], min((rows[j][0] for j in g if rows[j][0] is not None), default=None)) for g in groups.values() for i in g)


def test_near_classes(docs, plain):
    got = Counter((r.doc_id, r.class_id) for r in minhash.near_classes(docs).collect())
    assert got == brute_classes(plain)
    assert got[(42, 40)] == 1 and got[(43, 40)] == 2


def test_a_large_group_of_near_copies(spark):
    r = np.random.default_rng(2)
    base = [f"w{x}" for x in r.integers(0, 10_000, 300)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in r.choice(300, int(r.integers(0, 16)), replace=False):
            words[k] = f"e{i}-{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.class_id) for r in minhash.near_classes(docs).collect()) == brute_classes(rows)


def falling(texts, words, most, seed):
    """Near copies of one text: words of it replaced, left out, swapped or doubled, from none to ``most`` times."""
    r = np.random.default_rng(seed)
    base = [f"w{x}" for x in r.integers(0, 10_000, words)]
    rows = []
    for i in range(texts):
        new = list(base)
        for _ in range(int(r.integers(0, most + 1))):
            k, kind = int(r.integers(0, len(new) - 1)), int(r.integers(0, 4))
            new[k : k + 2] = [[f"e{r.integers(0, 3)}", new[k + 1]], [new[k + 1]], [new[k + 1], new[k]], [new[k], new[k], new[k + 1]]][kind]
        rows.append((i, " ".join(new)))
    return rows


@pytest.mark.parametrize(("similarity", "most", "crowd"), [(0.8, 9, minhash.CROWD), (0.8, 9, 2000), (0.5, 26, minhash.CROWD)])
def test_a_bucket_of_falling_similarity(spark, similarity, most, crowd):
    """Hundreds of texts share buckets, half of them without a link to the hub; small crowds are split again."""
    rows = falling(550, 120, most, 4)
    want = brute_classes(rows, similarity)
    assert 5 < len({c for _, c in want}) < 500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.class_id) for r in minhash.near_classes(docs, similarity, crowd=crowd).collect()) == want


def test_no_link_is_lost_beside_the_hub():
    """The first elements and the bound on their places, against all pairs, from any hub."""
    hasher = WordHasher()
    bags = [minhash.shingles(t.encode(), hasher) for _, t in falling(160, 80, 8, 7)]
    for similarity in (0.5, 0.8, 0.9):
        for h in (0, 11, 77):
            hub = bags[h]
            seen = []
            for b in bags:
                d = minhash.difference(b, hub)
                n_by, n_for = minhash.prefixes(int(b[1].sum()), int(hub[1].sum()), len(d), similarity)
                apart = minhash.weighted_jaccard(b, hub) < similarity
                seen.append((apart, set(d[:n_by].tolist()) if apart else set(), set(d[:n_for].tolist())))
            for i, (apart, by, _) in enumerate(seen):
                for j, (_, _, for_) in enumerate(seen):
                    if apart and i != j and minhash.weighted_jaccard(bags[i], bags[j]) >= similarity:
                        assert by & for_ or not len(minhash.difference(bags[i], bags[j]))


def test_apart_texts_meet_by_rare_elements(spark):
    """A star of near copies of which many are not linked to the hub: few pairs beside the links are compared, and no link is lost."""
    rows = falling(500, 120, 16, 9)
    hasher = WordHasher()
    docs = minhash.with_key(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    keyed = {bytes(r.key): minhash.shingles(r.text.encode(), hasher) for r in docs.collect()}
    hub = minhash.shingles(rows[0][1].encode(), hasher)
    hub_key = next(k for k, b in keyed.items() if np.array_equal(b[0], hub[0]) and np.array_equal(b[1], hub[1]))
    others = sorted(set(keyed) - {hub_key})
    pairs = spark.createDataFrame([(hub_key, k, 1) for k in others], "hub binary, key binary, star long")
    close, more = minhash.late(minhash.cut(minhash.compared(docs, pairs, 0.8)), 0.8)
    got = {(bytes(r.hub), bytes(r.key)) for r in close.collect()}
    apart = {k for k in others if minhash.weighted_jaccard(keyed[k], hub) < 0.8}
    want = {(x, y) for i, x in enumerate(others) for y in others[i + 1 :] if (x in apart or y in apart) and minhash.weighted_jaccard(keyed[x], keyed[y]) >= 0.8}
    assert len(apart) > 100 and want and want <= got and more.isEmpty()
    assert len(got) < 4 * len(want)


def test_banding_follows_the_similarity():
    assert minhash.banding(0.8) == (32, 4) and minhash.banding(0.5) == (64, 2) and minhash.banding(0.2) == (128, 1)
    assert all((1 - s**r) ** b < 1e-6 for s in (0.3, 0.5, 0.7, 0.8, 0.9, 0.99) for b, r in [minhash.banding(s)])


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {201: 200}


def brute_repeats(rows, window):
    seen, out = set(), Counter()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        words = text.encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[(doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeated_spans(docs, plain):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(docs).collect())
    assert got == brute_repeats(plain, 20)
    assert any(n for _, _, n, _ in got)


def test_repeated_spans_over_small_blocks(docs, plain):
    out = substrings.repeated_spans(docs, block_bytes=2000).collect()
    got = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in out)
    assert got == brute_repeats(plain, 20)


def test_empty_tables(none):
    assert minhash.near_classes(none).collect() == [] and substrings.report(none).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    steps = dict(p.STAGES)
    good = steps["quality_rules"](spark, docs, sf).cache()
    assert good.columns == names and 0 < good.count() < docs.count()
    lined = steps["line_dedup"](spark, good, sf).cache()
    assert lined.columns == names and lined.count() == good.count()
    one = steps["near_dedup"](spark, lined, sf).cache()
    rows = [(r.doc_id, r.text) for r in lined.collect()]
    classes = {c for _, c in brute_classes(rows)}
    assert one.columns == names and {r.doc_id for r in one.collect()} == classes
    safe = steps["secret_scan"](spark, one, sf).cache()
    assert safe.columns == names and safe.count() == one.count()
    assert all(r.n_chars == len(r.text) for r in safe.collect())
    from millrace.llm import secrets

    assert all(r.n_assign + r.n_access + r.n_hex == 0 for r in secrets.report(safe).collect())
    assert steps["pack_sequences"](spark, safe, sf).select("doc_id").distinct().count() == safe.count()


ODD = "doc_id long, text string, n_chars long, row string, key int, kept string, keep int, spans int, none int, new int, c0 int"


def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names clash with those inside the stages."""
    base = " ".join(f"word{i}" for i in range(80))
    boiler = "A common line of boilerplate"
    rows = [(i, f"{boiler}\n" + " ".join(f"u{i}x{k}" for k in range(60)), None, "r", i, "k", 1, 2, 3, 4, 5) for i in range(12)]
    rows += [(20, base, 5, "r", 1, None, None, None, None, None, None), (20, base, 5, "r", 0, None, None, None, None, None, None), (20, base, 5, "r", 0, None, None, None, None, None, None)]
    rows += [(21, base + " more", 9, None, 1, "k", 1, 1, 1, 1, 1), (None, base + " still", 9, None, 1, "k", 1, 1, 1, 1, 1)]
    rows += [(22, None, None, None, None, None, None, None, None, None, None), (23, "", 0, "r", 1, "k", 1, 1, 1, 1, 1), (24, "w " * 40_000, 80_000, "r", 1, "k", 1, 1, 1, 1, 1)]
    secret = "token = abcdefghijklmnop1234 " + " ".join(f"s{i}" for i in range(70))
    return [*rows, (25, secret, len(secret), "r", 1, "k", 1, 1, 1, 1, 1)]


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p

    rows = odd_rows()
    docs, steps = spark.createDataFrame(rows, ODD).repartition(3), dict(p.STAGES)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    for step in ("quality_rules", "line_dedup", "near_dedup", "secret_scan"):
        none = steps[step](spark, docs.where("false"), sf)
        assert none.columns == docs.columns and none.collect() == []
    assert steps["pack_sequences"](spark, docs.where("false"), sf).collect() == []

    good = as_rows(steps["quality_rules"](spark, docs, sf))
    assert good <= Counter(rows) and {r[0] for r in good} == {r[0] for r in rows} - {22, 23, 24}

    lined = as_rows(steps["line_dedup"](spark, docs, sf))
    want = Counter((r[0], r[1].split("\n")[1], len(r[1].split("\n")[1]), *r[3:]) if r[0] in range(1, 12) else r for r in rows)
    assert lined == want

    one = as_rows(steps["near_dedup"](spark, docs, sf))
    kept = [r for r in rows if r[0] not in (20, 21, None, 22, 23)] + [next(r for r in rows if r[0] == 20 and r[4] == 0), next(r for r in rows if r[0] == 22)]
    assert one == Counter(kept)

    safe = steps["secret_scan"](spark, docs, sf)
    assert as_rows(safe) == Counter((*r[:1], *((new, len(new)) if (new := (r[1] or "").replace("token = abcdefghijklmnop1234", "[assign]")) != (r[1] or "") else r[1:3]), *r[3:]) for r in rows)

    packed = steps["pack_sequences"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r[0] for r in rows)
