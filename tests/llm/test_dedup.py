"""Near-duplicates against all pairs, components against a search, SimHash against its definition."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import minhash_dedup as dedup
from tidemark.llm import simhash
from tidemark.operators.components import components
from tidemark.llm.shingles import Words


def corpus(seed, groups=25, hot=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(hot if hot and not g else rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own).replace("w1 ", "W1\t"))
    rng.shuffle(texts)
    return texts


def shingled(text, k):
    """The distinct word shingles of a text as tuples of words."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k, percent):
    sets = [(i, shingled(t, k)) for i, t in rows]
    low = {i: i for i, _ in rows}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                low[y] = x
    return sorted((i, len(a), root(i), root(i) == i) for i, a in sets)


def test_equals_all_pairs(spark):
    for seed, k, percent in ((1, 3, 85), (2, 5, 80)):
        rows = [(n * 7 % 1009, t) for n, t in enumerate(corpus(seed))] + [(2000, None), (2001, ""), (2002, " \n "), (2003, "one"), (2004, "ONE")]
        got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
        assert sorted(tuple(r) for r in got.collect()) == brute(rows, k, percent)


def test_large_cluster_goes_through_heads_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 16)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    # a group of near copies, and a chain of texts that share about half of the same words, some of them linked
    texts = corpus(3, 6, hot=110)
    for n in range(60):
        own = base[n : n + 110] + [rng.choice(words) for _ in range(40)]
        texts += [" ".join(own), " ".join([*own[:70], "other", *own[71:]])][: 1 + n % 2]
    rows = list(enumerate(texts))
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 85)


def test_rows_that_share_a_doc_id(spark):
    """They are documents of their own unless they are linked, and one row of each component stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "y"), (2, c, "z"), (2, c.upper(), "z"), (3, b + " more", "u"), (4, a + " more", "v"), (None, c, "w"), (None, "no number at all here", "q"), (None, "no number at all here", "q"), (7, "", "e"), (7, "", "e")]
    df = spark.createDataFrame([(i, t, x, 0, 0) for i, t, x in rows], "doc_id long, text string, _gone string, _again int, doc int")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 2, True), (2, 2, True), (3, 1, False), (4, 1, False), (None, 2, False), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True)], key=str)
    kept = dedup.without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, a), (1, b), (2, c.upper()), (None, "no number at all here"), (7, ""), (7, "")], key=str)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:480], rng.integers(0, 2**63, 120).astype(np.uint64)])
    same = (dedup.signature(a, 320) == dedup.signature(b, 320)).mean()
    assert abs(same - 480 / 720) < 0.09


def test_nasty_rows(nasty, nothing):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in dedup.near_duplicates(nasty).collect()}
    assert got[1, 0] == (1, True) and got[2, 0] == (2, True)
    assert got[5, 10] == (3, False) and got[3, 10] == (3, True) and got[7, 1] == (7, True)
    assert [v for (i, _), v in got.items() if i is None] == [(None, True)]
    assert dedup.near_duplicates(nothing).count() == 0
    kept = dedup.without_near_duplicates(nasty)
    assert kept.columns == nasty.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 7, 8, 9, 10, None], key=str)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)]
    low = {}

    def root(x):
        while low.get(x, x) != x:
            x = low[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        low[y] = x
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, root(x)) for x in nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_edits(spark, nasty, nothing):
    rows = sorted(nasty.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    hasher, want = simhash.Fingerprints(), []
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, n = r.text or "", after.text or ""
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = hasher.of(t), hasher.of(new), hasher.of(n)
        want.append((r.doc_id, len(t), hashlib.sha256(new.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    got = [tuple(r) for r in simhash.fingerprints_of_edits(nasty).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.fingerprints_of_edits(nothing).count() == 0
    one = simhash.fingerprints_of_edits(nasty.filter("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_simhash_votes():
    """The vote by byte sums equals the vote by bits."""
    from tidemark.llm.shingles import mixed, shingles

    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(200))
    w = Words().hashes(text)
    terms, counts = np.unique(np.concatenate([mixed(w), shingles(w, 2)]), return_counts=True)
    votes = [sum((1 if int(t) >> b & 1 else -1) * (1 + np.log(c)) for t, c in zip(terms, counts, strict=True)) for b in range(64)]
    assert simhash.Fingerprints().of(text) == sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(150)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints for _ in range(3)]
    df = spark.createDataFrame([(i, f"{p:016x}") for i, p in enumerate(prints)] + [(9999, None)], "doc_id long, fingerprint string")
    for radius in (0, 3):
        pairs, members = simhash.near_pairs(df, radius)
        distinct = sorted({f"{p:016x}" for p in prints})
        want = sorted((a, b, d) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius)
        assert sorted(map(tuple, pairs.collect())) == want
        assert members.filter(F.col("class").isNull()).count() == 0 and members.count() == len(prints)


def test_near_counts_of_every_tenth(spark):
    rng = random.Random(3)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for p in prints for _ in range(4)] + [7] * 400
    rows = [(i if i != 33 else None, f"{p:016x}", "x") for i, p in enumerate(prints)]
    got = simhash.with_near_counts(spark.createDataFrame(rows, "doc_id long, fingerprint string, docs string"), 10).collect()
    want = [(i, f, "x", sum((int(f, 16) ^ q).bit_count() <= 3 for q in prints) - 1 if i is not None and i % 10 == 0 else None) for i, f, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert simhash.with_near_counts(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0


def test_words_of_long_texts_hash_as_those_of_short_ones(monkeypatch):
    from tidemark.llm import shingles

    text = " ".join(corpus(9)) + "\x0b\x0c\ttail " + "x" * 5000 + "\n"
    whole = Words().hashes(text)
    assert len(whole) == len(text.encode().split()) and len(set(whole.tolist())) == len(set(text.lower().encode().split()))
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert np.array_equal(whole, Words().hashes(text))
