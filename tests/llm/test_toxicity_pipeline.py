"""The classifier on held-out rows, the pipeline stage by stage, and the registry."""

import hashlib
import importlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import mixing, registry, toxicity
from tidemark.llm.token_count import vocabulary_path

SF = "/root/testdata/sf0.001"


def labelled(n, seed):
    rng = random.Random(seed)
    syllables = ["ba", "le", "mi", "to", "ru", "sen", "kal", "po", "da", "ne"]
    bad = ["stupid", "stupidest", "stupidly", "morons", "moronic", "idiots", "idiotic"]
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 200))]
        toxic = rng.random() < 0.4
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", ",", "!!", "###"])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.train(*labelled(500, 1), steps=80)


def test_held_out_accuracy(model):
    texts, labels = labelled(300, 2)
    predicted = [s >= 0.5 for s in toxicity.Scorer(model).scores(texts)]
    assert np.mean([p == bool(y) for p, y in zip(predicted, labels, strict=True)]) > 0.97


def test_misspellings_share_subwords(model):
    scores = toxicity.Scorer(model).scores(["bale mito moronish ruse nene", "bale mito kalpo ruse nene"])
    assert scores[0] > scores[1]


def test_scores_depend_on_the_text_alone(model):
    texts, _ = labelled(40, 3)
    alone = [toxicity.Scorer(model).scores([t])[0] for t in texts]
    assert alone == toxicity.Scorer(model, bound=10).scores(texts)
    assert toxicity.Scorer(model).scores(["", "12 34 !!!"]) == [toxicity.EMPTY_SCORE] * 2


def test_scored_rows(model, nasty, nothing):
    got = toxicity.scored(nasty, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    kept = toxicity.without_toxic(nasty, model)
    assert kept.columns == nasty.columns and 10 not in {r.doc_id for r in kept.collect()}
    assert toxicity.scored(nothing, model).count() == 0


def test_training_rows_keep_out_the_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.training_rows(docs, labels, per_class=20).collect()
    assert 0 < len(rows) <= 40 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    none = toxicity.fit(docs, labels.limit(0))
    assert not none.trained and set(toxicity.Scorer(none).scores(["x"])) == {toxicity.EMPTY_SCORE}


def test_training_leaves_the_driver_alone(spark, monkeypatch):
    texts, y = labelled(60, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    rows = sorted(tuple(r) for r in toxicity.training_rows(docs, labels).collect())
    want, driver, train = toxicity.train([r[1] for r in rows], [r[2] for r in rows]), os.getpid(), toxicity.train

    def elsewhere(texts, labels):
        assert os.getpid() != driver
        return train(texts, labels)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    got = toxicity.fit(docs, labels)
    assert got.trained and got.bias == want.bias and (got.bucket == want.bucket).all() and (got.whole == want.whole).all()


M64 = (1 << 64) - 1


def plain_mixed(x):
    for factor in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15):
        x = (x ^ x >> 31) * factor & M64
    return x ^ x >> 31


def plain_buckets(word):
    """The buckets of a word's subwords, one by one."""
    points = [ord(c) for c in f"<{word}>"]
    found = [sum(plain_mixed(p + (i << 32)) for i, p in enumerate(points)) & M64]
    for n in toxicity.GRAMS:
        for i in range(len(points) - n + 1):
            h = points[i]
            for p in points[i + 1 : i + n]:
                h = plain_mixed(h) + p & M64
            found.append(plain_mixed(h + (n << 32) & M64))
    return [plain_mixed(x) % toxicity.BUCKETS for x in found]


def plain_score(text, model):
    """A document's score by its definition, word by word and window by window."""
    words = [plain_buckets(w) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
    if not words:
        return toxicity.EMPTY_SCORE
    local = [sum(float(model.bucket[b]) for b in w) / len(w) for w in words]
    whole = [sum(float(model.whole[b]) for b in w) / len(w) for w in words]
    width = min(toxicity.WINDOW, len(words))
    top = max(sum(local[i : i + width]) / width for i in range(len(words) - width + 1))
    return 1 / (1 + math.exp(-(top + sum(whole) / len(whole) + model.bias)))


def test_scores_by_their_definition(model, monkeypatch):
    texts, _ = labelled(30, 7)
    texts += ["x" * 700 + " stupid" + "y" * 300, "ab" * 50 + " é漢字 idiots", "", "1 2 3", "one two", "moron" * 40]
    want = [plain_score(t, model) for t in texts]
    assert np.allclose(toxicity.Scorer(model).scores(texts), want, atol=1e-6)
    monkeypatch.setattr(toxicity, "GRAM_CHARS", 64)
    scorer = toxicity.Scorer(model)
    assert np.allclose(scorer.scores(texts), want, atol=1e-6)
    assert all(len(r) <= toxicity.RUN_CHARS for r in scorer._kept)


def test_bounds_of_the_sample(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 3 else 400)) for i in range(60)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1), (500, 1)], "doc_id long, toxic int")
    for chars in (0, 900, 10**6):
        rows = toxicity.training_rows(docs, labels, chars=chars).collect()
        for label in (0, 1):
            size = [len(r.text) for r in rows if r.label == label]
            assert size and (sum(size) <= chars or len(size) == 1)
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(60))


def plain_mix(rows):
    """How often each (doc_id, source, size) is in the mix: whole epochs, and what is left in the order of the seeded hash."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    from tests.llm.test_media_pages_mix import plain_targets

    goal = plain_targets(sizes, mixing.WEIGHTS, 1.5 * sum(sizes.values()), 2)
    times = {}
    for s, size in sizes.items():
        epochs = 2 if goal[s] >= 2 * size else int(goal[s] // size) if size else 0
        left = round(goal[s] - epochs * size)
        for i, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()):
            times[i] = epochs + (left > 0 and n <= left or 0 < left < n <= 2 * left)
            left -= n
    return times


def test_pipeline_stages(spark):
    """Each stage against a plain version on its own input, and run() against the stages."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.collect() if plain_score(r.text, model) < 0.5)
    unique = stages["near_duplicates"](spark, clean, SF).cache()
    from tests.llm.test_dedup import brute

    want = [i for i, _, _, kept in brute([(r.doc_id, r.text) for r in clean.collect()], 5, 80) if kept]
    assert sorted(r.doc_id for r in unique.collect()) == want
    mix = stages["source_mixing"](spark, unique, SF).cache()
    assert clean.columns == unique.columns == mix.columns == docs.columns
    times = plain_mix([(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in unique.collect()])
    assert Counter(r.doc_id for r in mix.collect()) == Counter({i: n for i, n in times.items() if n})
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    want = []
    for r in mix.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    encoded = stages["bpe_encoding"](spark, mix, SF)
    assert sorted(map(tuple, encoded.collect())) == sorted(want) == sorted(map(tuple, pipeline.run(spark, SF).collect()))
    clean.unpersist(), unique.unpersist(), mix.unpersist()


def test_pipeline_on_nasty_and_empty_tables(spark, nasty, nothing, tmp_path):
    """Nulls, repeated and long rows, clashing names, and tables without rows: nothing but copies and toxic documents goes."""
    pipeline = pytest.importorskip("corpus_pipeline")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for name, docs in (("nasty", nasty), ("empty", nothing)):
        docs.selectExpr("*", "1 AS component", "2 AS _gone", "3 AS place", "4 AS doc").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        none.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    rows = pipeline.run(spark, f"{tmp_path}/nasty").collect()
    assert {r.doc_id for r in rows} <= {1, 2, 3, 4, 7, 8, 9, 10, None} and len(rows) >= 8


def test_registry_names():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)
    for name in ("audio", "minhash"):
        assert any(name in n for n in names)
    importlib.import_module("tidemark.llm")
