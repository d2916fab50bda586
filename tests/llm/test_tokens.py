"""Counting, encoding and token files against the library."""

import gc
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, byte_level, token_count, token_orc
from tidemark.llm.common import staged
from tidemark.llm.token_count import vocabulary_path

PARTS = ["\x0b", "\x0c", " ", "  ", "\n", "\t", "a", "The", "'s", "'S", "é", "É", "漢", "1", "23", "½", "!", ",", "...", "\xa0", "\x1c", "\x85", "​", "́", "😀", "<|endoftext|>", "<|endof", "\r", "Σ", "ß", "İ", "_", "aaaaaa", "     "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + [chr(i) + "a " + chr(i) + "1\n" for i in range(0x21, 0x3000, 7)]


def test_codec_and_count_equal_the_library(texts):
    path = vocabulary_path("byte_bpe_50k.json")
    codec, counter, library = bpe_codec.Codec(path), token_count.Counter(path), Tokenizer.from_file(path)
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = codec.encode(text)
        assert ids == ",".join(map(str, e.ids))
        assert codec.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == text
        assert counter.count(text) == len(e.ids)


def test_compatible_pairs_are_those_that_merging_leaves_alone():
    codec = bpe_codec.Codec(vocabulary_path("byte_bpe_50k.json"))
    v, rng = codec.vocabulary, random.Random(1)
    ids = [i for i in v.token_bytes if i not in v.specials.values()]
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        symbols = [v.byte_ids[x] for x in v.token_bytes[a] + v.token_bytes[b]]
        while pairs := [(v.merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in v.merges]:
            _, i = min(pairs)
            symbols[i : i + 2] = [v.merges[symbols[i], symbols[i + 1]][1]]
        assert codec._check(a, b) == (symbols == [a, b])


def test_small_caches_change_nothing(texts):
    path = vocabulary_path("byte_bpe_50k.json")
    wide, tight = bpe_codec.Codec(path), bpe_codec.Codec(path)
    tight._units._spaced._bound = tight._compatible._bound = 3
    assert all(wide.encode(t) == tight.encode(t) for t in texts[:500])


def test_run_encoder_equals_the_library(texts):
    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for bound in (50, 10**6):
        encoder = token_orc.RunEncoder(path, bound)
        for a in range(0, len(texts), 300):
            part = texts[a : a + 300]
            ids, at = encoder.encode(pa.array(part), 2)
            for e, x, y in zip(library.encode_batch(part, add_special_tokens=False), at, at[1:], strict=False):
                assert ids[x:y].tolist() == [*e.ids, 2]


def test_queries_on_nasty_rows(nasty, nothing):
    path = vocabulary_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = nasty.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows), key=str)
    got = token_count.token_counts(nasty, path).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got) and any(r.over_limit for r in got)
    got = bpe_codec.encoded(nasty, path, with_ids=True).collect()
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert sorted((r.decoded_sha256 for r in got)) == sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in rows)
    assert token_count.token_counts(nothing, path).count() == bpe_codec.encoded(nothing, path).count() == 0


def test_token_files_hold_all_ids_in_order(spark, nasty, nothing):
    path = vocabulary_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    tokens, at = token_orc.write_tokens(nasty, path)
    rows = sorted(nasty.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in token_orc.digest(tokens).collect()), key=lambda r: r[1])
    assert got == want
    places = [r.place for r in spark.read.orc(at).sort("place").collect()]
    assert len(set(places)) == len(rows)
    assert token_orc.digest(token_orc.write_tokens(nothing, path)[0]).count() == 0


def scanned(df):
    """Rows that a file scan returned after the files' indexes were used."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_token_files_prune_by_id(spark):
    """A look-up reads one row group of a file, and none where the Bloom filter lacks the id, though it is within the file's range."""
    docs = spark.range(0, 60_000, 2).selectExpr("id AS doc_id", "'a b' AS text")
    tokens, at = token_orc.write_tokens(docs, vocabulary_path("word_bpe_49k.json"))
    assert tokens.count() == 30_000
    assert 1 <= scanned(tokens.filter("doc_id = 30008")) <= 2000 < scanned(tokens.filter("doc_id >= 0"))
    assert sum(scanned(tokens.filter(f"doc_id = {i}")) for i in range(20_001, 20_021, 2)) <= 2000
    bare, _ = staged(docs, "bare", "orc", **token_orc.ORC | {"orc.bloom.filter.columns": ""})
    assert scanned(bare.filter("doc_id = 20001")) > 0


def test_long_runs_are_not_kept(texts):
    path = vocabulary_path("byte_bpe_50k.json")
    long = ["漢字" * 300 + str(i) for i in range(50)] + ["x" * 200 + str(i) + "!" for i in range(50)]
    codec, counter, library = bpe_codec.Codec(path), token_count.Counter(path), Tokenizer.from_file(path)
    for text in [t + " " + t for t in long]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ",".join(map(str, ids)) and counter.count(text) == len(ids)
    assert all(len(k) <= byte_level.KEY_CHARS for k in codec._units._spaced)
    path = vocabulary_path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_orc.RunEncoder(path)
    ids, at = encoder.encode(pa.array(long), 2)
    assert [ids[x:y].tolist() for x, y in zip(at, at[1:], strict=False)] == [[*e.ids, 2] for e in library.encode_batch(long, add_special_tokens=False)]
    assert all(len(k) <= token_orc.KEY_BYTES for k in encoder._kept)


def test_the_collector_rests_while_texts_are_encoded(spark, monkeypatch):
    made, seen, encode = [], [], bpe_codec.Codec.encode
    monkeypatch.setattr(bpe_codec, "map_rows", lambda rows, make, schema: made.append(make))
    monkeypatch.setattr(bpe_codec.Codec, "encode", lambda self, text: seen.append(gc.isenabled()) or encode(self, text))
    bpe_codec.encoded(spark.createDataFrame([(1, "a")], "doc_id long, text string"), vocabulary_path(bpe_codec.VOCABULARY))
    assert made[0]()(pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", None]})).column("n_tokens").to_pylist() == [2, 0]
    assert seen == [False, False] and gc.isenabled()
