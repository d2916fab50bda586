"""Token ids as ORC files.

Documents are dealt into ranges of doc_id and sorted, so that files and the rows in them ascend. ORC stores ids and row numbers
with integer run-length encoding, in stripes that tasks read in parallel; row indexes and Bloom filters on doc_id let a look-up
of single documents skip stripes and row groups. Every row keeps its file's number and its place in it, from which offsets follow
after the files are read back: running sums within a file, plus the sums of the files before it.

The ids are those of the tokenizers library. White space always ends a word of this tokenizer, and its normalizer doesn't reach over
white space, so the library encodes each distinct run of other characters once and the ids of a run are kept; see RunEncoder.

Null texts count as empty and hold only the end id. Rows that repeat a doc_id are ordered by text; a null doc_id sorts first. Other
columns are ignored, whatever their names. An empty table gives no file and an empty result. Texts of any length are written whole.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, map_rows, staged, table
from tidemark.llm.token_count import vocabulary_path

VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: ORC writer settings; the bloom filter's false positive rate and rows of a row index.
ORC = {"compression": "lz4", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "2000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}


#: Letters beside a-z that lower-casing and composition map to one such letter; words of these are one piece to the tokenizer, and so is the ASCII punctuation after them.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Texts in a batch; the more, the fewer look-ups, as words repeat.
RUN_ROWS = 8192
#: Distinct words that the library gets as one text, and bytes of the longest run whose ids are kept.
JOINED, KEY_BYTES = 512, 64


@lru_cache(2)
def _loaded(path: str) -> tuple:
    """Once a process: the tokenizer, the same model without the normaliser and splitter, which leave plain words as they are, and whether each id ends a word."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    words = Tokenizer(tokenizer.model)
    words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return tokenizer, words, ends


class RunEncoder:
    """Little-endian 32-bit ids of texts; the library encodes words that haven't been seen.

    Upper case A-Z is folded first, as the tokenizer folds it, but not in texts that may hold a special string. New words of Latin letters, less punctuation at
    their end, go to the library in one text; as they are one piece each, their ids end where a token with the end-of-word mark does. Punctuation and other
    runs are encoded one by one.
    """

    def __init__(self, path: str, bound: int = 400_000) -> None:
        self._tokenizer, self._words, self._ends = _loaded(path)
        self._kept, self._old, self._bound = {}, {}, bound

    def _learn(self, new: list[bytes]) -> None:
        kept = self._kept
        stems = [r.rstrip(PUNCTUATION) for r in new]
        plain = [w.isalpha() or LATIN.fullmatch(w) is not None for w in stems]
        words = list(set(compress(stems, plain)).difference(kept))
        for a in range(0, len(words), JOINED):
            part = words[a : a + JOINED]
            ids = np.array(self._words.encode_batch_fast([b" ".join(part).decode().lower()], add_special_tokens=False)[0].ids, "<u4")
            raw, at = ids.tobytes(), [0, *((np.flatnonzero(self._ends[ids]) + 1) * 4).tolist()]
            kept.update(zip(part, (raw[x:y] for x, y in zip(at, at[1:], strict=False)), strict=True))
        other = list({r[len(w) :] if ok else r for r, w, ok in zip(new, stems, plain, strict=True) if len(r) > len(w) or not ok}.difference(kept))
        for r, e in zip(other, self._tokenizer.encode_batch_fast([r.decode() for r in other], add_special_tokens=False), strict=True):
            kept[r] = np.array(e.ids, "<u4").tobytes()
        kept.update((r, kept[w] + kept[r[len(w) :]]) for r, w, ok in zip(new, stems, plain, strict=True) if ok and len(r) > len(w))

    def _ids(self, runs: list[bytes]) -> list[bytes]:
        if len(self._kept) > self._bound:  # the young generation becomes the old one, from which what is still in use comes back
            self._old, self._kept = self._kept, {}
        new = [r for r in runs if r not in self._kept]
        self._kept.update((r, self._old[r]) for r in new if r in self._old)
        self._learn([r for r in new if r not in self._old])
        own = list(map(self._kept.__getitem__, runs))
        for r in new:  # long runs aren't held, so that the store is bounded in bytes
            if len(r) > KEY_BYTES:
                self._kept.pop(r, None)
                self._kept.pop(r.rstrip(PUNCTUATION), None)
                self._kept.pop(r[len(r.rstrip(PUNCTUATION)) :], None)
        return own

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, and where each text's ids start; runs are numbered by Arrow and looked up once a batch."""
        special = pc.match_substring(texts, "<|")
        texts = pc.if_else(special, texts, pc.ascii_lower(texts)) if pc.any(special).as_py() else pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(texts)
        del texts
        where = split.offsets.to_numpy() - split.offsets[0].as_py()
        runs = split.flatten().cast(pa.binary()).dictionary_encode()
        del split
        own = self._ids(runs.dictionary.to_pylist())
        size = np.fromiter(map(len, own), np.int32, len(own)) // 4
        first, held = np.cumsum(size, dtype=np.int32) - size, np.frombuffer(b"".join(own), "<i4")
        number = runs.indices.to_numpy()
        n = size[number]
        del own, runs
        upto = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        at = np.repeat(first[number] - upto[:-1], n)
        at += np.arange(len(at), dtype=np.int32)
        cuts = upto[where]
        return np.insert(held[at], cuts[1:], end_id), cuts + np.arange(len(cuts), dtype=np.int32)


def token_rows(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (the end id last), place (file number and row) in ascending order of doc_id."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = RunEncoder(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, at = encoder.encode(batch.column("text"), end_id)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(ids))], names=["doc_id", "ids"])

        return one

    return map_rows(rows, make, "doc_id long, ids array<int>", RUN_ROWS).withColumn("place", F.monotonically_increasing_id())


def write_tokens(docs: DataFrame, path: str, **how) -> tuple[DataFrame, str]:
    """Write the token files into the shared folder and read them back; also gives their path."""
    return staged(token_rows(docs, path, **how), "tokens", "orc", **ORC)


def digest(tokens: DataFrame) -> DataFrame:
    """One row for each stored document: doc_id, start (ids of all before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers)."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "place", "n_tokens", "ids_crc32"])

        return one

    rows = checkpointed(map_rows(tokens.select("doc_id", "place", "ids"), make, "doc_id long, place long, n_tokens long, ids_crc32 long").withColumn("file", F.shiftright("place", 33)))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(files, "file").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, _ = write_tokens(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
    return digest(tokens)
