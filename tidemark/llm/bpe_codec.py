"""Exact byte-pair encoding and decoding by dynamic programming over prefixes.

An automaton over the vocabulary gives, for each position of a pre-token, the tokens that end there. The encoding of
a prefix ends in exactly one token, so the first candidate whose pair with the last token of the prefix before it is
compatible is that token, and it is stored for the prefix. Following the stored tokens back from the end gives the ids.

Two tokens are compatible if merging their joined bytes gives the two tokens again. That is read off the merges at
their common border: the left token's right edge and the right token's left edge each pass through a chain of symbols,
and a merge of a symbol of one chain with a symbol of the other must not come due while both are there.

Null texts count as empty: no ids, an empty decoded text. Repeated rows each get their own row. Other columns are
ignored, whatever their names. An empty table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_level import Kept, Units, loaded
from tidemark.llm.common import map_rows, table, uncollected
from tidemark.llm.token_count import vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
NEVER = 1 << 60


@lru_cache(2)
def _tables(path: str) -> tuple:
    """Once a process: the automaton of the tokens, the two parts of each merged token with their rank, the bytes of decimal ids, and tokens' lengths."""
    v = loaded(path)
    automaton = ahocorasick.Automaton()
    for i, raw in v.token_bytes.items():
        if i not in v.specials.values():
            automaton.add_word(raw.decode("latin-1"), (len(raw), i))
    automaton.make_automaton()
    parts = {new: (a, b, rank) for (a, b), (rank, new) in reversed(v.merges.items())}
    return automaton, parts, {str(i): raw for i, raw in v.token_bytes.items()}, {i: len(raw) for i, raw in v.token_bytes.items()}


class Codec:
    """ids of a text and the text of ids, for one byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        v = self.vocabulary = loaded(path)
        self._merges = v.merges
        self._automaton, self._parts, self._bytes, self._sizes = _tables(path)
        self._left, self._right, self._span = {}, {}, max(v.token_bytes) + 1
        self._compatible = Kept(lambda pair: self._check(*divmod(pair, self._span)), 250_000)
        pretoken = Kept(lambda p: ",".join(map(str, self.pretoken_ids(p.encode()))), 250_000)
        self._units = Units(lambda found: ",".join(map(pretoken.__getitem__, found)))

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The symbols at one border of a token as it builds up, from the first byte on, each with the rank of the merge that consumes it."""
        kept = self._right if right else self._left
        if token not in kept:
            chain, due = [], NEVER
            while True:
                chain.append((token, due))
                if token not in self._parts:
                    break
                a, b, due = self._parts[token]
                token = b if right else a
            kept[chain[0][0]] = chain[::-1]
            return kept[chain[0][0]]
        return kept[token]

    def _check(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart. A merge over the border loses a tie against one to its left and wins one against one to its right."""
        a, b, i, j = self._edge(left, True), self._edge(right, False), 0, 0
        while True:
            (x, x_due), (y, y_due) = a[i], b[j]
            found = self._merges.get((x, y))
            if found is not None and found[0] < x_due and found[0] <= y_due:
                return False
            if x_due == NEVER and y_due == NEVER:
                return True
            if x_due <= y_due:
                i += 1
            else:
                j += 1

    def pretoken_ids(self, raw: bytes) -> list[int]:
        last, found, compatible, span = [], 0, self._compatible, self._span  # last: the last token of each prefix, times span
        for end, (length, token) in self._automaton.iter(raw.decode("latin-1")):
            if end == found and (end < length or compatible[last[end - length] + token]):
                last.append(token * span)
                found += 1
        ids, n, sizes = [], len(last), self._sizes
        while n:
            token = last[n - 1] // span
            ids.append(token)
            n -= sizes[token]
        return ids[::-1]

    def encode(self, text: str) -> str:
        """The ids as decimal numbers joined by commas."""
        found = [x for part, special in self.vocabulary.segments(text) for x in ([str(special)] if special is not None else self._units.values(part))]
        return ",".join(found)

    def decode(self, ids: str) -> str:
        """The text of comma-joined ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self._bytes.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs: its id, n_tokens, sha256 of the ids and of the text decoded from them; with_ids adds the ids themselves."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def make():
        codec = Codec(path)

        @uncollected()
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([[int(i) for i in x.split(",")] if x else [] for x in ids], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        return one

    return map_rows(rows, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
