"""Token counts by byte-pair merging over a linked list with a heap.

Each pre-token starts as its bytes. A heap holds the adjacent pairs that can merge, by rank and position; the
lowest is popped and applied again and again, and the count is the number of bytes less the number of merges.
No identifiers leave this module. Counts are kept by unit of text, see byte_level.Units.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows each get their own row. Other columns are ignored,
whatever their names. An empty table gives an empty result. Texts of any length are taken whole.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_level import Kept, Units, loaded
from tidemark.llm.common import map_rows, table

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merged_count(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """The number of symbols that are left when no adjacent pair can merge any more.

    The heap orders by rank and then position, which is the order in which the merges of one rank apply. An entry
    is stale if the symbol to its left or right has been merged since; it is dropped when it is popped.
    """
    n = count = len(symbols)
    at, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(m[0], i, m[1], at[i], at[i + 1]) for i in range(n - 1) if (m := merges.get((at[i], at[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, new, left, right = heapq.heappop(heap)
        j = after[i]
        if at[i] != left or j >= n or at[j] != right:
            continue
        at[i], at[j] = new, -1
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if m := merges.get((new, at[k])):
                heapq.heappush(heap, (m[0], i, m[1], new, at[k]))
        h = before[i]
        if h >= 0 and (m := merges.get((at[h], new))):
            heapq.heappush(heap, (m[0], h, m[1], at[h], new))
    return count


class Counter:
    """Token counts of whole texts for one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.vocabulary = loaded(path)
        ids, merges = self.vocabulary.byte_ids, self.vocabulary.merges
        pretoken = Kept(lambda p: merged_count([ids[b] for b in p.encode()], merges), 250_000)
        self._units = Units(lambda found: sum(map(pretoken.__getitem__, found)))

    def count(self, text: str) -> int:
        return sum(1 if special is not None else sum(self._units.values(part)) for part, special in self.vocabulary.segments(text))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def make():
        counter = Counter(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n = [counter.count(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return one

    return map_rows(rows, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path(VOCABULARY))
