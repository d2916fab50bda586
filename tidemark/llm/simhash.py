"""SimHash fingerprints and the search for near ones.

The terms of a text are its words and its pairs of neighbouring words. Each distinct term's 64-bit hash votes with weight
1 + ln(count): for a bit that is set, against one that isn't. The signs of the sums are the fingerprint.

searched finds all fingerprints within a Hamming radius with permuted block tables: the bits are cut into blocks, and of any two
fingerprints within the radius some choice of blocks must agree; there is a table for each choice, whose key holds these blocks, and
pairs that share a key in a table are verified. Equal fingerprints are one class first, so copies make no pairs. The query searches for the documents
whose doc_id is divisible by QUERY_EVERY among all, and near_pairs for every pair.

fingerprints_of_edits sorts documents by doc_id in ranges; each partition streams its rows and needs of the next partition only its first
text. The first and last texts of the partitions meet in a second step. Null texts are empty; an empty text has fingerprint 0. Rows that
repeat a doc_id are ordered by text, null doc_ids come first. A single document is its own next one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, sliced, table
from tidemark.llm.shingles import Words, mixed, shingles
from tidemark.operators.components import attached

BITS = 64
#: The search: the chosen Hamming radius, the blocks that fingerprints are cut into, the parts of a key's fingerprints, and every how many ids a document is a query.
RADIUS, BLOCKS, SALTS, QUERY_EVERY = 3, 5, 8, 100
#: Terms that vote at once, so that a long text's vote table stays small.
VOTE_BLOCK = 1 << 15


class Fingerprints:
    """64-bit SimHash values of texts."""

    #: Votes of a byte's bits, and where the sums of each byte of a hash start.
    _SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64) * 2 - 1
    _OFFSETS = np.arange(BITS // 8) * 256

    def __init__(self) -> None:
        self._words = Words()

    def of(self, text: str) -> int:
        words = self._words.hashes(text)
        if not len(words):
            return 0
        terms, counts = np.unique(np.concatenate([mixed(words), shingles(words, 2)]), return_counts=True)
        weights, sums = 1 + np.log(counts), np.zeros(256 * BITS // 8)
        for a in range(0, len(terms), VOTE_BLOCK):
            # weights are summed by byte value first: 8 additions a term, and a bit's votes are sums over 256 values
            at = terms[a : a + VOTE_BLOCK].astype("<u8", copy=False).view(np.uint8).reshape(-1, BITS // 8) + self._OFFSETS
            sums += np.bincount(at.ravel(), np.repeat(weights[a : a + VOTE_BLOCK], BITS // 8), len(sums))
        votes = np.einsum("pv,vb->pb", sums.reshape(-1, 256), self._SIGNS).ravel()
        return int.from_bytes(np.packbits(votes > 0, bitorder="little").tobytes(), "little")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def edited(text: str, after: str) -> str:
    """text with its last floor(n/2) code points replaced by as many from the start of after, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _judged(hasher: Fingerprints, doc_id: int | None, text: str, own: int, after: str, after_own: int) -> tuple:
    new = edited(text, after)
    its = hasher.of(new)
    return doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), f"{own:016x}", f"{its:016x}", likeness(own, its), likeness(own, after_own)


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, see FIELDS; "next" is by ascending doc_id, after the last the first."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, part = Fingerprints(), None, 0

        def out(found: list[tuple], edge: str | None = None, text: str = "", order: int = 0) -> pa.RecordBatch:
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate(_TYPES)]
            more = [pa.array([v] * len(found), t) for v, t in ((edge, pa.string()), (text, pa.string()), (order, pa.int32()))]
            return pa.RecordBatch.from_arrays(columns + more, names=[*FIELDS, "edge", "text", "part"])

        for batch in sliced(batches):
            found = []
            for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
                own = hasher.of(text)
                if held is None:
                    yield out([(doc_id, *[None] * 6)], "first", text, part)
                else:
                    found.append(_judged(hasher, *held, text, own))
                held = (doc_id, text, own)
            yield out(found)
        if held is not None:
            yield out([(held[0], *[None] * 6)], "last", held[1], part)

    done = checkpointed(rows.mapInArrow(run, SCHEMA + ", edge string, text string, part int"))
    # two rows a partition: each last text meets the first text of the next partition that has rows, after the last one that of the first; only the partitions' numbers are put in order
    turn = Window.orderBy("part")
    turns = done.filter("edge = 'first'").select("part", F.coalesce(F.lead("part").over(turn), F.first("part").over(turn)).alias("next"))
    firsts = done.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    meet = done.filter("edge = 'last'").select("doc_id", "text", "part").join(turns, "part").join(firsts, "next")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Fingerprints()
        for batch in batches:
            found = [_judged(hasher, d, t, hasher.of(t), a, hasher.of(a)) for d, t, a in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(_TYPES)], names=list(FIELDS))

    return done.filter("edge is null").select(*FIELDS).unionByName(checkpointed(meet.select("doc_id", "text", "after").mapInArrow(join, SCHEMA)))


def _tables(radius: int, blocks: int) -> list[int]:
    """The mask of each table's blocks, as a signed number: of any two fingerprints within radius, at least blocks - radius blocks agree."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (cuts[b + 1] - cuts[b])) - 1) << cuts[b] for b in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _bits(print_: Column) -> Column:
    return F.conv(print_, 16, -10).cast("long")


def searched(queries: DataFrame, classes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """queries (a) and classes (b, and others), both of distinct fingerprints (hexadecimal) -> a, distance and the columns of all classes within radius, a itself included.

    A pair is reported by the first table that it agrees in. The classes of a key are dealt over SALTS tasks, to each of which the queries go.
    """
    masks = _tables(radius, blocks)
    keys = lambda bits: F.posexplode(F.array(*(bits.bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("t", "v")
    left = queries.select("a", _bits(F.col("a")).alias("a_bits")).select("a", "a_bits", keys(F.col("a_bits"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    right = classes.withColumn("b_bits", _bits(F.col("b"))).select("*", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"), keys(F.col("b_bits")))
    apart = F.col("a_bits").bitwiseXOR(F.col("b_bits"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, i) for i, m in enumerate(masks)))
    pairs = right.join(left, ["t", "v", "salt"]).withColumn("distance", F.bit_count(apart))
    return pairs.filter((F.col("distance") <= radius) & (F.col("t") == first)).select("a", "distance", *classes.columns)


def near_pairs(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, id_col: str = "doc_id", print_col: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints (hexadecimal) within radius, as classes (a, b, distance), and the membership (id, class).

    A class is named by its fingerprint. blocks > radius; each of the tables is keyed by blocks - radius of them. A null fingerprint belongs to no class.
    """
    members = prints.filter(prints[print_col].isNotNull()).select(prints[id_col].alias("doc_id"), prints[print_col].alias("class"))
    classes = members.select("class").distinct()
    pairs = searched(classes.withColumnRenamed("class", "a"), classes.withColumnRenamed("class", "b"), radius, blocks or radius + 2)
    return pairs.filter("a < b").select("a", "b", "distance"), members


def with_near_counts(prints: DataFrame, every: int = QUERY_EVERY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """prints (doc_id, fingerprint, and others) with near_docs: the number of other rows whose fingerprint is within radius, for rows whose doc_id is divisible by every; else null."""
    asked = F.col("doc_id") % every == 0
    classes = prints.groupBy(F.col("fingerprint").alias("b")).agg(F.count("*").alias("docs"), F.count(F.when(asked, 1)).alias("queries"))
    classes = checkpointed(classes)
    found = searched(classes.filter("queries > 0").select(F.col("b").alias("a")), classes.select("b", "docs"), radius, blocks)
    found = found.groupBy(F.col("a").alias("fingerprint")).agg((F.sum("docs") - 1).alias("near_docs"))
    found = checkpointed(found.join(classes.filter("queries > 0").select(F.col("b").alias("fingerprint"), "queries"), "fingerprint"))
    total = classes.agg(F.coalesce(F.sum("queries"), F.lit(0))).first()[0]
    others = prints.filter(~F.coalesce(asked, F.lit(False))).withColumn("near_docs", F.lit(None).cast("long"))
    return attached(prints.filter(asked), found, ["fingerprint"], "queries", total).select(*prints.columns, "near_docs").unionByName(others)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near_counts(fingerprints_of_edits(table(spark, sf_dir, "documents")))
